"""Document quality by a regularised quadratic discriminant.

Each document becomes a vector of transformed text statistics. Per class, the
mean and a covariance shrunk first towards the pooled one and then towards a
multiple of the identity are fitted; a score is the logistic of the difference
of the classes' log densities, from Mahalanobis distances by cached Cholesky
factors, plus the log ratio of the priors.

The fit uses labelled rows up to ``SAMPLE`` (those with the smallest hash of
doc_id and label), a documented bound; scoring reads every whole text.

Defined cases: null and empty texts are scored as texts of no words; rows with a null
doc_id are scored; labels that are null, not 0 or 1, or of no document are
ignored; a document with several labels counts with each, rows that repeat a doc_id
count once with each; with fewer than two
documents of a class every score is the smoothed share of label 1; repeated rows
each come out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import bounded_sample, crc_mod, read_table, utf8

#: Labelled rows that the fit takes at most.
SAMPLE = 20_000
#: Shrinkage towards the pooled covariance, and towards a multiple of the identity.
POOLED, SPHERE = 0.5, 0.05
THRESHOLD = 0.3
#: Temperature of the log-density difference: the statistics are not independent draws.
SOFTEN = 0.5

_CLASS = np.full(256, 5, np.uint8)  # other symbols
_CLASS[[*b"abcdefghijklmnopqrstuvwxyz"]] = 0
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_CLASS[[*b"0123456789"]] = 2
_CLASS[[*b" \t\r\x0b\x0c"]] = 3
_CLASS[[*b".,;:'\"-()?"]] = 4
_CLASS[10] = 6
_CLASS[128:] = 0
_TABLE = _CLASS.tobytes()

#: Shares of short texts lean on the usual ones, as if so many bytes or words more had been read.
PRIOR, FEW = 100, 12
USUAL = (0.02, 0.001, 0.16, 0.02, 0.002, 0.004)

NAMES = ("log_bytes", "upper", "digits", "spaces", "points", "symbols", "lines", "word_length", "distinct_words", "top_word", "repeats", "distinct_lines", "packed", "capitals", "long_words", "line_words")


def statistics(text: bytes) -> list[float]:
    """The raw statistics of one UTF-8 text, named by ``NAMES``."""
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    kinds = text.translate(_TABLE)
    shares = [(kinds.count(i) + PRIOR * p) / (n + PRIOR) for i, p in enumerate(USUAL, 1)]
    words = text.split()
    k = len(words) or 1
    counts = Counter(words)
    rows = text.split(b"\n")
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        float(np.log1p(n)),
        *shares,
        (sum(map(len, words)) + 6 * FEW) / (k + FEW),
        len(counts) / k**0.8,
        (max(counts.values(), default=0) + 0.04 * FEW) / (k + FEW),
        repeats / (k + FEW),
        (len(set(rows)) + 2) / (len(rows) + 2),
        len(zlib.compress(text, 1)) / (n + 20),
        (sum(w[:1].isupper() for w in counts) + 0.1 * FEW) / (len(counts) + FEW),
        (sum(len(w) > 14 for w in counts) + 0.02 * FEW) / (len(counts) + FEW),
        float(np.log1p((k + 4 * FEW) / (len(rows) + 4))),
    ]


#: Shares are spread out near zero.
_SHARES = [i for i, n in enumerate(NAMES) if n not in ("log_bytes", "word_length", "line_words", "distinct_words")]


def features(batch: list[bytes]) -> np.ndarray:
    x = np.array([statistics(t) for t in batch], float).reshape(-1, len(NAMES))
    x[:, _SHARES] = np.log(x[:, _SHARES] + 0.003)
    return x


@dataclass(frozen=True)
class Discriminant:
    """Per class the mean and the inverse Cholesky factor of the covariance."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    constants: tuple[float, ...]
    flat: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        z = (x - self.centre) / self.scale
        log = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1 / (1 + np.exp(-np.clip(SOFTEN * (log[1] - log[0]), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = POOLED, sphere: float = SPHERE) -> Discriminant:
    """The discriminant of the rows of ``x`` with labels ``y`` (0 or 1)."""
    p = x.shape[1]
    n = [int((y == k).sum()) for k in (0, 1)]
    if min(n) < 2:
        return Discriminant(np.zeros(p), np.ones(p), (), (), (), (n[1] + 1) / (sum(n) + 2))
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - centre) / scale
    means = tuple(z[y == k].mean(0) for k in (0, 1))
    spread = [np.cov(z[y == k], rowvar=False, bias=True) for k in (0, 1)]
    both = sum(m * s for m, s in zip(n, spread)) / sum(n)
    factors, constants = [], []
    for k in (0, 1):
        s = (1 - pooled) * spread[k] + pooled * both
        s = (1 - sphere) * s + (sphere * np.trace(s) / p + 1e-6) * np.eye(p)
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(n[k] / sum(n)) - np.log(np.diag(lower)).sum()))
    return Discriminant(centre, scale, means, tuple(factors), tuple(constants))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(utf8(batch, "text"))
        yield pa.record_batch([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def labelled(docs: DataFrame, labels: DataFrame, name: str, held_out: tuple[int, int], sample: int) -> DataFrame:
    """(label, text, doc_id) of at most ``sample`` label rows, none of them held out. Where
    several rows have the doc_id, the one whose text comes first counts."""
    modulus, rest = held_out
    picked = bounded_sample(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_mod("doc_id", modulus) != rest))
        .distinct(),
        sample,
        "doc_id",
        "label",
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = rows.join(F.broadcast(picked), "doc_id")  # at most ``sample`` small rows
    return met.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text", "doc_id")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Discriminant:
    rows = labelled(docs, labels, "quality", (5, 0), sample).mapInArrow(_features, "label int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(NAMES))
    y = rows["label"].to_numpy()
    order = np.lexsort((*x.T, y))  # the same sums whatever order the rows came in
    return fit(x[order], y[order])


def _scores(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(model.score(features(utf8(batch, "text"))))], names=["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _keep(model: Discriminant, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(utf8(batch, "text"))) >= threshold))

    return run


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, columns as they were."""
    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(_keep(model, threshold), rows.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))
