"""Language identification by learnt weights of character n-grams.

A text is read without newlines and, for this, as runs of letters in lower case with one space between. All its byte n-grams of
``SIZES`` go to ``BUCKETS`` buckets by their bytes read as a number, modulo a prime. A language's weight of a bucket is the log of its share of the
language's n-grams in thousandths, a whole number, so sums do not depend on their order; a text's language is
the one of the largest sum, of equal sums the first by name. Fitting is a sum of counts by language and bucket over
all labelled rows; scoring looks a whole column of texts up at once.

Defined cases: null texts have no language (null), texts without a letter are ``und``; rows without a label or text teach
nothing; without any labelled row every text is ``und``. Weights go to tasks as one table of buckets by languages
(``most`` languages at most, else an error), whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (1, 2, 3, 4)
#: A prime; sizes are told apart by a step that is added.
BUCKETS, STEP = 262_139, 1_000_003
#: Bytes that are looked up at once.
HELD = 1 << 20


def letters(text: Column) -> Column:
    """``text`` without newlines as runs of letters, in lower case, one space before, between and after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.replace(text, F.lit("\n"), F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, where each row begins and the last ends) of some rows at a time."""
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= HELD):
            size += len(texts[end])
            end += 1
        data = np.frombuffer(b"".join(texts[at:end]), np.uint8).astype(np.int64)
        yield at, data, np.cumsum([0, *map(len, texts[at:end])])
        at = end


def buckets(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of all n-grams of the rows, of one size at a time."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    code = np.zeros(len(data), np.int64)
    for n in range(1, SIZES[-1] + 1):
        ends = len(data) - n + 1
        if ends <= 0:
            return
        code = code[:ends] * 256 + data[n - 1 :]
        inside = row[:ends] == row[n - 1 :]
        if n in SIZES:
            yield (code[inside] + n * STEP) % BUCKETS, row[:ends][inside]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for first, data, bounds in _parts(batch.column(1)):
            for bucket, row in buckets(data, bounds):
                for lang in set(langs[first : first + len(bounds) - 1]):
                    of = bucket[langs[first + row] == lang]
                    held[lang] = held.get(lang, 0) + np.bincount(of, minlength=BUCKETS)
    for lang, n in held.items():
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(some)), pa.array(some), pa.array(n[some])], names=["lang", "bucket", "n"])


def counts(rows: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) of all n-grams of the rows that have both."""
    known = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), letters(F.col(text)).alias("text"))
    return known.mapInArrow(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order and their weights, a row for each bucket."""

    def __init__(self, found: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in found})
        n = np.zeros((BUCKETS, max(1, len(self.langs))), np.int64)
        for lang, bucket, count in found:
            n[bucket, self.langs.index(lang)] = count
        total = n.sum(0)
        # Few different counts: the logarithm of each is taken once, as the same double everywhere.
        self.weights = np.zeros(n.shape, np.int32)
        for at in range(len(self.langs)):
            values, place = np.unique(n[:, at], return_inverse=True)
            self.weights[:, at] = np.array([math.floor(1000 * math.log((v + 1) / float(total[at] + BUCKETS))) for v in values.tolist()], np.int32)[place]

    def languages(self, column: pa.Array) -> list[str]:
        """The language of each text of ``letters``."""
        out = []
        for _, data, bounds in _parts(column):
            score = np.zeros((len(bounds) - 1, self.weights.shape[1]), np.int64)
            for bucket, row in buckets(data, bounds):
                begins = np.flatnonzero(np.diff(row, prepend=-1))
                if len(row):
                    score[row[begins]] += np.add.reduceat(self.weights[bucket].astype(np.int64), begins, axis=0)
            best = score.argmax(1)
            out += [self.langs[b] if self.langs and size > 2 else "und" for b, size in zip(best, np.diff(bounds))]
        return out


def fitted(rows: DataFrame, text: str = "text", lang: str = "lang", most: int = 64) -> Model:
    found = counts(rows, text, lang)
    n = rows.select(lang).where(F.col(lang).isNotNull()).distinct().limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} languages")
    return Model([tuple(r) for r in found.collect()])  # at most ``most`` times ``BUCKETS`` rows


def _told(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = batch.column(1).is_null().to_pylist()
            lang = [None if x else y for x, y in zip(none, model.languages(batch.column(1)))]
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string())], names=[batch.schema.names[0], "lang"])

    return run


def detected(rows: DataFrame, model: Model, key: str, text: str = "text") -> DataFrame:
    """(key, lang) of every row."""
    return rows.select(key, letters(F.col(text)).alias("text")).mapInArrow(_told(model), f"{key} {rows.schema[key].dataType.simpleString()}, lang string")
