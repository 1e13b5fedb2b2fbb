"""Toxicity by a support vector machine on a gapped string kernel of sentences.

A word's features are the subsequences of 3 and of 4 characters that it holds within
``SPAN`` characters, its two ends being characters too. Each counts ``DECAY`` to the power
of its gaps, over the root of the sum of all its occurrences' squares, and the more the
rarer it is in clean sentences (any such factors leave a kernel a kernel). A
sentence is the sum of its words, and the kernel of two sentences the product of
their features: a word with characters put in, left out or masked keeps most of them.

The machine learns from labelled sentences: a sentence has its document's label. Since few
sentences of a toxic document are toxic, it is fitted ``PASSES`` times with squared hinge
loss: first on a hashed choice of all, then with the sentences of each toxic document that
it finds worst, against clean ones of which those that it takes for toxic are never left out.
Landmark sentences of both kinds give Nyström features. Since a decision is a weighted sum of
kernels with landmarks, it is at the same time one weight for each subsequence; texts are
scored with that table, which gives the same numbers without a kernel
evaluation per landmark. A document's score is a logistic function of its worst
sentence's decision.

The fit uses labelled rows up to ``SAMPLE`` (the smallest hashes), and of these
up to ``TOXIC`` and ``CLEAN`` sentences (the smallest hashes), which bounds what comes to the driver; a
sentence of more than ``CHARACTERS`` teaches in several parts. Scoring reads every whole text.
Sentences end at marks of any script, line ends and after ``WINDOW`` words. Words are lower-cased and
stripped to letters, digits and the usual stand-ins for letters are read as those; three or
more single characters in a row are also read as one word. Letters beyond a-z count as themselves: a subsequence
that holds one is told from others by a hash.

Defined cases: null and empty texts are one sentence without words; rows with a null doc_id
are scored; labels that are null, not 0 or 1, or of no document are ignored; a
document with several labels counts with each, rows that repeat a doc_id count once with
each; with fewer than two labelled rows, or without a sentence, of either kind every score is the
smoothed share of label 1, at most 1/2; repeated rows each come out; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import bounded_sample, crc_mod, read_table, stored, texts
from tarn.llm.quality import labelled

#: Labelled rows, sentences of toxic and of clean ones among them, characters of such a sentence before it is cut.
SAMPLE, TOXIC, CLEAN, CHARACTERS = 8_000, 60_000, 40_000, 400
THRESHOLD = 0.7
DECAY, SPAN, WINDOW = 0.6, 5, 12
#: Fits, sentences of the first fit, hashed and hardest clean ones of each, landmarks of either kind, distorted copies.
PASSES, FIRST, OTHERS, HARD, LANDMARKS, COPIES = 4, 8_000, 6_000, 3_000, 160, 3
#: Positions of a word that are worked on together, and words whose decisions a worker keeps.
CELLS, HELD = 1 << 16, 300_000

_STAND_INS = str.maketrans("013457@$!", "oieastasi")
_NO_LETTER = re.compile(r"[\W\d_]+")
_SINGLES = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")
_END = re.compile(r"[.!?]+(?:\s|$)|[。！？｡؟।]+|\n")


def plain(word: str) -> str:
    """``word`` (in lower case) with stand-ins read as letters and all else removed."""
    if word.isalpha():
        return word
    core = word.strip(".,;:!?\"'()[]{}#$%&*|-")
    return core if core.isalpha() else _NO_LETTER.sub("", core.translate(_STAND_INS))


def sentences(text: str) -> list[list[str]]:
    """The different words of each sentence, in lower case, as they stand."""
    out = []
    for part in _END.split(text.lower()):
        words = part.split()
        if sum([len(w) == 1 for w in words]) > 2:
            words += ["".join(m.group().split()) for m in _SINGLES.finditer(part)]
        out += [list(dict.fromkeys(words[i : i + WINDOW])) for i in range(0, len(words), WINDOW)]
    return out


def portions(words: list[str]) -> list[list[str]]:
    """A sentence's words in parts of at most ``CHARACTERS``; a longer word is cut, too, each part beginning with
    the last characters of the one before."""
    out, size = [[]], 0
    step = CHARACTERS - SPAN
    for word in words:
        for part in [word] if len(word) <= CHARACTERS else [word[i : i + CHARACTERS] for i in range(0, len(word) - SPAN, step)]:
            if size + len(part) > CHARACTERS and out[-1]:
                out.append([])
                size = 0
            out[-1].append(part)
            size += len(part)
    return [p for p in out if p]


def _codes(words: list[str]) -> np.ndarray:
    """Characters as numbers, a-z from 1 to 26, 30 and 31 at a word's ends (0: none), others from 32 on, one row each."""
    width = max(map(len, words))
    raw = np.array(words, f"<U{max(1, width)}").view(np.uint32).reshape(len(words), -1)
    latin = (raw >= 97) & (raw <= 122)
    out = np.zeros((len(words), raw.shape[1] + 2), np.int32)
    out[:, 0] = 30
    out[:, 1:-1] = np.where(raw == 0, 0, np.where(latin, raw - 96, 32 + raw))
    out[np.arange(len(words)), [len(w) + 1 for w in words]] = 31
    return out


_OFFSETS = [(0, *c) for p in (2, 3) for c in combinations(range(1, SPAN), p)]
TABLE = (1 << 20) + (1 << 15)


def _hashed(parts: list[np.ndarray]) -> np.ndarray:
    """A code from those of its length for a subsequence with letters beyond a-z."""
    h = np.zeros(parts[0].shape, np.uint32)
    for x in parts:
        h = (h ^ x.astype(np.uint32)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h & np.uint32((1 << 5 * len(parts)) - 1)).astype(np.int32)


def occurrences(codes: np.ndarray, starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Code and weight of each occurrence of a subsequence in each row, of those that begin
    in the first ``starts`` places. Codes of 4 characters follow those of 3; nothing is (0, 0)."""
    ids, weights = [np.zeros((len(codes), 1), np.int32)], [np.zeros((len(codes), 1), np.float32)]
    other = bool((codes >= 32).any())
    for o in _OFFSETS:
        n = min(codes.shape[1] - o[-1], codes.shape[1] if starts is None else starts)
        if n <= 0:
            continue
        parts = [codes[:, x : x + n] for x in o]
        there, key = parts[-1] > 0, parts[0]
        for x in parts[1:]:
            key = key * 32 + x
        if other:
            key = np.where(np.logical_or.reduce([x >= 32 for x in parts]), _hashed(parts), key)
        ids.append(np.where(there, key + (0 if len(o) == 3 else 1 << 15), 0))
        weights.append(np.where(there, np.float32(DECAY ** (o[-1] + 1 - len(o))), np.float32(0)))
    return np.concatenate(ids, axis=1), np.concatenate(weights, axis=1)


def features(words: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Each word, of any length, in some order with its subsequences, before any weight of their own."""
    words = sorted(words, key=len)
    while words:
        n = max(1, CELLS // (len(words[min(len(words), 1000) - 1]) + 2))
        some, words = words[: min(n, 1000)], words[min(n, 1000) :]
        ids, w = occurrences(_codes(some))
        w /= np.sqrt((w**2).sum(1, keepdims=True))
        for word, i, x in zip(some, ids, w):
            keep = x > 0
            yield word, i[keep], x[keep]


@dataclass
class Svm:
    table: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    logistic: tuple[float, float] = (0.0, 0.0)
    flat: float | None = None

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def decisions(self, words: list[str]) -> np.ndarray:
        """What each word, in plain form, adds to a sentence's decision."""
        out = np.zeros(len(words))
        order = [i for i in sorted(range(len(words)), key=lambda i: len(words[i])) if words[i]]
        at = 0
        while at < len(order):
            some = order[at : at + max(1, CELLS // (len(words[order[at]]) + 2))]
            while len(some) > 1 and len(some) * (len(words[some[-1]]) + 2) > 2 * CELLS:
                some = some[: len(some) // 2]
            at += len(some)
            codes = _codes([words[i] for i in some])
            value, square = np.zeros(len(some)), np.zeros(len(some))
            step = max(CELLS // len(some), 1)
            for first in range(0, codes.shape[1], step):  # the sums go on over a very long word's portions
                ids, w = occurrences(codes[:, first : first + step + SPAN], step)
                value += (self.table[ids] * w).sum(1, dtype=np.float64)
                square += (w**2).sum(1, dtype=np.float64)
            out[some] = value / np.sqrt(np.where(square > 0, square, 1))
        return out

    def tops(self, batch: list[str]) -> np.ndarray:
        """The highest decision of a sentence in each text."""
        out = []
        for at in range(0, len(batch), 500):
            cut = [sentences(t) for t in batch[at : at + 500]]
            new = {w for text in cut for s in text for w in s if w not in self.known}
            forms = {w: plain(w) for w in new}
            different = list(set(forms.values()))
            value = dict(zip(different, self.decisions(different).tolist()))
            self.known.update((w, value[f]) for w, f in forms.items())
            get = self.known.__getitem__
            out += [max([sum(map(get, s)) for s in text], default=0.0) + self.bias for text in cut]
            if len(self.known) > HELD:
                self.known = {}
        return np.array(out, float)

    def scores(self, batch: list[str]) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(batch), self.flat)
        return 1 / (1 + np.exp(-np.clip(self.logistic[0] + self.logistic[1] * self.tops(batch), -30, 30)))


Sentence = tuple[str, ...]


def train_sentences(bad: list[Sentence], good: list[Sentence], weight: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, float]:
    """The weight of each subsequence, and the bias, of the machine that tells ``bad`` (+1; with a
    weight each) from ``good`` sentences (-1), for subsequences that count ``rarity``."""
    half = min(LANDMARKS, len(bad)), min(LANDMARKS, len(good))
    landmarks = [bad[i * len(bad) // half[0]] for i in range(half[0])] + [good[i * len(good) // half[1]] for i in range(half[1])]
    known = {w: (ids, x) for w, ids, x in features(list({w for s in landmarks for w in s}))}
    seen = np.unique(np.concatenate([ids for ids, _ in known.values()]))
    place = np.full(TABLE, len(seen), np.int32)
    place[seen] = np.arange(len(seen))
    dense = np.zeros((len(seen) + 1, len(landmarks)), np.float32)
    for k, s in enumerate(landmarks):
        for w in s:
            np.add.at(dense[:, k], place[known[w][0]], known[w][1] * rarity[known[w][0]])
    value, vector = np.linalg.eigh((dense.T @ dense).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # K^(-1/2), on the part that is not null

    def nystrom(part: list[Sentence]) -> np.ndarray:
        words = list({w for s in part for w in s})
        number, kernel = {w: i for i, w in enumerate(words)}, np.zeros((len(words), len(landmarks)), np.float32)
        for w, ids, x in features(words):
            kernel[number[w]] = (x * rarity[ids]) @ dense[place[ids]]
        flat = kernel[[number[w] for s in part for w in s]]
        return np.add.reduceat(flat, np.cumsum([0, *map(len, part[:-1])]), axis=0) @ root

    every = [*bad, *good]
    x = np.vstack([nystrom(every[i : i + 2000]) for i in range(0, len(every), 2000)])
    x = np.hstack([x, np.ones((len(x), 1))])
    y, cost = np.r_[np.ones(len(bad)), -np.ones(len(good))], np.r_[weight, np.ones(len(good))]
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):  # Newton steps of the squared hinge loss
        on = y * (x @ w) < 1
        new = np.linalg.solve(ridge + 2 * (x[on].T * cost[on]) @ x[on], 2 * x[on].T @ (cost[on] * y[on]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    table = np.zeros(TABLE, np.float32)
    table[seen] = rarity[seen] * (dense[:-1] @ (root @ w[:-1]))
    return table, float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope, both classes weighing the same."""
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * (weight * p * (1 - p) + 1e-9)) @ x + 0.002 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.002 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def distorted(word: str) -> list[str]:
    """Virtual examples of a word: one character put in, doubled or left out."""
    if len(word) < 4:
        return []
    put_in = [word[:i] + "xzqkjv"[i % 6] + word[i:] for i in range(1, len(word))]
    doubled = [word[:i] + word[i] + word[i:] for i in range(len(word))]
    left_out = [word[:i] + word[i + 1 :] for i in range(1, len(word) - 1)] if len(word) > 4 else []
    return [*put_in, *doubled, *left_out]


def _crc(s: Sentence) -> tuple[int, Sentence]:
    return zlib.crc32(" ".join(s).encode("utf-8", "surrogatepass")), s


def fit(toxic: list[tuple[int, Sentence]], clean: list[Sentence]) -> Svm:
    """The machine, yet without its logistic function, of the sentences (words in plain form) of toxic
    documents, each with its document's number, and of clean ones. Equal sentences count once; those
    that clean documents have, too, are clean."""
    good = sorted({s for s in clean if s}, key=_crc)
    bags: dict[Sentence, int] = {}
    fine = set(good)
    for number, s in sorted(toxic):
        if s and s not in fine:
            bags.setdefault(s, number)
    bad = sorted(bags, key=_crc)
    model = Svm()
    if not bad or not good:
        return model
    count = np.zeros(TABLE, np.int64)
    codes = {w: np.unique(ids) for w, ids, _ in features(list({w for s in good[: OTHERS + HARD] for w in s}))}
    for s in good[: OTHERS + HARD]:
        count[np.unique(np.concatenate([codes[w] for w in s]))] += 1
    del codes
    n = min(len(good), OTHERS + HARD)
    rarity = ((np.log((n + 1) / (count + 1)) / np.log(n + 1)) ** 2).astype(np.float32)
    words = list({w for s in (*bad, *good) for w in s})
    now, against, share, extra = bad[:FIRST], good[: OTHERS + HARD], 0.1, []
    for turn in range(PASSES):
        last = turn == PASSES - 1
        cost = np.full(len(now), share * len(against) / len(now))
        if last:  # copies of the worst sentences with their worst word distorted
            extra = _virtual(now, value, {w for s in against for w in s})  # noqa: F821
            cost = np.r_[cost, np.full(len(extra), cost[0] / 2)]
        model.table, model.bias = train_sentences([*now, *extra], against, cost, rarity)
        if not last:
            value = dict(zip(words, model.decisions(words).tolist()))
            of_bag: dict[int, list[tuple[float, Sentence]]] = {}
            for s in bad:
                of_bag.setdefault(bags[s], []).append((-sum([value[w] for w in s]), s))
            worst = [sorted(found)[:2] for found in of_bag.values()]
            now = sorted([s for found in worst for d, s in found if d <= found[0][0] / 2], key=_crc)
            now = now or bad[:FIRST]
            hard = sorted(good, key=lambda s: (-sum([value[w] for w in s]), s))[:HARD]
            against, share = list(dict.fromkeys([*good[:OTHERS], *hard])), 0.3
    return model


def _virtual(bad: list[Sentence], value: dict[str, float], clean: set[str]) -> list[Sentence]:
    out = []
    for i, s in enumerate(bad):
        top = max(s, key=lambda w: (value.get(w, 0.0), w))
        forms = [v for v in distorted(top) if v not in clean]
        if forms and value.get(top, 0.0) > 0:
            for form in {forms[(i + k * len(forms) // COPIES) % len(forms)] for k in range(COPIES)}:
                out.append(tuple(form if w == top else w for w in s))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(label, doc_id, [p for p in map(plain, s) if p]) for label, doc_id, text in zip(batch.column("label").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch, "text")) for s in sentences(text)]
        rows = [(label, doc_id, part) for label, doc_id, words in rows for part in portions(words)]
        label, doc_id, words = zip(*rows) if rows else ((), (), ())
        yield pa.record_batch([pa.array(label, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["label", "doc_id", "words"])


def _tops(model: Svm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("label"), pa.array(model.tops(texts(batch, "text")))], names=["label", "top"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Svm:
    rows = stored(labelled(docs, labels, "toxic", (3, 1), sample), "labelled")
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    flat = Svm(flat=min(0.5, (n.get(1, 0) + 1) / (sum(n.values()) + 2)))
    if min(n.get(0, 0), n.get(1, 0)) < 2:
        return flat
    cut = stored(rows.mapInArrow(_cut, "label int, doc_id long, words array<string>"), "labelled-sentences").distinct()
    pool: dict[str, str] = {}  # one copy of each word
    found: list[list[tuple[int, Sentence]]] = []
    for label, most in ((1, TOXIC), (0, CLEAN)):
        some = bounded_sample(cut.where(F.col("label") == label), most, "words", "doc_id").toArrow()
        found.append([(i, tuple([pool.setdefault(w, w) for w in s])) for batch in some.to_batches() for i, s in zip(batch.column("doc_id").to_pylist(), batch.column("words").to_pylist())])
    model = fit(found[0], [s for _, s in found[1]])
    if not len(model.table):
        return flat
    tops = rows.mapInArrow(_tops(model), "label int, top double").toPandas().sort_values(["label", "top"])
    model.logistic = _logistic(tops["top"].to_numpy(), tops["label"].to_numpy(float))
    return model


def _scores(model: Svm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(model.scores(texts(batch, "text")))], names=["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: Svm, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _keep(model: Svm, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(texts(batch, "text")) < threshold))

    return run


def keep_clean(docs: DataFrame, model: Svm, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, columns as they were."""
    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(_keep(model, threshold), rows.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))
