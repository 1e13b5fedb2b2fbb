"""A language model from a subword lattice of an existing vocabulary.

Words are whitespace-separated and lower-cased in A-Z; each text ends with one
end token. A word's lattice has an edge for every piece of the vocabulary that
matches a substring; a forward recursion in log space sums the probability of
all segmentations, for words of every length. Every piece of the vocabulary
keeps its place: its weight is its own score (in a file of type BPE its rank, read as
a Zipf weight) as if ``PRIOR`` pieces had been seen, plus its expected count in the
distinct training words, from two passes of expectation maximisation over the same
lattices.

A training word is also an edge of its own lattice, from end to end, worth its
discounted count; the mass that the discounts free weighs the segmentations:

    p_k(w) = (max(c_k - d, 0) + (d * V_k + 1/2) * lattice_k(w)) / (N_k + 1)

Texts are of ``KINDS``: that language of ``FUNCTION_WORDS`` of which they have most
words, else the last kind. Each kind has piece weights and counts of its own, of all
training texts that are of it, and a text's probability is the mixture over the kinds,
whatever its own words say: sum over k of p(k) * p_k(text).

Beside the score stands ``lattice_score``, the log10 probability of a text's words under the vocabulary's own scores
alone, summed over all segmentations of each; nothing is learnt for it, and the end token has no part in it.

Words are counted in each task before they are shuffled. For scoring, the
``HOT`` most frequent words go to the tasks as one broadcast table of bounded
size; all other words of a document are joined with the word table by a
shuffle, so none is left out.

Defined cases: null and empty texts are the end token alone; rows with a null
doc_id are learnt from and scored (its text is empty for the hash); without
training rows words are scored by the vocabulary alone; repeated rows each count and
come out; an empty table gives an empty result; other columns are ignored. Memory for
learning from a word grows with the word (80 bytes for each of its bytes).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.lang import FUNCTION_WORDS
from tarn.llm.common import crc_mod, stored, utf8

MODULUS, HELD_OUT = 7, 2
#: Smaller weight of any byte; Zipf offset of the ranks.
FLOOR, ZIPF = 1e-7, 50
DISCOUNT = 0.7
#: Pieces that the vocabulary's scores, and all kinds together for each kind, are worth.
PRIOR, SHARED, PASSES = 2000.0, 500.0, 2
#: Words of these pieces end after each with this probability before any is read.
STOP = 0.3
KINDS = (*FUNCTION_WORDS, "other")
#: Numbers of a word: one for each kind, and the vocabulary's.
SETS = len(KINDS) + 1
#: Words whose scores every task gets at once (about 40 MB), and distinct words that a task counts before it passes them on.
HOT, HELD = 200_000, 300_000
#: Words of up to so many bytes are worked on many at a time, which changes no number; characters that are worked on together.
SHORT, CELLS, GATHERED = 64, 200_000, 60_000


@lru_cache(2)
def vocabulary(name: str = "piece_bpe_32k.model") -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (lower case, without the word mark) and log weights from
    the file's own scores; every single byte is a piece."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    said = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ranks = all(float(model.get_score(i)).is_integer() for i in said)
    weight = {bytes([b]): FLOOR for b in range(256)}
    for i in said:
        piece, score = model.id_to_piece(i).replace("▁", "").encode().lower(), model.get_score(i)
        if piece:
            w = 1.0 / ((-score if score > -1e8 else 1e6) + ZIPF) if ranks else math.exp(score)
            weight[piece] = weight.get(piece, 0.0) + w
    pieces = sorted(weight)
    w = np.array([weight[p] for p in pieces])
    return pieces, np.log(w / w.sum())


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _total(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials down the first axis."""
    top = x.max(0)
    top = np.where(np.isfinite(top), top, -1e300)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(x - top).sum(0))


class Lattice:
    """Sums over the segmentations of words, for several sets of piece weights.

    ``logs`` has a row of log probabilities for each piece and a column for each
    set; after each piece a word ends with probability ``stop`` of the set.
    Short words of equal length are worked on together: for each start and end, one
    search in the sorted 64-bit hashes of the pieces finds the edges of all.
    """

    def __init__(self, pieces: list[bytes], logs: np.ndarray, stop: np.ndarray):
        self.pieces, self.sets, self.given = pieces, logs.shape[1], (logs, stop)
        go = np.log1p(-stop)
        self.last = np.log(stop) - go
        self.logs = logs + go
        self.longest = max(map(len, pieces))
        hashes = np.array([int(self._hash(np.frombuffer(p, np.uint8)[None, :])[0]) for p in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have the same hash")

    def beside(self, scores: np.ndarray, stop: float) -> Lattice:
        """The same with one more set of weights."""
        logs, stops = self.given
        return Lattice(self.pieces, np.hstack([logs, scores[:, None]]), np.append(stops, stop))

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), np.uint64)
        for c in codes.T:
            out = (out + c.astype(np.uint64) + np.uint64(1)) * _BASE
        return out

    def _found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where hashes are those of pieces, and the pieces there."""
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        rows = np.flatnonzero(self.hashes[at] == h)
        return rows, self.order[at[rows]]

    # Many short words of one length.

    def _edges(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end, the (start, rows, pieces) of the edges there."""
        width = codes.shape[1]
        out: list[list] = [[] for _ in range(width + 1)]
        one = codes.astype(np.uint64) + np.uint64(1)
        for i in range(width):
            h = np.zeros(len(codes), np.uint64)
            for j in range(i + 1, min(width, i + self.longest) + 1):
                h = (h + one[:, j - 1]) * _BASE
                rows, pieces = self._found(h)
                if len(rows):
                    out[j].append((i, rows, pieces))
        return out

    def _forward(self, edges: list, n: int) -> np.ndarray:
        """Log of the summed probability of each prefix: position, row, set."""
        a = np.full((len(edges), n, self.sets), -np.inf)
        a[0] = 0.0
        for j, here in enumerate(edges):
            for i, rows, pieces in here:
                a[j, rows] = np.logaddexp(a[j, rows], a[i, rows] + self.logs[pieces])
        return a

    def _by_length(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, codes) of short words of equal length, ``CELLS`` at a time."""
        length = np.array([len(w) for w in words], np.int64)
        order = np.argsort(length, kind="stable")
        order = order[(length[order] > 0) & (length[order] <= SHORT)]
        for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
            width = int(length[part[0]])
            for at in range(0, len(part), CELLS // width):
                some = part[at : at + CELLS // width]
                yield some, np.frombuffer(b"".join([words[i] for i in some]), np.uint8).reshape(len(some), width)

    # One word of any length: a window of as many positions as the longest piece has bytes.

    def _ending(self, word: bytes, first: int, last: int) -> np.ndarray:
        """The piece of each length (1 to the longest) that ends at each of the
        positions ``first`` to ``last``; the number after the last piece for none."""
        out = np.full((last - first + 1, self.longest), len(self.pieces), np.int64)
        start = max(0, first - self.longest)
        one = np.frombuffer(word[start:last], np.uint8).astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(one), np.uint64)
        for n in range(1, min(self.longest, len(one)) + 1):
            h = (h[: len(one) - n + 1] + one[n - 1 :]) * _BASE
            rows, pieces = self._found(h)
            at = start + rows + n - first
            out[at[at >= 0], n - 1] = pieces[at >= 0]
        return out

    def _prefixes(self, word: bytes, whole: bool) -> np.ndarray:
        """As ``_forward`` for one word: all positions, or the last one alone."""
        logs = np.vstack([self.logs, np.full((1, self.sets), -np.inf)])
        kept = np.zeros((1, self.sets))
        for first in range(1, len(word) + 1, 4096):
            ending = self._ending(word, first, min(len(word), first + 4095))
            a = np.vstack([kept, np.zeros((len(ending), self.sets))])
            for r, here in enumerate(ending):
                j = len(kept) + r
                m = min(self.longest, j)
                a[j] = _total(a[j - m : j][::-1] + logs[here[:m]])
            kept = a if whole else a[-self.longest :]
        return kept if whole else kept[-1]

    def log_marginals(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the probability of each word over all segmentations, by
        the forward recursion in log space; a column for each set of weights."""
        out = np.full((len(words), self.sets), -np.inf)
        for some, codes in self._by_length(words):
            out[some] = self.last + self._forward(self._edges(codes), len(codes))[-1]
        for n, w in enumerate(words):
            if len(w) > SHORT:
                out[n] = self.last + self._prefixes(w, False)
        return out

    def expected(self, words: list[bytes], share: np.ndarray) -> np.ndarray:
        """Expected count of each piece in ``words``, a column for each set; a
        word counts in set ``k`` as often as its row of ``share`` says."""
        out = np.zeros((len(self.pieces), self.sets))

        def add(pieces: np.ndarray, amounts: np.ndarray) -> None:
            for k in range(self.sets):
                out[:, k] += np.bincount(pieces, amounts[:, k], len(out))

        for some, codes in self._by_length(words):
            edges = self._edges(codes)
            a = self._forward(edges, len(codes))
            weight = np.zeros_like(a)  # posterior weight of each position
            weight[-1] = share[some]
            used, amounts = [], []
            for j in range(len(edges) - 1, 0, -1):
                for i, rows, pieces in edges[j]:
                    x = weight[j, rows] * np.exp(a[i, rows] + self.logs[pieces] - a[j, rows])
                    weight[i, rows] += x
                    used.append(pieces)
                    amounts.append(x)
            add(np.concatenate(used), np.concatenate(amounts))
        logs = np.vstack([self.logs, np.full((1, self.sets), -np.inf)])
        for n, w in enumerate(words):
            if len(w) > SHORT:
                a = self._prefixes(w, True)
                weight = np.zeros_like(a)
                weight[-1] = share[n]
                for last in range(len(w), 0, -4096):
                    first = max(1, last - 4095)
                    ending = self._ending(w, first, last)
                    used = np.zeros((*ending.shape, self.sets))
                    for r in range(len(ending) - 1, -1, -1):
                        j = first + r
                        m = min(self.longest, j)
                        x = weight[j] * np.exp(a[j - m : j][::-1] + logs[ending[r, :m]] - a[j])
                        weight[j - m : j] += x[::-1]
                        used[r, :m] = x
                    there = ending < len(self.pieces)
                    add(ending[there], used[there])
        return out


@lru_cache(1)
def _function_words() -> list[list[bytes]]:
    return [[w.encode() for w in some] for some in FUNCTION_WORDS.values()]


def kind_of(counts: dict[bytes, int]) -> int:
    """The kind of a text by the counts of its words: a number of ``KINDS``."""
    get = counts.get
    found = [sum([get(w, 0) for w in some]) for some in _function_words()]
    most = max(found)
    return found.index(most) if most else len(found)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, kind, count in training texts) of what a task has read so far;
    kind -1 and count 0 for words of other texts."""
    counts: list[Counter] = [Counter() for _ in range(len(KINDS) + 1)]

    def told() -> Iterator[pa.RecordBatch]:
        for k, c in zip((*range(len(KINDS)), -1), counts):
            if c:
                yield pa.record_batch([pa.array(list(c), pa.binary()).cast(pa.string()), pa.array([k] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["word", "kind", "n"])
                c.clear()

    for batch in batches:
        for held_out, text in zip(batch.column("held_out").to_pylist(), utf8(batch, "text")):
            found = Counter(text.lower().split())
            if held_out:
                counts[-1].update(dict.fromkeys(found, 0))
            else:
                found[b""] = 1
                counts[kind_of(found)].update(found)
            if sum(map(len, counts)) > HELD:
                yield from told()
    yield from told()


def _split(docs: DataFrame, modulus: int, rest: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", modulus) == rest).alias("held_out"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame, modulus: int = MODULUS, rest: int = HELD_OUT) -> DataFrame:
    """(word, c): every word of ``docs`` with its counts in the training texts
    of each kind; the end token is the empty word."""
    told = _split(docs, modulus, rest).select("held_out", "text").mapInArrow(_count, "word string, kind int, n long")
    by_kind = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(len(KINDS))]
    return told.groupBy("word").agg(*by_kind).select("word", F.array(*[f"c{k}" for k in range(len(KINDS))]).alias("c"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches: a numpy call costs as much for few words as for many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED or sum(b.nbytes for b in held) >= 1 << 24:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("c").flatten().to_numpy().reshape(batch.num_rows, -1)


def _expected(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, words = np.zeros((len(lattice.pieces), lattice.sets)), np.zeros(lattice.sets)
        for batch in _gathered(batches):
            seen = _numbers(batch) > 0
            count += lattice.expected(utf8(batch, "word"), seen.astype(float))
            words += seen.sum(0)
        piece, kind = np.nonzero(count)
        kinds = np.arange(lattice.sets)
        yield pa.record_batch(
            [pa.array(np.r_[piece, np.full(len(kinds), -1)].astype(np.int32)), pa.array(np.r_[kind, kinds].astype(np.int32)), pa.array(np.r_[count[piece, kind], words])],
            names=["piece", "kind", "n"],
        )

    return run


def reweighed(pieces: list[bytes], scores: np.ndarray, count: np.ndarray, words: np.ndarray) -> Lattice:
    """The lattice of expected piece counts in so many words (a column for each
    set) over the vocabulary's own ``scores`` (log weights)."""
    shared = count.sum(1) + PRIOR * np.exp(scores)
    shared /= shared.sum()
    total = count.sum(0) + SHARED
    stop = np.clip((words + STOP * SHARED) / total, 0.01, 0.9)
    return Lattice(pieces, np.log((count + SHARED * shared[:, None]) / total), stop)


def train_pieces(words: DataFrame, name: str = "piece_bpe_32k.model") -> Lattice:
    """Piece weights of each kind, estimated on all distinct training words of
    ``words`` (word, c: count by kind). At most one number for each piece and kind
    comes to the driver in each pass."""
    pieces, scores = vocabulary(name)
    kinds = len(KINDS)
    lattice = Lattice(pieces, np.tile(scores[:, None], (1, kinds)), np.full(kinds, STOP))
    for _ in range(PASSES):
        sums = words.mapInArrow(_expected(lattice), "piece int, kind int, n double").groupBy("piece", "kind").agg(F.sum("n").alias("n")).toPandas()
        count, seen = np.zeros((len(pieces), kinds)), np.zeros(kinds)
        of_words = sums["piece"].to_numpy() < 0
        count[sums["piece"][~of_words], sums["kind"][~of_words]] = sums["n"][~of_words]
        seen[sums["kind"][of_words]] = sums["n"][of_words]
        lattice = reweighed(pieces, scores, count, seen)
    return lattice


class Model:
    """Probabilities of words in each kind, from counts and the lattice, and under the vocabulary's own ``scores`` alone."""

    def __init__(self, lattice: Lattice, scores: np.ndarray, tokens: np.ndarray, types: np.ndarray, ends: np.ndarray, discount: float):
        self.lattice, self.discount = lattice.beside(scores, STOP), discount
        self.all, self.spelt = np.log(tokens + 1.0), np.log(discount * types + 0.5)
        self.end = np.log(ends + 0.5) - self.all  # the end token
        self.prior = np.log((ends + 0.5) / (ends.sum() + 0.5 * len(ends)))

    def log_words(self, words: list[bytes], c: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each word (not the end) in each kind, and last of its marginal
        under the vocabulary's own scores."""
        with np.errstate(divide="ignore"):
            seen = np.log(np.maximum(c - self.discount, 0.0))
        spelt = self.lattice.log_marginals(words)
        return np.hstack([np.logaddexp(seen, self.spelt + spelt[:, :-1]) - self.all, spelt[:, -1:]])


def _log_words(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            c = _numbers(batch)
            logs = model.log_words(utf8(batch, "word"), c)
            offsets = pa.array(np.arange(len(c) + 1, dtype=np.int32) * SETS)
            yield pa.record_batch([batch.column("word"), pa.array(c.sum(1)), pa.ListArray.from_arrays(offsets, pa.array(logs.astype(np.float32).ravel()))], names=["word", "c", "logs"])

    return run


#: Documents whose words are scored together.
TOGETHER = 256


def _doc_terms(hot: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, base_of, logs_of, known_of = hot.value
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                yield terms(batch.slice(at, TOGETHER), number.get, base_of, logs_of, known_of)

    def terms(part: pa.RecordBatch, get, base_of: np.ndarray, logs_of: np.ndarray, known_of: np.ndarray) -> pa.RecordBatch:
        words, found, ns, sizes, lengths = [], [], [], [], []
        for text in utf8(part, "text"):
            said = text.lower().split()
            lengths.append(len(said) + 1)
            counts = Counter(said)
            words.extend(counts)
            ns.extend(counts.values())
            found.extend(map(get, counts, repeat(-1)))
            sizes.append(len(counts))
        n, found, ns = np.array(lengths, np.int64), np.array(found, np.int64), np.array(ns, np.int64)
        rows, other, at = np.repeat(np.arange(len(n)), sizes), np.flatnonzero(found < 0), np.flatnonzero(found >= 0)
        offsets = np.cumsum([0, *np.bincount(rows[other], minlength=len(n))])
        words, ns_other = [words[i] for i in other.tolist()], ns[other]
        rows, hit, hit_n = rows[at], found[at], ns[at].astype(float)

        def summed(weights: np.ndarray) -> np.ndarray:
            return np.bincount(rows, weights * hit_n, len(n)).astype(float)

        score = np.stack([summed(logs_of[hit, k]) for k in range(SETS)], axis=1)
        tail = pa.StructArray.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(ns_other)], names=["word", "n"])
        scores = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * SETS), pa.array(score.ravel()))
        return pa.record_batch(
            [part.column("key"), part.column("doc_id"), part.column("held_out"), pa.array(n), pa.array(summed(known_of[hit]).astype(np.int64)), pa.array(summed(base_of[hit])), scores, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tail)],
            names=["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail"],
        )

    return run


def score(docs: DataFrame, name: str = "piece_bpe_32k.model", modulus: int = MODULUS, rest: int = HELD_OUT, discount: float = DISCOUNT, hot_words: int = HOT) -> DataFrame:
    """Learns from the training rows of ``docs`` (doc_id, text) and scores all."""
    spark, kinds = docs.sparkSession, range(len(KINDS))
    counts = stored(word_counts(docs, modulus, rest), "word-counts")
    c = [F.col("c")[k] for k in kinds]
    whole, is_end = sum(c[1:], c[0]), F.col("word") == ""
    total = counts.agg(
        *[F.sum(x).alias(f"n{k}") for k, x in enumerate(c)],
        *[F.count_if((x > 0) & ~is_end).alias(f"v{k}") for k, x in enumerate(c)],
        *[F.sum(F.when(is_end, x)).alias(f"e{k}") for k, x in enumerate(c)],
        F.count_if(whole > 0).alias("v"),
    ).first()
    tokens, types, ends = (np.array([total[f"{x}{k}"] or 0 for k in kinds], float) for x in "nve")
    n, v, docs_seen = int(tokens.sum()), total["v"] or 0, float(ends.sum())
    words = counts.where(~is_end)
    model = Model(train_pieces(words.where(whole > 0), name), vocabulary(name)[1], tokens, types, ends, discount)
    words = stored(words.mapInArrow(_log_words(model), "word string, c long, logs array<float>"), "word-model")
    # The counts that at most ``hot_words`` words reach.
    least, so_far = 1, 0
    for r in words.where("c > 0").groupBy("c").count().orderBy(F.desc("c")).limit(hot_words).toLocalIterator():
        so_far += r["count"]
        if so_far > hot_words:
            least = r["c"] + 1
            break
    table = words.where(F.col("c") >= least).toArrow().combine_chunks()  # at most ``hot_words`` rows
    hot_c = table["c"].to_numpy().astype(float)
    logs = np.concatenate([np.zeros(0, np.float32), *(x.flatten().to_numpy() for x in table["logs"].chunks)]).reshape(-1, SETS)
    number = {w: i for i, w in enumerate(table["word"].cast(pa.binary()).to_pylist())}
    hot = spark.sparkContext.broadcast((number, np.log10((hot_c + 1) / (n + v + 1)), logs, np.ones(len(hot_c))))
    given = _split(docs, modulus, rest).select(F.monotonically_increasing_id().alias("key"), "*")
    shape = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score array<double>, tail array<struct<word:string,n:long>>"
    rows = stored(given.mapInArrow(_doc_terms(hot), shape), "document-terms")
    tail = (
        rows.select("key", F.explode("tail").alias("t"))
        .select("key", "t.word", "t.n")
        .join(words, "word")
        .select(
            "key",
            F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"),
            (F.col("n") * F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).alias("more"),
            *[(F.col("n") * F.col("logs")[k].cast("double")).alias(f"s{k}") for k in range(SETS)],
        )
        .groupBy("key")
        .agg(*[F.sum(x).alias(x) for x in ("known", "more", *[f"s{k}" for k in range(SETS)])])
    )

    def none(x: str) -> Column:
        return F.coalesce(x, F.lit(0))

    parts = [F.col("score")[k] + none(f"s{k}") + F.lit(float(model.end[k] + model.prior[k])) for k in kinds]
    joined = rows.drop("tail").join(tail, "key", "left").withColumn("parts", F.array(*parts)).withColumn("top", F.array_max("parts"))
    mixed = F.col("top") + F.log(F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top"))))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + none("known") + F.lit(int(docs_seen > 0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + none("more") + F.lit(math.log10((docs_seen + 1) / (n + v + 1)))).alias("base_score"),
        (mixed / math.log(10)).alias("score"),
        ((F.col("score")[SETS - 1] + none(f"s{SETS - 1}")) / math.log(10)).alias("lattice_score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
