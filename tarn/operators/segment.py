"""Words without white space: a dictionary learnt from unparted text, and cutting by it.

A candidate is a run of up to ``longest`` letters that occurs ``least`` times. It is a word if its characters stick together
(``cohesion``: the least, over all ways to cut it in two, of the log ratio of its share to that of the parts side by side) and
if what stands beside it varies (``entropy``: the lesser one of its left and right neighbours', where an end
of the text between marks counts as one more neighbour). ``candidates`` takes both from any table of n-gram counts (``gram_counts``);
``grams.found`` finds the same in texts without such a table, which is what large ones take.

Where other texts have white space, the words that it parts are a dictionary, too (``known_words``).

Text is cut along the best path of the word graph of its letters: the one of the largest sum of log shares.
Shares are first those of the candidates and then, ``passes`` times, those of the words that the cut of the texts itself gives. The
dictionary is a table; as long as it has at most ``most`` words (a parameter, of the largest counts) it goes to tasks at once.

Search mode also gives the words of two and of three characters within a longer one, before it.

Defined cases: null and empty texts have no words; digits and marks part runs and are given as
they stand, white space is not given; a letter that no word covers is a word of its own; texts of any length are cut in time in proportion.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.config import DEFAULT
from tarn.functions.text import HAN, SPACE
from tarn.operators import grams

#: Letters of any script, as runs.
RUNS = r"\p{L}+"
_RUN = regex.compile(RUNS)
_PARTS = regex.compile(r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]+")
_HAN = regex.compile(r"\p{Han}+|[^\p{Han}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = regex.compile(SPACE)
#: Letters of a word's beginning that is kept.
BEGINNING = 16
#: Characters that are counted together.
HELD = 1 << 21


def unparted(text: Column) -> Column:
    """``text`` without white space."""
    return F.regexp_replace(text, SPACE, "")


def _grams(text: str, breaks: np.ndarray, longest: int) -> Iterator[tuple[str, int]]:
    """Counts of the n-grams of ``text`` that no break is within; equal 64-bit hashes of one length are equal grams."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(codes), np.uint64)
    good = np.ones(len(codes), bool)
    for n in range(1, min(longest, len(codes)) + 1):
        ends = len(codes) - n + 1
        h = (h[:ends] + codes[n - 1 :] + np.uint64(1)) * _BASE
        good = good[:ends] & ~breaks[n - 1 :]
        at = np.flatnonzero(good)
        _, first, count = np.unique(h[at], return_index=True, return_counts=True)
        for i, c in zip(at[first].tolist(), count.tolist()):
            yield text[i : i + n], c


def _counted(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(runs: list[str]) -> pa.RecordBatch:
            whole = "\n".join(runs)
            found = list(_grams(whole, np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32) == 10, longest))
            grams, counts = zip(*found) if found else ((), ())
            return pa.record_batch([pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["gram", "n"])

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for r in _RUN.findall(text or ""):
                    held.append(r)
                    size += len(r) + 1
                    if size > HELD:
                        yield told(held)
                        held, size = [], 0
        yield told(held)

    return run


def gram_counts(texts: DataFrame, longest: int, text: str = "text") -> DataFrame:
    """(gram, n): how often each run of up to ``longest`` letters stands in ``texts``."""
    return texts.select(F.col(text)).mapInArrow(_counted(longest), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def candidates(grams: DataFrame, longest: int = DEFAULT.word_longest, least: int = DEFAULT.word_least) -> DataFrame:
    """(word, n, cohesion, entropy) of all grams of up to ``longest`` letters that occur ``least`` times, of ``grams`` that
    reach one letter further. One letter has neither (null)."""
    size = F.length("gram")

    def beside(within: Column, name: str) -> DataFrame:
        return grams.where(size > 1).select(within.alias("word"), "n").groupBy("word").agg(F.sum("n").alias(f"{name}_n"), F.sum(F.col("n") * F.log("n")).alias(f"{name}_s"))

    words = grams.where((size <= longest) & (F.col("n") >= least)).withColumnRenamed("gram", "word")
    total = grams.where(size == 1).agg(F.sum("n").alias("total"))
    long = words.where(F.length("word") > 1)
    cuts = long.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    cuts = cuts.select("word", "n", F.expr("substr(word, 1, at)").alias("a"), F.expr("substr(word, at + 1)").alias("b"))
    first, second = words.select(F.col("word").alias("a"), F.col("n").alias("na")), words.select(F.col("word").alias("b"), F.col("n").alias("nb"))
    loosest = cuts.join(first, "a").join(second, "b").groupBy("word").agg(F.max(F.col("na").cast("double") * F.col("nb")).alias("parts"))
    right, left = beside(F.expr("substr(gram, 1, length(gram) - 1)"), "r"), beside(F.expr("substr(gram, 2)"), "l")

    def entropy(name: str) -> Column:
        end = F.col("n") - F.coalesce(F.col(f"{name}_n"), F.lit(0))
        ends = F.when(end > 0, end * F.log(end.cast("double"))).otherwise(F.lit(0.0))
        return F.log("n") - (F.coalesce(F.col(f"{name}_s"), F.lit(0.0)) + ends) / F.col("n")

    whole = words.join(loosest, "word", "left").join(right, "word", "left").join(left, "word", "left").join(F.broadcast(total))  # one row
    return whole.select(
        "word", "n",
        (F.round(F.log(F.col("n") * F.col("total") / F.col("parts")), 6) + 0.0).alias("cohesion"),  # no -0.0
        F.when(F.length("word") > 1, F.round(F.least(entropy("l"), entropy("r")), 6) + 0.0).alias("entropy"),
    )


def chosen(found: DataFrame, cohesion: float = DEFAULT.word_cohesion, entropy: float = DEFAULT.word_entropy) -> DataFrame:
    """(word, n): the candidates that are words, and all single letters."""
    return found.where((F.length("word") == 1) | ((F.col("cohesion") >= cohesion) & (F.col("entropy") >= entropy))).select("word", "n")


class Cutter:
    """Cuts text by a dictionary (word to count)."""

    def __init__(self, words: dict[str, int]):
        total = max(1, sum(words.values()))
        self.weight = {w: math.log(n / total) for w, n in words.items() if w and n > 0}
        self.longest = max(map(len, self.weight), default=1)
        self.unknown = math.log(0.1 / total)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("starts", "tails")}

    def _begun(self) -> None:
        """``starts``: what words of two letters and more begin with, up to ``BEGINNING`` letters, with the weight of those that
        are words; ``tails``: the lengths of the longer words with the same beginning."""
        self.starts: dict[str, float | None] = {}
        self.tails: dict[str, list[int]] = {}
        for w, x in self.weight.items():
            for n in range(2, min(len(w), BEGINNING + 1)):
                self.starts.setdefault(w[:n], None)
            if 1 < len(w) <= BEGINNING:
                self.starts[w] = x
            elif len(w) > BEGINNING:
                self.starts.setdefault(w[:BEGINNING], None)
                self.tails.setdefault(w[:BEGINNING], []).append(len(w))
        self.tails = {w: sorted(set(n)) for w, n in self.tails.items()}

    def cut(self, run: str) -> list[str]:
        """The words of the best path; of equal sums the one with the longer last word. From each letter words are looked for only as
        long as one begins like that."""
        if not hasattr(self, "starts"):
            self._begun()
        size = len(run)
        best, back = [0.0] + [-math.inf] * size, [0] * (size + 1)
        get, starts, unknown = self.weight.get, self.starts, self.unknown
        for start in range(size):
            so_far = best[start]
            for end in range(start + 2, min(start + BEGINNING, size) + 1):
                part = run[start:end]
                w = starts.get(part, False)
                if w is False:
                    break
                if w is not None and so_far + w > best[end]:
                    best[end], back[end] = so_far + w, start
            else:
                for n in self.tails.get(run[start : start + BEGINNING], ()) if self.tails else ():
                    w = get(run[start : start + n]) if start + n <= size else None
                    if w is not None and so_far + w > best[start + n]:
                        best[start + n], back[start + n] = so_far + w, start
            w = so_far + get(run[start], unknown)
            if w > best[start + 1]:
                best[start + 1], back[start + 1] = w, start
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return out[::-1]

    def words(self, text: str, search: bool = False) -> list[str]:
        """All parts of ``text`` but white space, runs of letters cut."""
        out: list[str] = []
        for part in _PARTS.findall(text):
            for word in self.cut(part) if part[0].isalpha() else [part]:
                if search:
                    for size in (2, 3):
                        if len(word) > size:
                            out += [g for g in (word[i : i + size] for i in range(len(word) - size + 1)) if g in self.weight]
                out.append(word)
        return out

    def tokens(self, text: str, search: bool = False, limit: int = DEFAULT.text_limit) -> list[str]:
        """Plain pieces between white space as they are, runs of Chinese characters by the dictionary, other runs whole."""
        out: list[str] = []
        for piece in text[:limit].split():
            if piece.isascii() and piece.isalnum():
                out.append(piece)
                continue
            for part in _PARTS.findall(piece):
                for run in _HAN.findall(part) if part[0].isalpha() else []:
                    out += self.words(run, search) if regex.match(HAN.replace("Is", ""), run) else [run]
                if not part[0].isalpha() and part[0].isalnum():
                    out.append(part)
        return out


def collected(dictionary: DataFrame, most: int = DEFAULT.dictionary) -> Cutter:
    """The ``most`` words of the largest counts, for tasks to cut by."""
    rows = dictionary.orderBy(F.desc("n"), "word").limit(most).collect()
    return Cutter({r["word"]: r["n"] for r in rows})


def _recounted(cutter: Cutter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                for r in _RUN.findall(text or ""):
                    n.update(cutter.cut(r))
            yield pa.record_batch([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    return run


def known_words(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the runs of letters of texts whose words are parted, as a dictionary for those that are not."""
    return texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(RUNS), 0)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def learnt(texts: DataFrame, text: str = "text", passes: int = DEFAULT.word_passes, longest: int = DEFAULT.word_longest) -> Cutter:
    """A cutter whose dictionary comes from ``texts`` alone."""
    cutter = collected(chosen(grams.found(texts, longest, DEFAULT.word_least, text)))
    for _ in range(passes):
        found = texts.select(F.col(text)).mapInArrow(_recounted(cutter), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        cutter = collected(found)
    return cutter


def _words(cutter: Cutter, search: bool, as_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = cutter.tokens if as_tokens else cutter.words
            out = [None if t is None else cut(t, search) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(out, pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "words"])

    return run


def segmented(docs: DataFrame, cutter: Cutter, key: str, text: str | Column = "text", search: bool = False, as_tokens: bool = False) -> DataFrame:
    """(key, words) of every row; with ``as_tokens`` those of U7, else all of the whole text."""
    rows = docs.select(key, (F.col(text) if isinstance(text, str) else text).alias("text"))
    return rows.mapInArrow(_words(cutter, search, as_tokens), f"{key} {docs.schema[key].dataType.simpleString()}, words array<string>")


def _ends(words: list[str]) -> set[int]:
    """Where each word ends."""
    return set(accumulate(map(len, words)))


def _told(cutter: Cutter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int | None, ...]] = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                if text is None:
                    out.append((None, None, None))
                    continue
                joined = _SPACE.sub("", text)
                marks = _ends(_PARTS.findall(joined))
                true, found = _ends(_PARTS.findall(_SPACE.sub(" ", text))) - marks, _ends(cutter.words(joined)) - marks
                out.append((len(true), len(found), len(true & found)))
            counts = [pa.array(c, pa.int32()) for c in zip(*out)] if out else [pa.array([], pa.int32())] * 3
            yield pa.record_batch([*batch.columns[:-1], *counts], names=[*batch.schema.names[:-1], "n_true", "n_cut", "n_both"])

    return run


def places(docs: DataFrame, cutter: Cutter, *keys: str, text: str = "text") -> DataFrame:
    """(keys, n_true, n_cut, n_both) of every row: the places between letters where white space was, where a cut of the text without
    white space is, and where both are; null for a null text. A text is read, cut and compared at once; as cutting takes far longer
    than reading, texts are dealt to all cores, however few parts their files have."""
    schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return docs.select(*keys, text).repartition(parts, keys[0]).mapInArrow(_told(cutter), f"{schema}, n_true int, n_cut int, n_both int")
