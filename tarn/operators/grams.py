"""Words of unparted text, counted by the windows of letters that begin at each place.

``segment.candidates`` says what is found. A place of a text gives one row here, not one of each length: its window, the up to ``longest`` + 1 letters
from there to the end of the run. Grams are beginnings of windows, so sorted windows have the counts of all lengths:

1. Letters get numbers, so that a window of up to 127 different letters is one 64-bit number (more letters: several).
2. The counts of the shortest grams, of fewer letters than ``_Code.dealt``, which there cannot be many of, are a table that tasks get.
3. Windows are counted in chunks of ``HELD`` letters where texts are read, and dealt by their first letters. Their group has all counts of the grams of
   that beginning, what follows each, and how many of each begin a run.
4. Grams that occur twice are dealt again, by their last letters. Their group has what stands before each and the counts of all endings. (What stands
   beside a word but once adds nothing to the sum of n ln n, and how many of them there are follows from the ends of runs.)

Groups grow in number with the letters of the texts, so their usual size stays; but all windows of one beginning are in one group, and that of
the most frequent beginning does grow. Counts are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import SPACE

#: Letters that are counted together.
HELD = 1 << 23
#: Texts that are made windows of together.
ROWS = 64
#: Letters of the texts for each group.
GROUP = 1 << 23
#: So many short grams can there be at most.
SHORT = 1 << 26
_LETTER = regex.compile(r"\p{L}")
_SPACE = regex.compile(SPACE)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PART = "part int, sizes array<int>, data binary, more binary"
_FOUND = "word string, n long, parts double, entropy double"


def _codes(column: pa.Array) -> np.ndarray:
    """The code points of texts, each ended by a zero."""
    whole = "\0".join([t or "" for t in column.to_pylist()]) + "\0"
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)


def _alphabet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0x110000, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            n = np.bincount(_codes(batch.column(0).slice(at, ROWS)))
            counts[: len(n)] += n
    codes = np.array([c for c in np.flatnonzero(counts).tolist() if _LETTER.match(chr(c))], np.int64)
    yield pa.record_batch([pa.array(codes), pa.array(counts[codes])], names=["code", "n"])


class _Code:
    """Letters as numbers from 1, and windows of up to ``size`` letters as ``words`` 64-bit numbers, the first letter on top; sorted
    windows are in the order of their letters, and what has ended comes before what goes on."""

    def __init__(self, letters: list[int], size: int):
        self.letters, self.size = np.array([0, *letters], np.uint32), size
        self.bits = max(1, len(letters).bit_length())
        self.per = 64 // self.bits
        self.words = -(-size // self.per)
        self.dealt = max(1, min(size - 1, self.per, int(math.log(SHORT) / math.log(max(2, len(letters))))))
        self.masks = np.zeros((self.words, size + 1), np.uint64)
        for n in range(1, size + 1):
            for j in range(n):
                v, shift = self.place(j)
                self.masks[v, n] |= np.uint64((1 << self.bits) - 1) << shift

    def place(self, j: int) -> tuple[int, np.uint64]:
        return j // self.per, np.uint64((self.per - 1 - j % self.per) * self.bits)

    def letter(self, keys: np.ndarray, j: int) -> np.ndarray:
        v, shift = self.place(j)
        return (keys[v] >> shift) & np.uint64((1 << self.bits) - 1)

    def beginning(self, keys: np.ndarray, n: int) -> np.ndarray:
        return keys & self.masks[:, n, None]

    def reversed(self, keys: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros_like(keys)
        for j in range(n):
            v, shift = self.place(n - 1 - j)
            out[v] |= self.letter(keys, j) << shift
        return out

    def part(self, keys: np.ndarray, parts: int) -> np.ndarray:
        """The group of each window, by its first letters."""
        mixed = (self.beginning(keys[:1], self.dealt)[0] if self.words == 1 else keys[0] & self.masks[0, self.dealt]) * _MIX
        return ((mixed ^ (mixed >> np.uint64(29))) * _MIX >> np.uint64(32)).astype(np.int64) % parts

    def numbers(self) -> np.ndarray:
        """The number of each code point; 0 for what is no letter."""
        found = np.zeros(0x110000, np.uint32)
        found[self.letters[1:]] = np.arange(1, len(self.letters))
        return found

    def windows(self, x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows that begin at each letter of ``x``, and which of them begin a run. ``x`` ends with a zero."""
        breaks = np.flatnonzero(x == 0)
        left = np.repeat(breaks, np.diff(breaks, prepend=-1)) - np.arange(len(x))
        left = np.minimum(left, size).astype(np.int8)
        padded = np.concatenate([x, np.zeros(size, x.dtype)])
        keys = np.zeros((self.words, len(x)), np.uint64)
        step = 1 << 15  # as much as stays near the processor
        for at in range(0, len(x), step):
            n = min(step, len(x) - at)
            for j in range(size):
                v, shift = self.place(j)
                keys[v, at : at + n] |= padded[at + j : at + j + n].astype(np.uint64) << shift
            for v in range(self.words):
                keys[v, at : at + n] &= self.masks[v][left[at : at + n]]
        at = np.flatnonzero(left)
        return keys[:, at], left[at - 1] == 0  # of the first, that of the last zero


def _order(keys: np.ndarray) -> np.ndarray:
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


def _new(keys: np.ndarray) -> np.ndarray:
    """Where other ones than before begin among sorted ``keys``."""
    new = np.ones(keys.shape[1], bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(0) if len(keys) > 1 else keys[0, 1:] != keys[0, :-1]
    return np.flatnonzero(new)


def _summed(keys: np.ndarray, n: np.ndarray, begun: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not keys.shape[1]:
        return keys, n, begun
    order = _order(keys)
    keys, n, begun = keys[:, order], n[order], begun[order]
    at = _new(keys)
    return keys[:, at], np.add.reduceat(n, at), np.add.reduceat(begun, at)


def _count(keys: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different windows in order, how often each is there, and how often as the beginning of a run."""
    if len(keys) > 1:
        return _summed(keys, np.ones(keys.shape[1], np.int64), begins.astype(np.int64))
    first = np.sort(keys[:, begins], axis=1)
    keys.sort(axis=1)  # in place: it is most of what a task holds
    at = _new(keys)
    n, keys = np.diff(at, append=keys.shape[1]), keys[:, at]
    begun, at = np.zeros(len(n), np.int64), _new(first)
    begun[np.searchsorted(keys[0], first[0, at])] = np.diff(at, append=first.shape[1])
    return keys, n, begun


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, byte by byte of all, so that the bytes that are alike lie together."""
    planes = np.stack([np.ascontiguousarray(c).view(np.uint8).reshape(len(c), 8).T for c in columns])
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int, columns: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, size * columns * 8, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(columns, 8, size).transpose(0, 2, 1)).view(np.uint64).reshape(columns, size)


def _steps(keys: np.ndarray) -> list[np.ndarray]:
    return [np.diff(k, prepend=np.uint64(0)) for k in keys]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary())
    columns = zip(*rows) if rows else [()] * 4
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "sizes", "data", "more"])


def _chunks(batches: Iterator[pa.RecordBatch], code: _Code, size: int, joined: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What ``_count`` gives for the windows of every ``HELD`` letters."""
    numbers, blank = code.numbers(), np.zeros(0x110000, bool)
    blank[[c for c in range(1 << 16) if joined and _SPACE.match(chr(c))]] = True
    keys, begins, used = np.empty((code.words, 0), np.uint64), np.empty(0, bool), 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            codes = _codes(batch.column(0).slice(at, ROWS))
            k, b = code.windows(numbers[codes[~blank[codes]] if joined else codes], size)
            if used and used + len(b) > HELD:
                yield _count(keys[:, :used], begins[:used])
                used = 0
            if used + len(b) > len(begins):
                room = max(2 * len(begins), used + len(b), 1 << 20) if len(begins) * 2 < HELD else max(HELD, used + len(b))
                grown, begun = np.empty((code.words, room), np.uint64), np.empty(room, bool)
                grown[:, :used], begun[:used] = keys[:, :used], begins[:used]
                keys, begins = grown, begun
            keys[:, used : used + len(b)], begins[used : used + len(b)] = k, b
            used += len(b)
    if used:
        yield _count(keys[:, :used], begins[:used])


def _shortest(code: _Code, joined: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n, begun in _chunks(batches, code, code.dealt, joined):
            yield pa.record_batch([pa.array(keys[0].view(np.int64)), pa.array(n), pa.array(begun)], names=["key", "n", "begun"])

    return run


def _windows(code: _Code, parts: int, joined: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n, begun in _chunks(batches, code, code.size, joined):
            yield _batch([(p, [len(at)], _packed(*_steps(keys[:, at]), n[at], begun[at]), None) for p, at in _dealt(code.part(keys, parts))])

    return run


def _dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each part."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    sorted_ = part[order]
    at = np.flatnonzero(np.diff(sorted_, prepend=-1))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(part)]):
        yield int(sorted_[a]), order[a:b]


def _times_log(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1))


def _entropy(n: np.ndarray, beside: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.log(n) - (beside + _times_log(ends)) / n


class _Level:
    """Grams of one length: their letters, counts, how many begin a run, the entropy of what follows them, and the counts of their
    beginnings, shortest first."""

    def __init__(self, keys, n, begun, entropy=None, beginnings=()):
        self.keys, self.n, self.begun, self.entropy, self.beginnings = keys, n, begun, entropy, list(beginnings)

    def of(self, at: np.ndarray) -> _Level:
        return _Level(self.keys[:, at], self.n[at], self.begun[at], None if self.entropy is None else self.entropy[at], [b[at] for b in self.beginnings])


def _levels(code: _Code, keys: np.ndarray, n: np.ndarray, begun: np.ndarray, first: int, last: int) -> dict[int, _Level]:
    """The grams of ``first`` to ``last`` letters that sorted windows begin with; the longest have no entropy."""
    sums, starts = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(begun)])
    out: dict[int, _Level] = {}
    before = places = None
    for length in range(first, last + 1):
        at = _new(code.beginning(keys, length))
        to = np.append(at[1:], keys.shape[1])
        there = code.letter(keys[:, at], length - 1) > 0
        at, to = at[there], to[there]
        level = _Level(code.beginning(keys[:, at], length), sums[to] - sums[at], starts[to] - starts[at])
        if before is not None:
            of = np.searchsorted(places, at, "right") - 1
            level.beginnings = [b[of] for b in before.beginnings] + [before.n[of]]
            beside = np.bincount(of, _times_log(level.n), len(places))
            ends = before.n - np.bincount(of, level.n, len(places)).astype(np.int64)
            before.entropy = _entropy(before.n, beside, ends)
        out[length], before, places = level, level, at
    return out


class _Short:
    """The counts of all grams of fewer letters than ``code.dealt``, by length."""

    def __init__(self, code: _Code, levels: dict[int, _Level]):
        self.code, self.counts = code, {n: (x.keys[0], x.n) for n, x in levels.items() if n < code.dealt}

    def of(self, keys: np.ndarray, n: int) -> np.ndarray:
        known, count = self.counts[n]
        return count[np.searchsorted(known, self.code.beginning(keys, n)[0])]


def _told(code: _Code, levels: dict[int, _Level], least: int) -> tuple[list[int], bytes, bytes]:
    """How many grams there are of each length, their letters and counts, and what else is known of those that may be words."""
    keys, n = (np.concatenate(x, axis=-1) for x in zip(*[(x.keys, x.n) for x in levels.values()]))
    more = [np.zeros(0, np.uint64)]
    for length, x in levels.items():
        w = x.of(np.flatnonzero(x.n >= least)) if length < code.size else None
        more += [c.view(np.uint64) for c in (w.begun, w.entropy, *w.beginnings)] if w else []
    sizes = [len(levels[k].n) if k in levels else 0 for k in range(code.dealt, code.size + 1)]
    return sizes, _packed(*_steps(keys), n), _packed(np.concatenate(more))


def _heard(code: _Code, sizes: list[int], data: pa.Buffer, more: pa.Buffer, least: int) -> dict[int, _Level]:
    """What ``_told`` told; zeros for what it did not tell."""
    columns = _unpacked(data, sum(sizes), code.words + 1)
    keys, n = np.cumsum(columns[: code.words], axis=1, dtype=np.uint64), columns[-1].view(np.int64)
    levels, words, at = {}, {}, 0
    for length, size in enumerate(sizes, code.dealt):
        count = n[at : at + size]
        levels[length] = _Level(keys[:, at : at + size], count, np.zeros(size, np.int64), np.zeros(size), [np.zeros(size, np.int64) for _ in range(code.dealt, min(length, code.size - 1))])
        words[length] = np.flatnonzero(count >= least) if length < code.size else np.zeros(0, np.int64)
        at += size
    rest, at = _unpacked(more, sum(len(w) * (2 + k - code.dealt) for k, w in words.items()), 1)[0], 0
    for length, w in words.items():
        x = levels[length]
        for column in (x.begun, x.entropy, *x.beginnings) if length < code.size else ():
            column[w] = rest[at : at + len(w)].view(column.dtype)
            at += len(w)
    return levels


def _followed(code: _Code, parts: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        got = [_unpacked(d.as_buffer(), k, code.words + 2) for d, (k,) in zip(table.column("data"), table.column("sizes").to_pylist())]
        keys = np.concatenate([np.cumsum(g[: code.words], axis=1, dtype=np.uint64) for g in got], axis=1)
        n, begun = (np.concatenate([g[code.words + i] for g in got]).view(np.int64) for i in (0, 1))
        del got
        levels = _levels(code, *_summed(keys, n, begun), code.dealt, code.size)
        del keys, n, begun
        of_part: dict[int, dict[int, _Level]] = {}
        for length, all_ in levels.items():
            level = all_.of(np.flatnonzero(all_.n >= min(2, least)))
            level.keys = code.reversed(level.keys, length)
            level = level.of(_order(level.keys))
            for p, at in _dealt(code.part(level.keys, parts)):
                of_part.setdefault(p, {})[length] = level.of(at)
        return pa.Table.from_batches([_batch([(p, *_told(code, x, least)) for p, x in of_part.items()])])

    return run


def _words(code: _Code, levels: dict[int, _Level], least: int, first: int, short: _Short | None) -> pa.Table:
    """The words among reversed grams of ``first`` letters and more, that have all of their endings here. Those of ``short`` are known."""
    lengths = np.concatenate([np.full(len(x.n), length, np.int8) for length, x in levels.items()])
    keys, n = np.concatenate([x.keys for x in levels.values()], axis=1), np.concatenate([x.n for x in levels.values()])
    origin = np.concatenate([np.arange(len(x.n)) for x in levels.values()])
    order = _order(keys)  # an ending is nearer than any other gram of its length
    keys, n, lengths, origin = keys[:, order], n[order], lengths[order], origin[order]
    last = {k: np.maximum.accumulate(np.where(lengths == k, np.arange(len(n)), -1)) for k in levels}
    out = []
    for length, x in levels.items():
        if length == code.size or (short is None and length == max(levels)):
            continue
        at = np.flatnonzero((lengths == length) & (n >= least))
        if not len(at):
            continue
        of, count, own = origin[at], n[at], keys[:, at]
        letters = code.reversed(own, length)
        parts, entropy = np.zeros(len(at)), np.zeros(len(at))
        for cut in range(1, length):
            a = x.beginnings[cut - first][of] if cut >= first else short.of(letters, cut)
            rest = length - cut
            b = n[last[rest][at]] if rest >= first else short.of(code.reversed(code.beginning(own, rest), rest), rest)
            parts = np.maximum(parts, a.astype(np.float64) * b)
        if length > 1:
            longer = np.flatnonzero(lengths == length + 1)
            to = last[length][longer]
            longer, to = longer[to >= 0], to[to >= 0]
            same = (code.beginning(keys[:, longer], length) == keys[:, to]).all(0)
            beside = np.bincount(to[same], _times_log(n[longer[same]]), len(n))[at]
            entropy = np.minimum(_entropy(count, beside, x.begun[of]), x.entropy[of])
        points = np.stack([code.letters[code.letter(letters, j).astype(np.int64)] for j in range(length)], axis=1)
        words = np.ascontiguousarray(points).view(f"<U{length}").reshape(-1)
        none = np.full(len(at), length == 1)
        out.append(pa.table([pa.array(words, pa.string()), pa.array(count), pa.array(parts, mask=none), pa.array(entropy, mask=none)], names=["word", "n", "parts", "entropy"]))
    kinds = pa.schema([("word", pa.string()), ("n", pa.int64()), ("parts", pa.float64()), ("entropy", pa.float64())])
    return pa.concat_tables(out) if out else kinds.empty_table()


def _preceded(code: _Code, least: int, short):
    def run(table: pa.Table) -> pa.Table:
        columns = zip(table.column("sizes").to_pylist(), table.column("data"), table.column("more"))
        got = [_heard(code, sizes, data.as_buffer(), more.as_buffer(), least) for sizes, data, more in columns]

        def together(x: list[_Level]) -> _Level:
            return _Level(np.concatenate([y.keys for y in x], axis=1), *(np.concatenate([getattr(y, k) for y in x]) for k in ("n", "begun", "entropy")), [np.concatenate(b) for b in zip(*[y.beginnings for y in x])])

        levels = {n: together([x[n] for x in got]) for n in got[0]}
        del got
        return _words(code, levels, least, code.dealt, short.value)

    return run


def _short_words(code: _Code, least: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            levels = _levels(code, *table.value, 1, code.dealt)
            for length, x in levels.items():
                x.keys = code.reversed(x.keys, length)
            yield from _words(code, levels, least, 1, None).to_batches()

    return run


def found(texts: DataFrame, longest: int, least: int, text: str = "text", joined: bool = False) -> DataFrame:
    """(word, n, cohesion, entropy) as ``segment.candidates`` gives them of the grams of ``texts``; with ``joined`` as if these had no white space. Texts are read three times. The driver gets
    the letters that occur and the counts of the shortest grams."""
    spark, rows = texts.sparkSession, texts.select(F.col(text))
    counts = sorted((r["code"], r["n"]) for r in rows.mapInArrow(_alphabet, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in counts)
    code = _Code([c for c, _ in counts], longest + 1)
    sums = rows.mapInArrow(_shortest(code, joined), "key long, n long, begun long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("begun").alias("begun")).toArrow()
    columns = [np.asarray(c) for c in sums.columns]
    table = _summed(columns[0].view(np.uint64)[None] if code.words == 1 else np.concatenate([columns[0].view(np.uint64)[None], np.zeros((code.words - 1, len(columns[0])), np.uint64)]), *columns[1:])
    short = spark.sparkContext.broadcast(_Short(code, _levels(code, *table, 1, code.dealt)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP))
    followed = rows.mapInArrow(_windows(code, parts, joined), _PART).groupBy("part").applyInArrow(_followed(code, parts, least), _PART)
    long = followed.groupBy("part").applyInArrow(_preceded(code, least, short), _FOUND)
    few = spark.range(0, 1, 1, 1).mapInArrow(_short_words(code, least, spark.sparkContext.broadcast(table)), _FOUND)
    return long.unionByName(few).select(
        "word", "n",
        (F.round(F.log(F.col("n") * F.lit(total) / F.col("parts")), 6) + 0.0).alias("cohesion"),  # no -0.0
        (F.round("entropy", 6) + 0.0).alias("entropy"),
    )
