"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the smallest hash among its inner
s-mers lies at its first or last position. That depends on the k-mer alone, so
the same passage gives the same anchors in any text. A fingerprint keeps, for
each of ``BINS`` ranges of the anchors' hashes, the smallest hash and the place
where it first stands. Two fingerprints are as alike as the share of filled bins
with equal hashes, of which only those count whose places are shifted about as
the median one is: anchors must match in position, not only occur.

``with_edits`` also makes, for each row, the text whose last third is replaced
by the beginning of the next row's text. Rows are range-partitioned by doc_id;
the first row of each range also goes to the range before it, so each task sees
every row's next one and keeps two texts at a time.

Defined cases: null texts count as empty; an empty text has an empty
fingerprint, fully alike to another empty one and unlike any other; a text
without anchors (shorter than ``K``, as a rule) has one anchor made of all of
it. Rows are in descending order of doc_id, equal ids by ascending text, null
ids last; the row after the last is the first, which for a single row is
itself. Repeated rows each come out; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import texts

K, S, BINS = 12, 4, 128
#: A fingerprint's text: for each bin 4 hex digits of the hash (ffff: none) and 2 of the place.
NONE = 0xFFFF
LOWEST = -(2**63)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, over wrapping unsigned numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15


def _rolled(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` codes: windows of doubled widths joined."""
    have, at, out, done = codes, 1, None, 0
    while True:
        if width & at:
            if out is None:
                out = have
            else:
                n = len(codes) - done - at + 1
                out = out[:n] + have[done : done + n] * np.uint64(pow(_BASE, done, 1 << 64))
            done += at
        if done == width:
            return out
        n = len(codes) - 2 * at + 1
        have = have[:n] + have[at : at + n] * np.uint64(pow(_BASE, at, 1 << 64))
        at *= 2


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window."""
    at = 1
    while 2 * at <= width:
        x = np.minimum(x[:-at], x[at:])
        at *= 2
    return np.minimum(x[: len(x) - (width - at)], x[width - at :]) if width > at else x


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of ``text``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) >= K:
        inner = _mix(_rolled(codes, S))
        least = _least(inner, K - S + 1)
        at = np.flatnonzero((inner[: len(least)] == least) | (inner[K - S :] == least))
        if len(at):
            return at, _mix(_rolled(codes, K)[at])
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return np.zeros(1, np.int64), np.array([whole], np.uint64)


Sketch = tuple[np.ndarray, np.ndarray]


def sketch(text: str) -> Sketch:
    """For each bin the smallest hash's upper part (-1: none) and its place."""
    at, h = anchors(text)
    values, places = np.full(BINS, -1, np.int64), np.zeros(BINS, np.int64)
    order = np.argsort(h, kind="stable")[::-1]  # the smallest, at its first place, is written last
    h, at = h[order], at[order]
    same = np.r_[h[1:] == h[:-1], False]
    at = np.where(same, -1, at)
    keep = at >= 0
    h, at = h[keep], at[keep]
    bins = (h >> np.uint64(57)).astype(np.int64)
    values[bins] = np.minimum((h >> np.uint64(20)) & np.uint64(0xFFFF), NONE - 1).astype(np.int64)
    places[bins] = (at // 32) & 255
    return values, places


def as_text(s: Sketch) -> str:
    if (s[0] < 0).all():
        return ""
    v = np.where(s[0] < 0, NONE, s[0])
    return np.stack([v >> 8, v & 255, np.where(s[0] < 0, 255, s[1])], axis=1).astype(np.uint8).tobytes().hex()


def likeness(a: Sketch, b: Sketch) -> float:
    """0 to 1: the share of filled bins that match in hash and in position."""
    filled = (a[0] >= 0) | (b[0] >= 0)
    if not filled.any():
        return 1.0
    same = (a[0] == b[0]) & (a[0] >= 0)
    if not same.any():
        return 0.0
    shift = (a[1][same] - b[1][same] + 128) % 256 - 128
    steady = np.abs(shift - np.median(shift)) <= 4
    return float(steady.sum()) / float(filled.sum())


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([as_text(sketch(t)) for t in texts(batch, "text")], pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sketches, "doc_id long, fingerprint string")


def _dealt(bounds: np.ndarray, heads: dict[int, list[int]]):
    """Each row's range; a range's first rows also as ``halo`` of the range before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(LOWEST).to_numpy()
            own = np.searchsorted(bounds, ids)
            rows, range_, halo = [np.arange(len(ids))], [own], [np.zeros(len(ids), bool)]
            for head, before in heads.items():
                hit = np.flatnonzero(ids == head)
                for b in before if len(hit) else ():
                    rows.append(hit)
                    range_.append(np.full(len(hit), b))
                    halo.append(np.ones(len(hit), bool))
            rows = np.concatenate(rows)
            taken = batch.take(pa.array(rows))
            yield pa.record_batch([pa.array(np.concatenate(range_).astype(np.int32)), pa.array(np.concatenate(halo)), taken.column("doc_id"), taken.column("text")], names=["range", "halo", "doc_id", "text"])

    return run


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None  # range, halo, doc_id, text, sketch of the row before
    for batch in batches:
        out = []
        for range_, halo, doc_id, text in zip(batch.column("range").to_pylist(), batch.column("halo").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch, "text")):
            if halo and (last is None or last[0] != range_ or last[1]):
                last = (range_, halo, doc_id, text, None)  # a second halo row, or one without rows before it
                continue
            mine = sketch(text)
            if last is not None and last[0] == range_ and not last[1]:
                out.append(_row(last, text, mine))
            last = (range_, halo, doc_id, text, mine)
        cols = list(zip(*out)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in EDITS.split(", ")])


def _row(last: tuple, next_text: str, next_sketch: Sketch) -> tuple:
    _, _, doc_id, text, mine = last
    third = len(text) // 3
    edited = text[: len(text) - third] + next_text[:third]
    other = sketch(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, as_text(mine), as_text(other), likeness(mine, other), likeness(mine, next_sketch)


def with_edits(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint, that of its edited text, and their likeness."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("id"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("cuts")).first()["cuts"]
    bounds = sorted(set(cuts or []))
    # A range's rows are those above the bound below it, up to its own.
    bucket = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("id"))) if bounds else F.lit(0)
    first = ids.groupBy(bucket.alias("range")).agg(F.max("id").alias("head")).orderBy(F.desc("range")).collect()
    heads: dict[int, list[int]] = {}
    for i, r in enumerate(first):  # the first range's head goes to the last range
        heads.setdefault(r["head"], []).append(first[i - 1]["range"])
    dealt = rows.mapInArrow(_dealt(np.array(bounds, np.int64), heads), "range int, halo boolean, doc_id long, text string")
    placed = dealt.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "halo", F.desc_nulls_last("doc_id"), "text")
    return placed.mapInArrow(_edited, EDITS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
