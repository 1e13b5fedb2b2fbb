"""Importance resampling towards a target distribution, by hashed word features.

Texts are lists of words of digits, letters and bytes beyond ASCII, A-Z in lower case; features are
all runs of 1 to ``longest`` words, joined by one space. A feature's bucket is the CRC-32 of its bytes
modulo ``buckets``. From the counts of the buckets in all documents and in all target
texts follows a gain for each bucket, a document's weight is the sum of its features' gains, and
a Gumbel draw by the document's id turns weights into a sample without replacement: the highest
scores are drawn.

Features are found by a byte automaton over whole Arrow columns. A table of 256 entries classifies and
lower-cases the column's UTF-8 buffer at once; words are where the class changes (a difference of
neighbours, cut at the ends of texts too), and the CRCs of all words that have a k-th
byte advance by it together. Words of more than ``STEPS`` bytes are finished one by one, so that a
long one does not hold up the others.

Two passes read the texts: one leaves a count for each bucket and task, one makes the weights. The
driver gets ``buckets`` pairs of numbers, whatever the corpus. Ranks come from sorted ranges, so no
task holds all documents.

Defined cases: null and empty texts have no features and weight 0; a null id draws as the empty text and
comes last among ties; rows that share an id and a text have neighbouring ranks; an empty table or an empty target
gives gains from the added counts alone; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import read_table, stored
from tarn.operators.rank_cut import ranked_overall

LONGEST, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: Bytes of a word that advance together with those of all others.
STEPS = 64
#: Bytes of text that are worked out at once.
HELD = 1 << 22
SPACE = 0x20


def _crc_table() -> np.ndarray:
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, np.uint32(0xEDB88320) ^ (row >> 1), row >> 1)
    return row


CRC = _crc_table()
#: A byte of a word as it counts (A-Z in lower case), 0 for all others.
WORD = np.array([b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 0x20 if 0x41 <= b <= 0x5A else 0 for b in range(256)], np.uint8)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as they count, where words begin and end, and the text each is of."""
    low = WORD[data]
    inside = np.zeros(len(low) + 1, np.int8)
    inside[:-1] = low != 0
    turn = np.diff(inside, prepend=np.int8(0))
    # Two words that meet where a text ends and the next begins are cut there.
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(low))])
    cut = cut[(inside[cut] == 1) & (inside[cut - 1] == 1)]
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return low, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def advanced(crc: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each inner CRC state after the bytes from its start to its end."""
    crc, lengths = crc.copy(), ends - starts
    order = np.argsort(-np.minimum(lengths, STEPS), kind="stable")
    at, state = starts[order], crc[order]
    left = np.searchsorted(-np.minimum(lengths[order], STEPS), -np.arange(STEPS), "left")  # words that have a k-th byte
    for k in range(STEPS):
        n = left[k]
        if not n:
            break
        state[:n] = CRC[(state[:n] ^ low[at[:n] + k]) & 0xFF] ^ (state[:n] >> 8)
    crc[order] = state
    for i in np.flatnonzero(lengths > STEPS):
        rest = low[starts[i] + STEPS : ends[i]].tobytes()
        crc[i] = zlib.crc32(rest, int(crc[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return crc


def features(data: np.ndarray, offsets: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(CRC-32, text) of all runs of 1 to ``longest`` words, those of one length at a time."""
    low, starts, ends, text = words_of(data, offsets)
    state = advanced(np.full(len(starts), 0xFFFFFFFF, np.uint32), low, starts, ends)
    yield state ^ np.uint32(0xFFFFFFFF), text
    for more in range(1, longest):
        n = max(0, len(starts) - more)
        first = np.flatnonzero(text[:n] == text[more : more + n])
        crc = CRC[(state[first] ^ SPACE) & 0xFF] ^ (state[first] >> 8)
        state[first] = crc = advanced(crc, low, starts[first + more], ends[first + more])
        yield crc ^ np.uint32(0xFFFFFFFF), text[first]


def _buffers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The UTF-8 bytes of a string column and where its texts begin and end, some at a time."""
    column = column.cast(pa.large_binary())
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if places is not None and len(column) else np.zeros(1, np.int64)
    if column.null_count:  # a null's bytes, if any, do not count
        column = pa.array([x or b"" for x in column.to_pylist()], pa.large_binary())
        _, places, data = column.buffers()
        offsets = np.frombuffer(places, np.int64)[: len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + HELD, "right")) - 1)
        yield whole[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _counted(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, offsets in _buffers(batch.column(0)):
                for crc, _ in features(data, offsets, longest):
                    n += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(n)
        yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(n[held])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts each bucket has."""
    found = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counted(buckets, longest), "bucket int, n long")
    counts = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():  # ``buckets`` rows at most
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's shares, one added to each count; floors."""
    s, t, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * float(s + k) / ((float(a) + 1) * float(t + k)))) for a, b in zip(source, target)], np.int64)


def _weighed(gain: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, grams, weight = [], [], []
            for data, offsets in _buffers(batch.column(1)):
                n = len(offsets) - 1
                w, g, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for length, (crc, text) in enumerate(features(data, offsets, longest)):
                    if not len(text):
                        continue
                    each = np.bincount(text, minlength=n)
                    g += each
                    if not length:
                        w += each
                    first = np.flatnonzero(np.diff(text, prepend=-1))
                    total[text[first]] += np.add.reduceat(gain[crc % np.uint32(len(gain))], first)
                words, grams, weight = [*words, w], [*grams, g], [*weight, total]
            cols = [np.concatenate([*c, np.zeros(0, np.int64)]) for c in (words, grams, weight)]
            yield pa.record_batch([batch.column(0), *map(pa.array, cols)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_weighed(gain, longest), "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw by the id: it repeats."""
    low = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((low + F.lit(0.5)) / F.lit(4294967296.0))))


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; of the rows with ``least_words``
    or more the given share is drawn and has a rank."""
    gain = gains(bucket_counts(docs, buckets=buckets, longest=longest), bucket_counts(target, buckets=buckets, longest=longest))
    scored = stored(weights(docs, gain, longest=longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "importance")
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = ranked_overall(scored.where(able).select(*columns), [F.desc("score"), F.asc_nulls_last("doc_id")])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: CRC-32 of a text ``x`` in SQL: a table of 256 entries by rule, folded over the bytes.
SQL_CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(
  [CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"""


def sql_crc(x: str) -> str:
    """``x``'s CRC-32; needs ``crc`` in scope. The first of the list is the start value, the bytes follow."""
    bytes_ = f"list_transform(range(1, length(hex(encode({x}))) // 2 + 1), lambda j: CAST(('0x' || substr(hex(encode({x})), CAST(2 * j - 1 AS BIGINT), 2)) AS BIGINT))"
    fold = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, b: xor(crc[CAST((xor(c, b) & 255) + 1 AS BIGINT)], c >> 8))"
    return f"xor({fold}, CAST(4294967295 AS BIGINT))"


SQL_WORDS = r"list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
SQL = f"""
WITH {SQL_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS} AS w FROM documents),
b AS (SELECT {SQL_WORDS} AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
known AS MATERIALIZED (SELECT word, {sql_crc('word')} % {BUCKETS} AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc_table),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN known USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN known USING (word) GROUP BY bucket),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT sum(n) FROM s) + {BUCKETS})::DOUBLE / ((s.n::DOUBLE + 1) * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN known USING (word) JOIN g USING (bucket) GROUP BY r),
n AS (SELECT d.r, doc_id, CAST(len(d.w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS noise FROM d LEFT JOIN w USING (r)),
c AS (SELECT doc_id, n_features, weight, weight + noise AS score, n_features >= {LEAST_WORDS} AS able FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, {PERCENT} * (SELECT count(*) FROM c WHERE able) // 100 AS drawn FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= drawn THEN place END AS rank FROM k
"""
