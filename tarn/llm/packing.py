"""Sum-of-squares bin packing of documents into fixed-length sequences.

Pieces are placed largest first. Of the open bins that have room each goes where
the sum over residual gaps of (number of open bins with that gap) squared becomes
smallest, which keeps bins of every gap at hand for the pieces to come; among equal
sums the tightest gap counts. A new bin is opened only where no open one has room,
as few sequences are wanted. Every place is decided by this rule alone.

Pieces are dealt to shards of about ``shard_items`` rows by their position, not
by any key, so no document, source or group of copies can crowd a shard. Each
shard is packed by one task on its own; the waste is a few bins a shard. Pieces
as long as a sequence fill one alone and skip the shards.

Defined cases: null and empty texts have the end id alone; rows with null or
equal doc_id are packed as separate documents; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.bpe import encoded
from tarn.llm.common import crc32_ids, stored, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SHARD_ITEMS = 50_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of ``n`` ids: full pieces,
    with what is over in the first."""
    over = n % capacity
    edges = ([0] if over else []) + list(range(over, n + 1, capacity))
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _pieces(capacity: int, end_id: int, vocab: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(texts(batch, "text"), end_id, vocab)):
                rows += [(doc_id, i, a, n, crc32_ids(ids[a : a + n].tobytes())) for i, (a, n) in enumerate(cut(len(ids), capacity))]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocab: str = "byte_bpe_50k.json") -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pieces(capacity, end_id, vocab), PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin (from 0) and the offset in it of each length."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    bins: dict[int, list[int]] = defaultdict(list)
    opened = 0
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        # change of the sum, halved, when a bin with gap n, n+1, ... takes the piece
        cost = count[: capacity + 1 - n] - count[n:] + 1.0
        cost[0] = 0.5 - count[n]  # a bin that becomes full is no longer open
        cost[count[n:] == 0] = np.inf
        best = int(cost.argmin())
        if cost[best] < np.inf:
            gap = n + best
            b = bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b, opened = capacity, opened, opened + 1
        where[i], offset[i] = b, capacity - gap
        if gap > n:
            bins[gap - n].append(b)
            count[gap - n] += 1
    return where, offset


def _packer(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        b, off = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.drop(columns=["at", "shard"]).assign(sequence_id=(rows["shard"].to_numpy() << 32) + b, offset=off)

    return run


def pack(items: DataFrame, capacity: int = 1024, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``items`` (with ``length`` from 1 to ``capacity``; stored, so that a
    repeated task reads the same rows) with sequence_id and offset added."""
    full = items.where(F.col("length") == capacity)
    part = items.where(F.col("length") < capacity)
    shards = max(1, -(-part.count() // shard_items))
    out = items.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    at = F.monotonically_increasing_id()
    dealt = part.withColumn("at", at).withColumn("shard", F.pmod(F.xxhash64("at"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(_packer(capacity), f"{out}, sequence_id long, offset long")
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocab: str = "byte_bpe_50k.json") -> DataFrame:
    """Each piece of every document with its place: sequence_id, offset."""
    return pack(stored(pieces(docs, capacity, end_id, vocab), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
