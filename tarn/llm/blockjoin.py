"""Nearest neighbours by an int8 block matrix join.

Vectors are scaled to length 1 and quantised to int8 with a scale of their own.
Query blocks meet candidate blocks; matrix products of the quantised tiles over ``COLUMNS``
columns each (integers below 2^24, exact in float32), added as integers, give every cosine up
to a bound that follows from the two quantisation errors:

    |q.c - q'.c'| <= |q - q'| * |c'| + |q| * |c - c'|

A candidate survives if its upper bound reaches the ``k``-th best lower bound of
its query in the tile. Survivors are recomputed in double precision on the
original vectors, each tile keeps a query's ``k`` best in a heap, and the heaps of
all tiles are merged. Nothing is approximate in the end: the bound proves that
no nearer candidate was left out.

A tile has at most ``C_BLOCK`` candidates and ``Q_BLOCK`` queries, which bounds a
task's memory. Rows go to blocks by hash of their id, so blocks are of even
size. Equal vectors within a tile are compared once, with the ids of the
``k + 1`` smallest copies: no more of them can be among the nearest.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows with a null id; vectors meet those of their own
width only, as there is no cosine with others; ties go to the smaller id; repeated rows
(equal id and vector) are one candidate each, save of their own id's query, and ask
once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


C_BLOCK, Q_BLOCK, K, EVERY = 8_192, 2_048, 5, 50
#: Columns whose products of int8 numbers add up to less than 2^24.
COLUMNS = 1_024
OUT = "query_id long, vec_id long, score double"


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the lengths of the quantised rows and of the errors."""
    scale = np.abs(unit).max(1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt((back**2).sum(1)), np.sqrt(((unit - back) ** 2).sum(1))


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, cosine) of each query's ``k`` nearest in the tile."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    _, first, same = np.unique(np.ascontiguousarray(c).view(np.dtype((np.void, c.dtype.itemsize * c.shape[1]))).ravel(), return_index=True, return_inverse=True)
    copies: list[list[int]] = [[] for _ in first]
    for i, g in zip(c_ids.tolist(), same.tolist()):
        if len(copies[g]) <= k:  # in ascending order of id
            copies[g].append(i)
    c = c[first].astype(np.float64)
    q = q.astype(np.float64)
    cu, qu = _unit(c), _unit(q)
    c8, cs, cn, ce = quantised(cu)
    c8 = c8.astype(np.float32).T.copy()
    # Powers of two keep squares from overflow and change no digit of a cosine.
    c, q = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (c, q))
    out = []
    for at in range(0, len(q), 128):
        part = qu[at : at + 128]
        q8, qs, _, qe = quantised(part)
        sums = np.zeros((len(part), len(c)))
        for first in range(0, c8.shape[0], COLUMNS):
            sums += q8[:, first : first + COLUMNS].astype(np.float32) @ c8[first : first + COLUMNS]
        near = sums * (qs[:, None] * cs[None, :])
        slack = qe[:, None] * cn[None, :] + ce[None, :] + 1e-9
        # One more than k, as the query itself may be among the candidates.
        kth = min(k + 1, near.shape[1])
        floor = np.partition(near - slack, near.shape[1] - kth, axis=1)[:, near.shape[1] - kth]
        for r, cols in enumerate(near + slack >= floor[:, None]):
            cols = np.flatnonzero(cols)
            own = int(q_ids[at + r])
            a, b = q[at + r], c[cols]
            # summed in order, so that the numbers do not depend on the tile
            dot, bb, aa = (np.cumsum(x, axis=-1)[..., -1] for x in (a * b, b * b, a * a))
            cosine = np.clip(dot / np.sqrt(aa * bb), -1.0, 1.0)
            heap: list[tuple[float, int]] = []
            for s, g in zip(cosine.tolist(), cols.tolist()):
                for i in copies[g]:
                    if i == own:
                        continue
                    item = (s, -i)
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
            out += [(own, -i, s) for s, i in heap]
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _tiles(k: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        asks = table["asks"].to_numpy(zero_copy_only=False)
        if len(asks) and asks.any() and not asks.all():
            ids, x = table["id"].to_numpy(), _vectors(table["v"].combine_chunks())
            found = tile(ids[asks], x[asks], ids[~asks], x[~asks], k)
            cols = list(zip(*found)) or [()] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def _fit(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    kind = df.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
    return rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` nearest others of its width.
    ``is_query`` is a condition on the column ``id``, which has the ids as long numbers."""
    rows = _fit(df, id_col, vector_col)
    n_c, n_q = rows.agg(F.count("*"), F.count_if(is_query)).first()
    c_blocks, q_blocks = max(1, -(-n_c // C_BLOCK)), max(1, -(-n_q // Q_BLOCK))
    # Of rows equal in id and vector a block gets ``k + 1`` at most, as no more can be among the nearest.
    once = rows.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k + 1)).cast("int").alias("n"))

    def dealt(side: DataFrame, blocks: int, others: int, asks: bool) -> DataFrame:
        own = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        c, q = (other, own) if asks else (own, other)
        return side.select("id", "v", F.lit(asks).alias("asks"), F.size("v").alias("w"), c.alias("c"), q.alias("q"))

    candidates = once.select("id", "v", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    both = dealt(candidates, c_blocks, q_blocks, False).unionByName(dealt(once.where(is_query), q_blocks, c_blocks, True))
    found = both.groupBy("w", "c", "q").applyInArrow(_tiles(k), OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % EVERY == 0)


SQL = f"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
    AND list_contains(list_transform(embedding, lambda x: x <> 0), true)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
