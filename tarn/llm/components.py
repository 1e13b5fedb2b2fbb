"""Connected components of an edge table, by alternating large and small stars.

Each round replaces edges by edges to smaller neighbours until every node hangs
on the smallest node of its component. The result of a star is written to the shared folder, so lineage stays
short and nothing but two numbers comes to the driver. A node with many neighbours is split
among tasks.

Every round costs the driver memory for its plans, stages and threads, so there are as few as can be: a task
first replaces the edges that it has by a forest that connects the same nodes, and as soon as no more than
``ONE`` edges are left, which a long chain needs many rounds for, one task joins them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import beside_least, released, stored_at

#: Edges (of 16 bytes) that one task may hold: so many are joined at once, and more are given out in parts.
ONE = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that the edges join to a smaller one, ascending, and the smallest that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # of two roots, the larger one hangs on the smaller
        while not np.array_equal(root, above := root[root]):
            root = above
    moved = np.flatnonzero(root < np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _forests(most: int, names: tuple[str, str] = ("a", "b")):
    """Forests of what a task reads; one alone if that connects fewer than ``most`` nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held, limit = [], [], 0, most
        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held < limit:
                continue
            left = forest(np.concatenate(a), np.concatenate(b))
            if len(left[0]) >= most:
                yield pa.record_batch(list(map(pa.array, left)), names=names)
                left = left[0][:0], left[1][:0]
            a, b, held = [left[0]], [left[1]], len(left[0])
            limit = held + most
        if held:
            yield pa.record_batch(list(map(pa.array, forest(np.concatenate(a), np.concatenate(b)))), names=names)

    return run


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = beside_least(_both_ways(edges), "a", "b")
    return near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "least").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = beside_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "a", "b")
    moved = down.select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(down.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (node, root): every node that has an edge to
    another one, with the smallest node of its component. The smallest node
    itself is not listed."""
    now, path = stored_at(edges.where("a <> b").select("a", "b").mapInArrow(_forests(ONE), "a long, b long").distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or tuple(state) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(state)
        if state["n"] <= ONE:
            whole = stored_at(now.coalesce(1).mapInArrow(_forests(ONE + 1, ("node", "root")), "node long, root long"), "components")[0]
            released(now.sparkSession, path)
            return whole
        for star in (_large_star, _small_star):  # each a plan of its own
            before = path
            now, path = stored_at(star(now), "edges")
            released(now.sparkSession, before)
