"""Near copies of vectors of one label, by a robust-pruned flat graph over cluster shards.

1. Equal vectors of a label are one node with a number of copies.
2. Nodes of a label (and width) are clustered until no cluster has more than ``SHARD`` members: centres come from
   a sample of at most ``FIT`` nodes of a cluster, then every node goes to its nearest centre, which owns it,
   and as a guest to the next ones, so shards overlap.
3. Each shard's task links a node to its nearest and some random members, and robust pruning keeps
   those that no kept, nearer neighbour stands for. The lists that several shards make of a node are united where it is owned.
4. The owner's shard, its members and the neighbours of what it owns in other shards, is searched for each node it owns: a greedy
   walk with a beam, from the medoid and from the node's own neighbours, and from every node in range
   on to its neighbours until none is new. Every link is verified in double precision.
5. The audit compares the links of ``AUDIT`` sampled nodes with all nodes of their label by brute force. Below
   ``RECALL`` the search is made again with more guests and a wider beam, up to the last of ``WIDTHS``.

A cluster in which very many nodes lie close together cannot be cut without cutting links. Where a sample shows
that, all nodes within half the angle of the threshold of a leader become one ball: any two of its members are linked by the triangle
inequality, so they are counted without being compared. A ball goes on as one node with a radius. What is near it
is linked with all members if the angles say so, and else compared with them in tiles, so no task
holds a whole ball. Pairs within a shard are counted there, and only a forest of them leaves it.

Defined cases: rows whose vector is null, empty, zero or has null or non-finite components, whose label is null or
whose id is null link with nothing and are kept; vectors meet those of their own label and width; repeated rows are
linked as equal vectors are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.common import beside_least, read_table, stored
from tarn.llm.components import connected_components, forest

THRESHOLD = 0.93
#: Members of a cluster that is not cut any more, and centres it is cut by at most.
SHARD, FAN = 4096, 64
#: Times that a cluster is cut; what is too large then (vectors of one direction, say) stays whole.
LEVELS = 40
#: Nodes of a cluster that centres are fitted on, and that one task assigns at a time.
FIT, CHUNK = 2048, 16_384
#: Neighbours that pruning keeps, of so many nearest and random ones, and its factor.
DEGREE, NEAREST, RANDOM, ALPHA = 24, 48, 16, 1.2
#: Shards that a node is in, and width of the beam: first, and where the audit falls short.
WIDTHS = ((2, 16), (4, 64), (8, 256))
AUDIT, RECALL = 256, 0.95
#: Nodes of either side that a tile compares.
TILE = 2048
#: Pairs that are worked out at once.
PAIRS = 1 << 17
#: What rounding may add to an angle.
SLACK = 1e-6

MEMBER = "shard string, node long, v array<double>, copies long, r double, own boolean"
ASSIGNED = MEMBER + ", ball string"
CENTRE = "shard string, child int, ball boolean, v array<double>, home array<int>"
FOUND = "kind int, a long, b long, na long, nb long, s double"
#: Kinds of rows of a search: links of a node, an edge of a forest, a link across shards, a pair with a ball.
COUNT, EDGE, ACROSS, WIDE = range(4)


def _vectors(table: pa.Table, name: str = "v") -> np.ndarray:
    column = table[name].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32)), pa.array(x.ravel()))


def leaders(x: np.ndarray, angle: float, least: float) -> list[int]:
    """Nodes of a sample that at least so many others are within ``angle`` of, those of earlier leaders apart."""
    near, left, found = x @ x.T >= math.cos(angle), np.ones(len(x), bool), []
    while True:
        n = near[:, left].sum(1) * left
        best = int(n.argmax())
        if n[best] < least:
            return found
        found.append(best)
        left &= ~near[best]


def means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of ``k`` clusters of unit vectors."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(8):
        to = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, to, x)
        size = np.sqrt((sums**2).sum(1, keepdims=True))
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def _centres(threshold: float, overlap: int):
    half = math.acos(threshold) / 2 - SLACK

    def run(table: pa.Table) -> pa.Table:
        x, n, shard = unit(_vectors(table)), table["n"][0].as_py(), table["shard"][0].as_py()
        dense = leaders(x, half, max(8.0, len(x) * SHARD / 4 / n)) if half > 0 else []
        rest = x[(x @ x[dense].T < math.cos(half)).all(1)] if dense else x
        size = n * len(rest) / len(x)
        k = min(FAN, max(1 if dense else 2, math.ceil(1.5 * overlap * size / SHARD)))
        centres = means(rest if len(rest) else x, k, np.random.default_rng(len(x)))
        near = np.argsort(-(x[dense] @ centres.T), axis=1)[:, :overlap] if dense else np.zeros((0, 1), int)
        both = np.concatenate([x[dense], centres])
        return pa.table(
            {
                "shard": [shard] * len(both),
                "child": pa.array(range(len(both)), pa.int32()),
                "ball": [True] * len(dense) + [False] * len(centres),
                "v": _lists(both),
                "home": pa.array([[len(dense) + int(c) for c in row] for row in near] + [[]] * len(centres), pa.list_(pa.int32())),
            }
        )

    return run


def _assign(threshold: float, overlap: int):
    half = math.acos(threshold) / 2 - SLACK

    def run(rows: pa.Table, centres: pa.Table) -> pa.Table:
        if not rows.num_rows or not centres.num_rows:
            return pa.table({c: [] for c in ("shard", "node", "v", "copies", "r", "own", "ball")}, _schema())
        x, c, shard = unit(_vectors(rows)), _vectors(centres), rows["shard"][0].as_py()
        child, is_ball = centres["child"].to_numpy(), centres["ball"].to_numpy(zero_copy_only=False)
        own, r = rows["own"].to_numpy(zero_copy_only=False), rows["r"].to_numpy()
        sims = x @ c.T
        nearest = np.argsort(-sims[:, ~is_ball], axis=1)[:, :overlap]
        caught, of = np.zeros(len(x), bool), np.zeros(len(x), int)
        if is_ball.any():
            to = sims[:, is_ball]
            of = to.argmax(1)
            angle = np.arccos(np.clip(to[np.arange(len(x)), of], -1, 1))
            caught = own & (r == 0) & (angle <= half)
            r = np.where(caught, angle, r)
        plain, parts = child[~is_ball], []
        for rank in range(nearest.shape[1]):
            goes = np.flatnonzero(~caught & (own if rank else True))
            part = rows.take(pa.array(goes))
            to = [f"{plain[k]}/{shard}" for k in nearest[goes, rank]]
            parts.append(_filled(part, to, r[goes], own[goes] & (not rank), [None] * len(goes)))
        goes = np.flatnonzero(caught)
        if len(goes):
            parts.append(_filled(rows.take(pa.array(goes)), [None] * len(goes), r[goes], own[goes], [f"{b}/{shard}" for b in child[is_ball][of[goes]]]))
        return pa.concat_tables(parts)

    return run


def _schema() -> pa.Schema:
    return pa.schema([("shard", pa.string()), ("node", pa.int64()), ("v", pa.list_(pa.float64())), ("copies", pa.int64()), ("r", pa.float64()), ("own", pa.bool_()), ("ball", pa.string())])


def _filled(rows: pa.Table, shard: list, r: np.ndarray, own: np.ndarray, ball: list) -> pa.Table:
    columns = [pa.array(shard, pa.string()), rows["node"], rows["v"].cast(pa.list_(pa.float64())), rows["copies"], pa.array(r), pa.array(own), pa.array(ball, pa.string())]
    return pa.table(columns, schema=_schema())


def shards(nodes: DataFrame, threshold: float = THRESHOLD, overlap: int = WIDTHS[0][0]) -> tuple[DataFrame, DataFrame]:
    """Members of shards, and balls with their members (ball, node, v, copies, r) of ``nodes`` (shard, node, v, copies)."""
    now = nodes.select("shard", "node", "v", "copies", F.lit(0.0).alias("r"), F.lit(True).alias("own"))
    done, balls = [], []
    for level in range(LEVELS + 1):
        sizes = now.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD)
        sized = now.join(sizes, "shard")
        if level == LEVELS or not sizes.limit(1).count():
            done.append(now)
            break
        done.append(now.join(sizes.select("shard"), "shard", "left_anti"))
        first = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("node"), "node"))
        sample = sized.select("shard", "n", "node", "v").withColumn("first", first).where(F.col("first") <= FIT)
        centres = stored(sample.select("shard", "n", "v").groupBy("shard").applyInArrow(_centres(threshold, overlap), CENTRE), "centres")
        chunks = F.ceil(F.col("n") / CHUNK).cast("int")
        dealt = sized.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("chunk")), chunks).cast("int")).drop("n")
        given = centres.join(sizes, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("n")
        out = stored(dealt.groupBy("shard", "chunk").cogroup(given.groupBy("shard", "chunk")).applyInArrow(_assign(threshold, overlap), ASSIGNED), "assigned")
        caught = out.where("ball is not null")
        balls.append(caught.select("ball", "node", "v", "copies", "r"))
        size = caught.groupBy("ball").agg(F.min("node").alias("least"), F.sum("copies").alias("copies"), F.max("r").alias("r"))
        at = centres.where("ball").select(F.concat_ws("/", "child", "shard").alias("ball"), "shard", "v", F.posexplode("home").alias("place", "child"))
        as_node = at.join(size, "ball").select(F.concat_ws("/", "child", "shard").alias("shard"), (-F.col("least") - 1).alias("node"), "v", "copies", "r", (F.col("place") == 0).alias("own"))
        # A node that a ball took is no guest of another shard: the ball stands for it.
        now = out.where("ball is null").drop("ball").join(caught.select("node"), "node", "left_anti").select(*as_node.columns).unionByName(as_node)
    members = done[0]
    for more in done[1:]:
        members = members.unionByName(more)
    if not balls:
        return members, nodes.select(F.lit("").alias("ball"), "node", "v", "copies", F.lit(0.0).alias("r")).limit(0)
    held = balls[0]
    for more in balls[1:]:
        held = held.unionByName(more)
    return members.join(held.select("node"), "node", "left_anti"), held


def pruned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of each node's neighbours that robust pruning keeps."""
    x, n, rng = x.astype(np.float32), len(x), np.random.default_rng(len(x))
    k, src, dst = min(NEAREST, n - 1), [], []
    for at in range(0, n if k > 0 else 0, 256):
        sims = x[at : at + 256] @ x.T
        here = np.arange(len(sims))
        sims[here, at + here] = -3
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        pool = np.concatenate([near, rng.integers(0, n, (len(sims), RANDOM))], axis=1)
        far = 2 - 2 * np.take_along_axis(sims, pool, 1)
        apart = 2 - 2 * (x[pool] @ x[pool].transpose(0, 2, 1))
        alive = pool != (at + here)[:, None]
        for _ in range(DEGREE):
            pick = np.where(alive, far, np.inf).argmin(1)
            is_one = alive[here, pick]
            src.append(at + here[is_one])
            dst.append(pool[here, pick][is_one])
            alive &= ALPHA**2 * apart[here, pick] > far
            alive[here, pick] = False
    return (np.concatenate(src), np.concatenate(dst)) if src else (np.zeros(0, int), np.zeros(0, int))


def _graph(table: pa.Table) -> pa.Table:
    node = table["node"].to_numpy()
    a, b = pruned(unit(_vectors(table)))
    return pa.table({"shard": table["shard"].combine_chunks().take(pa.array(a)), "src": node[a], "dst": node[b]})


class Walk:
    """Greedy search over a graph of unit vectors ``x`` (each with a radius), and what is in range."""

    def __init__(self, x: np.ndarray, r: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, beam: int):
        both = np.unique(np.concatenate([a * len(x) + b, b * len(x) + a]))
        self.x, self.r, self.beam, self.angle = x, r, beam, math.acos(threshold)
        self.to = both % len(x)
        self.first = np.searchsorted(both // len(x), np.arange(len(x) + 1))
        self.threshold, self.medoid = threshold, int((x @ x.mean(0)).argmax())

    def near(self, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All neighbours of ``v``, each with its ``q``."""
        n = self.first[v + 1] - self.first[v]
        at = np.repeat(self.first[v] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(q, n), self.to[at]

    def reach(self, own: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of ``own[q]`` and ``v``, and which are in range."""
        u = own[q]
        s = np.concatenate([np.einsum("ij,ij->i", self.x[u[at : at + PAIRS]], self.x[v[at : at + PAIRS]]) for at in range(0, len(u), PAIRS)] or [np.zeros(0)])
        wide = self.r[u] + self.r[v]
        limit = np.where(wide > 0, np.cos(np.minimum(math.pi, self.angle + wide + SLACK)), self.threshold)
        return s, s >= limit

    def search(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``own``, node, cosine) of all nodes found in range of the nodes ``own``."""
        m, rows = len(own), np.arange(len(own))
        seen = np.zeros((m, len(self.x)), bool)
        seen[rows, own] = True
        ids, sims, told = np.zeros((m, self.beam), int), np.full((m, self.beam), -np.inf), np.ones((m, self.beam), bool)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            new = ~seen[q, v]
            code = np.unique(q[new] * len(self.x) + v[new])
            q, v = code // len(self.x), code % len(self.x)
            seen[q, v] = True
            s, inside = self.reach(own, q, v)
            hits.append((q[inside], v[inside], s[inside]))
            return q, v, s

        q, v = self.near(rows, own)
        q, v = np.concatenate([rows, q]), np.concatenate([np.full(m, self.medoid), v])
        while len(q):
            q, v, s = visit(q, v)
            if len(q):
                n = np.bincount(q, minlength=m)
                place = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
                wide = int(n.max())
                more_ids, more = np.zeros((m, wide), int), np.full((m, wide), -np.inf)
                more_ids[q, place], more[q, place] = v, s
                ids, sims = np.concatenate([ids, more_ids], 1), np.concatenate([sims, more], 1)
                told = np.concatenate([told, np.isinf(more)], 1)
                best = np.argpartition(-sims, self.beam - 1, axis=1)[:, : self.beam]
                ids, sims, told = (np.take_along_axis(y, best, 1) for y in (ids, sims, told))
            pick = np.where(told, -np.inf, sims).argmax(1)
            goes = np.flatnonzero(~told[rows, pick])
            told[rows, pick] = True
            q, v = self.near(goes, ids[goes, pick[goes]])
        front = [tuple(np.concatenate(y) for y in list(zip(*hits))[:2])] if hits else []
        while front:  # from what is in range to its neighbours
            q, v = front.pop()
            for at in range(0, len(q), PAIRS // 8):
                before = len(hits)
                visit(*self.near(q[at : at + PAIRS // 8], v[at : at + PAIRS // 8]))
                front += [(a, b) for a, b, _ in hits[before:] if len(a)]
        return tuple(np.concatenate(y) for y in zip(*hits)) if hits else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _search(threshold: float, beam: int):
    def run(points: pa.Table, edges: pa.Table) -> pa.Table:
        order = np.argsort(points["node"].to_numpy(), kind="stable") if points.num_rows else []
        points = points.take(pa.array(order, pa.int64()))
        node, own = points["node"].to_numpy(), points["own"].to_numpy(zero_copy_only=False)
        if len(node) < 2 or not own.any():
            return _rows([])
        copies, r = points["copies"].to_numpy(), points["r"].to_numpy()
        a, b = edges["src"].to_numpy(), edges["dst"].to_numpy()
        walk = Walk(unit(_vectors(points)), r, np.searchsorted(node, a), np.searchsorted(node, b), threshold, beam)
        mine, inner, out = np.flatnonzero(own), [], []
        for at in range(0, len(mine), 512):
            part = mine[at : at + 512]
            q, v, s = walk.search(part)
            u = part[q]
            wide, across = (r[u] > 0) | (r[v] > 0), ~own[v]
            out.append((WIDE, node[u[wide]], node[v[wide]], copies[u[wide]], copies[v[wide]], s[wide]))
            far = across & ~wide
            out.append((ACROSS, node[u[far]], node[v[far]], copies[u[far]], copies[v[far]], s[far]))
            at_home = ~across & ~wide
            inner.append(np.unique(np.minimum(u, v)[at_home] * len(node) + np.maximum(u, v)[at_home]))
        code = np.unique(np.concatenate(inner))
        u, v = code // len(node), code % len(node)
        n = np.zeros(len(node), np.int64)
        np.add.at(n, u, copies[v])
        np.add.at(n, v, copies[u])
        has = np.flatnonzero(n)
        out.append((COUNT, node[has], node[has], n[has], n[has], np.zeros(len(has))))
        moved, root = forest(node[u], node[v])
        out.append((EDGE, moved, root, moved * 0, moved * 0, np.zeros(len(moved))))
        return _rows(out)

    return run


def _rows(parts: list[tuple]) -> pa.Table:
    kind = np.concatenate([np.full(len(p[1]), p[0], np.int32) for p in parts] or [np.zeros(0, np.int32)])
    cols = [np.concatenate([p[i] for p in parts] or [np.zeros(0)]).astype(t) for i, t in zip(range(1, 6), (np.int64,) * 4 + (np.float64,))]
    return pa.table({name.split()[0]: c for name, c in zip(FOUND.split(", "), [kind, *cols])})


def _tiles(threshold: float):
    def run(members: pa.Table, others: pa.Table) -> pa.Table:
        if not members.num_rows or not others.num_rows:
            return _rows([])
        a, b = members["node"].to_numpy(), others["node"].to_numpy()
        near = unit(_vectors(members)) @ unit(_vectors(others)).T >= threshold
        n, m = near @ others["copies"].to_numpy(), members["copies"].to_numpy() @ near
        x, y = np.flatnonzero(n), np.flatnonzero(m)
        some = a[near[:, y].argmax(0)] if len(y) else a[:0]  # members are all linked, so one of them stands for those
        return _rows([(COUNT, a[x], a[x], n[x], n[x], np.zeros(len(x))), (COUNT, b[y], b[y], m[y], m[y], np.zeros(len(y))), (EDGE, some, b[y], some * 0, some * 0, np.zeros(len(y)))])

    return run


def _with_balls(found: DataFrame, held: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, n) and edges (a, b) that balls give: those of their members among each other, and with what is near."""
    angle = math.acos(threshold)
    size = stored(held.groupBy("ball").agg(F.min("node").alias("least"), F.sum("copies").alias("m"), F.max("r").alias("r"), F.count("*").alias("rows")).withColumn("at", -F.col("least") - 1), "balls")
    inside = held.join(size.select("ball", "at", "least", "m"), "ball").select("at", "least", "m", "node", "v", "copies")
    counts = [inside.select("node", (F.col("m") - F.col("copies")).alias("n"))]
    edges = [inside.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))]
    pairs = found.where(F.col("kind") == WIDE).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"), "s").dropDuplicates(["a", "b"])
    ball = size.select(F.col("at").alias("a"), F.col("m").alias("na"), F.col("r").alias("ra"), F.col("least").alias("la"))
    other = size.select(F.col("at").alias("b"), F.col("r").alias("rb"), F.col("least").alias("lb"))
    near = pairs.join(ball, "a").join(other, "b", "left").withColumn("rb", F.coalesce("rb", F.lit(0.0)))
    near = stored(near.withColumn("whole", F.acos(F.least(F.col("s"), F.lit(1.0))) + F.col("ra") + F.col("rb") <= angle - SLACK), "near-balls")
    whole = near.where("whole")
    to_ball = whole.select(F.col("a").alias("at"), F.col("nb").alias("n")).unionByName(whole.where("b < 0").select(F.col("b").alias("at"), F.col("na").alias("n")))
    counts.append(whole.where("b >= 0").select(F.col("b").alias("node"), F.col("na").alias("n")))
    counts.append(inside.select("at", "node").join(to_ball.groupBy("at").agg(F.sum("n").alias("n")), "at").select("node", "n"))
    edges.append(whole.select(F.col("la").alias("a"), F.coalesce("lb", "b").alias("b")))
    open_ = near.where("not whole").select("a", "b")
    points = open_.where("b >= 0").join(nodes.select(F.col("node").alias("b"), "v", "copies"), "b").select("a", F.col("b").alias("node"), "v", "copies")
    of_balls = open_.where("b < 0").join(inside.select(F.col("at").alias("b"), "node", "v", "copies"), "b").select("a", "node", "v", "copies")
    around = stored(points.unionByName(of_balls), "around-balls")
    tiles = around.groupBy("a").agg(F.ceil(F.count("*") / TILE).cast("int").alias("xs")).join(size.select(F.col("at").alias("a"), F.ceil(F.col("rows") / TILE).cast("int").alias("ms")), "a")

    def dealt(side: DataFrame, own: str, others: str) -> DataFrame:
        place = F.pmod(F.xxhash64("node"), F.col(own)).cast("int")
        rows = side.join(tiles, "a").select("a", "node", "v", "copies", place.alias(own[0]), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(others[0]))
        return rows.select("a", "x", "m", "node", "v", "copies")

    left, right = dealt(inside.select(F.col("at").alias("a"), "node", "v", "copies"), "ms", "xs"), dealt(around, "xs", "ms")
    told = stored(left.groupBy("a", "x", "m").cogroup(right.groupBy("a", "x", "m")).applyInArrow(_tiles(threshold), FOUND), "tiles")
    counts.append(told.where(F.col("kind") == COUNT).select(F.col("a").alias("node"), F.col("na").alias("n")))
    edges.append(told.where(F.col("kind") == EDGE).select("a", "b"))
    return _all(counts), _all(edges)


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def linked(nodes: DataFrame, threshold: float = THRESHOLD, overlap: int = WIDTHS[0][0], beam: int = WIDTHS[0][1]) -> tuple[DataFrame, DataFrame]:
    """(node, n): the copies of other nodes that a node is linked with, and edges (a, b) that connect
    what is linked, of ``nodes`` (shard: what may be linked, node, v, copies)."""
    members, held = shards(nodes, threshold, overlap)
    members, held = stored(members, "members"), stored(held, "held")
    graph = stored(members.groupBy("shard").applyInArrow(_graph, "shard string, src long, dst long"), "graph")
    own = members.where("own").select("node", "v", "copies", "r")
    # A shard has the lists made in it, and those that other shards made of the nodes it owns.
    owners = members.where("own").select(F.col("node").alias("src"), F.col("shard").alias("owner"))
    abroad = graph.join(owners, "src").where("shard <> owner").select(F.col("owner").alias("shard"), "src", "dst")
    out = stored(graph.unionByName(abroad).distinct(), "lists")
    guests = out.select("shard", F.col("dst").alias("node")).distinct().join(members.select("shard", "node"), ["shard", "node"], "left_anti")
    points = members.select("shard", "node", "v", "copies", "r", "own").unionByName(guests.join(own, "node").select("shard", "node", "v", "copies", "r", F.lit(False).alias("own")))
    found = stored(points.groupBy("shard").cogroup(out.groupBy("shard")).applyInArrow(_search(threshold, beam), FOUND), "found")
    is_less = F.col("a") < F.col("b")
    across = found.where(F.col("kind") == ACROSS).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(is_less, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(is_less, F.col("nb")).otherwise(F.col("na")).alias("nb")
    ).distinct()
    counts = [found.where(F.col("kind") == COUNT).select(F.col("a").alias("node"), F.col("na").alias("n"))]
    counts += [across.select(F.col("a").alias("node"), F.col("nb").alias("n")), across.select(F.col("b").alias("node"), F.col("na").alias("n"))]
    joined = [found.where(F.col("kind") == EDGE).select("a", "b"), across.select("a", "b")]
    if held.limit(1).count():
        n, e = _with_balls(found, held, nodes, threshold)
        counts, joined = [*counts, n], [*joined, e]
    return stored(_all(counts).groupBy("node").agg(F.sum("n").alias("n")), "counts"), _all(joined)


def _brute(sample: list[tuple], threshold: float):
    by_shard: dict[str, list[tuple]] = {}
    for shard, node, v in sample:
        by_shard.setdefault(shard, []).append((node, v))
    known = {s: (np.array([n for n, _ in rows]), unit(np.array([v for _, v in rows], float))) for s, rows in by_shard.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            shard, node, copies = np.array(table["shard"].to_pylist(), object), table["node"].to_numpy(), table["copies"].to_numpy()
            for s, (ids, x) in known.items():
                at = np.flatnonzero(shard == s)
                if not len(at):
                    continue
                near = (x @ unit(_vectors(table.take(pa.array(at)))).T >= threshold) & (ids[:, None] != node[at][None, :])
                yield pa.record_batch([pa.array(ids), pa.array(near @ copies[at])], names=["node", "n"])

    return run


def audit(nodes: DataFrame, counts: DataFrame, threshold: float = THRESHOLD, size: int = AUDIT) -> float:
    """The share of the links of ``size`` nodes, compared with all nodes that they may be linked with, that ``counts`` has."""
    sample = nodes.orderBy(F.xxhash64("node", F.lit("audit")), "node").limit(size).select("shard", "node", "v").collect()
    true = nodes.select("shard", "node", "v", "copies").mapInArrow(_brute([tuple(r) for r in sample], threshold), "node long, n long").groupBy("node").agg(F.sum("n").alias("true"))
    got = true.join(counts, "node", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("n", F.lit(0))))).first()
    return got[1] / got[0] if got[0] else 1.0


def near_copies(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id, kept) of every row, and the recall that the audit found."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    usable = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(usable & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.lit(False))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Rows of one vector are dealt to parts, so that a vector that many have is no task's alone.
    dealt = rows.where(usable).select("vec_id", F.concat(F.lit("|"), F.size("v").cast("string"), F.lit(":"), "label").alias("shard"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"))
    of_part = dealt.groupBy("shard", "v", "part").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = of_part.groupBy("shard", "v").agg(F.min("least").alias("least"), F.sum("copies").alias("copies"))
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    for overlap, beam in WIDTHS:
        counts, edges = linked(nodes, threshold, overlap, beam)
        recall = audit(nodes, counts, threshold)
        if recall >= RECALL:
            break
    roots = connected_components(edges)
    of = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    told = beside_least(of.withColumnRenamed("least", "first"), "root", "first").select("node", F.col("least").alias("component_id"))
    known = nodes.join(told, "node").join(counts, "node", "left").select("shard", "v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    placed = of_part.select("shard", "v", "part").join(known, ["shard", "v"])
    out = dealt.join(placed, ["shard", "v", "part"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone), recall


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(read_table(spark, sf_dir, "embeddings"))[0]


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
    AND list_contains(list_transform(embedding, lambda x: x <> 0), true)
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, coalesce(vec_id = least(vec_id, coalesce(c.b, vec_id)), true) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
