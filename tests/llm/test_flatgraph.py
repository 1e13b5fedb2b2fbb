"""Near copies of vectors against all pairs: clusters, balls, tiles and hard rows."""

import math

import duckdb
import numpy as np

from tarn.llm import flatgraph
from tests.conftest import SF
from tests.test_engine import rows_of

SCHEMA = "vec_id long, embedding array<double>, label int, node long"


def brute(rows, threshold=0.93):
    at = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and None not in v and all(map(math.isfinite, v)) and any(v):
            at.setdefault((label, len(v)), []).append((i, v))
    out = {i: (0, i) for i, _, _ in rows}
    for group in at.values():
        x = flatgraph.unit(np.array([v for _, v in group], float))
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        root = list(range(len(group)))
        for _ in range(len(group)):
            new = [min([root[j] for j in np.flatnonzero(row)] + [root[i]], key=lambda k: group[k][0]) for i, row in enumerate(near)]
            if new == root:
                break
            root = new
        for i, (v, _) in enumerate(group):
            out[v] = (int(near[i].sum()), group[root[i]][0])
    return out


def clouds(seed, parts, alone, d=16):
    rng = np.random.default_rng(seed)
    rows = []
    for m, spread in parts:
        base = rng.normal(size=d)
        base /= np.linalg.norm(base)
        rows += [base + spread * rng.normal(size=d) for _ in range(m)]
    rows += list(rng.normal(size=(alone, d)))
    order = rng.permutation(len(rows))
    return [(int(7 * i + 2), [float(a) for a in rows[k]], int(i % 11 == 0)) for i, k in enumerate(order)]


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(4)
    out, recall = flatgraph.near_copies(df)
    return out.collect(), recall


def compared(spark, rows):
    got, recall = found(spark, rows)
    want = brute(rows)
    links = {r["vec_id"]: r["n_links"] for r in got}
    assert len(got) == len(rows) and all(links[i] <= want[i][0] for i in links)  # none below the threshold
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert recall >= 0.95
    true = sum(n for n, _ in want.values())
    return sum(links.values()) / max(true, 1), {r["vec_id"]: r["component_id"] for r in got}, {i: c for i, (_, c) in want.items()}


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df = flatgraph.query(spark, SF)
    assert rows_of(df.toPandas()) == rows_of(con.sql(flatgraph.SQL).df()[df.columns])


def test_one_shard_is_all_pairs(spark):
    rows = clouds(1, [(60, 0.01), (40, 0.06), (30, 0.09), (2, 0.02)], 150) + [(1, [3.0] * 16, 0), (0, [0.5] * 16, 0)]
    share, got, want = compared(spark, rows)
    assert share >= 0.99 and got == want


def test_many_shards_with_balls_and_tiles(spark, monkeypatch):
    for name, value in dict(SHARD=150, FIT=256, CHUNK=200, TILE=32).items():
        monkeypatch.setattr(flatgraph, name, value)
    taken = []
    tiles = flatgraph._tiles
    monkeypatch.setattr(flatgraph, "_tiles", lambda t: taken.append(t) or tiles(t))
    rows = clouds(2, [(300, 0.01), (250, 0.06), (40, 0.05), (9, 0.01)], 300)
    share, got, want = compared(spark, rows)
    assert share >= 0.98 and taken
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_no_shard_is_larger_than_its_bound(spark, monkeypatch):
    for name, value in dict(SHARD=100, FIT=128, CHUNK=150).items():
        monkeypatch.setattr(flatgraph, name, value)
    rows = clouds(3, [(400, 0.005)], 250)
    nodes = spark.createDataFrame([("|16:0", i, v, 1) for i, v, _ in rows], "shard string, node long, v array<double>, copies long")
    members, held = flatgraph.shards(nodes)
    sizes = members.groupBy("shard").count().toPandas()["count"]
    assert sizes.max() <= 100
    caught, free = {r["node"] for r in held.collect()}, {r["node"] for r in members.where("own and node >= 0").collect()}
    assert len(caught) > 200 and not caught & free and caught | free == {i for i, _, _ in rows}
    for r in held.groupBy("ball").agg({"r": "max"}).collect():
        assert 2 * r["max(r)"] <= math.acos(flatgraph.THRESHOLD)


def test_vectors_of_one_direction(spark, monkeypatch):
    for name, value in dict(SHARD=40, FIT=64, CHUNK=50, TILE=16).items():
        monkeypatch.setattr(flatgraph, name, value)
    rng = np.random.default_rng(8)
    rows = [(i, [float(a * (i + 1)) for a in (1, 2, -1, 3)], 0) for i in range(150)] + [(1000 + i, [float(a) for a in rng.normal(size=4)], 0) for i in range(60)]
    share, got, want = compared(spark, rows)
    assert share >= 0.98 and sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_audit_counts_what_is_missing(spark):
    rows = clouds(4, [(20, 0.01)], 20)
    nodes = spark.createDataFrame([("|16:0", i, v, 1) for i, v, _ in rows], "shard string, node long, v array<double>, copies long")
    want = brute([(i, v, 0) for i, v, _ in rows])
    whole = spark.createDataFrame([(i, n) for i, (n, _) in want.items()], "node long, n long")
    assert flatgraph.audit(nodes, whole) == 1.0
    half = spark.createDataFrame([(i, n // 2) for i, (n, _) in want.items()], "node long, n long")
    assert 0.4 <= flatgraph.audit(nodes, half) <= 0.6
    assert flatgraph.audit(nodes, whole.limit(0)) == 0.0


def test_pruning_keeps_the_nearest_and_bounds_degrees():
    x = flatgraph.unit(np.random.default_rng(1).normal(size=(300, 8)))
    a, b = flatgraph.pruned(x)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    assert np.bincount(a).max() <= flatgraph.DEGREE and (a != b).all()
    assert all(sims[i].argmax() in b[a == i] for i in range(300))
    assert len(flatgraph.pruned(x[:1])[0]) == 0


def test_hard_rows(spark):
    nan, one = float("nan"), [1.0, 2.0, 3.0]
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0, 0.0], 0), (4, [1.0, None, 2.0], 0), (5, [nan, 1.0, 1.0], 0), (6, [float("inf"), 1.0, 1.0], 0),
        (9, one, None), (8, one, 0), (7, [2.0, 4.0, 6.0], 0), (10, one, 1), (11, [1.0, 2.0], 0), (12, [1e-200, 2e-200, 3e-200], 0), (13, [1e200, 2e200, 3e200], 0),
    ]
    got, _ = found(spark, rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (0, i) for i, _, _ in rows} | {i: (3, 7) for i in (7, 8, 12, 13)}
    again, _ = found(spark, [(None, one, 0), (8, one, 0), (8, one, 0), (8, one, 0), (3, one, 0)])
    assert sorted((tuple(r) for r in again), key=str) == sorted([(None, 0, None, True), *[(8, 3, 3, False)] * 3, (3, 3, 3, True)], key=str)
    assert found(spark, [])[0] == []
