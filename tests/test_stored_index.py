"""Blocks of postings, search that leaves blocks out, and the index that grows by segments."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tarn.config import Config
from tarn.operators import blocks, index
from tarn.session import shared_path
from tarn.sources.index_store import IndexStore
from tarn.streaming import index_stream

SMALL = Config(index_buckets=4, block_cell=16, block_size=5, postings_limit=6, index_segments=2)


def corpus(seed, docs, terms="abcdefgh", most=30):
    draw = random.Random(seed)
    return [(t, d, float(draw.choice((1, 1, 1, 2, 3, 9, most)))) for d in docs for t in terms if draw.random() < 0.6]


def table(spark, rows):
    return spark.createDataFrame(rows, "term string, doc long, weight double")


def best(rows, terms, k):
    score = defaultdict(float)
    for t, d, w in rows:
        if t in terms:
            score[d] += w
    return [(d, s) for d, s in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]]


def test_a_document_is_in_one_layer(spark):
    rows = corpus(3, range(100)) + [("zero", 500, 0.0)]
    made = blocks.layered(table(spark, rows))
    assert made.groupBy("doc").agg(F.countDistinct("layer").alias("n")).where("n > 1").count() == 0
    total = defaultdict(float)
    for _, d, w in rows:
        total[d] += w
    for r in made.where("doc < 500").collect():
        assert 2 ** (r["layer"] / blocks.LAYERS) <= total[r["doc"]] * (1 + 1e-9) and total[r["doc"]] < 2 ** ((r["layer"] + 1) / blocks.LAYERS) * (1 + 1e-9)


def answers(found):
    out = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r["query"], r["rank"])):
        out[r["query"]].append((r["doc"], r["score"]))
    return dict(out)


def test_blocks_keep_every_posting(spark):
    rows = corpus(1, range(-20, 200)) + [("a", 7, 1.0), ("a", 7, 1.0), ("z", 10**12, 2.5)]
    made = blocks.packed(table(spark, [*rows, (None, 1, 1.0), ("a", None, 1.0), ("a", 1, None)]), 4, 16, 5).cache()
    assert sorted(map(tuple, blocks.unpacked(made, cell=16).collect())) == sorted(rows)
    for b in made.collect():
        assert b["n"] == len(b["offsets"]) == len(b["weights"]) <= 5 and b["top"] == max(b["weights"])
        assert all(0 <= o < 16 for o in b["offsets"]) and b["offsets"] == sorted(b["offsets"]) and b["first"] == b["cell"] * 16 + b["offsets"][0]
    assert blocks.packed(table(spark, []), 4).count() == 0


@pytest.mark.parametrize("k", [1, 3, 10, 1000])
def test_search_is_that_of_all_postings(spark, k):
    rows = corpus(2, range(600))
    made = blocks.packed(table(spark, rows), 4, 16, 5).cache()
    asked = {0: "a", 1: "ab", 2: "abcdefgh", 3: "ax", 4: "x"}
    queries = spark.createDataFrame([(q, t) for q, terms in asked.items() for t in terms], "query long, term string")
    found, counts = blocks.searched(made, queries, k, 2, 16)
    got = answers(found)
    assert got == {q: b for q, terms in asked.items() if (b := best(rows, terms, k))}
    told = {r["query"]: (r["n_blocks"], r["n_read"]) for r in counts.collect()}
    assert all(0 < n <= m for m, n in told.values())


def test_search_leaves_most_blocks_out(spark):
    rows = [("a", d, 50.0 if d in (77, 78, 900) else 1.0) for d in range(3000)] + [("b", d, 40.0 if d == 78 else 1.0) for d in range(0, 3000, 2)]
    made = blocks.packed(table(spark, rows), 4, 16, 8).cache()
    found, counts = blocks.searched(made, spark.createDataFrame([(1, "a"), (1, "b")], "query long, term string"), 3, 2, 16)
    assert answers(found)[1] == [(78, 90.0), (900, 51.0), (77, 50.0)]
    m, n = counts.select("n_blocks", "n_read").first()
    assert n < m / 20


def test_batches_are_the_whole_and_each_is_added_once(spark):
    store = IndexStore(spark, shared_path(spark, "store"), SMALL)
    assert store.postings().count() == 0 and store.version() == 0
    parts = [corpus(i, range(100 * i, 100 * i + 60)) for i in range(4)]
    for i, part in enumerate(parts):
        assert store.add(table(spark, part), i) == i + 1
    assert store.add(table(spark, parts[2]), 2) == 4
    rows = sorted(sum(parts, []))
    assert sorted(map(tuple, store.postings().collect())) == rows
    assert sorted(map(tuple, store.postings(["a", "x"]).collect())) == [r for r in rows if r[0] == "a"]
    assert sorted(map(tuple, store.postings(version=2).collect())) == sorted(parts[0] + parts[1])
    assert store.upkeep(cut=False)
    assert sorted(map(tuple, store.postings().collect())) == rows
    assert all(len(s) <= SMALL.index_segments for s in store.manifest()["buckets"].values())


def cut(rows, limit):
    lists = defaultdict(list)
    for t, d, w in rows:
        lists[t].append((-w, d))
    return sorted((t, d, -w) for t, ps in lists.items() for w, d in sorted(ps)[:limit])


def test_lists_converge_to_a_batch_build(spark):
    store = IndexStore(spark, shared_path(spark, "store"), SMALL)
    parts = [corpus(i + 10, range(100 * i, 100 * i + 40), "abcdefghijklmnop"[: 4 + 3 * i]) for i in range(4)]
    for i, part in enumerate(parts):
        store.add(table(spark, part), i)
        store.upkeep()
        n = {r["term"]: r["n"] for r in store.postings().groupBy("term").agg(F.count("*").alias("n")).collect()}
        assert max(n.values()) <= SMALL.compact_over * SMALL.postings_limit
    store.upkeep(whole=True)
    assert sorted(map(tuple, store.postings().collect())) == cut(sum(parts, []), SMALL.postings_limit)


def test_upkeep_rewrites_what_is_due_alone(spark):
    store = IndexStore(spark, shared_path(spark, "store"), SMALL)
    many, few = [("a", d, float(d)) for d in range(20)], [(t, d, 1.0) for t in "bcdefg" for d in range(2)]
    store.add(table(spark, many + few), 0)
    before = store.manifest()["buckets"]
    done = store.upkeep()
    bucket = str(spark.range(1).select(blocks.bucket_of(F.lit("a"), 4)).first()[0])
    assert done == [bucket]
    after = store.manifest()["buckets"]
    assert {b: s for b, s in after.items() if b != bucket} == {b: s for b, s in before.items() if b != bucket} and after[bucket] != before[bucket]
    assert sorted(map(tuple, store.postings().collect())) == cut(many + few, 6)
    assert store.upkeep() == []
    assert store.clean(1) == [] and store.version() == 2


def test_a_writer_that_fails_leaves_the_old_version(spark, monkeypatch):
    store = IndexStore(spark, shared_path(spark, "store"), SMALL)
    rows = corpus(5, range(50))
    store.add(table(spark, rows), 0)
    other = IndexStore(spark, store.path, SMALL)
    with monkeypatch.context() as m:
        m.setattr(IndexStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.upkeep(whole=True)
        with pytest.raises(OSError):
            store.add(table(spark, rows), 1)
    assert store.version() == 1 and sorted(map(tuple, store.postings().collect())) == sorted(rows)
    stale = other.manifest()
    store.add(table(spark, corpus(6, range(60, 70))), 1)
    with pytest.raises(RuntimeError):
        other._commit(stale, 1, stale["buckets"])
    assert len(store.clean(1)) >= 1  # what the failed writers left
    assert sorted(map(tuple, store.postings().collect())) == sorted(rows + corpus(6, range(60, 70)))


def test_a_stream_feeds_the_index(spark, tmp_path):
    store, checkpoint = IndexStore(spark, shared_path(spark, "store"), SMALL), shared_path(spark, "checkpoint")
    texts = {i: " ".join(random.Random(i).choices(["apple", "pear", "plum", "fig"], k=9)) for i in range(30)}
    for part in range(3):
        rows = [(i, t) for i, t in texts.items() if i % 3 == part]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        index_stream.feed_index(store, f"file://{tmp_path}/in", "doc_id long, text string", checkpoint, plain=True, cut=False)
    want = sorted((t, i, float(text.split().count(t))) for i, text in texts.items() for t in set(text.split()))
    assert sorted(map(tuple, store.postings().collect())) == want
    # The last batch is run once more, as after a failure between the store's commit and the stream's.
    last = store.version()
    assert store.add(table(spark, [("apple", 99, 1.0)]), store.manifest()["batch"]) == last
    assert sorted(map(tuple, store.postings().collect())) == want


@pytest.mark.parametrize("once", [True, False])
def test_terms_are_counted_where_a_text_is_read(spark, once):
    rows = [(1, "a1 b1 a1 A1 the"), (2, None), (3, ""), (4, "the of"), (5, "b1 " * 700), (None, "n1 n1")] + [(i, f"w{i % 7} x{i % 300} é") for i in range(10, 900)]
    rows += [] if once else [(1, "a1 c1"), (None, "n1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = defaultdict(int)
    for d, t in rows:
        for w in (t or "").lower().split():
            if w.isascii() and w not in ("the", "of"):
                want[d, w] += 1
    tf = index.term_frequencies(docs, "doc_id", plain=True)
    assert {(r["doc_id"], r["term"]): r["tf"] for r in tf.collect()} == want and tf.count() == len(want)
    plain = table(spark, [(w, d, float(n)) for (d, w), n in want.items() if d is not None])
    known = {(r["doc"], r["term"]): r["layer"] for r in blocks.layered(plain).collect()}
    got = index.weighed_terms(docs, "doc_id", plain=True)
    assert {(r["doc"], r["term"]): r["layer"] for r in got.where("doc is not null").collect()} == known
    # Where each key is one row, only what is written is dealt out.
    if once:
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_ranges_grow_in_number_with_the_postings(spark, monkeypatch, tmp_path):
    """A task sorts no more postings when there are more of them."""
    rows = spark.range(4000).select(F.concat(F.lit("t"), F.col("id") % 7).alias("term"), F.col("id").alias("doc"), (F.col("id") % 5 + 1.0).alias("weight"))
    rows.write.parquet(f"{tmp_path}/rows")
    rows = blocks.layered(spark.read.parquet(f"{tmp_path}/rows"))
    few = sorted(map(tuple, blocks.unpacked(blocks.packed(rows, 4)).collect()))
    monkeypatch.setattr(blocks, "SORTED", 100)
    asked = []
    monkeypatch.setattr(type(rows), "repartitionByRange", lambda self, *a, f=type(rows).repartitionByRange: asked.append(a[0]) or f(self, *a))
    store = IndexStore(spark, f"{tmp_path}/index")
    store.add(rows, 0)
    assert asked == [40] and sorted(map(tuple, store.postings().collect())) == few
