"""Index, links, store, metrics and streams; all queries against their SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tarn.config import Config
from tarn.operators import index, links, sample, search
from tarn.plans.oracles import ORACLES
from tarn.plans.queries import QUERIES
from tarn.metrics import error_counts, errors_by_place, guarded, indicators_of, quarantined
from tarn.session import shared_path
from tarn.sources.store import Store, read_scored, write_scored
from tarn.streaming import index_stream
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        wanted = duck.sql(ORACLES[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows_of(found) == rows_of(wanted)
    else:
        assert len(found)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans(spark):
    plan = QUERIES["frontier_domain"](spark, SF)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    plan = QUERIES["url_penalty"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan and "Python" not in plan


def test_scored_lists_round_trip(spark):
    rows = [(i / 997, format(i * 7919, "x") * (1 + i % 50)) for i in range(2000)]
    path = shared_path(spark, "test")
    write_scored(spark.createDataFrame(rows, "score double, url string"), path)
    assert sorted(map(tuple, read_scored(spark, path).collect())) == sorted(rows)


def test_store(spark):
    store = Store(spark, shared_path(spark, "test"), 4)
    store.put(spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int"), 0)
    store.put(spark.createDataFrame([("a", 3)], "key string, value int"), 1)
    assert {r["key"]: r["value"] for r in store.get("a", "b", "c").collect()} == {"a": 3, "b": 2}
    assert store.all().count() == 2


def test_errors_are_counted_and_others_go_on(spark):
    df = spark.createDataFrame([(1, "1"), (2, "x"), (3, None)], "k long, v string")
    out = guarded(df, "k", "v", int, "long")
    assert {(r["type"], r["errors"]) for r in error_counts(out).collect()} == {("ValueError", 1), ("TypeError", 1)}
    assert out.where("k = 1").first()["result"] == 1


def test_errors_have_a_place_and_a_bounded_log(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else str(i)) for i in range(40)], "k long, v string")
    out = guarded(df, "k", "v", int, "long").cache()
    (only,) = errors_by_place(out).collect()
    assert only["key"].endswith("]ValueError") and only["key"].startswith("[") and only["errors"] == 20
    log = quarantined(out, "k", 5).collect()
    assert [r["k"] for r in log] == [39, 37, 35, 33, 31] and all("ValueError" in r["trace"] for r in log)


def test_indicators_of_an_empty_and_a_full_table(spark):
    df = spark.range(10).select("id", (F.col("id") % 3).alias("m"))
    assert tuple(indicators_of(df, most=F.max("m")).first()) == (10, 2)
    assert tuple(indicators_of(df.limit(0), most=F.max("m")).first()) == (0, None)


POSTINGS = [("cat", f"https://a{i % 3}.com/{i}", float(i)) for i in range(30)] + [("dog", "https://a.com/1", 2.0), ("dog", "https://b.com/1", 3.0)]


def test_stored_postings_are_read_by_term(spark):
    rows, path = spark.createDataFrame(POSTINGS, "term string, url string, weight double"), shared_path(spark, "test")
    index.write_postings(rows, path, 8)
    assert sorted(map(tuple, index.read_postings(spark, path).collect())) == sorted(POSTINGS)
    some = index.read_postings(spark, path, ["dog", "none"], 8)
    assert sorted(map(tuple, some.collect())) == [r for r in sorted(POSTINGS) if r[0] == "dog"]
    assert "PartitionFilters: [bucket" in some._jdf.queryExecution().toString()
    assert index.read_postings(spark, path, []).count() == 0


def test_compaction_cuts_lists_that_are_due_alone(spark):
    rows, config = spark.createDataFrame(POSTINGS, "term string, url string, weight double"), Config(postings_limit=4, postings_per_domain=2, compact_percent=0)
    got = sorted(map(tuple, index.compacted(rows, "", config).collect()))
    # 2 of each of 3 domains, then the 4 heaviest; two postings are not over the limit
    assert sorted(r[2] for r in got if r[0] == "cat") == [26.0, 27.0, 28.0, 29.0]
    assert [r for r in got if r[0] == "dog"] == [r for r in sorted(POSTINGS) if r[0] == "dog"]
    again = index.compacted(spark.createDataFrame(got, rows.schema), "", config)
    assert sorted(map(tuple, again.collect())) == got
    every = Config(postings_limit=4, postings_per_domain=1, compact_percent=100)
    assert index.compacted(rows, "", every).where("term = 'dog'").count() == 2


def test_visits_of_several_batches_add_up(spark, tmp_path):
    pages = [(1, "https://a.com/1", '<a href="/2">x</a><a href="https://b.com/">y</a>'), (2, "https://A.com/2", "<p>no links</p>"), (3, "http://c.com/", '<a href="//d.com/z">z</a>')]
    schema, target = "page_id long, url string, html string", shared_path(spark, "test")
    for i, part in enumerate((pages[:1], pages[1:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        index_stream.visit(spark, f"file://{tmp_path}/in", schema, target)
        assert spark.read.parquet(f"{target}/pages/*").count() == (1, 3)[i]
    linked = {}
    for r in index_stream.outlinks(spark, target).collect():
        linked.setdefault(r["domain"], []).append(r["outlink"])
    got = {r["domain"]: (r["visits"], sorted(linked.get(r["domain"], []))) for r in index_stream.domains(spark, target).collect()}
    assert got == {"a.com": (2, ["a.com", "b.com"]), "c.com": (1, ["d.com"])}


def test_bfs_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert {tuple(r) for r in links.bfs(start, edges, 10).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_freeze_counts_later_links_too(spark):
    df = spark.createDataFrame([(0, "https://a.com/x"), (1, "https://a.com/x"), (2, "https://b.com")], "pos long, url string")
    assert {tuple(r) for r in links.frozen_counts(df, 0).collect()} == {("a.com", 2), ("a.com/x", 2)}


def test_merge_variants(spark):
    df = spark.createDataFrame([("t", "http://a.com/x/", 5), ("t", "https://a.com/x", 2), ("t", "https://a.com/x/", 3)], "term string, url string, tf long")
    assert [tuple(r) for r in index.merge_variants(df).collect()] == [("t", "https://a.com/x", 5)]


def test_weighted_sample_favours_weight(spark):
    df = spark.range(2000).withColumn("w", F.when(F.col("id") < 1000, 9.0).otherwise(1.0))
    picked = sample.weighted(df, "id", F.col("w"), 200)
    heavy = picked.where("id < 1000").count()
    assert picked.count() == 200 and heavy > 150
    u = [r[0] for r in spark.range(2000).select(sample.uniform(F.col("id"))).collect()]
    assert 0 < min(u) and max(u) < 1 and math.isclose(sum(u) / 2000, 0.5, abs_tol=0.03)


def test_search_without_terms_finds_nothing(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat cat")], "doc_id long, text string")
    tf = index.term_frequencies(docs, "doc_id")
    assert search.search(tf, docs, "the that").count() == 0
    best = search.search(tf, docs, "cat").orderBy(F.desc("score")).collect()
    assert [(r["doc_id"], r["snippet"]) for r in best] == [(2, "cat cat"), (1, "cat dog")]
    assert search.as_json(search.search(tf, docs, "dog")).first()[0].startswith('{"doc_id":1')
