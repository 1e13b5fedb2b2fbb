"""The pipeline's stages: what each drops, keeps and changes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarn import session
from tarn.llm import packing, quality, secrets, simhash, toxicity
from tarn.llm.common import stored

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def stages(spark):
    docs = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], SMALL), name))
    return docs


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_each_stage_does_what_its_operator_says(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = quality.score(stages[0], quality.train(stages[0], labels))
    assert ids(stages[1]) == ids(good.where("predicted = 1"))
    clean = toxicity.score(stages[1], toxicity.train(stages[1], labels))
    assert ids(stages[2]) == ids(clean.where("predicted = 0"))
    classes = simhash.similar(stages[2], 5, 0.8)
    assert ids(stages[3]) == sorted({r["component_id"] for r in classes.collect()})
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    for r in stages[4].collect():
        assert r["text"] == secrets.masked(before[r["doc_id"]]) and r["n_chars"] == len(r["text"])
        assert not secrets.base_spans(r["text"])
    packed = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    whole = packing.pieces(stages[4]).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sorted(map(tuple, packed)) == sorted(map(tuple, whole))
    assert stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_filters_keep_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    clean = labels.where("quality = 1 and toxic = 0").select("doc_id")
    assert stages[0].join(clean, "doc_id").count() - stages[2].join(clean, "doc_id").count() <= 1


HARD = [
    (1, None, "en", "a", 0, 7, "x"),
    (2, "", None, "a", 0, 8, "x"),
    (3, "a b c", "en", None, 5, 9, "x"),
    (3, "a b c", "en", None, 5, 9, "x"),
    (3, "another text under the same number", "en", "b", 34, 9, "x"),
    (None, "a b c", "fr", "a", 5, None, None),
    (None, None, None, None, None, None, None),
    (5, "word " * 30_000, "en", "a", 150_000, 1, "x"),
    (6, "é中文🙂 password=hunter2hunter2 x", "en", "a", None, 1, "x"),
    (7, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 62, 1, "x"),
    (8, "one two three four five six seven eight nine ten eleven twelve thirteen", "en", "a", 71, 1, "x"),
]
#: Names that operators use themselves.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, component_id long, fp string"


def test_stages_on_hard_rows(spark):
    docs = spark.createDataFrame(HARD, CLASH)
    clash = docs.withColumnsRenamed({"component_id": "label", "fp": "score"})
    for table in (docs, clash, docs.withColumnRenamed("fp", "__tarn_shingles"), docs.limit(0)):
        now, n = table, table.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, now, SMALL), name)
            if name != "packing":
                assert out.dtypes == table.dtypes, name
            now = out
        if n:
            ids_left = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in now.select("doc_id").distinct().collect())
            # rows 1 and 2 are one class, 7 and 8 another; of 3 both texts stay
            assert ids_left == [(False, 0), (True, 1), (True, 3), (True, 5), (True, 6), (True, 7)]
            assert now.where("doc_id = 3 and piece = 0").count() == 2
        else:
            assert now.count() == 0


def test_near_copies_from_the_similarity_on_are_found(spark):
    """Of pairs made to any similarity, those of 0.8 or more, by brute force, are all found."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(5000)]
    rows = []
    for length in (12, 30, 80, 300):
        for changed in range(0, max(2, length // 8)):
            base = list(rng.choice(words, length))
            other = list(base)
            for at in rng.choice(length, changed, replace=False):
                other[at] = str(rng.choice(words))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()}
    for (i, a), (j, b) in zip(rows[::2], rows[1::2]):
        x, y = grams(a), grams(b)
        assert i in kept and (j in kept) == (5 * len(x & y) < 4 * len(x | y)), (i, len(x & y) / len(x | y))


def test_near_copies_meet_by_fingerprints_first(spark, monkeypatch):
    """The stage's candidates hold all links of the fingerprints, by brute force, and the sets decide on them."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(5000)]
    rows = []
    for _ in range(12):
        text = list(rng.choice(words, 400))
        for _ in range(5):
            rows.append((len(rows), " ".join(text)))
            text[int(rng.integers(0, 400))] = str(rng.choice(words))
    rows += [(len(rows), "two words"), (len(rows) + 1, "Two  words"), (len(rows) + 2, "")]
    seen, print_links = [], simhash.print_links
    monkeypatch.setattr(simhash, "print_links", lambda reps: seen.append((reps, print_links(reps).collect())) or print_links(reps))
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()}
    assert kept == {*range(0, 60, 5), 60, 62}
    (reps, pairs), least = seen[0], {}
    prints = {r["node"]: simhash.fingerprint(dict(rows)[r["node"]].encode(), 5) for r in reps.collect()}

    def root(i):
        while least.get(i, i) != i:
            i = least[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert len(near) > 20 and all(root(a) == root(b) for a, b in near)


def test_run_leaves_its_last_table_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [p.name.split("-")[1] for p in tmp_path.iterdir()] == ["packing"]
    assert out.count() > 0
