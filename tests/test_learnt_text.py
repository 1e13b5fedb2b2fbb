"""Learnt dictionaries and language weights, against brute force and on held-out rows."""

import math
import random
from collections import Counter
from itertools import product

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.functions import lang, language
from tarn.operators import grams, segment
from tarn.plans.queries import word_candidates
from tests.conftest import SF

# Hand-made Chinese words and sentences of them.
WORDS = "我们 今天 公园 散步 学习 中文 图书馆 朋友 喜欢 在 去 和 很 的".split()
SENTENCES = ["我们 今天 去 公园 散步", "朋友 喜欢 在 图书馆 学习 中文", "今天 我们 在 公园", "我们 和 朋友 去 图书馆", "中文 很 喜欢", "朋友 的 公园", "去 公园 学习", "喜欢 散步 的 朋友 今天 去", "图书馆 的 中文", "在 公园 散步 很 喜欢"]


def best_cut(cutter, run):
    """The best of all ways to cut."""
    best = None
    for cuts in product((0, 1), repeat=len(run) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(run)]
        parts = [run[a:b] for a, b in zip(at, at[1:])]
        if any(p not in cutter.weight and len(p) > 1 for p in parts):
            continue
        total = 0.0
        for p in parts:
            total += cutter.weight.get(p, cutter.unknown)
        best = max(best or (-math.inf,), (total,))
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=4), st.integers(1, 50), max_size=12), st.text("abcd", min_size=1, max_size=10))
def test_the_cut_is_the_best_path(words, run):
    cutter = segment.Cutter(words)
    parts = cutter.cut(run)
    assert "".join(parts) == run
    total = 0.0
    for p in parts:
        total += cutter.weight.get(p, cutter.unknown)
    assert total == pytest.approx(best_cut(cutter, run))


def test_cutting_takes_time_in_proportion():
    cutter = segment.Cutter({"ab": 5, "abc": 3, "c": 1})
    assert "".join(cutter.cut("abcab" * 40_000)) == "abcab" * 40_000


def test_chinese_is_cut_by_a_dictionary():
    cutter = segment.Cutter({w: 10 for w in WORDS} | {"中华人民共和国": 5, "中华": 5, "人民": 9, "共和国": 5, "共和": 2})
    for s in SENTENCES:
        assert cutter.cut(s.replace(" ", "")) == s.split()
    assert cutter.words("中华人民共和国", True) == ["中华", "人民", "共和", "共和国", "中华人民共和国"]
    assert cutter.tokens("Hello world，我们go去公园 v1.5 naïve", True) == ["Hello", "world", "我们", "go", "去", "公园", "v", "1", "5", "naïve"]
    assert cutter.tokens("我们" * 6000, limit=4) == ["我们", "我们"]
    assert cutter.words("") == [] and cutter.words("  \n") == []


def test_words_are_found_in_unparted_chinese(spark):
    rows = [(i, s.replace(" ", "")) for i, s in enumerate(SENTENCES * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = segment.candidates(segment.gram_counts(docs, 5), 4, 5)
    cutter = segment.collected(segment.chosen(found, 0.5, 0.6))
    right = wrong = true = 0
    for s in SENTENCES:
        def ends(words):
            return {sum(map(len, words[: i + 1])) for i in range(len(words) - 1)}

        a, b = ends(s.split()), ends(cutter.cut(s.replace(" ", "")))
        right, wrong, true = right + len(a & b), wrong + len(b - a), true + len(a)
    assert 2 * right / (2 * right + wrong + true - right) > 0.8
    assert segment.learnt(docs, longest=4).cut("我们") in (["我们"], ["我", "们"])


def test_counts_and_entropies_are_plain(spark):
    texts = ["abab cab", "abc1abc", "é中", None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["gram"]: r["n"] for r in segment.gram_counts(docs, 3).collect()}
    runs = ["abab", "cab", "abc", "abc", "é中"]
    assert got == Counter(r[i : i + n] for r in runs for n in (1, 2, 3) for i in range(len(r) - n + 1))
    found = {r["word"]: r for r in segment.candidates(segment.gram_counts(docs, 3), 2, 1).collect()}
    # "ab" (5 times): after it a, c, c and two ends; before it three beginnings, b and c.
    after, before = [1, 2, 2], [3, 1, 1]
    h = min(-sum(x / 5 * math.log(x / 5) for x in side) for side in (after, before))
    assert found["ab"]["n"] == 5 and found["ab"]["entropy"] == pytest.approx(h, abs=1e-6)
    assert found["ab"]["cohesion"] == pytest.approx(math.log(5 * 15 / (got["a"] * got["b"])), abs=1e-6)
    assert found["a"]["cohesion"] is None and found["a"]["entropy"] is None
    assert segment.gram_counts(docs.limit(0), 3).count() == 0


def test_parted_texts_teach_words_of_unparted_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    cutter = segment.collected(segment.known_words(docs.where("doc_id % 5 <> 0")))
    right = cut = true = 0
    for r in docs.where("doc_id % 5 = 0").collect():
        words = segment._RUN.findall(r["text"])[:200]
        joined, at = "".join(words), 0
        ends = set()
        for w in words:
            at += len(w)
            ends.add(at)
        at, found = 0, set()
        for w in cutter.cut(joined):
            at += len(w)
            found.add(at)
        right, cut, true = right + len(ends & found), cut + len(found), true + len(ends)
    assert 2 * right / (cut + true) > 0.55


def test_segmented_rows(spark):
    cutter = segment.Cutter({"ab": 3, "a": 1, "b": 1})
    docs = spark.createDataFrame([(1, "abab", "x"), (2, None, "x"), (3, "", "x"), (3, "ab 1,2", "x"), (None, "b", "x")], "doc_id long, text string, words string")
    got = sorted((str(r["doc_id"]), r["words"]) for r in segment.segmented(docs, cutter, "doc_id").collect() if r["words"] is not None)
    assert got == [("1", ["ab", "ab"]), ("3", []), ("3", ["ab", "1", ",", "2"]), ("None", ["b"])]
    assert segment.segmented(docs.limit(0), cutter, "doc_id").count() == 0


def brute_language(train, text):
    def grams(t):
        t = (" " + " ".join("".join(c.lower() if c.isalpha() else " " for c in t.replace("\n", "")).split()) + " ").encode()
        return [(int.from_bytes(t[i : i + n], "big") + n * language.STEP) % language.BUCKETS for n in language.SIZES for i in range(len(t) - n + 1)]

    n = {}
    for label, t in train:
        n.setdefault(label, Counter()).update(grams(t))
    if not text.replace("\n", "").strip(" .,0123456789"):
        return "und"
    score = {label: sum(math.floor(1000 * math.log((c[g] + 1) / (sum(c.values()) + language.BUCKETS))) for g in grams(text)) for label, c in n.items()}
    return max(sorted(score), key=score.get)


def test_language_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language, "HELD", 40)
    train = [("de", "der Hund und die Katze schlafen nicht"), ("fr", "le chien et le chat ne dorment pas"), ("ру", "собака и кошка не спят"), ("fr", "où est\nla gare"), (None, "nothing"), ("de", None)]
    rows = spark.createDataFrame(train, "lang string, text string")
    model = language.fitted(rows)
    texts = ["die Katze", "le chat", "кошка", "chien", "x", "", None, "123 ...", "schlafen die HUNDE", "la\ngare", "word " * 5000]
    got = {r["i"]: r["lang"] for r in language.detected(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), model, "i").collect()}
    known = [(a, b) for a, b in train if a and b]
    assert got == {i: None if t is None else brute_language(known, t) for i, t in enumerate(texts)}
    empty = language.fitted(rows.limit(0))
    assert [r["lang"] for r in language.detected(spark.createDataFrame([(1, "abc")], "i long, text string"), empty, "i").collect()] == ["und"]
    with pytest.raises(ValueError):
        language.fitted(rows, most=1)


def test_language_of_held_out_and_short_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fitted(docs.where("doc_id % 4 <> 0"))
    held = docs.where("doc_id % 4 = 0")

    def share(rows):
        found = language.detected(rows, model, "doc_id").withColumnRenamed("lang", "found").join(rows, "doc_id")
        return found.agg(F.avg((F.col("found") == F.col("lang")).cast("int"))).first()[0], rows.agg(F.avg((lang.detect(F.col("text")) == F.col("lang")).cast("int"))).first()[0]

    whole, lists = share(held)
    assert whole >= 0.97 and whole >= lists
    short, lists = share(held.withColumn("text", F.substring("text", 1, 25)))
    assert short >= 0.85 and short > lists


def test_cutting_does_not_take_the_time_of_the_longest_word():
    """A dictionary learnt from texts without white space has words as long as they are."""
    cutter, text = segment.Cutter({"ab": 5, "abc": 3, "c": 1, "x" * 30_000: 1, "abcab" * 4: 2}), "abcab" * 20_000
    asked = []
    cutter.weight = type("Counted", (dict,), {"get": lambda self, *k: asked.append(1) or dict.get(self, *k)})(cutter.weight)
    assert "".join(cutter.cut(text)) == text and len(asked) <= 3 * len(text)
    assert segment.Cutter({"x" * 30: 9, "x": 1}).cut("x" * 61) == ["x", "x" * 30, "x" * 30]


def test_places_are_those_of_plain_sets(spark):
    rows = [(1, "ab cd, ab1 x yz"), (2, None), (3, ""), (None, "ab ab")]
    got = [tuple(r) for r in segment.places(spark.createDataFrame(rows, "doc_id long, text string"), segment.Cutter({"ab": 3, "cd": 1, "yz": 2}), "doc_id").collect()]
    assert got == [(1, 2, 2, 2), (2, None, None, None), (3, 0, 0, 0), (None, 1, 1, 1)]


# One 64-bit number a window, two, and three.
ALPHABETS = {"one": "abcdefgh é中1 ", "two": "".join(map(chr, range(0x4E00, 0x4E00 + 900))) + "的的 " * 300, "three": "".join(map(chr, range(0x20000, 0x20000 + 5000))) + "ab 1" * 4000}


@pytest.mark.parametrize("letters", ALPHABETS)
@pytest.mark.parametrize("longest, least", [(8, 2), (3, 5), (1, 1)])
def test_words_are_those_of_a_table_of_grams(spark, letters, longest, least):
    rng = random.Random(longest)
    texts = ["".join(rng.choices(ALPHABETS[letters], k=rng.randrange(300))) for _ in range(60)] + ["abcabcabcab" * 30, None, "", " 1 "]
    docs = spark.createDataFrame([(t,) for t in texts * 2], "text string")
    plain = segment.candidates(segment.gram_counts(docs, longest + 1), longest, least)
    assert sorted(map(tuple, grams.found(docs, longest, least).collect())) == sorted(map(tuple, plain.collect()))
    joined = segment.candidates(segment.gram_counts(docs.select(segment.unparted(F.col("text")).alias("text")), longest + 1), longest, least)
    assert sorted(map(tuple, grams.found(docs, longest, least, joined=True).collect())) == sorted(map(tuple, joined.collect()))
    assert grams.found(docs.limit(0), longest, least).count() == 0


def test_a_place_gives_one_window(monkeypatch):
    """Not one row of each length; chunks, however small, have the same windows together."""
    texts = ["abcdefghijklmnop" * 4, "qrstuvwxyz, abc", None]
    code, batch = grams._Code(sorted(map(ord, "abcdefghijklmnopqrstuvwxyz")), 9), pa.record_batch([pa.array(texts)], names=["text"])
    whole = list(grams._windows(code, 4, False)(iter([batch])))
    assert sum(x[0] for b in whole for x in b.column("sizes").to_pylist()) == 16 + 8 + 10 + 3  # with the ends of runs, which are shorter
    monkeypatch.setattr(grams, "HELD", 8)
    monkeypatch.setattr(grams, "ROWS", 1)
    assert len(list(grams._windows(code, 4, False)(iter([batch])))) > len(whole)


def test_the_query_counts_windows(spark, monkeypatch):
    monkeypatch.setattr(segment, "gram_counts", None)
    assert word_candidates(spark, SF).where("length(word) = 8 and cohesion is not null and entropy is not null").count() > 0
