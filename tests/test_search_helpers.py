"""Least stretches of text and misspelt terms, against brute force."""

import random

from pyspark.sql import functions as F

from tarn.operators import misspelt, search


def least(places):
    """The least stretch by trying every pair of ends."""
    hits = sorted(p for ps in places.values() for p in ps)
    best = None
    for a in hits:
        for b in hits:
            if a <= b and all(any(a <= p <= b for p in ps) for ps in places.values()):
                best = min(best or (b - a, a, b), (b - a, a, b))
    return best[1:]


def test_windows_are_the_least(spark):
    draw = random.Random(2)
    texts = {i: {t: sorted(draw.sample(range(60), draw.randint(1, 6))) for t in draw.sample("abcd", draw.randint(1, 4))} for i in range(80)}
    rows = [(i, t, ps) for i, ts in texts.items() for t, ps in ts.items()]
    got = search.windows(spark.createDataFrame(rows, "doc_id long, term string, places array<int>"), "doc_id").collect()
    assert {r["doc_id"]: (r["n_terms"], r["first"], r["last"]) for r in got} == {i: (len(ts), *least(ts)) for i, ts in texts.items()}


def test_snippets_begin_at_the_window(spark):
    docs = spark.createDataFrame([(1, "red fish swim. " * 3 + "no blue  red\nfish here"), (2, "no such words"), (3, "fish"), (4, None)], "doc_id long, text string")
    best = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 1.0), (4, 0.5)], "doc_id long, score double")
    got = {r["doc_id"]: (r["n_terms"], r["first"], r["last"], r["snippet"]) for r in search.window_snippets(best, docs, "Red blue fish", width=15).collect()}
    assert got == {1: (3, 10, 12, "blue red fish h"), 3: (1, 0, 0, "fish")}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_near_terms_are_all_within_the_distance(spark):
    draw = random.Random(7)
    terms = sorted({"".join(draw.choices("abé🙂", k=draw.randint(1, 6))) for _ in range(200)})
    words = sorted({"".join(draw.choices("abé🙂", k=draw.randint(1, 6))) for _ in range(25)}) + ["zzzzzzz", "a", "a"]
    table = spark.createDataFrame([(t,) for t in [*terms, "", None, terms[0]]], "term string")
    asked = spark.createDataFrame([(w,) for w in [*words, "", None]], "word string")
    for most in (1, 2):
        got = {(r["word"], r["term"]): r["distance"] for r in misspelt.near_terms(asked, misspelt.deletions(table, most), most).collect()}
        assert got == {(w, t): d for w in words for t in terms if (d := edits(w, t)) <= most}


def test_the_nearest_then_most_frequent_term_is_taken(spark):
    frequency = spark.createDataFrame([("house", 5), ("mouse", 9), ("horse", 50), ("moose", 9)], "term string, df long")
    asked = spark.createDataFrame([("hous",), ("xouse",), ("horsey",), ("qqqqqq",)], "word string")
    got = {r["word"]: (r["term"], r["distance"]) for r in misspelt.corrected(asked, misspelt.deletions(frequency), frequency).collect()}
    assert got == {"hous": ("house", 1), "xouse": ("mouse", 1), "horsey": ("horse", 1)}
