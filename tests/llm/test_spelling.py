"""Spelling variants against all pairs, long words and hard rows."""

import random
import re
import zlib
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import spelling
from tests.conftest import SF


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        others = [(-m, o) for o, m in counts.items() if near(w, o)]
        best = min(others, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        out[w] = (form, n, len(others), -best[0] if form is not None else None)

    def root(w):
        while out[w][0] is not None:
            w = out[w][0]
        return w

    return {w: (form, root(w), n, k, m) for w, (form, n, k, m) in out.items()}


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_query_is_its_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = spelling.query(spark, SF)
    wanted = con.sql(f"SELECT {', '.join(df.columns)} FROM ({spelling.SQL})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, wanted))
    counts = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    assert got(df) == brute({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})


def test_chains_lead_to_the_last_form(spark):
    counts = {"abcdefgh"[: 4 + i]: 5 ** (i + 1) for i in range(5)} | {"abcdexyz": 7, "abcdefxh": 700}
    assert got(spelling.grouped(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)
    assert brute(counts)["abcd"][1] == "abcdefgh"


def test_any_words_are_brute_force(spark):
    draw = random.Random(5)
    words = {"".join(draw.choices("abé", k=draw.randint(1, 7))) for _ in range(400)} | {"", "a" * 50, "a" * 51, "ab" * 25, "ba" * 25}
    counts = {w: draw.choice((5, 6, 30, 200, 5000)) for w in sorted(words)}
    assert got(spelling.grouped(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abÿ🙂", max_size=9), min_size=1, max_size=6))
def test_keys_are_those_of_the_deletions(words):
    of, keys = spelling.deletion_keys(words)
    for w, word in enumerate(words):
        strings = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
        own = set(keys[of == w].tolist())
        assert len(own) == len(strings) == (of == w).sum()
        assert own == {int(spelling.deletion_keys([s])[1][0]) for s in strings}


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_near_is_one_edit(a, b):
    assert a == b or spelling.is_near(a, b) == near(a, b)


def test_long_words_take_time_in_proportion(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=100_000))
    counts = {long: 100, long[:50_000] + long[50_001:]: 10, long[::-1]: 9, "b" * 100_000: 50, "b" * 99_999: 8}
    found = got(spelling.grouped(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert [found[w][3] for w in counts] == [1, 1, 0, 1, 1]
    assert found[long[:50_000] + long[50_001:]][0] == long


def test_hard_rows(spark):
    rows = [(1, None, "k", 1), (2, "", "k", 2), (None, "sample " * 5 + "sampled×÷", None, 3), (3, "Sample SAMPLE sämple sämple", "k", 4), (3, "Sample SAMPLE sämple sämple", "k", 4), (4, "sämple", "k", 5), (5, "z" * 200_000, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    found = got(spelling.grouped(spelling.words(docs, every=10**9)))
    assert found == {"sample": (None, "sample", 9, 1, None), "sämple": (None, "sämple", 5, 1, None)}
    assert spelling.grouped(spelling.words(docs.limit(0))).count() == 0
