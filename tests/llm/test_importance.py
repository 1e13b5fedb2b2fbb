"""Importance resampling against plain counting, and the byte automaton against patterns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import importance
from tests.conftest import SF

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, longest):
    words = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent, least, buckets, longest):
    def counted(texts):
        return Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in grams(t, longest)[1])

    s, t = counted(x for _, x in docs), counted(target)
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((n + 1) * (T + buckets)))) for b, n in s.items()}
    rows = []
    for i, text in docs:
        words, found = grams(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in found)
        rows.append((i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    out = []
    for place, r in enumerate(able, 1):
        out.append((r[0], r[2], r[3], r[4], place if place <= percent * len(able) // 100 else None))
    return out + [(r[0], r[2], r[3], r[4], None) for r in rows if r[1] < least]


def test_query_is_its_sql_and_brute_force(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = importance.query(spark, SF)
    rows = [tuple(r) for r in found.collect()]
    wanted = con.sql(f"SELECT {', '.join(found.columns)} FROM ({importance.SQL})").fetchall()
    assert sorted(map(str, rows)) == sorted(map(str, wanted))
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(rows, key=str) == sorted(brute(docs, target, 10, 20, 10_000, 1), key=str)


def test_hard_rows_and_longer_runs(spark):
    docs = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "Ä b-c"), (4, "w" * 70_000), (5, "x y " * 20_000), (6, "中文 🙂 a1 B2")]
    wide = spark.createDataFrame([(*r, 1, 2, "z") for r in docs], "doc_id long, text string, weight int, score int, rank string")
    target = ["a b", "Ä b c", None]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for longest in (1, 2, 3):
        got = importance.resampled(wide, aim, 50, 2, 97, longest)
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(brute(docs, target, 50, 2, 97, longest), key=str)
    assert importance.resampled(wide.limit(0), aim).count() == 0
    assert importance.resampled(wide, aim.limit(0)).count() == len(docs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aZ9 .é\x7f🙂", max_size=12), st.just("q" * 200)), max_size=6), st.integers(1, 3))
def test_automaton_is_the_pattern(texts, longest):
    found = [Counter() for _ in texts]
    at = 0
    for data, offsets in importance._buffers(pa.array(texts, pa.string())):
        for crc, text in importance.features(data, offsets, longest):
            for c, t in zip(crc.tolist(), text.tolist()):
                found[at + t][c] += 1
        at += len(offsets) - 1
    assert found == [Counter(zlib.crc32(g.encode()) for g in grams(t, longest)[1]) for t in texts]


def test_slices_and_small_parts(monkeypatch):
    monkeypatch.setattr(importance, "HELD", 7)
    column = pa.array(["skip", "ab cd", None, "efghijklmnop", "", "x"], pa.string()).slice(1)
    parts = [[bytes(d[a:b]) for a, b in zip(o, o[1:])] for d, o in importance._buffers(column)]
    assert [x for p in parts for x in p] == [b"ab cd", b"", b"efghijklmnop", b"", b"x"]
    assert len(parts) > 1


def test_crc_table():
    data = np.frombuffer(b"any bytes \xff\x00", np.uint8)
    crc = importance.advanced(np.array([0xFFFFFFFF], np.uint32), data, np.array([0]), np.array([len(data)]))
    assert int(crc[0]) ^ 0xFFFFFFFF == zlib.crc32(data.tobytes())
