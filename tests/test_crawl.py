"""The crawl loop, redirects and the tree that freezes, against plain loops."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from tarn.config import Config
from tarn.operators import crawl, links
from tarn.operators.rank_cut import kth_smallest, ranked_overall


def uniform(key, seed=""):
    return (int(hashlib.md5(f"{seed}{key}".encode()).hexdigest()[:12], 16) + 0.5) / float(1 << 48)


def plain_crawl(start, edges, known, c):
    domain = lambda u: urlparse(u).netloc.lower()
    level, front, told = {}, set(start), []
    for depth in range(c.crawl_depth + 1):
        level |= {u: depth for u in front}
        if depth == c.crawl_depth:
            break
        reached = {d for s, d in edges if s in front}
        new = {u for u in reached if u not in level}
        visits = Counter(map(domain, level))
        weight = {u: (1 + math.log(1 + known.get(u, (0, 0))[0])) / (1 + visits[domain(u)]) for u in new}
        left = sorted(new, key=lambda u: (round(-math.log(uniform(u)) / weight[u], 9), u))[: c.frontier_size]
        by = defaultdict(list)
        for u in sorted(left, key=lambda u: (uniform(u, "domain"), u)):
            by[domain(u)].append(u)
        left = [u for us in by.values() for u in us[: c.frontier_per_domain]]

        def some(rows, which, most, seed):
            hit = sorted((u for u in rows if which(u)), key=lambda u: (uniform(u, seed), u))[:most]
            return [u for u in rows if not which(u)] + hit

        left = some(left, lambda u: u.startswith("http://"), c.frontier_http, "http")
        front = set(some(left, lambda u: known.get(u, (0, 0))[1] == 0, c.frontier_orphans, "orphan"))
        told.append((depth + 1, len(reached), len(new), len(front)))
        if not front:
            break
    return level, told


@pytest.mark.parametrize("words", [1, 1 << 12])
def test_crawl_is_a_plain_loop(spark, words):
    draw = random.Random(3)
    urls = [f"http{'s' if i % 3 else ''}://d{i % 23}.example/{i}" for i in range(400)]
    edges = [(u, draw.choice(urls)) for u in urls for _ in range(6)] + [(urls[0], None), (None, urls[1])]
    known = {u: (draw.randint(0, 9), draw.randint(0, 2)) for u in urls[:350]}
    c = Config(frontier_size=40, frontier_per_domain=3, frontier_http=8, frontier_orphans=6, crawl_depth=4, bloom_words=words)
    table = spark.createDataFrame([(u, *k) for u, k in known.items()], "url string, backlinks long, domain_backlinks long")
    found, told = crawl.crawl(spark.createDataFrame([(urls[0],), (urls[7],), (urls[7],), (None,)], "url string"), spark.createDataFrame(edges, "src string, dst string"), table, c)
    want, levels = plain_crawl([urls[0], urls[7]], [(s, d) for s, d in edges if s and d], known, c)
    rows = found.collect()
    assert len(rows) == len(want) and {r["url"]: r["level"] for r in rows} == want
    got = [tuple(r) for r in told.orderBy("level").collect()]
    assert [(r[0], r[1], r[3], r[4]) for r in got] == levels
    # A filter of a single word sends most to the exact look-up, a wide one little more than what was visited.
    assert all(r[2] >= r[1] - r[3] for r in got)
    if words > 1:
        assert sum(r[2] for r in got) <= sum(r[1] - r[3] for r in got) + 5


def test_an_empty_start_or_web_ends_at_once(spark):
    none = spark.createDataFrame([], "url string, backlinks long, domain_backlinks long")
    edges = spark.createDataFrame([], "src string, dst string")
    assert crawl.crawl(none.select("url"), edges, none)[0].count() == 0
    assert [tuple(r) for r in crawl.crawl(spark.createDataFrame([("https://a/",)], "url string"), edges, none)[0].collect()] == [("https://a/", 0)]


def test_redirects_end_or_go_in_a_circle(spark, monkeypatch):
    rounds = []
    stored = crawl._stored
    monkeypatch.setattr(crawl, "_stored", lambda df, label: rounds.append(label) or stored(df, label))
    chain = [(f"c{i}", f"c{i + 1}") for i in range(10_000)]
    rows = [*chain, ("x", "y"), ("y", "z"), ("z", "x"), ("in", "x"), ("self", "self"), ("two", "b"), ("two", "a"), ("n", None), (None, "n")]
    got = {r["url"]: (r["final_url"], r["hops"]) for r in crawl.resolved(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert all(got[f"c{i}"] == ("c10000", 10_000 - i) for i in range(10_000))
    assert {k: v for k, v in got.items() if k[0] != "c"} == {k: (None, None) for k in ("x", "y", "z", "in", "self")} | {"two": ("a", 1)}
    assert len(rounds) <= 17
    assert crawl.resolved(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_order_statistics(spark):
    draw = random.Random(1)
    values = [draw.randint(-(10**12), 10**12) for _ in range(3000)] + [7] * 500
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    for k in (1, 2, 1700, 3500):
        assert kth_smallest(df, "v", k) == sorted(values)[k - 1]
    assert kth_smallest(df, "v", 3501) is None and kth_smallest(df.limit(0), "v", 1) is None
    ranked = ranked_overall(df, [F.desc("v")]).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 3501))
    assert [r["v"] for r in sorted(ranked, key=lambda r: r["rank"])] == sorted(values, reverse=True)


def plain_tree(urls, nodes):
    tree, frozen = {}, False
    for u in urls:
        rest = u.split("//", 1)[1].rstrip("/").lower()
        parts = rest.split("/")
        for i in range(1, len(parts) + 1):
            prefix = "/".join(parts[:i])
            if prefix in tree or not frozen:
                tree[prefix] = tree.get(prefix, 0) + 1
        frozen = frozen or len(tree) >= nodes
    return tree


@pytest.mark.parametrize("nodes", [1, 5, 60, 10_000])
def test_the_tree_freezes_at_its_size(spark, nodes):
    draw = random.Random(4)
    urls = [f"https://h{draw.randint(0, 9)}.x/" + "/".join(str(draw.randint(0, 3)) for _ in range(draw.randint(1, 4))) for _ in range(300)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "pos long, url string").repartition(3)
    assert {r["prefix"]: r["n"] for r in links.frozen_by_size(df, nodes).collect()} == plain_tree(urls, nodes)


@pytest.mark.parametrize("seed", range(3))
def test_urls_with_several_redirects_follow_all(spark, seed):
    draw = random.Random(seed)
    rows = [(f"u{draw.randint(0, 25)}", f"u{draw.randint(0, 34)}") for _ in range(22 if seed else 34)] + [("two", "b"), ("two", "a"), ("to", "two"), ("c1", "c2"), ("c2", "c1"), ("c3", "c1")]
    rows += [("s", "s"), ("s", "out"), ("into", "s")] if seed == 1 else []
    rows += rows[:2]
    went, walk = defaultdict(set), {(s, d, 1) for s, d in rows}
    for s, d in rows:
        went[s].add(d)
    new = walk
    while new:
        new = {(u, d, h + 1) for u, at, h in new if h <= len(rows) for d in went.get(at, ())} - walk
        walk |= new
    ended = [(u, at, h) for u, at, h in walk if at not in went]
    want = {s: (max((at for u, at, _ in ended if u == s), default=None), max((h for u, _, h in ended if u == s), default=None)) for s in went}
    found = crawl.followed(spark.createDataFrame(rows, "src string, dst string")).collect()
    assert len(found) == len(went) and {r["url"]: (r["final_url"], r["hops"]) for r in found} == want
    assert want["to"] == ("b", 2) and want["c3"] == (None, None)
