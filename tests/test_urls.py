"""URL functions: vectors and properties."""

from urllib.parse import urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.functions import urls
from tarn.operators.rank_cut import domain_cap, domain_cap_sorted

PREFIXES = {
    "https://Shop.example/Fruit/pear.html": ["shop.example", "shop.example/fruit", "shop.example/fruit/pear.html"],
    "http://x.example/a?b=c#d": ["x.example", "x.example/a", "x.example/a/b=c", "x.example/a/b=c/d"],
    "https://x.example/a//": ["x.example", "x.example/a", "x.example/a/"],
    "ftp://a.com/x": [],
    "https://": [],
    "https:///x": [],
    "https://A.com/": ["a.com"],
    "http://a.com//b": ["a.com", "a.com/", "a.com//b"],
    "a.com": [],
    "https:// a.com": [],
    "https://%a.com": [],
}
HOME = {
    "https://a.com": True, "https://a.com///": True, "https://a.com?x=1": True, "a.com": True,
    "http://a.com": False, "https://a.com/x": False, "HTTPS://a.com": False,
}
PENALTY = {"https://a.com": 0, "http://a.com/": 0.3, "a.co": 0.3, "https://a.com/x": 0.1, "https://a.com/x.php": 0.37, "https://" + 242 * "a": 0.9}


def values(spark, inputs, expr):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(inputs)], "i long, url string")
    return [r["v"] for r in df.select("i", expr(F.col("url")).alias("v")).orderBy("i").collect()]


def test_prefixes(spark):
    assert values(spark, PREFIXES, urls.prefixes) == list(PREFIXES.values())
    assert values(spark, [None], urls.prefixes) == [None]


def test_home(spark):
    assert values(spark, HOME, urls.is_home) == list(HOME.values())


def test_penalty(spark):
    assert values(spark, PENALTY, urls.penalty) == pytest.approx(list(PENALTY.values()), abs=1e-12)


def test_netloc(spark):
    hostile = ["https://u:p@A.com:8/x", "HTTPS://A.com/x", "//a.com/x", "a.com", "", "https://a.com#t/q", "https://a.com?x", "mailto:x@y", "https:///x"]
    assert values(spark, hostile, urls.netloc) == [urlparse(u).netloc for u in hostile]
    assert values(spark, [None], urls.netloc) == [None]


def test_variant_key(spark):
    assert len(set(values(spark, ["https://a.com/x/", "http://a.com/x", "https://a.com/x"], urls.variant_key))) == 1


def test_domain_cap(spark):
    rows = [(1, "https://a.com/1"), (2, "https://a.com/"), (3, "https://A.com/2"), (4, "http://a.com/"), (5, "https://b.com/1"), (6, "https://c.com/"), (7, "https://c.com/1")]
    df = spark.createDataFrame(rows, "pos long, url string")
    assert [r["pos"] for r in domain_cap_sorted(df, 1).collect()] == [1, 2, 5, 6]
    assert [r["pos"] for r in domain_cap_sorted(df, 0).collect()] == [2, 6]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["https://a.com", "https://a.com/1", "https://A.com/2", "http://a.com/", "https://b.com/x", "https://b.com/"]), max_size=12), st.integers(0, 3))
def test_domain_cap_keeps_first_rows_and_home_pages(spark, seq, limit):
    """A row stays if fewer than ``limit`` rows of its domain stand before it, or if it is a home page."""
    domains = [urlparse(u).netloc.lower() for u in seq]
    homes = {"https://a.com", "https://b.com/"}
    wanted = [i for i, u in enumerate(seq) if domains[:i].count(domains[i]) < limit or u in homes]
    df = spark.createDataFrame(list(enumerate(seq)), "pos long, url string")
    assert sorted(r["pos"] for r in domain_cap(df, limit).collect()) == wanted
