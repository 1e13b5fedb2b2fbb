"""Links, character references and page records on hand-made pages."""

import html as stdlib_html
from urllib.parse import urljoin

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.functions import html

BASES = ["https://a.example/b/c/d?q=1#f", "https://a.example", "http://a.example/", "https://a.example/b", "https://u@a.example:8/b/./x/"]
LINKS = ["g", "./g", "g/", "/g", "//h/x", "?y", "g?y#s", "#s", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "..g", "./../g", "./g/.", "g/./h", "g/../h", "https://z/x/../y", "mailto:a@b", "a/b/../../c?d=../e", "x y", "é/ü"]


def test_links_are_resolved_as_urljoin_does(spark):
    rows = spark.createDataFrame([(b, h) for b in BASES for h in LINKS], "base string, href string")
    for r in rows.select("base", "href", html.absolute(F.col("base"), F.col("href")).alias("full")).collect():
        assert r["full"] == urljoin(r["base"], r["href"]), (r["base"], r["href"])


def test_all_forms_of_links(spark):
    page = """<A class=x HREF='/one?a=1&amp;b=2'>x</a> <a data-href="/no" href="/two">y</a><a data-href="/no">z</a> <a
      title="t" href = three rel=y>w</a><abbr href="/no"> <a href="">e</a> <a href=" /five ">v</a><area href="/no"><a href="/s&#x69;x">"""
    got = spark.createDataFrame([(page,), (None,), ("",), ("<a href=",)], "h string").select(html.hrefs(F.col("h")).alias("l")).collect()
    assert got[0]["l"] == ["/one?a=1&b=2", "/two", "three", "", "/five", "/six"]
    assert got[1]["l"] is None and got[2]["l"] == [] and got[3]["l"] == []


NAMED = ["&amp;", "&lt;", "&gt;", "&quot;", "&copy;", "&middot;", "&nbsp;", "&eacute;", "&Uuml;", "&euro;", "&alpha;", "&#39;", "&#x1F642;", "&#8364;", "&#X41;", "&amp;lt;", "&nosuch;", "&", ";", "a&b", "&#0;", "&#xD800;", "&#1114112;", "&#;"]


def test_references_are_decoded_once(spark):
    texts = [*NAMED, "&amp;amp; &lt;b&gt; &amp;copy;", "plain", "", None, "&amp;" * 3000]
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(html.unescaped(F.col("t")).alias("t")).collect()]
    assert got == [None if t is None else stdlib_html.unescape(t) for t in texts]


@settings(max_examples=12, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from([*NAMED[:17], "x", " ", "é"]), max_size=6).map("".join), min_size=1, max_size=30))
def test_any_text_of_references(spark, texts):
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(html.unescaped(F.col("t")).alias("t")).collect()]
    assert got == [stdlib_html.unescape(t) for t in texts]


def test_titles_and_texts_are_decoded(spark):
    page = "<title>A &amp; B</title><meta name=description content='x &quot;y&quot;'><p>1 &lt; 2</p><!-- &amp; --><script>&lt;</script>&copy; Z"
    r = spark.createDataFrame([(page,)], "h string").select(html.title(F.col("h")).alias("t"), html.description(F.col("h")).alias("d"), html.visible(F.col("h")).alias("v")).first()
    assert (r["t"], r["d"], r["v"]) == ("A & B", 'x "y"', "A & B 1 < 2 © Z")


def test_shapes_of_broken_pages():
    number = {t: i for i, t in enumerate(html.TAGS)}

    def shape(tree):
        name, below = tree
        code = str(number[name])
        return f"[{code},[{','.join(map(shape, below))}]]" if below else code

    def page(*body):
        return "[" + shape(("html", [("body", list(body))])) + "]"

    div, b, i_, table, td, tr = (lambda *below, tag=tag: (tag, list(below)) for tag in ("div", "b", "i", "table", "td", "tr"))
    cases = {
        "<div><b>1<i>2</b>3</i>4</div>": page(div(b(i_()))),
        "</b><div></i></div></div>": page(div()),
        "<div><table><tr><td><b></div>x</td></tr></table><i></i></div>": page(div(table(tr(td(b()))), i_())),
        "<table><tr><td></table><div></div>": page(table(tr(td())), div()),
        "<div><b><i>": page(div(b(i_()))),
        "<html><body><div></div><body><html><b></b></body></html>": page(div(), b()),
        "<table><tr><td>1<td>2<tr><td>3</table>": page(table(tr(td(), td()), tr(td()))),
    }
    for text, want in cases.items():
        assert html.shape_of(text) == want, text
