"""Tokenizing, term analysis, DOM shapes and language."""

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tarn.functions import html, lang, text
from tests.conftest import SF


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("v")).first()["v"]


def test_tokens(spark):
    assert one(spark, "Hello World 42", text.tokens) == ["Hello", "World", "42"]
    assert one(spark, "café are. x-1", text.tokens) == ["café", "are", "x", "1"]
    assert one(spark, "你好吗 x", text.tokens) == ["你", "好", "吗", "x"]
    assert one(spark, "你好吗ab 字", lambda t: text.tokens(t, True)) == ["你好", "好吗", "ab", "字"]
    assert one(spark, "", text.tokens) == []
    assert one(spark, None, text.tokens) is None
    assert one(spark, "a " * 9000, lambda t: F.size(text.tokens(t))) == 5000


def test_white_space_is_that_of_python(spark):
    marks = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x200B, 0x180E)]
    s = "".join(f"x{i}{m}" for i, m in enumerate(marks))
    assert one(spark, s, text.pieces) == s.split()


def test_terms(spark):
    assert one(spark, "The CAT, sat. I by " + "x" * 33 + " " + "y" * 32, text.terms) == ["cat", "sat", "i", "y" * 32]


def test_shape():
    page = "<html><head><title>t</title></head><body><div><h1>x</h1></div><p><b>y</b></p></body></html>"
    assert html.shape_of(page) == "[[20,[[18,[21]],[19,[[0,[30]]]]]]]"
    assert html.shape_of("") == html.shape_of(None) == ""
    assert html.shape_of("<html><foo></foo><br><img></html>") == '[[20,[[19,["foo"]]]]]'
    assert len(html.shape_of("<div>" * 100_000)) == 512
    assert len(set(html.TAGS)) == 65


def shape(*node):
    """(tag, child, ...) as the shape writes it."""
    tag, *inner = node
    code = html.TAGS.index(tag) if tag in html.TAGS else tag
    return [code, [shape(*n) if isinstance(n, tuple) else shape(n) for n in inner]] if inner else code


@pytest.mark.parametrize(
    ("page", "tree"),
    [
        ("<table><tr><td>a<td><b>x</b><tr><th>c</table>", ("html", ("body", ("table", ("tr", "td", ("td", "b")), ("tr", "th"))))),
        ("<dl><dt>a<dd><i>x</i><dt>b</dl>", ("html", ("body", ("dl", "dt", ("dd", "i"), "dt")))),
        ("<select><option>a<option>b</select>", ("html", ("body", ("select", "option", "option")))),
        ("<title>t</title><div>x</div>", ("html", ("head", "title"), ("body", "div"))),
        ("<html><head><meta><title>t</title><body><div>x", ("html", ("head", "meta", "title"), ("body", "div"))),
        ("<table><tr><td><table><tr><td>x</table><td>y</table>", ("html", ("body", ("table", ("tr", ("td", ("table", ("tr", "td"))), "td"))))),
        ("<div><!-- c --><ul><li><div>left out</div></ul><svg><b></b></svg><h2>x</h2></div>", ("html", ("body", ("div", "h2")))),
        ("text alone", ("html",)),
    ],
)
def test_shapes_of_hand_made_pages(page, tree):
    assert html.shape_of(page) == json.dumps([shape(*tree)], separators=(",", ":"))


def test_description(spark):
    for page, said in {
        '<meta name="description" content="A \'short\' text"><p>x': "A 'short' text",
        "<META content='about it' name=description>": "about it",
        '<meta name="keywords" content="a, b">': "",
        "": "",
    }.items():
        assert one(spark, page, html.description) == said


def test_links(spark):
    cases = {"/a": "https://x.com/a", "b": "https://x.com/d/b", "//y.com/c": "https://y.com/c", "http://z.com": "http://z.com"}
    for href, full in cases.items():
        assert one(spark, href, lambda h: html.absolute(F.lit("https://x.com/d/e?q=/1#f"), h)) == full
    assert one(spark, "b", lambda h: html.absolute(F.lit("https://x.com"), h)) == "https://x.com/b"


def test_language_is_mostly_right(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("lang").isNotNull())
    right = docs.select((lang.detect(F.col("text")) == F.col("lang")).cast("int").alias("r")).agg(F.avg("r")).first()[0]
    assert right > 0.8
    assert one(spark, "", lang.detect) == "und"
    assert pq.read_table(f"{SF}/documents.parquet").num_rows >= 200


def test_language_is_that_of_the_whole_text(spark):
    assert one(spark, "x1 " * 4000 + "der die das und nicht", lang.detect) == "de"
    assert one(spark, "the of and " * 1000 + "der die das und nicht " * 3000, lang.detect) == "de"
