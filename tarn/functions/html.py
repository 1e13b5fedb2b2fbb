"""Page expressions, and the DOM shape."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.entities import name2codepoint
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.config import DEFAULT

# Tags with a number of their own (0, 1, 2, ... in this order).
TAGS = (
    "div meta script link h2 h3 td input source dd label nav picture section button dt form dl head body html title tr "
    "code style strong h4 i table em h1 noscript header video footer b iframe tbody template hr pre small figure center "
    "main th h5 h6 fieldset article var option select font ol legend track aside s blockquote area base map textarea big"
).split()
# Tags that are left out with all they hold.
LEFT_OUT = set("a p li ul span img br svg".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())


#: A character reference, whole.
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def unescaped(text: Column) -> Column:
    """``text`` with numeric character references and the named ones of HTML 4 decoded, each once; others stay."""
    named = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))])
    parts = F.split(F.regexp_replace(text, f"({REFERENCE})", "\u0000$1\u0000"), "\u0000")

    def decoded(part: Column) -> Column:
        inner = F.substring(part, F.lit(2), F.length(part) - 2)
        digits = F.when(inner.rlike("^#[xX]"), F.conv(F.substring(inner, F.lit(3), F.length(inner)), 16, 10)).otherwise(F.substring(inner, F.lit(2), F.length(inner)))
        code = digits.try_cast("long")
        is_character = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        numeric = F.when(is_character, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        return F.when(inner.startswith("#"), numeric).otherwise(F.coalesce(F.try_element_at(named, inner), part))

    whole = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^{REFERENCE}$"), decoded(p)).otherwise(p)), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def title(html: Column) -> Column:
    return unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def description(html: Column) -> Column:
    """What the page's meta tag says of it, or an empty string."""
    tag = F.regexp_extract(html, r"""(?is)(<meta\s[^>]*name=["']?description(?=["'\s/>])[^>]*>)""", 1)
    return unescaped(F.regexp_extract(tag, r"""(?is)\scontent=(["'])(.*?)\1""", 2))


#: The value of the first ``href`` of an ``a`` tag, in quotes of either kind or without.
HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def hrefs(html: Column) -> Column:
    """The links of ``a`` tags, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(HREF), 1), lambda h: unescaped(F.trim(F.regexp_replace(h, "^[\"']|[\"']$", ""))))


def absolute(base: Column, href: Column) -> Column:
    """A link in full, as RFC 3986 resolves it: rooted links take the base's scheme and host, others its folder, dot segments go."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    bare = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.split(F.regexp_replace(F.substring(bare, F.length(root) + 1, F.length(bare)), "[^/]*$", ""), "/")
    path, after = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    # The folder of ``/a/b`` is ``/a/``, which splits into an empty part, ``a`` and an empty part.
    start = F.when(path.startswith("/") | (F.size(folder) < 2), F.array(F.lit(""))).otherwise(F.slice(folder, 1, F.size(folder) - 1))
    parts = F.concat(start, F.split(F.regexp_replace(path, "^/", ""), "/"))
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(p))),
    )
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.array_join(kept, "/")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href == "", base)
        .when(href.startswith("?"), F.concat(bare, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .otherwise(F.concat(root, F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined)), after))
    )


def visible(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")), r"\s+", " "))


#: An opening tag ends open elements of these kinds, up to one of the kinds after the bar.
ENDS = {
    "td": ("td th", "table tr"), "th": ("td th", "table tr"), "tr": ("tr td th", "table"),
    "tbody": ("thead tbody tfoot tr td th", "table"), "thead": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table"),
    "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "li": ("li", "ul ol"), "option": ("option", "select"), "p": ("p", "div td th body"),
    "body": ("head", "html"),
}
ENDS = {tag: (set(ended.split()), set(within.split())) for tag, (ended, within) in ENDS.items()}
# How strongly elements hold against the end of another one; all others 100.
HOLD = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}
#: What stands in the head where a page has none.
IN_HEAD = set("title meta link base style script".split())


class _Tree(HTMLParser):
    """Elements as [tag, children]; exact on well-formed pages. End tags that may be
    left out are put in, and so are html, head and body.

    On broken pages: an end tag also ends what was opened within its element and not ended, unless that holds more
    strongly (an inline or block end tag within a table cell does not end the table); an end tag without an open element
    is left out; a second html or body tag is left out while the first is open; what is open at the end of the page ends there."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top: list = ["", []]
        self.open = [self.top]

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and any(n[0] == tag for n in self.open[1:]):
            return
        ended, within = ENDS.get(tag, ((), ()))
        for i in range(len(self.open) - 1, 0, -1) if ended else ():
            if self.open[i][0] in within:
                break
            if self.open[i][0] in ended:
                del self.open[i:]
        node = [tag, []]
        self.open[-1][1].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][1].append([tag, []])

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
            if HOLD.get(self.open[i][0], 100) > HOLD.get(tag, 100):
                break

    def root(self) -> list:
        """The html element."""
        found = [n for n in self.top[1] if n[0] == "html"]
        root = found[0] if found else ["html", []]
        loose = [n for n in self.top[1] if n is not root]
        parts = root[1] + loose
        if not any(n[0] == "body" for n in parts):
            head = [n for n in parts if n[0] == "head"]
            first = next((i for i, n in enumerate(parts) if n[0] not in IN_HEAD and n[0] != "head"), len(parts))
            early, late = [n for n in parts[:first] if n[0] in IN_HEAD], parts[first:]
            head = head or ([["head", early]] if early else [])
            parts = [*head, *([["body", late]] if late else [])]
        return ["html", parts]


def shape_of(html: str | None, limit: int = DEFAULT.shape_limit) -> str:
    """The nesting of a page's tags as compact JSON, cut at ``limit``."""
    if not html:
        return ""
    number = {t: i for i, t in enumerate(TAGS)}
    tree = _Tree()
    tree.feed(html)
    top = ["", [tree.root()]]
    # Children first, without recursion: pages may nest deeply.
    done: dict[int, list] = {}
    stack = [(top, False)]
    while stack:
        node, ready = stack.pop()
        inner = [c for c in node[1] if c[0] not in LEFT_OUT]
        if not ready:
            stack.append((node, True))
            stack += [(c, False) for c in inner]
            continue
        parts = []
        for c in inner:
            code = json.dumps(number.get(c[0], c[0]))
            below = done.pop(id(c))
            parts.append(f"[{code},[{','.join(below)}]]" if below else code)
        done[id(node)] = parts
    return f"[{','.join(done[id(top)])}]"[:limit]


def _shapes(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in html:
        yield part.map(shape_of)


def dom_shape(html: Column) -> Column:
    """``shape_of`` a column, in Arrow batches."""
    return F.pandas_udf(_shapes, "string")(html)
