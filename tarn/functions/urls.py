"""URL expressions: authority, home page, penalty, prefixes, variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def netloc(url: Column) -> Column:
    """User info, host and port as written; empty without ``//``."""
    return F.regexp_extract(url, NETLOC, 1)


def is_home(url: Column) -> Column:
    """U4: nothing but slashes after the host. Only ``https://`` counts as a
    scheme, so an http home page is none."""
    rest = F.when(url.startswith("https://"), F.substring(url, 9, 1 << 30)).otherwise(url)
    return ~F.contains(F.rtrim(rest, F.lit("/")), F.lit("/"))


def penalty(url: Column) -> Column:
    """From 0 to 0.9, growing with length and for pages, paths and plain http."""

    def more(s: Column, when: Column, k: float) -> Column:
        return F.when(when, s + (1 - s) * k).otherwise(s)

    s = F.greatest(F.lit(0.0), (F.length(url) - 30) / F.lit(200.0))
    s = more(s, F.contains(url, F.lit(".htm")) | F.contains(url, F.lit(".php")), 0.3)
    trimmed = F.rtrim(url, F.lit("/"))
    s = more(s, F.length(trimmed) - F.length(F.replace(trimmed, F.lit("/"), F.lit(""))) > 2, 0.1)
    s = more(s, (F.length(url) < 5) | (F.substring(url, 5, 1) == ":"), 0.3)
    return F.least(s, F.lit(0.9))


def prefixes(url: Column) -> Column:
    """The host and every longer path prefix, as an array; empty for other
    schemes and for hosts that start with a space, slash or percent sign."""
    low = F.lower(url)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "^https?://", ""), "[?#]", "/"), "/$", "")
    parts = F.split(rest, "/", -1)
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    fits = low.rlike("^https?://") & rest.rlike(r"(?s)^[^ /%]")
    return F.when(url.isNotNull(), F.when(fits, chain).otherwise(F.array().cast("array<string>")))


def variant_key(url: Column) -> Column:
    """What http, https and slash spellings of a URL have in common."""
    return F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "/$", "")
