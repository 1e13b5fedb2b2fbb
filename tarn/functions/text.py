"""Tokenizing and term analysis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.config import DEFAULT

#: White space as Unicode-aware splitting has it.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

# The stop words.
STOP_WORDS = (
    "in www when and about as la an to it be what the or I this with by und that how en are who at of com from a will "
    "was is where de on for"
).split()

HAN = r"\p{IsHan}"


def all_pieces(text: Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def pieces(text: Column, limit: int = DEFAULT.text_limit) -> Column:
    """The parts between white space of the first ``limit`` characters."""
    return all_pieces(F.substring(text, 1, limit))


def is_plain(piece: Column) -> Column:
    """ASCII letters and digits only."""
    return piece.rlike("^[A-Za-z0-9]+$")


def segments(piece: Column, search: bool = False) -> Column:
    """The fallback segmentation of a piece that is not plain: runs of letters and
    digits; of Chinese characters each one, or in search mode each pair (single
    ones stay). The dictionary segmenter that this stands in for is not here."""
    runs = F.regexp_extract_all(piece, F.lit(rf"{HAN}+|(?:(?!{HAN})[\p{{L}}\p{{N}}])+"), 0)

    def cut(run: Column) -> Column:
        step = 2 if search else 1
        last = F.greatest(F.length(run) - (step - 1), F.lit(1))
        return F.when(run.rlike(f"^{HAN}"), F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(run, i, F.lit(step)))).otherwise(F.array(run))

    return F.flatten(F.transform(runs, cut))


def tokens(text: Column, search: bool = False, limit: int = DEFAULT.text_limit) -> Column:
    """Plain pieces as they are, others segmented; order and repeats stay."""
    return F.flatten(F.transform(pieces(text, limit), lambda p: F.when(is_plain(p), F.array(p)).otherwise(segments(p, search))))


def plain_tokens(text: Column, limit: int = DEFAULT.text_limit) -> Column:
    """The plain part of ``tokens``."""
    return F.filter(pieces(text, limit), is_plain)


def reduced(token: Column) -> Column:
    """A1: lower case, without punctuation at either end."""
    return F.regexp_replace(F.lower(token), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def kept(term: Column, limit: int = DEFAULT.term_limit) -> Column:
    """A2, A3: neither empty, nor a stop word, nor too long."""
    return (term != "") & ~term.isin(*STOP_WORDS) & (F.length(term) <= limit)


def terms(text: Column, limit: int = DEFAULT.text_limit, longest: int = DEFAULT.term_limit) -> Column:
    """A4: search-mode tokens, reduced and filtered; order and repeats stay."""
    return F.filter(F.transform(tokens(text, True, limit), reduced), lambda t: kept(t, longest))
