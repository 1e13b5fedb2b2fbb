"""Terms that a misspelt one may stand for: all within two edits, by shared deletions.

Two words are within ``edits`` insertions, deletions and replacements only if leaving out at most so many characters of each makes
them equal. So the index has, for every term, a 64-bit hash of each of its shortened forms; a query's forms meet it by
equality, and edit distance tells which of the terms met are near. Nothing is compared with all terms.

Defined cases: null and empty words have no near terms; a word is near itself; words of any length (a form is a hash, but making
them takes time with the square of a word's length for two edits); repeated words count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _without_one(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def forms(word: Column, edits: int) -> Column:
    """The different strings that leaving out up to ``edits`` characters of ``word`` gives."""
    found = F.array(word)
    for _ in range(edits):
        shorter = F.flatten(F.transform(found, lambda w: F.when(F.length(w) > 0, _without_one(w)).otherwise(F.array().cast("array<string>"))))
        found = F.array_distinct(F.concat(found, shorter))
    return found


def deletions(terms: DataFrame, edits: int = 2, term: str = "term") -> DataFrame:
    """(hash, term): the index of ``terms``; store it by hash where many queries come."""
    words = terms.select(F.col(term).alias("term")).where(F.col("term") != "").distinct()
    return words.select(F.explode(F.transform(forms(F.col("term"), edits), lambda w: F.xxhash64(w))).alias("hash"), "term")


def near_terms(words: DataFrame, index: DataFrame, edits: int = 2, word: str = "word") -> DataFrame:
    """(word, term, distance) of all terms of ``index`` within ``edits`` of each word of ``words``."""
    asked = words.select(F.col(word).alias("word")).where(F.col("word") != "").distinct()
    keys = asked.select("word", F.explode(F.transform(forms(F.col("word"), edits), lambda w: F.xxhash64(w))).alias("hash"))
    met = keys.join(index, "hash").select("word", "term").distinct()
    return met.withColumn("distance", F.levenshtein("word", "term", edits)).where(F.col("distance") >= 0)


def corrected(words: DataFrame, index: DataFrame, frequency: DataFrame, edits: int = 2, word: str = "word") -> DataFrame:
    """(word, term, distance): the term that each word most likely stands for: the nearest, then the most frequent
    (``frequency``: term, df), then the first. Words without a near term are left out."""
    near = near_terms(words, index, edits, word).join(frequency.select("term", "df"), "term")
    best = F.min(F.struct("distance", (-F.col("df")).alias("order"), "term")).alias("best")
    return near.groupBy("word").agg(best).select("word", F.col("best.term").alias("term"), F.col("best.distance").alias("distance"))
