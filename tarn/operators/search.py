"""Keyword search over postings, with snippets (Q1 to Q7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.config import DEFAULT
from tarn.functions.text import pieces, terms
from tarn.operators import blocks
from tarn.operators.index import positions
from tarn.sources.index_store import IndexStore


def query_terms(spark: SparkSession, q: str) -> DataFrame:
    """Q2: the distinct terms of a query; few rows, whatever the corpus."""
    return spark.range(1).select(F.explode(F.array_distinct(terms(F.lit(q)))).alias("term"))


def ranked(postings: DataFrame, wanted: DataFrame, key: str, score: Column, k: int | None = DEFAULT.results) -> DataFrame:
    """Q3 to Q5: (key, score) of the ``k`` best, or of all in no order; a document with
    any of the terms counts, scores add up, ties go to the smaller key."""
    found = postings.join(F.broadcast(wanted), "term")  # the terms of one query
    scored = found.groupBy(key).agg(F.round(F.sum(score.cast("double")), 6).alias("score"))
    return scored if k is None else scored.orderBy(F.desc("score"), key).limit(k)


def stored_best(store: IndexStore, q: str, k: int = DEFAULT.results) -> DataFrame:
    """Q3 to Q5 over a stored index: (doc, score) of the ``k`` best, best first. Only the query's lists are read, and
    of those only the blocks that can matter."""
    spark = store.spark
    wanted = [r["term"] for r in query_terms(spark, q).collect()]  # the terms of one query
    asked = spark.createDataFrame([(0, t) for t in wanted], "query long, term string")
    best = blocks.searched(store.blocks(wanted), asked, k, cell=store.config.block_cell)[0]
    return best.orderBy("rank").select("doc", "score")


def snippet(text: Column, q: str, width: int = DEFAULT.snippet) -> Column:
    """Q6: ``width`` characters from a little before the first hit of any query
    term, else the beginning."""
    hits = F.filter(F.transform(terms(F.lit(q)), lambda t: F.call_function("locate", t, F.lower(text))), lambda p: p > 0)
    at = F.coalesce(F.array_min(hits), F.lit(1))
    return F.substring(text, F.greatest(at - width // 4, F.lit(1)), F.lit(width))


def search(postings: DataFrame, documents: DataFrame, q: str, key: str = "doc_id", score: Column | None = None, k: int = DEFAULT.results) -> DataFrame:
    """Q1: the ``k`` best documents of ``q`` with a snippet each."""
    best = ranked(postings, query_terms(postings.sparkSession, q), key, F.col("tf") if score is None else score, k)
    return shown(best, documents, q, key)


def stored_search(store: IndexStore, documents: DataFrame, q: str, key: str = "doc_id", k: int = DEFAULT.results) -> DataFrame:
    """Q1 over a stored index."""
    return shown(stored_best(store, q, k).withColumnRenamed("doc", key), documents, q, key)


def shown(best: DataFrame, documents: DataFrame, q: str, key: str) -> DataFrame:
    """Q6: (key, score, snippet) of the ``k`` rows of ``best``."""
    rows = documents.select(key, "text").join(F.broadcast(best), key)  # ``k`` rows
    return rows.select(key, "score", snippet(F.col("text"), q).alias("snippet"))


def windows(places: DataFrame, key: str) -> DataFrame:
    """Q6: (key, n_terms, first, last): of ``places`` (key, term, places) of the terms of one query, the least stretch of each text that has
    all of these terms that the text has; of equal ones the first. A hit ends such a stretch where every term has been met,
    and the stretch begins at the term whose last place is furthest back: one pass over a text's hits in order."""
    of_text = places.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "places"))).alias("terms"))
    n = F.size("terms")
    each = F.flatten(F.transform("terms", lambda t, i: F.transform(t["places"], lambda p: F.struct(p.alias("place"), i.alias("term")))))
    none = F.transform(F.sequence(F.lit(1), n), lambda i: F.lit(-1))
    start = F.struct(none.alias("last"), F.lit(None).cast("struct<size:int,first:int,last:int>").alias("best"))

    def met(acc: Column, hit: Column) -> Column:
        last = F.transform(acc["last"], lambda p, i: F.when(i == hit["term"], hit["place"]).otherwise(p))
        first = F.array_min(last)
        found = F.when(first >= 0, F.struct((hit["place"] - first).alias("size"), first.alias("first"), hit["place"].alias("last")))
        return F.struct(last.alias("last"), F.array_min(F.array(acc["best"], found)).alias("best"))

    best = F.aggregate(F.array_sort(each), start, met)["best"]
    return of_text.select(key, n.alias("n_terms"), best.alias("best")).select(key, "n_terms", F.col("best.first").alias("first"), F.col("best.last").alias("last"))


def window_snippets(best: DataFrame, documents: DataFrame, q: str, key: str = "doc_id", width: int = DEFAULT.snippet) -> DataFrame:
    """Q6: (key, score, n_terms, first, last, snippet) of the ``k`` rows of ``best`` (key, score): the least stretch of a text with the query's terms,
    then the text from there on up to ``width`` characters. ``documents`` has each key once."""
    rows = documents.select(key, "text").join(F.broadcast(best), key)  # ``k`` rows
    wanted = F.array_distinct(terms(F.lit(q)))
    found = windows(positions(rows, key).where(F.array_contains(wanted, F.col("term"))), key)
    words = pieces(F.col("text"))
    shown_ = F.substring(F.array_join(F.slice(words, F.col("first") + 1, F.size(words)), " "), 1, width)
    return rows.join(found, key).select(key, "score", "n_terms", "first", "last", shown_.alias("snippet"))


def as_json(results: DataFrame) -> DataFrame:
    """Q7: each result as a JSON object."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("result"))
