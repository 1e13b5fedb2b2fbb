"""Inverted index: term frequencies, postings, variants, weights and compaction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.config import DEFAULT, Config
from tarn.functions.text import is_plain, kept, pieces, plain_tokens, terms
from tarn.functions.urls import netloc, penalty, variant_key
from tarn.operators.blocks import layer_of, layered
from tarn.operators.rank_cut import top_per_key
from tarn.operators.sample import one_in

#: Texts whose terms are counted together.
ROWS = 256


def term_frequencies(docs: DataFrame, key: str, text: str = "text", plain: bool = False) -> DataFrame:
    """(key, term, tf): how often a term is in a text."""
    counts = _of_rows(docs, key, text, plain)
    if _each_once(docs, key):
        return counts.drop("total")
    return counts.groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def weighed_terms(docs: DataFrame, key: str, text: str = "text", plain: bool = False) -> DataFrame:
    """(term, doc, weight, layer): the postings of ``term_frequencies``, with the layers of ``blocks.layered``."""
    if not _each_once(docs, key):
        return layered(term_frequencies(docs, key, text, plain).select("term", F.col(key).alias("doc"), F.col("tf").alias("weight")))
    rows = _of_rows(docs, key, text, plain)
    return rows.select("term", F.col(key).alias("doc"), F.col("tf").alias("weight"), layer_of(F.col("total")).alias("layer"))


def _each_once(docs: DataFrame, key: str) -> bool:
    """Whether no two rows share a key; only the keys are read for it."""
    return docs.groupBy(key).count().where("count > 1").isEmpty()


def _of_rows(docs: DataFrame, key: str, text: str, plain: bool) -> DataFrame:
    """(key, term, tf, total): how often a term is in a row's text, and how many terms that has. A text is one row, so its
    terms are counted where it is read, and no task holds the counts of more texts than a batch has."""
    found = F.filter(F.transform(plain_tokens(F.col(text)), F.lower), lambda t: kept(t)) if plain else terms(F.col(text))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, term string, tf long, total long"
    return docs.select(key, found.alias("terms")).mapInArrow(_counts, schema)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            keys, lists = (c for c in batch.slice(at, ROWS).columns)
            words = lists.flatten().dictionary_encode()
            if not len(words):
                continue
            pair = lists.value_parent_indices().to_numpy().astype(np.int64) * len(words.dictionary) + words.indices.to_numpy()
            pairs, n = np.unique(pair, return_counts=True)
            row, word = pairs // len(words.dictionary), pairs % len(words.dictionary)
            total = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            yield pa.record_batch([keys.take(pa.array(row)), words.dictionary.take(pa.array(word)), pa.array(n.astype(np.int64)), pa.array(total[row])], names=[batch.schema.names[0], "term", "tf", "total"])


def positions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, places): where each plain term stands in a text, as numbers of its pieces between white space from 0 on. A text's
    tokenized part is bounded, and so are its lists."""
    each = docs.select(key, F.posexplode(pieces(F.col(text))).alias("place", "piece")).where(is_plain(F.col("piece")))
    return each.select(key, "place", F.lower("piece").alias("term")).where(kept(F.col("term"))).groupBy(key, "term").agg(F.array_sort(F.collect_list("place")).alias("places"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(term, df): how many texts hold a term."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def weight(tf: Column, n_backlinks: Column, url: Column) -> Column:
    """More with frequency and backlinks, less with the URL's penalty."""
    return F.round(tf * (1 + F.log(1 + n_backlinks)) * (1 - penalty(url)), 6)


def merge_variants(postings: DataFrame) -> DataFrame:
    """Spellings of one URL in a term become one: https before http, then
    without a last slash; the larger tf stays."""
    choice = F.struct((~F.col("url").startswith("https://")).alias("http"), F.col("url").endswith("/").alias("slash"), F.col("url").alias("url"))
    return postings.groupBy("term", variant_key(F.col("url")).alias("key")).agg(F.min(choice)["url"].alias("url"), F.max("tf").alias("tf")).drop("key")


def trimmed(postings: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """In each term the heaviest postings, first of each domain, then of all."""
    by_weight = [F.desc("weight"), F.asc("url")]
    domains = top_per_key(postings.withColumn("domain", F.lower(netloc(F.col("url")))), ["term", "domain"], by_weight, config.postings_per_domain, "__of_domain")
    return top_per_key(domains.drop("__of_domain"), ["term"], by_weight, config.postings_limit)


def compaction_due(postings: DataFrame, batch: str = "", config: Config = DEFAULT) -> DataFrame:
    """I4, I8: (term, n, over, forced, due): is a term's list over 1.1 times its
    limit, or drawn for a cut anyway?"""
    n = postings.groupBy("term").agg(F.count("*").alias("n"))
    over, forced = F.col("n") > F.lit(config.compact_over * config.postings_limit), one_in(F.col("term"), config.compact_percent, batch)
    return n.select("term", "n", over.alias("over"), forced.alias("forced"), (over | forced).alias("due"))


def inverted(postings: DataFrame) -> DataFrame:
    """(term, postings): each term's list, heaviest first. Trim before: a
    list is one value."""
    entry = F.struct((-F.col("weight")).alias("order"), "url")
    return postings.groupBy("term").agg(F.array_sort(F.collect_list(entry)).alias("p")).select("term", F.transform("p", lambda x: F.struct((-x["order"]).alias("weight"), x["url"].alias("url"))).alias("postings"))


def compacted(postings: DataFrame, batch: str = "", config: Config = DEFAULT) -> DataFrame:
    """The postings (term, url, weight) after a round of upkeep: lists that are
    due are cut to their limits, all others stay whole."""
    due = compaction_due(postings, batch, config).where("due").select("term")
    whole = postings.join(due, "term", "left_anti")
    cut = trimmed(postings.join(due, "term", "left_semi"), config).select(*postings.columns)
    return whole.unionByName(cut)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_postings(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings as zstd Parquet in folders by a hash of the term, each list heaviest
    first; a look-up reads the folders of its terms alone. A term's list is in one file's
    sorted run, so that statistics of row groups skip the rest of a folder."""
    rows = postings.select("term", "url", "weight").withColumn("bucket", _bucket(F.col("term"), buckets))
    placed = rows.repartition("bucket", "term").sortWithinPartitions("bucket", "term", F.desc("weight"), "url")
    placed.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, terms: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """(term, url, weight) of all terms, or of some: then only their folders and lists are read."""
    rows = spark.read.schema("term string, url string, weight double, bucket int").parquet(path)
    if terms is not None:
        places = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"), buckets)).distinct().collect()] if terms else []
        rows = rows.where(F.col("bucket").isin(*places) & F.col("term").isin(*terms))
    return rows.drop("bucket")
