"""Streaming index build (I1, C9): documents arrive as files, postings grow.

Each micro-batch writes its term frequencies under its own batch id, so a batch
that is run again overwrites what it wrote before. ``compacted`` gives the
postings that a batch build over the same documents gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.config import DEFAULT
from tarn.functions.urls import netloc
from tarn.operators.index import term_frequencies, weighed_terms
from tarn.operators.links import page_records
from tarn.operators.rank_cut import top_per_key
from tarn.sources.index_store import IndexStore


def feed(spark: SparkSession, source: str, schema: str, target: str, plain: bool = False, files_per_batch: int = 1000) -> None:
    """Reads what is at ``source`` and not yet in ``target``, then stops."""

    def take(batch: DataFrame, batch_id: int) -> None:
        term_frequencies(batch, "doc_id", plain=plain).write.mode("overwrite").parquet(f"{target}/tf/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    run = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()


def feed_index(store: IndexStore, source: str, schema: str, checkpoint: str, plain: bool = False, cut: bool = True, files_per_batch: int = 1000) -> None:
    """Documents (doc_id, text) that arrive as files become segments of ``store``, with upkeep after each batch; then stops. A
    batch that is run again finds its number in the store and is left alone."""

    def take(batch: DataFrame, batch_id: int) -> None:
        store.add(weighed_terms(batch, "doc_id", plain=plain), batch_id)
        store.upkeep(cut)

    stream = store.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def compacted(spark: SparkSession, target: str, limit: int = DEFAULT.postings_limit) -> DataFrame:
    """(term, rank, doc_id, tf) of all batches."""
    rows = spark.read.schema("doc_id long, term string, tf long").parquet(f"{target}/tf/*")
    whole = rows.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
    return top_per_key(whole, ["term"], [F.desc("tf"), F.asc("doc_id")], limit).select("term", "rank", "doc_id", "tf")


def visit(spark: SparkSession, source: str, schema: str, target: str, files_per_batch: int = 1000) -> None:
    """Pages (page_id, url, html) that arrive as files leave their records, their domains' visits and
    the domains that those link to, under the batch's id."""

    def take(batch: DataFrame, batch_id: int) -> None:
        records = page_records(batch).withColumn("domain", F.lower(netloc(F.col("url"))))
        records.drop("raw").write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/pages/batch={batch_id}")
        told = spark.read.parquet(f"{target}/pages/batch={batch_id}")
        told.groupBy("domain").agg(F.count("*").alias("visits")).write.mode("overwrite").parquet(f"{target}/domains/batch={batch_id}")
        links = told.select("domain", F.explode("href").alias("href")).select("domain", F.lower(netloc(F.col("href"))).alias("outlink"))
        links.distinct().write.mode("overwrite").parquet(f"{target}/outlinks/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def outlinks(spark: SparkSession, target: str) -> DataFrame:
    """(domain, outlink): the domains that a domain's pages link to, a row each, of all batches."""
    return spark.read.schema("domain string, outlink string").parquet(f"{target}/outlinks/*").distinct()


def domains(spark: SparkSession, target: str) -> DataFrame:
    """(domain, visits) of all batches."""
    return spark.read.schema("domain string, visits long").parquet(f"{target}/domains/*").groupBy("domain").agg(F.sum("visits").alias("visits"))
