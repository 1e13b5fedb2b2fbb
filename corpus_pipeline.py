"""Cleaning of a document table into packed training sequences.

Stages, each over all that the one before kept, written as Parquet in the shared
folder and read again: drop documents of low quality, drop toxic ones, keep one
of each group of near copies, mask secrets, pack into sequences.

Near copies have sets of five-word shingles of a Jaccard similarity of 0.8 or
more, or a chain of such documents between them; of a group the smallest doc_id stays.
They meet by SimHash fingerprints first, checked on the sets; pairs that fingerprints cannot tell
meet by the hashes of their sets.

Defined cases: rows with a null doc_id form no group and stay; of rows that share a doc_id each
text stays once; null and empty texts are one group; an empty table gives an empty result; columns of
any other name go through all stages but the last; without labels no document is dropped as bad or toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import packing, quality, secrets, simhash, toxicity
from tarn.llm.common import read_table, released, stored_at
from tarn.session import share_package, shared_paths

WORDS, SIMILARITY, CAPACITY = 5, 0.8, 1024
ORACLE_SQL = None  # no stage is within SQL's reach


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_package(spark)
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_package(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_package(spark)
    return simhash.keep_one(docs, WORDS, SIMILARITY)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_package(spark)
    masked = secrets.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_package(spark)
    return packing.pack_documents(docs, CAPACITY)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stored on its way, and the stage before it, goes
    once its own rows are stored."""
    share_package(spark)
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with shared_paths() as made:
            docs, path = stored_at(stage(spark, docs, sf_dir), f"pipeline-{name}")
        for old in (*before, *made):
            if old != path:
                released(spark, old)
        before = [path]
    return docs
