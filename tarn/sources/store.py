"""Key-value store and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Keys and values as zstd Parquet, partitioned by a hash of the key, so that
    a lookup reads one bucket. One writer at a time; a later value of a key wins."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets))

    def put(self, rows: DataFrame, version: int = 0) -> None:
        """Adds ``rows`` (key: string, value: any type)."""
        out = rows.select("key", "value").withColumns({"version": F.lit(version), "bucket": self._bucket(F.col("key"))})
        out.repartition("bucket").write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(self.path)

    def all(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return rows.groupBy("key").agg(F.max_by("value", "version").alias("value"))

    def get(self, *keys: str) -> DataFrame:
        """The values of some keys; only their buckets are read."""
        buckets = [r[0] for r in self.spark.createDataFrame([(k,) for k in keys], "key string").select(self._bucket(F.col("key"))).distinct().collect()]
        rows = self.spark.read.parquet(self.path).where(F.col("bucket").isin(*buckets) & F.col("key").isin(*keys))
        return rows.groupBy("key").agg(F.max_by("value", "version").alias("value"))


def write_scored(rows: DataFrame, path: str) -> None:
    """(score, url) lists; full doubles, so within any tolerance."""
    rows.select("score", "url").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("score double, url string").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_json`` wrote."""
    return spark.read.schema(schema).json(path)


def parse_json(text: Column, schema: str) -> Column:
    """Null for what is not JSON of this schema."""
    return F.from_json(text, schema)
