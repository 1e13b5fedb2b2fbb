"""Helpers shared by the training-data operators."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.session import shared_path

#: Hint of joins whose sides both grow with the corpus. What Spark expects of a stored or exploded table can be far below its
#: real size, and it would send that table through the driver.
MERGE = "merge"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later plans start
    from the files, so a lost executor costs no recomputation."""
    return stored_at(df, label)[0]


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``stored``, and the folder."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def released(spark: SparkSession, path: str) -> None:
    """Deletes a folder in the shared folder that no table is to be read from any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def crc_mod(id_col: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as
    the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column's values as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column's values, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def crc32_ids(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


def bounded_sample(df: DataFrame, n: int, *keys: Column | str) -> DataFrame:
    """At most ``n`` rows of ``df``, those with the smallest hashes of ``keys``.

    Rows far above the cut are dropped before the sort, so it gets about ``n``
    rows from all tasks together.
    """
    total = df.count()
    hashed = df.withColumn("__hash", F.xxhash64(*keys))
    share = (1.2 * n + 1000) / max(total, 1)
    if share < 1:
        hashed = hashed.where(F.col("__hash") <= int(-(2**63) + share * (2**64 - 1)))
    return hashed.orderBy("__hash", *keys).limit(n).drop("__hash")


def beside_least(df: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` with ``least``, the smallest ``value`` of each ``key``. Rows of a key are
    dealt to as many parts as there are shuffle partitions, by their value, and only
    one row of each part meets the others: a key of many rows is no task's alone."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(value), F.lit(parts)).cast("int"))
    of_part = dealt.groupBy(key, "__part").agg(F.min(value).alias("least"))
    least = of_part.groupBy(key).agg(F.min("least").alias("least"))
    return dealt.join(of_part.select(key, "__part").join(least.hint(MERGE), key).hint(MERGE), [key, "__part"]).drop("__part")
