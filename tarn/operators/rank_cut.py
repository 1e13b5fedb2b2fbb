"""Rank-and-cut: the best rows of each group, and rows that are exempt.

Catalyst turns ``rank <= limit`` over a window into a group limit that each task
applies before the shuffle, so a group that holds much of a table sends at most
``limit`` rows a task to the one that ranks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.config import DEFAULT
from tarn.functions.urls import is_home, netloc
from tarn.session import shared_path


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each group in ``order``, with their rank."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, best).where(F.col(rank) <= limit)


def domain_cap(urls: DataFrame, limit: int = DEFAULT.domain_cap, pos: str = "pos", url: str = "url") -> DataFrame:
    """In the order of ``pos``, at most ``limit`` rows of a domain, and every
    home page. Until a domain has ``limit`` rows nothing is left out, so its first
    rows are exactly those of rank up to ``limit``."""
    keyed = urls.withColumn("__domain", F.lower(netloc(F.col(url))))
    capped = top_per_key(keyed, ["__domain"], [F.col(pos)], limit, "__rank").drop("__rank")
    homes = keyed.where(is_home(F.col(url)))
    # A home page among the first rows is in both; ``pos`` identifies a row.
    return capped.unionByName(homes.join(capped.select(pos), pos, "left_anti")).drop("__domain")


def domain_cap_sorted(urls: DataFrame, limit: int = DEFAULT.domain_cap, pos: str = "pos", url: str = "url") -> DataFrame:
    """The rows of U5 in order."""
    return domain_cap(urls, limit, pos, url).orderBy(pos)


def kth_smallest(df: DataFrame, column: str, k: int, bins: int = 1024) -> int | None:
    """The ``k``-th smallest value (from 1) of a column of whole numbers, or None if there are fewer. Each round counts the values in
    ``bins`` equal ranges and goes on within the one that has it; nothing is sorted or gathered."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < k:
        return None
    while lo < hi:
        width = (hi - lo) // bins + 1
        inside = df.where(F.col(column).between(lo, hi))
        for b, n in sorted(tuple(r) for r in inside.groupBy(F.floor((F.col(column) - lo) / width).cast("long")).count().collect()):
            if n >= k:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            k -= n
    return lo


def ranked_overall(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """All rows with their rank (long, from 1) over the whole table. Ranges of ``order`` are
    sorted by a task each and stored; only the number of rows of each range comes to the driver.
    Rows that ``order`` does not tell apart have neighbouring ranks in any order."""
    spark = df.sparkSession
    path = shared_path(spark, "ranked")
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_.withColumn("__at", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    placed = spark.read.schema(df.schema.add("__at", "long")).parquet(path)
    # The number of a row within its range is in the lower 33 bits, that of the range above them.
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    before, starts = 0, []
    for p, n in sorted(tuple(r) for r in placed.groupBy(part).count().collect()):
        starts.append((p, before))
        before += n
    known = spark.createDataFrame(starts, "__part long, __start long")
    return placed.withColumn("__part", part).join(F.broadcast(known), "__part").withColumn(rank, F.col("__start") + within + 1).drop("__at", "__part", "__start")
