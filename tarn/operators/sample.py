"""Repeatable random choice: numbers from an md5 of the row's key, never ``rand()``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(key: Column, seed: str = "") -> Column:
    """A number in (0, 1) for each key: the first 12 hex digits of its md5."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary")), 1, 12), 16, 10).cast("double")
    return (digits + 0.5) / float(1 << 48)


def one_in(key: Column, percent: int, seed: str = "") -> Column:
    """I8: true for ``percent`` of the keys."""
    return F.pmod(F.floor(uniform(key, seed) * 1_000_000), F.lit(100)) < percent


def weighted(df: DataFrame, key: str, weight: Column, n: int, seed: str = "") -> DataFrame:
    """``n`` rows without replacement, likelier with more weight: those with
    the smallest -ln(u) / weight."""
    draw = F.round(-F.log(uniform(F.col(key), seed)) / weight, 9)
    return df.where(weight > 0).withColumn("draw", draw).orderBy("draw", key).limit(n)


def shuffled(df: DataFrame, key: str, seed: str = "") -> DataFrame:
    """B2: in random order, with the place as ``draw``."""
    return df.withColumn("draw", uniform(F.col(key), seed)).orderBy("draw", key)
