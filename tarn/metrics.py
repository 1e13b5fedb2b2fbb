"""Errors and indicators.

Spark's own ``PrometheusServlet`` serves metrics on a cluster; what is here counts
the rows and errors of a query.
"""

from __future__ import annotations

import os
import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def ordered_map(df: DataFrame, pos: str, **columns: Column) -> DataFrame:
    """Expressions over all rows in parallel, results in the order of ``pos``."""
    return df.select(pos, *[c.alias(n) for n, c in columns.items()]).orderBy(pos)


def guarded(df: DataFrame, key: str, value: str, fn: Callable, result: str) -> DataFrame:
    """U8: ``fn`` of each value as (key, result, error, place, trace). An error fills its
    row's ``error`` (the type's full name), ``place`` ([file:line] where it was raised) and
    ``trace``; the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, v in zip(batch[key], batch[value]):
                try:
                    out.append((k, fn(v), None, None, None))
                except Exception as e:  # noqa: BLE001 - counting any error is what this is for
                    t, at = type(e), traceback.extract_tb(e.__traceback__)[-1]
                    name = t.__name__ if t.__module__ == "builtins" else f"{t.__module__}.{t.__name__}"
                    out.append((k, None, name, f"[{os.path.basename(at.filename)}:{at.lineno}]", traceback.format_exc()))
            yield pd.DataFrame(out, columns=[key, "result", "error", "place", "trace"])

    return df.select(key, value).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, result {result}, error string, place string, trace string")


def error_counts(results: DataFrame) -> DataFrame:
    """(type, errors): the counter of ``guarded``'s errors."""
    return results.where("error is not null").groupBy(F.col("error").alias("type")).agg(F.count("*").alias("errors"))


def errors_by_place(results: DataFrame) -> DataFrame:
    """(key, errors): the counter by [file:line]Type."""
    return results.where("error is not null").groupBy(F.concat("place", "error").alias("key")).agg(F.count("*").alias("errors"))


def quarantined(results: DataFrame, key: str, most: int) -> DataFrame:
    """(key, error, trace) of the last ``most`` failed rows by key: a log of bounded size."""
    return results.where("error is not null").select(key, "error", "trace").orderBy(F.desc(key)).limit(most)


def observed(df: DataFrame, name: str | Observation, **indicators: Column) -> DataFrame:
    """M1: the same rows; listeners, or the observation, get the indicators when a query
    over them ends. M2: on a cluster ``spark.ui.prometheus.enabled`` and a
    ``PrometheusServlet`` sink in ``spark.metrics.conf.*`` serve Spark's own metrics."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in indicators.items()])


def indicators_of(df: DataFrame, **indicators: Column) -> DataFrame:
    """M1: one row with the indicators of a run over all rows of ``df``."""
    seen = Observation()
    observed(df, seen, **indicators).write.format("noop").mode("overwrite").save()
    got = seen.get
    return df.sparkSession.createDataFrame([tuple(got[n] for n in ("rows", *indicators))], ", ".join(f"{n} long" for n in ("rows", *indicators)))
