"""What a crawl knows of each domain, kept as the state of a stream.

Pages that arrive add to their domain's state: visits, how many pages are of each language, and a sketch of the domains that
it links to: the ``SKETCH`` smallest 64-bit hashes of them. The sketch is exact up to that many and an estimate beyond, it has a
bound however many links a domain has, and it does not depend on the order or the batches in which pages come.
With ``idle``, a domain that no page has come from for that long, by the pages' own time and the watermark, is
told once more as ``ended`` and forgotten.

State, offsets and what was written so far are in the checkpoint folder: a stream that is started again goes
on from there, and a batch that is run again overwrites what it wrote.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarn.functions.html import absolute, hrefs, visible
from tarn.functions.lang import detect
from tarn.functions.urls import netloc

SKETCH = 256
STATE = "visits long, langs string, links string"
OUT = "domain string, visits long, langs map<string,long>, n_outlinks long, ended boolean"


def seen(pages: DataFrame, lang: Column | None = None, at: Column | None = None) -> DataFrame:
    """(domain, at, lang, links: hashes of linked domains, each once) of every page (url, html). A row is small, whatever its page."""
    url, html = F.col("url"), F.col("html")
    links = F.array_distinct(F.transform(hrefs(html), lambda h: F.xxhash64(F.lower(netloc(absolute(url, h))))))
    told = detect(visible(html)) if lang is None else lang
    rows = pages.select(F.lower(netloc(url)).alias("domain"), (F.lit(None).cast("timestamp") if at is None else at).alias("at"), told.alias("lang"), links.alias("links"))
    return rows.where("domain <> ''")


def estimate(links: list[int]) -> int:
    """How many different hashes there were, from the smallest ones of them."""
    if len(links) < SKETCH:
        return len(links)
    return round((SKETCH - 1) / ((links[-1] + 2**63 + 1) / 2**64))


def _told(domain: str, visits: int, langs: dict[str, int], links: list[int], ended: bool) -> pd.DataFrame:
    return pd.DataFrame({"domain": [domain], "visits": [visits], "langs": [langs], "n_outlinks": [estimate(links)], "ended": [ended]})


def _update(idle: int | None):
    def run(key: tuple[Any, ...], pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        visits, langs, links = state.get if state.exists else (0, "{}", "[]")
        langs, links = json.loads(langs), json.loads(links)
        if state.hasTimedOut:
            state.remove()
            yield _told(key[0], visits, langs, links, True)
            return
        last = 0
        for part in pages:
            visits += len(part)
            for lang, n in part["lang"].value_counts().items():
                langs[lang] = langs.get(lang, 0) + int(n)
            links = sorted({*links, *(int(h) for hs in part["links"] if hs is not None for h in hs)})[:SKETCH]
            if idle is not None and part["at"].notna().any():
                last = max(last, int(part["at"].max().timestamp() * 1000))
        state.update((visits, json.dumps(langs), json.dumps(links)))
        if idle is not None:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1) + idle)
        yield _told(key[0], visits, langs, links, False)

    return run


def domain_states(rows: DataFrame, idle: int | None = None, late: str = "0 seconds") -> DataFrame:
    """A row for each domain that a batch of the stream ``rows`` (of ``seen``) tells something of, with all that is known then; ``idle`` in milliseconds."""
    if idle is not None:
        rows = rows.withWatermark("at", late)
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("domain").applyInPandasWithState(_update(idle), OUT, STATE, "update", timeout)


def follow(spark: SparkSession, source: str, schema: str, target: str, idle: int | None = None, at: Column | None = None, files_per_batch: int = 1000) -> None:
    """Reads the pages that are at ``source`` and not yet told of in ``target``, then stops."""

    def take(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/states/batch={batch_id}")

    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    run = domain_states(seen(pages, at=at), idle).writeStream.foreachBatch(take).outputMode("update")
    run.option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """(domain, visits, langs, n_outlinks, ended): the newest row of every domain."""
    rows = spark.read.schema(f"{OUT}, batch long").parquet(f"{target}/states")
    newest = rows.groupBy("domain").agg(F.max_by(F.struct("visits", "langs", "n_outlinks", "ended"), "batch").alias("s"))
    return newest.select("domain", "s.visits", "s.langs", "s.n_outlinks", "s.ended")
