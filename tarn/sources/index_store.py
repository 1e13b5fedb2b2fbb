"""A stored index that grows by segments.

``segments/segment=<id>/bucket=<n>`` has sorted blocks of postings that never change; ``manifests/<version>`` names, for each bucket,
the segments that are read. A batch adds one segment. Upkeep rewrites the buckets of terms whose lists are due, and
those in too many segments, into one new segment; other buckets keep their files. Either is written
first and counts when its manifest appears under the next number, by one rename: a reader sees one version or the next,
a writer that fails leaves the old one, and of two writers one fails.

Postings are (term, doc: long, weight). Each document comes in one batch. What a cut leaves
out of a list would not be in it later either, as later postings only push it back, so after a last
cut the lists are those of a build over all documents.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.config import DEFAULT, Config
from tarn.operators import blocks
from tarn.operators.rank_cut import top_per_key
from tarn.operators.sample import one_in

SCHEMA = blocks.BLOCK.replace("bucket int, ", "") + ", segment string, bucket int"


class IndexStore:
    def __init__(self, spark: SparkSession, path: str, config: Config = DEFAULT):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, where: str) -> Any:
        return self._hadoop.Path(f"{self.path}/{where}" if where else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(at)) if self._files.exists(at) else []

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        return max((int(n) for n in self._names("manifests") if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "batch": -1, "buckets": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version:09d}", wholetext=True).first()[0])

    def _commit(self, after: dict, batch: int, buckets: dict[str, list[str]]) -> int:
        version = after["version"] + 1
        draft = self._at(f"drafts/{uuid.uuid4().hex}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps({"version": version, "batch": batch, "buckets": buckets}).encode()))
        out.close()
        self._files.mkdirs(self._at("manifests"))
        target = self._at(f"manifests/{version:09d}")
        if self._files.exists(target) or not self._files.rename(draft, target):
            raise RuntimeError(f"version {version} of {self.path} has been written by another")
        return version

    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """A new segment of postings, and the buckets it has."""
        segment, draft = f"s{uuid.uuid4().hex}", f"drafts/{uuid.uuid4().hex}"
        # Rows are read twice, first for their ranges: made once.
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{draft}")
        stored = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{draft}")
        made = blocks.packed(stored, self.config.index_buckets, self.config.block_cell, self.config.block_size, stored.count())
        made.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/segments/segment={segment}")
        self._files.delete(self._at(draft), True)
        return segment, [n.split("=")[1] for n in self._names(f"segments/segment={segment}") if n.startswith("bucket=")]

    def add(self, postings: DataFrame, batch: int) -> int:
        """A batch as one more segment, in layers (they are made where ``postings`` has none); a batch that is there already is left alone. The version."""
        now = self.manifest()
        if batch <= now["batch"]:
            return now["version"]
        segment, filled = self._write(postings if "layer" in postings.columns else blocks.layered(postings))
        lists = {b: list(s) for b, s in now["buckets"].items()}
        for b in filled:
            lists.setdefault(b, []).append(segment)
        return self._commit(now, batch, lists)

    def blocks(self, terms: list[str] | None = None, version: int | None = None, buckets: list[str] | None = None) -> DataFrame:
        """The blocks of all terms, or of some: then only their buckets and lists are read."""
        lists = self.manifest(version)["buckets"]
        if terms is not None:
            asked = self.spark.createDataFrame([(t,) for t in terms], "term string").select(blocks.bucket_of(F.col("term"), self.config.index_buckets).alias("b")).distinct()
            buckets = [str(r["b"]) for r in asked.collect()]
        chosen = lists if buckets is None else {b: lists[b] for b in buckets if b in lists}
        paths = [f"{self.path}/segments/segment={s}/bucket={b}" for b, segments in sorted(chosen.items()) for s in segments]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).option("basePath", f"{self.path}/segments").parquet(*paths)
        return rows if terms is None else rows.where(F.col("term").isin(*terms))

    def postings(self, terms: list[str] | None = None, version: int | None = None) -> DataFrame:
        """(term, doc, weight)"""
        return blocks.unpacked(self.blocks(terms, version), cell=self.config.block_cell)

    def due(self, seed: str = "") -> DataFrame:
        """I4, I8: (bucket, term) of the lists that are over 1.1 times their limit, or drawn for a cut anyway."""
        limit = self.config.postings_limit
        n = self.blocks().groupBy("bucket", "term").agg(F.sum("n").alias("n"))
        drawn = one_in(F.col("term"), self.config.compact_percent, seed) & (F.col("n") > limit)
        return n.where((F.col("n") > F.lit(self.config.compact_over * limit)) | drawn).select("bucket", "term")

    def upkeep(self, cut: bool = True, whole: bool = False, order: list[Column] | None = None) -> list[str]:
        """Rewrites the buckets that need it and gives their names. With ``cut`` those of due lists, which
        are cut to their limit by weight (``order``), else none is cut; those in more than ``index_segments`` segments, or with ``whole``
        all in more than one, are made one."""
        now = self.manifest()
        most = 1 if whole else self.config.index_segments
        many = {b for b, s in now["buckets"].items() if len(s) > most}
        due = self.due(str(now["version"])) if cut else None
        if due is not None and whole:
            n = self.blocks().groupBy("bucket", "term").agg(F.sum("n").alias("n"))
            due = n.where(F.col("n") > self.config.postings_limit).select("bucket", "term")
        if due is not None:
            due.write.parquet(listed := f"{self.path}/drafts/{uuid.uuid4().hex}")
            due = self.spark.read.schema(due.schema).parquet(listed)
            many |= {str(r["bucket"]) for r in due.select("bucket").distinct().collect()}
        chosen = sorted(many, key=int)
        if not chosen:
            return []
        rows = blocks.unpacked(self.blocks(buckets=chosen), "layer", cell=self.config.block_cell)
        if due is not None:
            lists = due.select("term")
            best = order or [F.desc("weight"), F.asc("doc")]
            cut_ = top_per_key(rows.join(lists, "term", "left_semi"), ["term"], best, self.config.postings_limit).drop("rank")
            rows = rows.join(lists, "term", "left_anti").unionByName(cut_)
        segment, filled = self._write(rows)
        lists_ = {b: s for b, s in now["buckets"].items() if b not in chosen}
        self._commit(now, now["batch"], lists_ | {b: [segment] for b in filled})
        return chosen

    def clean(self, keep: int = 2) -> list[str]:
        """Deletes what none of the newest ``keep`` versions reads, and gives the segments. No reader may be at an older one."""
        last = self.version()
        used = {s for v in range(max(1, last - keep + 1), last + 1) for segments in self.manifest(v)["buckets"].values() for s in segments}
        old = [n for n in self._names("segments") if n.split("=")[1] not in used]
        for name in old:
            self._files.delete(self._at(f"segments/{name}"), True)
        for v in range(1, last - keep + 1):
            self._files.delete(self._at(f"manifests/{v:09d}"), False)
        return [n.split("=")[1] for n in old]
