"""Indicators of running streams as a table (M1, M2).

A listener writes a file for each micro-batch: its rows, how long it took, and what ``metrics.observed`` counts in it. The
folder is read as a table, while streams run or after. ``PROMETHEUS`` is the configuration with which a cluster's
driver and executors serve Spark's own metrics, those of streams among them, to a Prometheus server.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

#: For the builder of a session: metrics are at ``/metrics/prometheus`` of the driver's UI, executors' at ``/metrics/executors/prometheus``.
PROMETHEUS = {
    "spark.ui.enabled": "true",
    "spark.ui.prometheus.enabled": "true",
    "spark.metrics.conf.*.sink.prometheusServlet.class": "org.apache.spark.metrics.sink.PrometheusServlet",
    "spark.metrics.conf.*.sink.prometheusServlet.path": "/metrics/prometheus",
    "spark.sql.streaming.metricsEnabled": "true",
}

SCHEMA = "query string, run string, batch long, at timestamp, rows long, seconds double, name string, indicator string, value string"


class ProgressLog(StreamingQueryListener):
    """Writes each micro-batch's indicators under ``path``, a folder of the session's default file system or with a scheme."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.path = path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        base = {"query": str(p.id), "run": str(p.runId), "batch": p.batchId, "at": p.timestamp, "rows": p.numInputRows, "seconds": (p.batchDuration or 0) / 1000}
        lines = [base | {"name": "stream", "indicator": "rows", "value": str(p.numInputRows)}]
        for name, row in (p.observedMetrics or {}).items():
            lines += [base | {"name": name, "indicator": k, "value": None if v is None else str(v)} for k, v in row.asDict().items()]
        where = self._hadoop.Path(f"{self.path}/{p.runId}-{p.batchId}.json")
        out = where.getFileSystem(self._conf).create(where, True)
        out.write(bytearray("\n".join(map(json.dumps, lines)).encode()))
        out.close()


def progress(spark: SparkSession, path: str) -> DataFrame:
    """A row for each indicator of each micro-batch."""
    return spark.read.schema(SCHEMA).json(path)
