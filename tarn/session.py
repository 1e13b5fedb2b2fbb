"""Session set-up."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def share_package(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it,
    bounds the Arrow batches that they get (a row is a whole document here) and
    has shuffle files go when the query that wrote them is over. Values that the
    session's owner set stay.

    On a cluster whose nodes lack that folder, ship it with ``--py-files``.
    """
    if spark.conf.get(ROWS, "-1") == "-1":
        spark.conf.set(ROWS, "2000")
    if spark.conf.get(CLEANUP, "true") != spark.conf.get(CLEANUP, "false"):
        spark.conf.set(CLEANUP, "true")
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tarn")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return share_package(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, as in
    tests, gets a folder of its own where that is unset.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="tarn-shared-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir("file://" + made)
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def shared_paths() -> Iterator[list[str]]:
    """The paths that ``shared_path`` gives to this thread within the block."""
    token = _made.set([])
    try:
        yield _made.get()
    finally:
        _made.reset(token)
