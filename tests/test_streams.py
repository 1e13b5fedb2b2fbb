"""State of domains over several batches, and the indicators of streams."""

import datetime
import random
import subprocess
import sys
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tarn.metrics import observed
from tarn.session import shared_path
from tarn.streaming import domain_state
from tarn.streaming.progress import ProgressLog, progress
from tests.conftest import ROOT

SCHEMA = "page_id long, url string, html string, fetched timestamp"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def page(i, domain, links, words, minutes=0):
    html = "".join(f'<a href="https://{d}/x">l</a>' for d in links) + f"<p>{words}</p>"
    return {"page_id": i, "url": f"https://{domain}/{i}", "html": html, "fetched": START + datetime.timedelta(minutes=minutes)}


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("fetched", pa.timestamp("us", "UTC"))])
    pq.write_table(pa.Table.from_pylist(rows, kinds), folder / f"{name}.parquet")


def known(df):
    return {r["domain"]: (r["visits"], dict(r["langs"]), r["n_outlinks"], r["ended"]) for r in df.collect()}


def pages(seed, n):
    draw = random.Random(seed)
    words = {"en": "the of and to in", "fr": "le la les des et", "und": "zzz"}
    return [page(1000 * seed + i, f"d{draw.randint(0, 4)}.example", [f"o{draw.randint(0, 30)}.example" for _ in range(3)], words[draw.choice(list(words))]) for i in range(n)]


def test_batches_and_restarts_are_one_batch(spark, tmp_path):
    parts = [pages(s, 20) for s in range(3)]
    one, several = shared_path(spark, "one"), shared_path(spark, "several")
    write(tmp_path / "all", "all", sum(parts, []))
    domain_state.follow(spark, f"file://{tmp_path}/all", SCHEMA, one)
    for i, part in enumerate(parts):  # a stream of its own for each, from the checkpoint of the last
        write(tmp_path / "some", str(i), part)
        domain_state.follow(spark, f"file://{tmp_path}/some", SCHEMA, several, files_per_batch=1)
        domain_state.follow(spark, f"file://{tmp_path}/some", SCHEMA, several)  # nothing new
    a, b = known(domain_state.latest(spark, one)), known(domain_state.latest(spark, several))
    assert a == b and sum(v[0] for v in a.values()) == 60
    linked = {}
    for p in sum(parts, []):
        linked.setdefault(p["url"].split("/")[2], set()).update(x.split("/")[0] for x in p["html"].split("https://")[1:])
    assert {d: v[2] for d, v in a.items()} == {d: len(s) for d, s in linked.items()}


def test_idle_domains_end(spark, tmp_path):
    target = shared_path(spark, "idle")
    follow = lambda: domain_state.follow(spark, f"file://{tmp_path}/in", SCHEMA, target, idle=30 * 60 * 1000, at=F.col("fetched"))
    for i, rows in enumerate(([page(1, "a.example", [], "x"), page(2, "b.example", [], "x")], [page(3, "b.example", ["z.example"], "x", 50)], [page(4, "c.example", [], "x", 60)], [page(5, "a.example", [], "x", 61)])):
        write(tmp_path / "in", str(i), rows)
        follow()
    rows = spark.read.schema(domain_state.OUT + ", batch long").parquet(f"{target}/states").where("ended").collect()
    assert {(r["domain"], r["visits"]) for r in rows} == {("a.example", 1)}
    got = known(domain_state.latest(spark, target))
    assert got["b.example"][0] == 2 and got["a.example"][0] == 1  # a began anew


def test_sketches_are_bounded_and_near(monkeypatch):
    draw = random.Random(1)
    for n in (10, 255, 3000, 50_000):
        hashes = sorted(draw.randint(-(2**63), 2**63 - 1) for _ in range(n))[: domain_state.SKETCH]
        assert abs(domain_state.estimate(hashes) - n) <= (0 if n < domain_state.SKETCH else 0.2 * n)


def test_indicators_of_a_stream_are_those_of_its_batches(spark, tmp_path):
    for i in range(3):
        write(tmp_path / "in", str(i), pages(i, 10 * (i + 1)))
    path = shared_path(spark, "progress")
    log = ProgressLog(spark, path)
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        rows = observed(stream, "pages", n=F.count("*"), longest=F.max(F.length("url")))
        run = rows.writeStream.format("noop").option("checkpointLocation", shared_path(spark, "checkpoint")).trigger(availableNow=True).start()
        run.awaitTermination()
        for _ in range(100):
            time.sleep(0.1)
            if spark.read.format("binaryFile").load(path).count() >= 3 if _exists(spark, path) else False:
                break
    finally:
        spark.streams.removeListener(log)
    found = progress(spark, path)
    n = {r["batch"]: int(r["value"]) for r in found.where("name = 'pages' and indicator = 'n'").collect()}
    assert sorted(n.values()) == [10, 20, 30]
    assert {r["batch"]: r["rows"] for r in found.where("name = 'stream'").collect()} == n
    assert found.where("indicator = 'longest'").count() == 3 and found.where("at is null or seconds is null").count() == 0


def _exists(spark, path):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


SERVED = """
import urllib.request
from pyspark.sql import SparkSession
from tarn.streaming.progress import PROMETHEUS
builder = SparkSession.builder.master("local[1]").config("spark.ui.port", "0")
for k, v in PROMETHEUS.items():
    builder = builder.config(k, v)
spark = builder.getOrCreate()
spark.range(10).count()
url = spark.sparkContext.uiWebUrl
port = url.rsplit(":", 1)[1]
for path in ("/metrics/prometheus/", "/metrics/executors/prometheus/"):
    text = urllib.request.urlopen(f"http://127.0.0.1:{port}{path}", timeout=20).read().decode()
    print("SERVED", path, sum(line[:1].isalpha() for line in text.splitlines()))
spark.stop()
"""


def test_metrics_are_served():
    done = subprocess.run([sys.executable, "-c", SERVED], capture_output=True, text=True, timeout=180, cwd=ROOT)
    counts = [int(line.split()[-1]) for line in done.stdout.splitlines() if line.startswith("SERVED")]
    assert len(counts) == 2 and min(counts) > 5, done.stderr[-2000:]
