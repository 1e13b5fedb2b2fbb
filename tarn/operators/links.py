"""Link graph: backlinks, prosperity, breadth-first search and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.config import DEFAULT, Config
from tarn.functions.html import absolute, description, hrefs, title, visible
from tarn.functions.urls import netloc, prefixes
from tarn.operators.rank_cut import kth_smallest, top_per_key
from tarn.operators.sample import uniform, weighted
from tarn.session import shared_path


def page_records(pages: DataFrame) -> DataFrame:
    """What fetching a page yields; the ``pages`` table stands for the web."""
    url, html = F.col("url"), F.col("html")
    return pages.select(
        "page_id",
        "url",
        title(html).alias("title"),
        description(html).alias("description"),
        visible(html).alias("text"),
        F.transform(hrefs(html), lambda h: absolute(url, h)).alias("href"),
        url.alias("final_url"),
        F.create_map().cast("map<string,string>").alias("redirects"),
        html.alias("raw"),
        F.lit("").alias("server"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, src, pos, dst), a row for each link."""
    return pages.select("page_id", F.col("url").alias("src"), F.posexplode(hrefs(F.col("html"))).alias("pos", "href")).select("page_id", "src", "pos", absolute(F.col("src"), F.col("href")).alias("dst"))


def cross_domain(links: DataFrame) -> DataFrame:
    """(src_domain, dst) of links between domains, each once."""
    own, other = F.lower(netloc(F.col("src"))), F.lower(netloc(F.col("dst")))
    return links.where(own != other).select(own.alias("src_domain"), "dst").distinct()


def backlinks(links: DataFrame) -> DataFrame:
    """(url, n): how many other domains link to a URL."""
    return cross_domain(links).groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("n"))


def prefix_counts(urls: DataFrame, url: str = "url") -> DataFrame:
    """(prefix, n): every URL counts for itself and all its prefixes. Partial
    sums in each task keep hosts that most URLs share from crowding one task."""
    return urls.select(F.explode(prefixes(F.col(url))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


def frozen_counts(urls: DataFrame, freeze_at: int, pos: str = "pos", url: str = "url") -> DataFrame:
    """Prefixes that occur up to the position where the tree froze, with all
    their occurrences, later ones too."""
    found = urls.select(F.col(pos).alias("__pos"), F.explode(prefixes(F.col(url))).alias("prefix"))
    return found.groupBy("prefix").agg(F.count("*").alias("n"), F.min("__pos").alias("made")).where(F.col("made") <= freeze_at).select("prefix", "n")


def frozen_by_size(urls: DataFrame, nodes: int, pos: str = "pos", url: str = "url") -> DataFrame:
    """(prefix, n) of the tree that stops growing after the link with which it has ``nodes`` nodes or more: its nodes are those
    made up to that link, with all their occurrences. A node is made where its prefix first occurs, so that link
    stands where the ``nodes``-th smallest first occurrence is."""
    spark, path = urls.sparkSession, shared_path(urls.sparkSession, "tree")
    found = urls.select(F.col(pos).cast("long").alias("__pos"), F.explode(prefixes(F.col(url))).alias("prefix"))
    found.groupBy("prefix").agg(F.count("*").alias("n"), F.min("__pos").alias("made")).write.option("compression", "zstd").parquet(path)
    tree = spark.read.schema("prefix string, n long, made long").parquet(path)
    last = kth_smallest(tree, "made", nodes)
    return (tree if last is None else tree.where(F.col("made") <= last)).select("prefix", "n")


def prosperous(counts: DataFrame, least: int = DEFAULT.prosperous) -> DataFrame:
    """The prefixes of at least ``least`` backlinks; write with ``sources.store.write_json``."""
    return counts.where(F.col("n") >= least)


def estimates(urls: DataFrame, counts: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Each URL's value is that of its longest known prefix (0 without one)."""
    known = urls.select(key, url, F.posexplode_outer(prefixes(F.col(url))).alias("depth", "prefix")).join(counts, "prefix", "left")
    return known.groupBy(key, url).agg(F.coalesce(F.max_by("n", F.when(F.col("n").isNotNull(), F.col("depth"))), F.lit(0)).alias("prosperity"))


def domain_weights(links: DataFrame) -> DataFrame:
    """(domain, n): how many other domains link to any URL of a domain."""
    own, other = F.lower(netloc(F.col("src"))), F.lower(netloc(F.col("dst")))
    pairs = links.where(own != other).select(own.alias("src_domain"), other.alias("domain")).distinct()
    return pairs.groupBy("domain").agg(F.count("*").alias("n"))


def seeds(spark: SparkSession, urls: list[str]) -> DataFrame:
    """The entry URLs."""
    return spark.createDataFrame([(u,) for u in urls], "url string")


def bfs(start: DataFrame, edges: DataFrame, depth: int = DEFAULT.crawl_depth) -> DataFrame:
    """C4: (node, level) of what ``start`` (node) reaches over ``edges`` (src, dst)
    in at most ``depth`` steps; a visited node is not visited again. Each level is
    written to the shared folder, so plans stay short and survive lost executors."""
    spark, path = edges.sparkSession, shared_path(edges.sparkSession, "bfs")
    front = start.select("node").distinct()
    for level in range(depth + 1):
        front.select("node", F.lit(level).alias("level")).write.mode("append").parquet(path)
        seen = spark.read.schema("node long, level int" if dict(start.dtypes)["node"] == "bigint" else "node string, level int").parquet(path)
        last = seen.where(F.col("level") == level)
        if level == depth or last.isEmpty():
            break
        reached = edges.join(last, edges["src"] == last["node"]).select(F.col("dst").alias("node")).distinct()
        front = reached.join(seen.select("node"), "node", "left_anti")
    return seen


def frontier_weight(visits: Column, n_backlinks: Column) -> Column:
    """What is linked more and visited less is likelier to stay."""
    return (1 + F.log(1 + n_backlinks)) / (1 + visits)


def keep_weighted(front: DataFrame, key: str, weight: Column, config: Config = DEFAULT) -> DataFrame:
    """At most ``frontier_size`` URLs, chosen at random by weight."""
    return weighted(front, key, weight, config.frontier_size)


def keep_per_domain(front: DataFrame, key: str, url: str = "url", config: Config = DEFAULT) -> DataFrame:
    """Of each domain at most ``frontier_per_domain``, chosen at random."""
    drawn = front.withColumn("domain", F.lower(netloc(F.col(url)))).withColumn("draw", uniform(F.col(key), "domain"))
    return top_per_key(drawn, ["domain"], [F.col("draw"), F.col(key)], config.frontier_per_domain)


def _keep_some(front: DataFrame, key: str, which: Column, most: int, seed: str) -> DataFrame:
    some = front.where(which).orderBy(uniform(F.col(key), seed), key).limit(most)
    return front.where(~which).unionByName(some)


def keep_http(front: DataFrame, key: str, url: str = "url", config: Config = DEFAULT) -> DataFrame:
    """At most ``frontier_http`` URLs of plain http, chosen at random; all others."""
    return _keep_some(front, key, F.col(url).startswith("http://"), config.frontier_http, "http")


def keep_orphans(front: DataFrame, key: str, n_backlinks: Column, config: Config = DEFAULT) -> DataFrame:
    """At most ``frontier_orphans`` URLs without backlinks, chosen at random; all others."""
    return _keep_some(front, key, F.coalesce(n_backlinks, F.lit(0)) == 0, config.frontier_orphans, "orphan")
