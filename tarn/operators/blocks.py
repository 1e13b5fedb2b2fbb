"""Postings in blocks, and a search that leaves out the blocks that cannot matter.

Documents are parted into cells: by layers of like total weight, and in a layer by ranges of ``cell`` numbers. A term's postings
(term, doc, weight) are cut by cell and then into blocks of at most ``size``.
A block has its largest weight, and documents as offsets within the range, small numbers that Parquet packs
into few bits. Since no block crosses a cell, what a document of a cell can score at most is a sum over the cell's
blocks, found from the blocks' heads alone, by equality of cells; since documents of a layer are of like weight, most
cells can score far less than the best ones:

1. The few cells of the largest bounds are read, ``k`` at least, as each has a document; the ``k``-th best score there is a floor of the final one.
2. A block is left out if its largest weight and the largest ones of all other terms in its cell add up to less than
   the floor. A document of such a block cannot be among the best, and one that can has all of its blocks read.

So the result is that of reading everything. A term that most documents have is dealt to many tasks, by
document, and its blocks go to as many; nothing holds a whole list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.config import DEFAULT
from tarn.operators.rank_cut import top_per_key

BLOCK = "bucket int, term string, layer int, cell long, first long, n int, top double, offsets array<int>, weights array<double>"
#: Scores are compared after rounding to six places.
ROUNDING = 1e-6
#: Layers of documents' total weights for each doubling.
LAYERS = 4
#: Postings that a task sorts, about.
SORTED = 1 << 19
#: What names a cell.
CELL = ["layer", "cell"]


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def layer_of(total: Column) -> Column:
    """The layer of a document of this total weight."""
    return F.when(total > 0, F.floor(LAYERS * F.log2(total))).otherwise(-1000).cast("int")


def layered(postings: DataFrame) -> DataFrame:
    """``postings`` with ``layer``, that of the document's total weight. All postings of a document have to be there, as
    they must be of one layer; what moves postings later keeps it."""
    total = F.sum("weight").over(Window.partitionBy("doc"))
    return postings.withColumn("layer", layer_of(total))


def _pack(cell: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bucket, term, layer, doc, weight = batch.columns
            layer, doc, weight = layer.to_numpy(), doc.to_numpy(), weight.to_numpy()
            of_term, at = term.dictionary_encode().indices.to_numpy(), np.arange(n)
            of_cell = doc // cell
            new = np.ones(n, bool)
            new[1:] = (of_term[1:] != of_term[:-1]) | (of_cell[1:] != of_cell[:-1]) | (layer[1:] != layer[:-1])
            begun = np.maximum.accumulate(np.where(new, at, 0))
            starts = np.flatnonzero((at - begun) % size == 0)
            bounds = pa.array(np.append(starts, n), pa.int32())
            offsets = pa.array((doc - of_cell * cell).astype(np.int32))
            columns = [
                bucket.take(pa.array(starts)), term.take(pa.array(starts)), pa.array(layer[starts]), pa.array(of_cell[starts]), pa.array(doc[starts]), pa.array(np.diff(np.append(starts, n)).astype(np.int32)),
                pa.array(np.maximum.reduceat(weight, starts)), pa.ListArray.from_arrays(bounds, offsets), pa.ListArray.from_arrays(bounds, pa.array(weight)),
            ]
            yield pa.record_batch(columns, names=[c.split()[0] for c in BLOCK.split(", ")])

    return run


def packed(postings: DataFrame, buckets: int, cell: int = DEFAULT.block_cell, size: int = DEFAULT.block_size, n: int = 0) -> DataFrame:
    """Blocks of ``postings`` (term, doc: long, weight, layer), by bucket and term, in the order of documents. Rows
    without a term, document or weight are in no block; weights are 0 or more. Without layers they are made. With ``n``, the number of
    postings, ranges grow in number and not in size."""
    rows = postings if "layer" in postings.columns else layered(postings)
    rows = rows.select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", "layer", F.col("doc").cast("long").alias("doc"), F.col("weight").cast("double").alias("weight"))
    order = ["bucket", "term", "layer", "doc"]
    ranges = -(-n // SORTED)
    if ranges > int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.dropna().repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    else:
        rows = rows.dropna().repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(_pack(cell, size), BLOCK)


def unpacked(blocks: DataFrame, *others: str, cell: int = DEFAULT.block_cell) -> DataFrame:
    """(term, doc, weight) and ``others`` of every posting of ``blocks``."""
    each = F.explode(F.arrays_zip("offsets", "weights")).alias("p")
    return blocks.select(*others, "term", "cell", each).select(*others, "term", (F.col("cell") * cell + F.col("p.offsets")).alias("doc"), F.col("p.weights").alias("weight"))


def _bounds(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, layer, cell, most, terms): what a document of the cell scores at most, and the heads of its blocks by term."""
    heads = blocks.select("term", *CELL, "first", "top").join(queries.select("query", "term").distinct(), "term")
    of_term = heads.groupBy("query", *CELL, "term").agg(F.max("top").alias("top"), F.collect_list(F.struct("first", "top")).alias("blocks"))
    return of_term.groupBy("query", *CELL).agg(F.sum("top").alias("most"), F.collect_list(F.struct("term", "top", "blocks")).alias("terms"))


def _heads(bounds: DataFrame) -> DataFrame:
    """(query, layer, cell, most, term, first, bound) of every block: ``bound`` is what a document in it scores at most."""
    by_term = bounds.select("query", *CELL, "most", F.explode("terms").alias("t"))
    each = by_term.select("query", *CELL, "most", F.col("t.term").alias("term"), (F.col("most") - F.col("t.top")).alias("rest"), F.explode("t.blocks").alias("b"))
    return each.select("query", *CELL, "most", "term", F.col("b.first").alias("first"), (F.col("rest") + F.col("b.top")).alias("bound"))


def _scores(blocks: DataFrame, wanted: DataFrame, cell: int, k: int) -> DataFrame:
    """(query, rank, doc, score): the ``k`` best documents in the blocks that ``wanted`` (query, term, layer, cell, first) names."""
    name = ["term", *CELL, "first"]
    rows = blocks.select(*name, "offsets", "weights").join(wanted.select("query", *name), name)
    scored = unpacked(rows, "query", cell=cell).groupBy("query", "doc").agg(F.round(F.sum("weight"), 6).alias("score"))
    return top_per_key(scored, ["query"], [F.desc("score"), F.asc("doc")], k)


def searched(blocks: DataFrame, queries: DataFrame, k: int = DEFAULT.results, cells: int = DEFAULT.seed_cells, cell: int = DEFAULT.block_cell) -> tuple[DataFrame, DataFrame]:
    """Q3, Q5: (query, rank, doc, score) of the ``k`` best documents of each query of ``queries`` (query, term), and (query,
    n_blocks, n_read): how many blocks its terms have and how many of them were read. A document with
    any of the terms counts, scores add up, ties go to the smaller document."""
    bounds = _bounds(blocks, queries)
    heads = _heads(bounds)
    first = top_per_key(bounds.select("query", *CELL, "most"), ["query"], [F.desc("most"), F.desc("layer"), F.asc("cell")], max(cells, k), "place").select("query", *CELL)
    seeds = _scores(blocks, heads.join(first, ["query", *CELL]), cell, k)
    floors = seeds.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    judged = heads.join(floors, "query", "left").withColumn("read", F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - ROUNDING)
    best = _scores(blocks, judged.where("read"), cell, k).select("query", "rank", "doc", "score")
    # Those that the floor was found in are read too, whatever their bound.
    seeded = first.withColumn("seed", F.lit(True))
    counts = judged.join(seeded, ["query", *CELL], "left").groupBy("query").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("read") | F.coalesce("seed", F.lit(False))).alias("n_read"))
    return best, counts
