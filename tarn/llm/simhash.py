"""SimHash fingerprints and near-duplicate classes by pigeonhole blocks.

A document's fingerprint has a bit set where over half of its word-shingle
hashes (XXH64, seed 42) have it set. Two fingerprints link when they differ in
at most ``max_bits`` bits, and classes are the connected components.

Links are found without comparing all pairs: the 64 bits are cut into ``m``
blocks. Two fingerprints that differ in at most ``max_bits`` bits agree on at
least ``m - max_bits`` whole blocks, so they meet under the key of one such set
of blocks. Equal fingerprints are collapsed first, hence a group of exact
copies is one row here, whatever its size. Within one key a task compares
fingerprints tile by tile and returns a spanning forest of the links it found,
never the pairs, so output is linear in the rows read and no link between
classes is lost.

For the similarity of shingle sets, 64 bits say too little: sets of Jaccard
similarity 0.8 differ in about ten. ``similar`` compares the sets themselves
(by 64-bit hashes of the shingles). It begins with the pairs that the fingerprints link,
by the same blocks as above, and checks them on the texts. What is still apart then, and
fingerprints cannot tell, meets under the hashes of a prefix
of each set, rarest first, which two sets of the similarity asked for always share;
sizes and bitmaps (short ones with the keys, then ones as wide as the sets need) drop
only pairs that cannot have it, and the rest is verified on the texts.

Defined cases: null and empty texts have the zero fingerprint and link like any
other; rows with a null ``doc_id`` have a fingerprint but make no link and have
a null ``component_id``; repeated rows each come out; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tarn.llm.common import MERGE, beside_least, stored, utf8
from tarn.llm.components import connected_components

SEED = 42
#: Rows of one key that one task compares with each other; larger groups are cut into tiles.
TILE = 1024


def fingerprint(text: bytes, words: int = 4) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    parts = text.lower().split()
    if not parts:
        return 0
    n = len(parts) - words + 1
    if n <= 1:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i : n + i] for i in range(words))))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(s, SEED) for s in shingles])
    total = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    for at in range(0, len(rows), 65536):  # bounded memory on very long texts
        total += np.unpackbits(rows[at : at + 65536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(rows)).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, words) for t in utf8(batch, "text")]
            yield pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp: the fingerprint as a signed long) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(words), "doc_id long, fp long")


def block_keys(max_bits: int, blocks: int) -> list[list[tuple[int, int]]]:
    """For each key, the (shift, width) of the bit blocks that it joins."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    spans = [(a, b - a) for a, b in zip(edges, edges[1:])]
    return [list(c) for c in combinations(spans, blocks - max_bits)]


def enough_blocks(n: int, max_bits: int) -> int:
    """How many blocks keep chance meetings under a key rare among ``n`` fingerprints."""
    blocks = max_bits + 3
    while blocks < 2 * max_bits + 4 and n > 2 ** (64 * (blocks - max_bits) / blocks):
        blocks += 1
    return blocks


def _forest_of(key: np.ndarray, fp: np.ndarray, node: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key: for each row that a link joins to a smaller node
    of its key, that row's node and the smallest node that it reaches."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.repeat(np.r_[starts[1:], len(key)], np.diff(np.r_[starts, len(key)]))
    at, left, right, d = np.arange(len(key)), [], [], 1
    while True:
        at = at[at + d < ends[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= max_bits]
        left.append(near)
        right.append(near + d)
        d += 1
    if not left:
        return node[:0], node[:0]
    left, right, least = np.concatenate(left), np.concatenate(right), node.copy()
    while True:
        before, low = least.copy(), np.minimum(least[left], least[right])
        np.minimum.at(least, left, low)
        np.minimum.at(least, right, low)
        if np.array_equal(before, least):
            moved = least < node
            return node[moved], least[moved]


def _forests(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
            rest = [x[cut:] for x in cols]
            if cut:
                yield forest([x[:cut] for x in cols])
        if rest is not None:
            yield forest(rest)

    def forest(cols: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _forest_of(cols[0], cols[1], cols[2], max_bits)
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(reps: DataFrame, max_bits: int = 4, blocks: int = 7) -> DataFrame:
    """(a, b) edges that connect all ``reps`` (fp, node) that links connect."""
    keys = block_keys(max_bits, blocks)

    def key(i: int, spans: list[tuple[int, int]]):
        out = F.lit(i).cast("long")
        parts = [F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1) for s, w in spans]
        return F.xxhash64(out, *parts)  # equal blocks give equal keys; a chance clash only costs a comparison

    keyed = reps.select("fp", "node", F.explode(F.array(*(key(i, s) for i, s in enumerate(keys)))).alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return _tiled(keyed, groups).repartition("key").sortWithinPartitions("key").mapInArrow(_forests(max_bits), "a long, b long")


def _tiled(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, fp, node) of rows whose key others have too; a group of over ``TILE``
    rows is cut into parts, and every two parts meet under a key of their own."""
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp", "node"), tiles).cast("int")
    return (
        keyed.join(groups.hint(MERGE), "key")
        .withColumns({"tiles": tiles, "own": own})
        .select("key", "fp", "node", "tiles", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        .select(F.when(F.col("tiles") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key"), "fp", "node")
    )


def with_class(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """``prints`` (doc_id, fp) with the component_id that ``classes`` (fp, component_id)
    gives to the fp; null for a null doc_id. The rows of one fp are dealt to as many parts as
    there are shuffle partitions, so that copies of a text, however many, are no task's alone."""
    parts = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = prints.where("doc_id is not null").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    of_part = named.select("fp", "part").distinct().join(classes.hint(MERGE), "fp")
    found = named.join(of_part.hint(MERGE), ["fp", "part"]).select("doc_id", "fp", "component_id")
    return found.unionByName(prints.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text)."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    reps = stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "reps")
    roots = connected_components(links(reps, max_bits, blocks or enough_blocks(reps.count(), max_bits)))
    return with_class(prints, reps.join(roots.hint(MERGE), "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")))


# Sets of word shingles, for a Jaccard similarity.

#: Shingles of about so many texts are counted, and so many of the frequent ones go to the tasks.
SAMPLE, FREQUENT = 20_000, 65_536
#: 64-bit lanes of a set's bitmap.
LANES = 16
#: The table of bits that says which texts are to be compared has two to this power.
PLACES = 24
#: Against rounding: a bound is loosened by this before it drops a pair.
EPS = 1e-9


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The hashes of a text's distinct word shingles, ascending."""
    parts = text.lower().split()
    n = len(parts) - words + 1
    grams = {b" ".join(parts)} if n <= 1 else set(map(b" ".join, zip(*(parts[i : n + i] for i in range(words)))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in grams), np.uint64, len(grams))) if parts else np.zeros(0, np.uint64)


def digest_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def prefix(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest hashes of a set, so many that two sets of this similarity share one:
    they have ``similarity`` of either set's hashes in common at least, hence the first
    common one, in an order that is the same for all sets, stands before the others."""
    n = len(hashes)
    if not n:
        return hashes
    level = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        level = np.where(frequent[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, level))[: n - math.ceil(similarity * n - EPS) + 1]]


def bitmap(hashes: np.ndarray) -> bytes:
    """Bits that are set where an odd number of hashes falls: two sets' bitmaps differ
    in no more bits than the sets differ in hashes."""
    bits = np.bincount((hashes % np.uint64(64 * LANES)).astype(np.int64), minlength=64 * LANES) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _hashes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in utf8(batch, "text"):
                yield pa.record_batch([pa.array(shingles(t, words).view(np.int64))], names=["h"])

    return run


def frequent_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles that several texts of a sample have. They only set
    the order of ``prefix``: which they are decides the work, never the result."""
    share, some = SAMPLE / max(1, rows.count()), rows
    if share < 1:
        some = rows.where(F.xxhash64("doc_id", "text") <= int(-(2**63) + share * (2**64 - 1)))
    counted = some.select("text").mapInArrow(_hashes(words), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    top = counted.orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    hashes, counts = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _listed(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *(p.view(np.int64) for p in parts)])))


def _described(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in utf8(batch, "text")]
            prints = pa.array(np.array([fingerprint(t, words) for t in utf8(batch, "text")], np.uint64).view(np.int64))
            yield pa.record_batch([batch.column(0), pa.array(map(digest_of, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(map(bitmap, sets), pa.binary()), prints], names=["doc_id", "fp", "size", "bits", "print"])

    return run


def _keys(words: int, similarity: float, frequent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = frequent.value
        for batch in batches:
            sets = [shingles(t, words) for t in utf8(batch, "text")]
            yield pa.record_batch([batch.column(0), pa.array(map(digest_of, sets), pa.binary()), _listed([prefix(s, hashes, counts, similarity) for s in sets])], names=["node", "fp", "keys"])

    return run


def possible(similarity: float, sizes: tuple[np.ndarray, np.ndarray], bits: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where sets of these sizes and bitmaps (rows of lanes) can have the similarity."""
    least, most = np.minimum(*sizes), np.maximum(*sizes)
    apart = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64)
    return (least >= similarity * most - EPS) & (apart <= (1 - similarity) / (1 + similarity) * (least + most) + EPS)


def _lanes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, LANES)


def _possible_pairs(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = possible(similarity, (batch.column("m").to_numpy(), batch.column("n").to_numpy()), (_lanes(batch.column("p")), _lanes(batch.column("q"))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _by_key(of_groups):
    """A task over rows sorted by key (first column): ``of_groups`` gets the columns of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            key = table.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            rest = table.slice(cut)
            if cut:
                yield of_groups(table.slice(0, cut).combine_chunks())
        if rest is not None:
            yield of_groups(rest.combine_chunks())

    return run


def _open_pairs(similarity: float):
    def pairs(table: pa.Table) -> pa.RecordBatch:
        """Pairs of one key, of different roots, that the sizes and bitmaps allow."""
        key, node, root, size = (table.column(c).to_numpy() for c in ("key", "node", "root", "size"))
        lanes = _lanes(table.column("bits"))
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.repeat(np.r_[starts[1:], len(key)], np.diff(np.r_[starts, len(key)]))
        at, left, right, d = np.arange(len(key)), [node[:0]], [node[:0]], 1
        while True:
            at = at[at + d < ends[at]]
            if not len(at):
                break
            a = at[root[at] != root[at + d]]
            a = a[possible(similarity, (size[a], size[a + d]), (lanes[a], lanes[a + d]))]
            left.append(node[a])
            right.append(node[a + d])
            d += 1
        a, b = np.concatenate(left), np.concatenate(right)
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return pairs


def _alike(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, seen = [], (None, None)
            for x, y in zip(utf8(batch, "x"), utf8(batch, "y")):
                if y != seen[0]:  # rows come in order of b
                    seen = (y, shingles(y, words))
                one, other = shingles(x, words), seen[1]
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(both >= similarity * (len(one) + len(other) - both) - EPS)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _places(ids: np.ndarray) -> np.ndarray:
    x = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - PLACES)).astype(np.int64)


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    taken = np.zeros(1 << PLACES, bool)
    for batch in batches:
        taken[_places(batch.column(0).to_numpy())] = True
    yield pa.record_batch([pa.array([np.packbits(taken).tobytes()], pa.binary())], names=["taken"])


def _may_be(taken: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(taken.value, np.uint8)
        for batch in batches:
            at = _places(batch.column("doc_id").to_numpy())
            yield batch.filter(pa.array((table[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))

    return run


def texts_of(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The ``rows`` of ``nodes``, and by chance a few others: by a table of bits of
    fixed size, so that the other texts take no shuffle."""
    parts = nodes.coalesce(8).mapInArrow(_taken, "taken binary").collect()
    taken = np.zeros(1 << PLACES - 3, np.uint8)
    for r in parts:
        taken |= np.frombuffer(r["taken"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(taken.tobytes())
    return rows.where("doc_id is not null").mapInArrow(_may_be(sent), rows.schema)


def wide_bitmap(hashes: np.ndarray) -> bytes:
    """As ``bitmap``, of two to four bits for each hash; the halves of a wider one of the same set, by
    exclusive or, are the narrower one."""
    width = 64 << max(0, math.ceil(math.log2(max(1, len(hashes)) / 32)))
    bits = np.bincount((hashes % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _wide(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in utf8(batch, "text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(map(wide_bitmap, sets), pa.binary())], names=["node", "size", "bits"])

    return run


def wide_possible(similarity: float, m: int, p: bytes, n: int, q: bytes) -> bool:
    """Whether sets of sizes ``m`` and ``n`` with these wide bitmaps can have the similarity."""
    x, y = sorted((np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= (1 - similarity) / (1 + similarity) * (m + n) + EPS


def _wide_pairs(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("m", "p", "n", "q")))
            yield batch.select(["a", "b"]).filter(pa.array([wide_possible(similarity, *r) for r in rows], pa.bool_()))

    return run


def verified(pairs: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts' sets of shingles have this Jaccard similarity.
    Bitmaps as wide as the sets need come first; only pairs that they leave open take the texts along."""
    found = stored(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), rows), "candidate-texts")
    wide = stored(found.mapInArrow(_wide(words), "node long, size long, bits binary"), "candidate-bits")
    met = pairs.join(wide.toDF("a", "m", "p").hint(MERGE), "a").join(wide.toDF("b", "n", "q").hint(MERGE), "b")
    near = stored(met.select("a", "b", "m", "p", "n", "q").mapInArrow(_wide_pairs(similarity), "a long, b long").distinct(), "near-pairs")
    full = near.join(found.select(F.col("doc_id").alias("a"), F.col("text").alias("x")).hint(MERGE), "a").join(found.select(F.col("doc_id").alias("b"), F.col("text").alias("y")).hint(MERGE), "b")
    return stored(full.select("a", "b", "x", "y").mapInArrow(_alike(words, similarity), "a long, b long"), "verified")


def print_links(reps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b) edges that connect all ``reps`` (node, print) whose fingerprints differ in at most ``max_bits`` bits."""
    one = stored(reps.groupBy("print").agg(F.min("node").alias("node")).select(F.col("print").alias("fp"), "node"), "prints")
    same = beside_least(reps.select("print", "node"), "print", "node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    far = links(one, max_bits, enough_blocks(one.count(), max_bits))
    return same.unionByName(far.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).where("a <> b").distinct()


def set_links(reps: DataFrame, keyed: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b) edges that connect all ``reps`` (node, size, bits, print) whose sets have this
    similarity. First come the pairs that their fingerprints link. Sets of this similarity also share
    a key of ``keyed`` (key, node): with the first ones each row is
    compared with the smallest node of each of its keys, which connects large groups
    by few comparisons; then the pairs of a key that are still apart."""
    least = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1").drop("n")
    shared = stored(keyed.join(least.hint(MERGE), "key"), "shared-keys")
    stars = shared.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    stars = stored(print_links(reps), "print-links").unionByName(stars).distinct()
    stars = stars.join(reps.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("bits").alias("p")).hint(MERGE), "a").join(reps.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("bits").alias("q")).hint(MERGE), "b")
    first = verified(stored(stars.select("a", "b", "m", "n", "p", "q").mapInArrow(_possible_pairs(similarity), "a long, b long"), "stars"), rows, words, similarity)
    roots = connected_components(first)
    info = reps.select("node", "size", "bits").join(roots.hint(MERGE), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size", "bits")
    members = shared.select("key", "node").join(info.select("node", "root").hint(MERGE), "node")
    groups = members.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    tiled = _tiled(members.withColumnRenamed("root", "fp"), groups.select("key", "n")).select("key", "node").join(info.hint(MERGE), "node").select("key", "node", "root", "size", "bits")
    left = tiled.repartition("key").sortWithinPartitions("key").mapInArrow(_by_key(_open_pairs(similarity)), "a long, b long").where("a <> b")
    return first.unionByName(verified(stored(left.distinct(), "pairs"), rows, words, similarity))


def _marked(words: int, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(mark, pa.array([digest_of(shingles(t, words)) for t in utf8(batch, "text")], pa.binary()))

    return run


def similar_classes(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The digests (doc_id, fp) of all rows, and for each digest (fp, node, component_id)
    the smallest doc_id that has it and the smallest one of its class."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(rows, words))
    about = stored(rows.mapInArrow(_described(words), "doc_id long, fp binary, size long, bits binary, print long"), "shingle-sets")
    least = about.where("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "size", "bits", "print")).alias("m"))
    reps = stored(least.select("fp", F.col("m.doc_id").alias("node"), "m.size", "m.bits", "m.print"), "reps")
    keys = rows.where("doc_id is not null").mapInArrow(_keys(words, similarity, frequent), "node long, fp binary, keys array<long>")
    keyed = keys.join(reps.select("node", "fp").hint(MERGE), ["node", "fp"], "left_semi").select(F.explode("keys").alias("key"), "node")
    roots = connected_components(set_links(reps, stored(keyed, "keys"), rows, words, similarity))
    return about.select("doc_id", "fp"), reps.select("fp", "node").join(roots.hint(MERGE), "node", "left").select("fp", "node", F.coalesce("root", "node").alias("component_id"))


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text): classes of
    texts whose sets of ``words``-word shingles have this Jaccard similarity or
    more, with all such pairs; ``fp`` is a digest of the set."""
    prints, classes = similar_classes(docs, words, similarity)
    return with_class(prints, classes.select("fp", "component_id"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without all but the smallest doc_id of each class of
    ``similar``; columns as they were. Of rows equal in doc_id and shingles one
    stays; rows with a null doc_id stay."""
    rows = docs.withColumn("text", F.col("text").cast("string"))
    mark = "__shingles"
    while mark in rows.columns:
        mark += "_"
    classes = similar_classes(docs, words, similarity)[1]
    first = classes.where("node = component_id").select(F.col("node").cast(rows.schema["doc_id"].dataType).alias("doc_id"), F.col("fp").alias(mark))
    marked = rows.where("doc_id is not null").mapInArrow(_marked(words, mark), StructType([*rows.schema.fields, StructField(mark, BinaryType())]))
    kept = marked.join(first.hint(MERGE), ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return kept.select(*rows.columns).unionByName(rows.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
