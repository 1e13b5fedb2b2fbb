"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into words before runs of the word mark, which no piece crosses.
Every distinct word is encoded once: its substrings up to the longest piece are
exploded and equi-joined to the piece table, the edges are grouped by word
again (on the partitioning that counting the words left, so without another
shuffle), and a higher-order ``aggregate`` folds them, for words of every length.

Two folds share the lattice. ``viterbi`` keeps, for each position, the best sum of
scores and where its last piece begins: right for unigram tables. The vocabulary
file at hand is of type BPE, where scores are merge ranks and the best sum is not
what the model means; for it, ``merges`` folds the same edges in order of rank:
an edge whose two parts are neighbours joins them. That gives the library's own ids
wherever a piece's parts rank before it, as training makes them; of the words of
the test tables none differs. Characters without an edge become byte pieces.

``document_ids`` gives each document's ids, in order, and ``decoded`` its text from
them. ``encode_documents`` makes the same ids and gives numbers about them, the decoded
text's digest against that of the text among them. The ids of the ``HOT`` most frequent
words go to the tasks as one table of bounded size; all other words are joined with the
word table by a shuffle and their ids brought to their documents.

Defined cases: null and empty texts have no pieces; repeated rows each come out;
rows with a null doc_id are encoded; an empty table gives an empty result; other
columns are ignored. A text that holds the word mark itself decodes to a space there,
so it makes no round trip. A word has fewer than 2^24 characters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import released, stored, stored_at, texts

MARK = "▁"
#: Words: a run of marks with what follows, and control characters, which no piece holds, on their own.
WORDS = re.compile(f"{MARK}*[^{MARK}\\x00-\\x1f]+|{MARK}+|[\\x00-\\x1f]")
HOT, HELD = 300_000, 500_000
#: Words whose edges one task groups in memory; with more it sorts them.
GROUPED = 200_000
#: Parts that the words beyond the hot ones, and then the documents, are moved in; words put together at once.
WORD_PARTS, PARTS, PORTION = 2, 4, 1 << 19
#: A document's digest: the sum over its words of ``BASE`` to the word's place times the
#: word's own digest, the sum over its pieces of ``INNER`` to the piece's place times id + 1.
PRIME, BASE, INNER = 2**31 - 1, 48_271, 69_621


@lru_cache(2)
def vocabulary(name: str = "piece_bpe_32k.model") -> tuple[dict[str, tuple[int, float]], list[int], str]:
    """Piece to (id, score), the ids of the 256 byte pieces, and the fold's name."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces, byte_ids = {}, [0] * 256
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = (i, model.get_score(i))
    # In a BPE model scores are ranks, whole numbers from 0 down.
    ranks = all(float(s).is_integer() for _, s in pieces.values())
    return pieces, byte_ids, "merges" if ranks else "viterbi"


def words_of(text: str) -> list[str]:
    """The words of ``text`` as the model sees it: spaces as marks, one put first."""
    return WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


def piece_table(spark: SparkSession, name: str = "piece_bpe_32k.model") -> DataFrame:
    """(piece, id, score, rank) of the pieces that are not bytes; the best score
    has rank 0, equal scores are ranked by id."""
    pieces = vocabulary(name)[0]
    order = sorted(pieces.items(), key=lambda x: (-x[1][1], x[1][0]))
    if len(order) >= 1 << 15:
        raise ValueError("an edge's number has 15 bits for ids and ranks")
    if max(map(len, pieces)) > OVER:
        raise ValueError(f"an edge lies in one block only up to {OVER} characters")
    rows = pd.DataFrame([(p, i, s, r) for r, (p, (i, s)) in enumerate(order)], columns=["piece", "id", "score", "rank"])
    return spark.createDataFrame(rows, "piece string, id int, score double, rank long")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def viterbi(edges: Column, n: Column) -> Column:
    """The edges (start, end, id, score) of the best path over ``n`` characters;
    a character without an edge of its own gets one with id null and score -1e6.
    Among equal sums the longer last piece wins."""
    start = F.array(F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("start"), F.lit(None).cast("int").alias("id")))

    def step(best: Column, j: Column) -> Column:
        into = F.transform(
            F.filter(edges, lambda e: e["end"] == j),
            lambda e: F.struct((F.element_at(best, e["start"] + 1)["sum"] + e["score"]).alias("sum"), (-e["start"]).alias("back"), e["id"].alias("id")),
        )
        alone = F.struct((F.element_at(best, j)["sum"] - 1e6).alias("sum"), (1 - j).alias("back"), F.lit(None).cast("int").alias("id"))
        top = F.array_max(F.concat(into, F.array(alone)))
        return F.concat(best, F.array(_let(top, lambda t: F.struct(t["sum"].alias("sum"), (-t["back"]).alias("start"), t["id"].alias("id")))))

    table = F.aggregate(F.sequence(F.lit(1), n), start, step)

    def back(table: Column) -> Column:
        none = F.array().cast("array<struct<start:int,end:int,id:int>>")
        walk = F.aggregate(
            F.sequence(F.lit(1), n),
            F.struct(n.alias("at"), none.alias("path")),
            lambda acc, _: F.when(acc["at"] == 0, acc).otherwise(
                _let(
                    F.element_at(table, acc["at"] + 1),
                    lambda t: F.struct(t["start"].alias("at"), F.concat(F.array(F.struct(t["start"].alias("start"), acc["at"].alias("end"), t["id"].alias("id"))), acc["path"]).alias("path")),
                )
            ),
        )
        return walk["path"]

    return F.when(n > 0, _let(table, back))


#: Where an edge's parts begin: its characters (5 bits), start (24), id (15), rank (15).
START_AT, ID_AT, RANK_AT = 5, 29, 44
#: Where the start of a piece that is left begins, above its id.
PLACE_AT = 15
#: The cuts of words of more characters than ``ONE`` are in blocks, a new one every ``STRIDE`` places; a
#: block also holds the ``OVER`` places after, so that an edge lies in the block of its start.
ONE, STRIDE, OVER = 48, 40, 17


def _start(e: Column) -> Column:
    return F.shiftright(e, START_AT).bitwiseAND((1 << 24) - 1).cast("int")


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def _by_place(bits) -> Column:
    """``bits`` (start, end) of every edge of a word whose cuts are in one number, in the order of the number's lowest bits."""
    ends = [(i >> START_AT, (i >> START_AT) + i % (1 << START_AT)) for i in range(64 << START_AT)]
    return F.expr("array(" + ",".join(f"{bits(i, j) if j <= ONE else 0}L" for i, j in ends) + ")")


def merges(edges: Column, n: Column, single) -> Column:
    """The pieces that merging by rank leaves, in order, as numbers with start and id. ``edges``
    are those of several characters, sorted; an edge is one number, from the highest bits: rank, id, start,
    how many characters. ``single(i)`` is the id of character ``i`` alone. The fold's state is the set of cuts as
    bits of a number, or of several: in order of rank, then place, an edge whose ends are cuts and
    that has one cut within takes it out, as its two parts are neighbours and merge. What no
    edge joins in the end are single characters."""
    def fold(first: Column, joins, without, remains, pairs) -> Column:
        """``joins``: whether an edge's ends are cuts and one cut is within, ``without``: the state less the cuts
        within, ``remains``: whether its ends are cuts and none is within, ``pairs``: the places of
        characters that stand between two cuts."""

        def left(cuts: Column) -> Column:
            kept = F.transform(
                F.filter(edges, lambda e: remains(cuts, e)),
                lambda e: F.shiftleft(F.shiftright(e, START_AT).bitwiseAND((1 << 24) - 1), PLACE_AT).bitwiseOR(F.shiftright(e, ID_AT).bitwiseAND(32767)),
            )
            return F.sort_array(F.concat(kept, F.transform(pairs(cuts), lambda i: F.shiftleft(i.cast("long"), PLACE_AT).bitwiseOR(single(i).cast("long")))))

        return _let(F.aggregate(edges, first, lambda cuts, e: F.when(joins(cuts, e), without(cuts, e)).otherwise(cuts)), left)

    places = F.sequence(F.lit(0), n - 1)
    from_to, ends, outside = (_by_place(x) for x in (lambda i, j: (2 << j) - (1 << i), lambda i, j: 1 << i | 1 << j, lambda i, j: (1 << ONE + 1) - 1 - (1 << j) + (2 << i if j > i else 1 << i)))

    def at(table: Column, e: Column) -> Column:
        return F.get(table, e.bitwiseAND((64 << START_AT) - 1).cast("int"))

    def between(cuts: Column) -> Column:
        two = cuts.bitwiseAND(F.shiftright(cuts, 1))
        return F.when(two == 0, F.array().cast("array<int>")).otherwise(F.filter(places, lambda i: F.call_function("shiftright", two, i).bitwiseAND(1) == 1))

    short = fold(
        _bit(n + 1) - 1,
        lambda cuts, e: (F.bit_count(cuts.bitwiseAND(at(from_to, e))) == 3) & (cuts.bitwiseAND(at(ends, e)) == at(ends, e)),
        lambda cuts, e: cuts.bitwiseAND(at(outside, e)),
        lambda cuts, e: cuts.bitwiseAND(at(from_to, e)) == at(ends, e),
        between,
    )

    def within(cuts: Column, lo: Column, hi: Column) -> Column:
        return cuts.bitwiseAND(hi - lo - lo)

    def both(cuts: Column, lo: Column, hi: Column) -> Column:
        return cuts.bitwiseAND(lo + hi) == lo + hi

    def block(e: Column) -> Column:
        return F.floor(_start(e) / STRIDE).cast("int")

    def in_block(e: Column) -> tuple[Column, Column]:
        at = _start(e) - block(e) * STRIDE
        return _bit(at), _bit(at + e.bitwiseAND((1 << START_AT) - 1).cast("int"))

    def own(blocks: Column, e: Column) -> Column:
        return F.element_at(blocks, block(e) + 1)

    def without(blocks: Column, e: Column) -> Column:
        inside = within(own(blocks, e), *in_block(e))

        def less(cuts: Column, i: Column) -> Column:
            taken = (
                F.when(i == block(e), inside)
                .when(i == block(e) + 1, F.shiftrightunsigned(inside, STRIDE))
                .when(i == block(e) - 1, F.shiftleft(inside, STRIDE).bitwiseAND((1 << STRIDE + OVER) - 1))
                .otherwise(F.lit(0).cast("long"))
            )
            return cuts.bitwiseAND(F.bitwise_not(taken))

        return F.transform(blocks, less)

    whole = F.transform(F.sequence(F.lit(0), F.floor(n / STRIDE).cast("int")), lambda b: _bit(F.least(F.lit(STRIDE + OVER), n + 1 - b * STRIDE)) - 1)
    def stands_alone(blocks: Column, i: Column) -> Column:
        return F.call_function("shiftright", F.element_at(blocks, F.floor(i / STRIDE).cast("int") + 1), i % STRIDE).bitwiseAND(3) == 3

    long = fold(
        whole,
        lambda blocks, e: both(own(blocks, e), *in_block(e)) & (F.bit_count(within(own(blocks, e), *in_block(e))) == 1),
        without,
        lambda blocks, e: both(own(blocks, e), *in_block(e)) & (within(own(blocks, e), *in_block(e)) == 0),
        lambda blocks: F.filter(places, lambda i: stands_alone(blocks, i)),
    )
    return F.when(n <= ONE, short).otherwise(long)


def edges_of(words: DataFrame, table: DataFrame, longest: int, least: int = 1) -> DataFrame:
    """``words`` with a row for each edge of ``least`` (1 or 2) characters or more: start, end, id, score, rank; those
    are null for a single character without a piece, and for a word's first one. Substrings meet the pieces by a
    64-bit hash, then as they are. ``table`` is the piece table, whose size the vocabulary
    bounds, so it is broadcast."""
    n, start = F.length("word"), F.col("start")
    substrings = (
        words.where("word <> ''")
        .withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(n - least, F.lit(0)))))
        .withColumn("end", F.explode(F.sequence(F.when(start == 0, F.lit(1)).otherwise(start + least), F.least(n, start + longest))))
        .withColumn("part", F.expr("substr(word, start + 1, end - start)"))
        .withColumn("hash", F.xxhash64("part"))
    )
    met = substrings.join(F.broadcast(table.withColumn("hash", F.xxhash64("piece"))), "hash", "left")
    is_piece, alone = F.col("piece") == F.col("part"), F.col("end") == start + 1
    is_edge = is_piece & (F.col("end") >= start + least)
    return met.where(is_edge | alone).select(*words.columns, "start", "end", *[F.when(is_edge, F.col(c)).alias(c) for c in ("id", "score", "rank")])


def encode_words(words: DataFrame, table: DataFrame, byte_ids: list[int], fold: str, longest: int, characters: dict[str, int] | None = None) -> DataFrame:
    """``words`` (word, not empty, and other columns that it determines) with ids. ``merges`` needs the
    ids of the pieces that are single ``characters``."""
    n, edges = F.length("word"), edges_of(words, table, longest, 1 if fold == "viterbi" else 2)
    of_byte = F.array(*[F.lit(b) for b in byte_ids])

    def as_bytes(start: Column, size: Column) -> Column:
        hexed = F.hex(F.encode(F.substring("word", start + 1, size), "utf-8"))
        return F.transform(F.regexp_extract_all(hexed, F.lit("(..)"), 1), lambda x: F.element_at(of_byte, F.conv(x, 16, 10).cast("int") + 1))

    if fold == "viterbi":
        grouped = edges.groupBy(*words.columns).agg(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("start", "end", "id", "score"))).alias("edges"))
        path = viterbi(F.col("edges"), n)
        return grouped.select(*words.columns, F.flatten(F.transform(path, lambda e: F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(as_bytes(e["start"], e["end"] - e["start"])))).alias("ids"))
    # An id by code point, of the others by the place of the character in one text of them; 0 where it has none.
    known = sorted((characters or {}).items(), key=lambda x: (x[0] != MARK, x[0]))
    first, others = [0] * 256, [(c, i) for c, i in known if ord(c) > 255]
    for c, i in known:
        if ord(c) < 256:
            first[ord(c)] = i
    by_code, other, their_ids = F.array(*map(F.lit, first)), F.lit("".join(c for c, _ in others)), F.array(F.lit(0), *[F.lit(i) for _, i in others])

    def single(i: Column) -> Column:
        c = F.substring("word", i + 1, F.lit(1))
        return F.when(F.ascii(c) < 256, F.get(by_code, F.ascii(c))).otherwise(F.element_at(their_ids, F.instr(other, c) + 1))

    number = F.expr(f"shiftleft(rank, {RANK_AT}) | shiftleft(cast(id as long), {ID_AT}) | shiftleft(cast(start as long), {START_AT}) | cast(end - start as long)")
    grouped = edges.groupBy(*words.columns).agg(F.collect_list(number).alias("edges")).select(*words.columns, F.sort_array("edges").alias("edges"))
    path = grouped.select(*words.columns, merges(F.col("edges"), n, single).alias("path"))
    ids = F.transform("path", lambda e: e.bitwiseAND(32767).cast("int"))
    spelt = F.flatten(F.transform("path", lambda e: F.when(e.bitwiseAND(32767) > 0, F.array(e.bitwiseAND(32767).cast("int"))).otherwise(as_bytes(F.shiftright(e, PLACE_AT).cast("int"), F.lit(1)))))
    return path.select(*words.columns, F.when(F.array_contains(ids, 0), spelt).otherwise(ids).alias("ids"))


#: What a text may hold that is not words parted by single spaces and newlines.
_ODD = f"^ |  |{MARK}|[\\x00-\\x09\\x0b-\\x1f]"


def split(given: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The words of a column of texts, null as empty, and where each text's words begin and the last one's end."""
    given, none, mark = pc.fill_null(given.cast(pa.large_string()), ""), *(pa.scalar(x, pa.large_string()) for x in ("", MARK))
    odd = pc.match_substring_regex(given, _ODD)
    parted = pc.replace_substring(pc.replace_substring(given, " ", " " + MARK), "\n", " \n ")
    parted = pc.if_else(pc.equal(given, none), none, pc.binary_join_element_wise(mark, parted, none))
    if pc.any(odd).as_py():  # no word holds a space
        parted = pc.replace_with_mask(parted, odd, pa.array([" ".join(words_of(t)) for t in given.filter(odd).to_pylist()], pa.large_string()))
    lists = pc.split_pattern(parted, " ")
    words, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.not_equal(words, none)
    return words.filter(full), np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])[ends]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of what a task has read so far."""
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        if not held:
            return pa.table({"word": pa.array([], pa.large_string()), "n": pa.array([], pa.int64())})
        whole = pa.concat_tables(held).combine_chunks()
        coded = _one(whole["word"]).dictionary_encode()
        n = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(n, coded.indices.to_numpy(), whole["n"].to_numpy())
        return pa.table({"word": coded.dictionary, "n": n})

    def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
        return iter(pa.table({"word": table["word"].cast(pa.string()), "n": table["n"]}).to_batches())

    for batch in batches:
        counts = split(batch.column("text"))[0].value_counts()
        held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
        if sum(t.num_rows for t in held) > 2 * HELD:
            held = [summed()]
            if held[0].num_rows > HELD:
                yield from told(held.pop())
    yield from told(summed())


def decode(ids: list[int], name: str = "piece_bpe_32k.model") -> str:
    """The text of one document's ids: marks read as spaces, the first left out."""
    return b"".join(map(texts_of(name).__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")[1:]


@lru_cache(2)
def texts_of(name: str) -> dict[int, bytes]:
    """The bytes that each id stands for."""
    pieces, byte_ids, _ = vocabulary(name)
    return {i: p.encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}


@lru_cache(2)
def _spellings(name: str) -> pa.LargeBinaryArray:
    """The bytes of each id, at its place."""
    known = texts_of(name)
    return pa.array([known.get(i) for i in range(max(known) + 1)], pa.large_binary())


def spelt(ids: np.ndarray, ends: np.ndarray, name: str = "piece_bpe_32k.model") -> Iterator[bytes]:
    """For each document the bytes that its ids, those from its end to the next, stand for: marks
    read as spaces, the first left out."""
    parts = _spellings(name).take(pa.array(ids))
    whole, mark = memoryview(parts.buffers()[2] or b""), MARK.encode()
    at = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1, 8 * parts.offset)[ends].tolist()
    return (bytes(whole[a:b]).replace(mark, b" ")[1:] for a, b in zip(at, at[1:]))


def digests(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The digest of each word, whose ids are those from its offset to the next."""
    sizes = np.diff(offsets)
    place = np.arange(len(ids)) - np.repeat(offsets[:-1], sizes)
    terms = powers(int(sizes.max(initial=0)) + 1, INNER)[place] * (ids + 1) % PRIME
    sums = np.concatenate([[0], np.cumsum(terms)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]) % PRIME


def word_table(docs: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """(word, n, ids): every distinct word of ``docs`` (text), its count, its ids."""
    pieces, byte_ids, fold = vocabulary(name)
    words = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_distinct, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    characters = {p: i for p, (i, _) in pieces.items() if len(p) == 1}
    return encode_words(words, piece_table(docs.sparkSession, name), byte_ids, fold, max(map(len, pieces)), characters)


@contextmanager
def in_memory(spark: SparkSession) -> Iterator[None]:
    """Groups of edges are hashed up to ``GROUPED`` words in a task, while Spark
    would begin to sort at 128."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(GROUPED))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frequent(table: DataFrame, hot_words: int) -> Column:
    """Which rows of a word table have the counts that at most ``hot_words`` words reach."""
    least, so_far = 1, 0
    for r in table.groupBy("n").count().orderBy(F.desc("n")).limit(hot_words).collect():
        so_far += r["count"]
        if so_far > hot_words:
            least = r["n"] + 1
            break
    return F.col("n") >= least


def numbers_of(text: str, number: dict[str, int]) -> tuple[np.ndarray, dict[int, str]]:
    """The numbers of the words of ``text`` in their order, -1 for those that ``number`` lacks, and
    these by place."""
    words = split(pa.array([text]))[0].to_pylist()
    found = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
    return found, {i: words[i] for i in np.flatnonzero(found < 0).tolist()}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """``base`` to the powers below ``n``."""
    out, step = np.ones(1, np.int64), base
    while len(out) < n:
        out = np.concatenate([out, out * step % PRIME])
        step = step * step % PRIME
    return out[:n]


def _read(hot: Broadcast):
    """Of each text a digest and its words in their order: numbers of hot words, and below 0, from -1 down,
    places in the text's own list of other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(hot.value, pa.large_string())
        for batch in batches:
            words, ends = split(batch.column("text"))
            numbers = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().copy()
            rare = np.flatnonzero(numbers < 0)
            coded = words.take(pa.array(rare)).dictionary_encode()
            doc, many = np.repeat(np.arange(batch.num_rows), np.diff(ends))[rare], max(len(coded.dictionary), 1)
            tail, entry = np.unique(doc * many + coded.indices.to_numpy(), return_inverse=True)
            tail_ends = np.searchsorted(tail, np.arange(batch.num_rows + 1) * many)
            numbers[rare] = tail_ends[doc] - entry - 1
            marks = pa.array([digest_of(t) for t in texts(batch, "text")], pa.binary())
            tails = pa.ListArray.from_arrays(pa.array(tail_ends, pa.int32()), coded.dictionary.take(pa.array(tail % many)).cast(pa.string()))
            numbers = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers, pa.int32()))
            yield pa.record_batch([batch.column("key"), batch.column("doc_id"), marks, numbers, tails], names=["key", "doc_id", "mark", "numbers", "tail"])

    return run


def digest_of(text: str | bytes) -> bytes:
    return hashlib.blake2b(text.encode() if isinstance(text, str) else text, digest_size=16).digest()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each list begins and the last one ends."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])


def _assembled(hot: Broadcast):
    """Each document's ids in their order, from those of its words, and how many each word has. Rows come
    in order of key: for each key one with the document's ``numbers``, the others with the ids of the words of its list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows + len(batch.column("numbers").flatten())
            if size < PORTION:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            key = rows["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut:
                yield whole(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            size = sum(b.num_rows + len(b.column("numbers").flatten()) for b in held)
        if sum(b.num_rows for b in held):
            yield whole(pa.Table.from_batches(held))

    def whole(rows: pa.Table) -> pa.RecordBatch:
        hot_ids, hot_ends = hot.value
        is_word = pc.is_valid(rows["j"])
        docs, tails = (rows.filter(x).combine_chunks() for x in (pc.invert(is_word), is_word))
        number, words = _flat(_one(docs["numbers"]))
        own_ids, own_ends = _flat(_one(tails["ids"]))
        place, keys, of_word = tails["j"].to_numpy(), docs["key"].to_numpy(), tails["key"].to_numpy()
        firsts = np.searchsorted(of_word, keys)
        entry = np.empty(len(place), np.int64)  # of a document's word at each place of its list
        entry[firsts[np.searchsorted(keys, of_word)] + place] = np.arange(len(place))
        word = number.astype(np.int64)
        rare = np.flatnonzero(word < 0)
        word[rare] = len(hot_ends) - 1 + entry[np.repeat(firsts, np.diff(words))[rare] - 1 - word[rare]]
        starts = np.concatenate([hot_ends[:-1], len(hot_ids) + own_ends[:-1]])
        size = np.concatenate([np.diff(hot_ends), np.diff(own_ends)])[word]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.concatenate([hot_ids, own_ids])[np.repeat(starts[word] - ends[:-1], size) + np.arange(ends[-1])]
        lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(x.astype(np.int32))) for o, x in ((ends[words], out), (words, size))]
        return pa.record_batch([_one(docs["doc_id"]), _one(docs["mark"]), *lists], names=["doc_id", "mark", "ids", "sizes"])

    return run


def numbered(batches: Iterator[pa.RecordBatch], name: str = "piece_bpe_32k.model") -> Iterator[pa.RecordBatch]:
    """Of documents' ``ids``, with the ``sizes`` of their words, the numbers and the digest, and whether
    the ids, decoded, are the text of which ``mark`` is the digest."""
    for batch in batches:
        (ids, ends), (sizes, words) = _flat(batch.column("ids")), _flat(batch.column("sizes"))
        ids, place = ids.astype(np.int64), np.arange(len(sizes)) - np.repeat(words[:-1], np.diff(words))
        of_word = digests(ids, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
        sums = np.concatenate([[0], np.cumsum(powers(int(place.max(initial=0)) + 1)[place] * of_word % PRIME)])
        same = [digest_of(text) == mark for text, mark in zip(spelt(ids, ends, name), batch.column("mark").to_pylist())]
        cols = [batch.column("doc_id"), *map(pa.array, (np.diff(words), np.diff(ends), (sums[words[1:]] - sums[words[:-1]]) % PRIME)), pa.array(same, pa.bool_())]
        yield pa.record_batch(cols, names=["doc_id", "n_words", "n_pieces", "ids_digest", "round_trip"])


def _encoded(docs: DataFrame, name: str, hot_words: int, told, shape: str) -> DataFrame:
    """What ``told`` makes of all documents' ids. The words beyond the hot ones meet the word table, and
    then their documents, in parts one after the other, so that the shuffles of
    one part at a time are on disk."""
    spark = docs.sparkSession
    with in_memory(spark):
        table, table_at = stored_at(word_table(docs, name), "word-table")
        hot = table.where(frequent(table, hot_words)).select("word", "ids").toArrow()  # at most ``hot_words`` rows
        words, hot_ids = spark.sparkContext.broadcast(hot["word"].to_pylist()), spark.sparkContext.broadcast(_flat(_one(hot["ids"])))
        given = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        rows, rows_at = stored_at(given.mapInArrow(_read(words), "key long, doc_id long, mark binary, numbers array<int>, tail array<string>"), "document-words")
        tails = rows.select("key", F.posexplode("tail").alias("j", "word"))

        def part(column: str, i: int, parts: int) -> Column:
            return F.pmod(F.xxhash64(column), F.lit(parts)) == i

        def met(i: int) -> DataFrame:
            here = part("word", i, WORD_PARTS)
            return tails.where(here).join(table.where(here).select("word", "ids"), "word").select("key", "j", "ids")

        def whole(i: int) -> DataFrame:
            both = rows.drop("tail").unionByName(found, allowMissingColumns=True).where(part("key", i, PARTS)).select("key", "doc_id", "mark", "numbers", "j", "ids")
            return both.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: told(_assembled(hot_ids)(batches)), shape)

        moved = [stored_at(met(i), "tail-ids") for i in range(WORD_PARTS)]
        released(spark, table_at)
        found = reduce(DataFrame.unionByName, [df for df, _ in moved])
        done = [stored(whole(i), "encoded") for i in range(PARTS)]
    for path in (rows_at, *(at for _, at in moved)):
        released(spark, path)
    return reduce(DataFrame.unionByName, done)


def encode_documents(docs: DataFrame, name: str = "piece_bpe_32k.model", hot_words: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_pieces, ids_digest, round_trip) of every row of ``docs``:
    how many words and pieces, the digest of its ids in their order, and whether
    they decode to its text; all from the ids that ``document_ids`` gives."""
    return _encoded(docs, name, hot_words, lambda batches: numbered(batches, name), "doc_id long, n_words long, n_pieces long, ids_digest long, round_trip boolean")


def _ids_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.select(["doc_id", "ids"])


def document_ids(docs: DataFrame, name: str = "piece_bpe_32k.model", hot_words: int = HOT) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text), ids in order."""
    return _encoded(docs, name, hot_words, _ids_alone, "doc_id long, ids array<int>")


def _decoded(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([decode(x or [], name) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def decoded(encoded: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, text) of every row of ``encoded`` (doc_id, ids); null ids as none."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(name), "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
