"""Spelling variants grouped under the form that is far more frequent, by a symmetric-delete join.

Words are runs of Latin letters, A-Z in lower case. Every word emits itself and its distinct single
deletions as keys; words that share a key are at most two edits apart, those one edit apart always share
one, and exact distance tells them. A word's form is its near word of largest count where that is
``RATIO`` times its own or more; roots follow forms to the last.

Keys are 64-bit numbers: the sum of a word's characters times powers of an odd number, from which the key of
each deletion follows in one step, so a word of n characters takes n steps, not n times n. Different strings
with one key only add a candidate. A deletion within a run of equal characters is that of the run's first, so a key
that many words share is bounded by alphabet times length, not by the corpus. A pair is made
once, and counts go to both.

``typed`` plants the typing errors of a controlled corpus: one character goes from every word of a
document that a checksum of both draws.

Defined cases: null and empty texts have no words; a null id is the empty text in the checksum; repeated rows count
each; words of any length are compared; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import read_table, released, stored, stored_at
from tarn.llm.importance import SQL_CRC_TABLE, sql_crc

LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LEAST, RATIO, EVERY = 6, 5, 5, 199
#: An odd number, and the one that undoes a product with it in 64 bits.
BASE = 0x9E3779B97F4A7C15
UNDO = pow(BASE, -1, 1 << 64)
#: Characters of words that are worked out at once.
HELD = 1 << 20


def typed(id_col: Column, run: Column, every: int = EVERY) -> Column:
    """``run`` without one character, if the checksum of id and run draws it."""
    h = F.crc32(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """(word, n): the words of ``shortest`` characters or more that occur ``least`` times or more, after typing errors."""
    # A shorter run gives no word, and no part of a run matches, as the pattern takes all of it.
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{shortest},}}"), 0)
    low = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    return low.select(typed(F.col("id"), F.col("run"), every).alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def deletion_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of a word and a key, for each word itself and each of its distinct single deletions."""
    lengths = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n, ends = len(chars), np.cumsum(lengths)
    of, first = np.repeat(np.arange(len(texts)), lengths), np.repeat(ends - lengths, lengths)
    place = np.arange(n) - first
    most = int(lengths.max(initial=0))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, BASE, np.uint64)]).astype(np.uint64), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(chars * powers[place], dtype=np.uint64)])
    begin, end = sums[ends - lengths], sums[ends]
    opens = np.ones(n, bool)  # the first of a run of equal characters
    opens[1:] = (chars[1:] != chars[:-1]) | (place[1:] == 0)
    at = np.flatnonzero(opens)
    w = of[at]
    without = (sums[at] - begin[w]) + (end[w] - sums[at + 1]) * np.uint64(UNDO)
    key = np.concatenate([end - begin, without])
    size = np.concatenate([lengths, lengths[w] - 1]).astype(np.uint64)
    key ^= size * np.uint64(BASE)
    return np.concatenate([np.arange(len(texts)), w]), key.view(np.int64)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum([len(t) for t in batch.column(1).to_pylist()])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + HELD, "right")))
            part = batch.slice(at, end - at)
            w, key = deletion_keys(part.column(1).to_pylist())
            yield pa.record_batch([pa.array(key), part.column(0).take(pa.array(w))], names=["key", "id"])
            at = end


def is_near(a: str, b: str) -> bool:
    """Whether two different strings differ by one inserted, deleted or replaced character, in one pass over them."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("word", "other_word"))
        yield batch.filter(pa.array(list(map(is_near, a, b)), pa.bool_()))


def near_pairs(numbered: DataFrame) -> DataFrame:
    """(id, n, other, other_n, word, other_word) of all pairs of words of ``numbered`` (id, word, n) at a distance of exactly
    one, once each. Keys go with the word's number alone, words join their candidates."""
    keys = numbered.select("id", "word").mapInArrow(_emit, "key long, id long")
    met = keys.join(keys.withColumnRenamed("id", "other"), "key").where("id < other").select("id", "other").distinct()
    told = numbered.select(F.col("id").alias("other"), F.col("word").alias("other_word"), F.col("n").alias("other_n"))
    pairs = met.join(numbered, "id").join(told, "other")
    return pairs.mapInArrow(_verified, pairs.schema)


def forms(numbered: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word of ``numbered`` (id, word, n)."""
    pairs = stored(near_pairs(numbered), "near-words")
    both = pairs.select("id", "other_word", "other_n").unionByName(pairs.select(F.col("other").alias("id"), F.col("word").alias("other_word"), F.col("n").alias("other_n")))
    best = both.groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("order"), "other_word")).alias("best"))
    beside = numbered.join(best, "id", "left")
    taken = -F.col("best.order") >= ratio * F.col("n")
    return beside.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(taken, F.col("best.other_word")).alias("form"), F.when(taken, -F.col("best.order")).alias("form_n"),
    )


def rooted(found: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``forms`` with ``root``: each word's way of forms to the last one. Counts grow by ``ratio``
    with every step, so ways are short and have no circle; each round doubles what is followed."""
    now, path = stored_at(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        longer = now.join(on, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved"))
        before = path
        now, path = stored_at(longer, "roots")
        released(now.sparkSession, before)
        moved = now.where("moved").limit(1).count()
        now = now.select("word", "root")
        if not moved:
            return found.join(now, "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table of different words and their counts."""
    known = stored(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    return rooted(stored(forms(known, ratio), "forms"), ratio).select("word", "form", "root", "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(words(read_table(spark, sf_dir, "documents")))


#: Two words are near if they differ at one place, or one is the other without a character.
SQL = f"""
WITH RECURSIVE {SQL_CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {SHORTEST} GROUP BY ALL),
drawn AS MATERIALIZED (SELECT run, n, {sql_crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM each, crc_table),
typed AS (SELECT n, CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM drawn),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}),
k AS MATERIALIZED (SELECT word, n, 0 AS i, word AS key FROM w UNION ALL SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS MATERIALIZED (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM k a JOIN k b USING (key) WHERE a.word <> b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
best AS (SELECT word, count(*) AS n_near, arg_max(other, (other_n, -rank)) AS other, max(other_n) AS other_n FROM (SELECT *, row_number() OVER (ORDER BY other) AS rank FROM p) GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * w.n THEN other END AS form, CASE WHEN other_n >= {RATIO} * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN last USING (word)
"""
