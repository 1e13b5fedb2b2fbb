"""Fingerprints, near copies, packing and token files, against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import bpe, common, components, packing, simhash, syncmers, token_files
from tarn.session import shared_path
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, fp long, key string"
EDGE = [(1, None, None, 1, "k"), (2, "", "x", None, None), (3, "a b c", "x", 1, "k"), (3, "a b c", "x", 1, "k"), (None, "a b c", None, 1, "k"), (5, "word " * 30000, "x", 1, "k"), (4, "é中文🙂", None, 1, "k")]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def slow_fingerprint(text, words=4):
    parts = text.encode().lower().split()
    if not parts:
        return 0
    grams = [b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or [b" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes_of(prints, bits=4):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_is_brute_force(spark, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, SF).collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    assert got == {i: (f"{prints[i]:016x}", c) for i, c in classes_of(prints).items()}


def test_simhash_with_groups_larger_than_a_tile(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 7)
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    prints = {}
    for i in range(300):
        x = base[i % 6]
        for b in rng.integers(0, 63, int(rng.integers(0, 5))):
            x ^= 1 << int(b)
        prints[i] = x
    first = {}
    for i, x in prints.items():
        first.setdefault(x, i)
    reps = spark.createDataFrame([(x, i) for x, i in first.items()], "fp long, node long")
    for blocks in (6, 7):
        roots = {r["node"]: r["root"] for r in components.connected_components(simhash.links(reps, 4, blocks)).collect()}
        wanted = classes_of({i: x for x, i in first.items()})
        assert {i: roots.get(i, i) for i in first.values()} == wanted


def test_simhash_edge_rows(spark, edge):
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(edge).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (None, None), (5, 5), (4, 4)], key=str)
    assert simhash.near_duplicates(edge.limit(0)).count() == 0
    kept = simhash.keep_one(edge, 5)
    assert kept.columns == edge.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, None, 5, 4], key=str)


def test_similar_finds_copies_and_leaves_others(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(3000)]
    rows, alike = [], {}
    for i in range(60):
        text = list(rng.choice(words, 300))
        rows.append((10 * i, " ".join(text)))
        for j, edits in enumerate((0, 2, 4, 40)):
            copy = list(text)
            for at in rng.choice(300, edits, replace=False):
                copy[at] = "changed"
            rows.append((10 * i + 1 + j, " ".join(copy)))

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        first = grams(rows[i // 10 * 5][1])
        alike = len(first & grams(t)) / len(first | grams(t))
        if alike >= 0.85:
            assert got[i] == i // 10 * 10
        elif alike < 0.7:
            assert got[i] == i


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}
    assert components.connected_components(edges.limit(0)).count() == 0


def slow_anchors(text):
    def rolled(part):
        x = sum(ord(c) * pow(syncmers._BASE, i, 1 << 64) for i, c in enumerate(part)) % (1 << 64)
        return int(syncmers._mix(np.array([x], np.uint64))[0])

    out = []
    for i in range(len(text) - syncmers.K + 1):
        kmer = text[i : i + syncmers.K]
        inner = [rolled(kmer[j : j + syncmers.S]) for j in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, rolled(kmer)))
    return out


def test_anchors_are_closed_syncmers(texts):
    for text in list(texts.values())[:8]:
        at, h = syncmers.anchors(text[:400])
        assert list(zip(at.tolist(), h.tolist())) == slow_anchors(text[:400])


def test_edits_are_brute_force(spark, texts):
    got = {r["doc_id"]: r for r in syncmers.query(spark, SF).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    better = 0
    for i, n in zip(order, [*order[1:], order[0]]):
        text, other = texts[i], texts[n]
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["edited_fingerprint"] == syncmers.as_text(syncmers.sketch(edited))
        assert r["near_next"] == syncmers.likeness(syncmers.sketch(text), syncmers.sketch(other))
        better += r["near_edited"] > r["near_next"]
    assert better > 0.95 * len(texts)


def test_fingerprint_edge_rows(spark, edge):
    rows = syncmers.with_edits(edge).collect()
    assert len(rows) == len(EDGE)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] == ""
    assert by_id[None]["fingerprint"] == by_id[3]["fingerprint"] != ""
    one = syncmers.with_edits(edge.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 4
    assert syncmers.with_edits(edge.limit(0)).count() == 0
    assert syncmers.fingerprints(edge).count() == len(EDGE)
    assert syncmers.likeness(syncmers.sketch(""), syncmers.sketch("")) == 1.0
    assert syncmers.likeness(syncmers.sketch("x"), syncmers.sketch("")) == 0.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80))
def test_packing_fills_no_bin_twice(lengths):
    where, offset = packing.sum_of_squares(np.array(lengths, np.int64), 60)
    bins = defaultdict(list)
    for n, b, o in zip(lengths, where.tolist(), offset.tolist()):
        bins[b].append((o, n))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 60
    assert len(bins) <= 2 * -(-sum(lengths) // 60) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_every_place_is_that_of_a_direct_search(lengths):
    """Largest first; of all open bins with room the one after which the squared
    counts of gaps sum to least; a new bin only where none has room."""
    lengths = np.array(lengths, np.int64)
    where, offset = packing.sum_of_squares(lengths, 40)

    def squares(gaps):
        return sum(n * n for n in Counter(g for g in gaps.values() if g).values())

    gaps = {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n, b = int(lengths[i]), int(where[i])
        open_bins = [x for x, g in gaps.items() if g >= n]
        if not open_bins:
            assert b not in gaps and offset[i] == 0
        else:
            least = min(squares(gaps | {x: gaps[x] - n}) for x in open_bins)
            assert gaps.get(b, 0) >= n and squares(gaps | {b: gaps[b] - n}) == least
            assert offset[i] == 40 - gaps[b]
        gaps[b] = gaps.get(b, 40) - n


def test_packing_is_tight():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1024, 4000)
    where, _ = packing.sum_of_squares(lengths, 1024)
    assert len(set(where.tolist())) <= 1.03 * -(-lengths.sum() // 1024)


def test_cut():
    assert packing.cut(5, 10) == [(0, 5)]
    assert packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)]


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


END = "<|endoftext|>"
ODD = ["", " ", "  a", "a  ", " a\n\n b 中文🙂\t'LL we'll x²", END, f"{END} at the start", f"in the {END} middle", f"in{END}side a word", f"at the end {END}", f"twice {END}{END}\n{END}", "tab\t x \n y\r\n z", "a\x1c b \x85c\xa0 d\u3000 e \u2028f", "x" * 300 + " y"]


def test_ids_are_those_of_the_library(texts):
    some = [*texts.values(), *ODD]
    for got, e in zip(bpe.encoded(some, 0), library().encode_batch(some, add_special_tokens=False)):
        assert got.tolist() == [*e.ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", " ", "  ", "\n", "\t", "\r\n", END, "<|endof", "'s", "é", "漢", "\u3000", "\x1c", "\x85", "\u180e", "1", "!", "\xa0", "😀", "\u0301"]), max_size=14).map("".join))
def test_any_text_has_the_ids_of_the_library(text):
    assert next(bpe.encoded([text], 7)).tolist() == [*library().encode(text, add_special_tokens=False).ids, 7]


def test_packed_pieces(spark, texts):
    rows = packing.query(spark, SF).collect()
    lib, by_doc, bins = library(), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(by_doc) == sorted(texts)
    for i, t in texts.items():
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in parts] == packing.cut(len(ids), 1024)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in parts)
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024


def test_packing_edge_rows(spark, edge):
    rows = packing.pack_documents(edge).collect()
    assert sum(r["doc_id"] == 3 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert [r["length"] for r in rows if r["doc_id"] == 2] == [1]
    assert packing.pack_documents(edge.limit(0)).count() == 0


def test_token_files_round_trip(spark, texts):
    manifest = token_files.write_token_files(spark.read.parquet(f"{SF}/documents.parquet").repartition(5), shared_path(spark, "test"), seq_len=64)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_files.read_token_files(manifest).collect()}
    start, stream, lib = 0, [], library()
    for i in sorted(texts):
        ids = np.array([*lib.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        stream.append(ids)
    stream, at = np.concatenate(stream), 0
    for r in sorted(manifest.collect(), key=lambda r: r["start"]):
        reader = token_files.SequenceReader(r["file"])
        for k in range(len(reader)):
            ids, mask = reader.sequence(k)
            assert len(ids) == len(mask) == 64
            assert ids[mask].tolist() == stream[at : at + mask.sum()].tolist()
            at += int(mask.sum())
    assert at == len(stream)


def test_files_of_failed_attempts_go(spark, docs, tmp_path):
    for name in ("lost.ids.arrow", "lost.docs.arrow", "other.txt"):
        (tmp_path / name).write_bytes(b"x")
    manifest = token_files.write_token_files(docs.limit(5), f"file://{tmp_path}")
    left = {p.name for p in tmp_path.iterdir()}
    assert left == {"other.txt"} | {f"{r['file'].rsplit('/', 1)[1]}.{kind}.arrow" for r in manifest.collect() for kind in ("ids", "docs")}


def test_token_file_edge_rows(spark, edge):
    rows = token_files.read_token_files(token_files.write_token_files(edge, shared_path(spark, "test"))).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 3, 4, 5]
    assert [r["n_tokens"] for r in rows][1:3] == [1, 1]
    empty = token_files.write_token_files(edge.limit(0), shared_path(spark, "test"))
    assert token_files.read_token_files(empty).count() == 0


def test_sequences_are_views_of_the_file(spark, docs):
    file = token_files.write_token_files(docs.limit(20), shared_path(spark, "test"), seq_len=32).first()["file"]
    ids, _ = token_files.SequenceReader(file).sequence(1)
    assert not ids.flags.owndata


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 3000), st.integers(0, 3000), st.integers(0, 99))
def test_bitmaps_drop_no_pair_that_has_the_similarity(both, left, right, seed):
    x = np.random.default_rng(seed).integers(0, 2**64, both + left + right, np.uint64)
    a, b = np.unique(x[: both + left]), np.unique(np.r_[x[:both], x[both + left :]])
    alike = len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    possible = simhash.wide_possible(0.8, len(a), simhash.wide_bitmap(a), len(b), simhash.wide_bitmap(b))
    assert possible or not alike
    if min(len(a), len(b)) > max(200, 0.8 * max(len(a), len(b))) and len(np.intersect1d(a, b)) < 0.5 * len(np.union1d(a, b)):
        assert not possible


def test_special_strings_are_their_token_in_files_and_pieces(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_files.read_token_files(token_files.write_token_files(df, shared_path(spark, "test"))).collect()}
    cut = {r["doc_id"]: r for r in packing.pieces(df).collect()}
    for i, t in enumerate(ODD):
        ids = library().encode(t, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
        assert cut[i]["ids_crc32"] == zlib.crc32(np.array([*ids, 2], "<u4").tobytes())


def test_width_of_ids_follows_vocabulary_and_end_id(spark, docs):
    for end_id, kind in ((0, pa.uint16()), (70_000, pa.uint32())):
        file = token_files.write_token_files(docs.limit(3), shared_path(spark, "test"), end_id=end_id).first()["file"]
        reader = token_files.SequenceReader(file)
        assert reader.reader.schema.field("ids").type.value_type == kind
        assert end_id in reader.sequence(0)[0] or len(reader) > 1


def test_similar_is_brute_force_jaccard(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(4000)]
    line = list(rng.choice(words, 12))  # a line that many texts share
    rows = []
    for length in (5, 8, 9, 12, 16, 19, 40, 80):
        for _ in range(12):
            base = [*rng.choice(words, length), *(line if rng.random() < 0.3 else [])]
            for cut in sorted({0, 1, 2, 3, length // 10, length // 6, length // 4}):
                rows.append((len(rows), " ".join(base[: len(base) - cut])))
                rows.append((len(rows), " ".join([*base[cut:], *rng.choice(words, cut // 2)])))

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(df).collect()}
    assert got == {i: root(i) for i in range(len(rows))}


def test_components_take_few_rounds_and_are_brute_force(spark, monkeypatch):
    """Chains, stars and random graphs: one forest and one last task, whatever the length of a chain;
    the same with every bound far below the edges, where stars and partial forests do it."""
    rng = np.random.default_rng(9)
    pairs = [(i, i + 1) for i in range(0, 1500)] + [(5000, i) for i in range(5001, 5400)]
    pairs += [tuple(map(int, rng.integers(6000, 7000, 2))) for _ in range(700)] + [(8000, 8000), (9001, 9000)]
    pairs = [pairs[i] for i in rng.permutation(len(pairs))]
    least = {i: i for p in pairs for i in p}
    while True:
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    wanted = {i: r for i, r in least.items() if i != r}
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    made, stored_at = [], components.stored_at
    monkeypatch.setattr(components, "stored_at", lambda df, label: made.append(label) or stored_at(df, label))
    assert {r["node"]: r["root"] for r in components.connected_components(edges).collect()} == wanted
    assert len(made) == 2
    monkeypatch.setattr(components, "ONE", 50)
    got = components.connected_components(edges).collect()
    assert {r["node"]: r["root"] for r in got} == wanted and len(got) == len(wanted) and len(made) > 5
    assert components.connected_components(edges.limit(0)).count() == 0


def test_no_table_that_grows_is_broadcast(spark):
    """Spark expects of the exploded keys no more than of what they are made of; they are many times larger."""
    reps = spark.range(3000).select(F.xxhash64("id").alias("fp"), F.col("id").alias("node"))
    found = simhash.links(reps, 4, 7)
    assert found.count() >= 0 and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    classes = simhash.with_class(reps.select(F.col("node").alias("doc_id"), "fp"), reps.select("fp", F.col("node").alias("component_id")))
    assert classes.count() == 3000 and "BroadcastHashJoin" not in classes._jdf.queryExecution().executedPlan().toString()
    least = common.beside_least(reps.select("fp", "node"), "fp", "node")
    assert least.count() == 3000 and "BroadcastHashJoin" not in least._jdf.queryExecution().executedPlan().toString()
