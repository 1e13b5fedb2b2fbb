"""Token-id output in Arrow IPC files that give equal-length sequences in place.

Each file holds record batches with two fixed-size-list columns: ``ids`` (one
row is one sequence of ``seq_len`` ids) and ``mask`` (true for real tokens; only
a file's last sequence can have false). A memory-mapped reader reaches sequence
``k`` of a file by arithmetic alone: batches are of equal size, and a list
column's values are one flat buffer. Ids take 16 bits where the vocabulary and
the end id allow it, else 32. Beside each file, ``*.docs.arrow`` lists its documents: doc_id,
where its ids start in the file, and how many there are.

Documents are range-partitioned by doc_id, so files in order of their first
document hold all ids in ascending doc_id order. Each task writes files under
names of its own attempt and reports them; only files reported by a task that
succeeded are in the manifest, so lost executors and repeated tasks do no harm. What attempts
that failed have left is deleted when the manifest is complete.

Defined cases: null and empty texts give the end id alone; rows with a null
doc_id come first; rows with equal doc_id are ordered by text; repeated rows
are written each; an empty table gives no file and an empty result; other
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.bpe import encoded, encoder
from tarn.llm.common import crc32_ids, texts
from tarn.session import shared_path

#: Sequences in one record batch.
BATCH = 256
MANIFEST = "file string, first_doc long, docs long, tokens long"


def _schema(seq_len: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class SequenceWriter:
    """Writes a run of ids as sequences; ids come in any portions."""

    def __init__(self, files: fs.FileSystem, path: str, seq_len: int, wide: bool):
        self.files, self.path, self.seq_len, self.schema = files, path, seq_len, _schema(seq_len, wide)
        self.kind = np.uint32 if wide else np.uint16
        self.sink = files.open_output_stream(path + ".ids.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = 0
        self.docs: list[tuple[int | None, int, int]] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.tokens, len(ids)))
        self.tokens += len(ids)
        self.parts.append(ids.astype(self.kind))
        self.held += len(ids)
        if self.held >= BATCH * self.seq_len:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        run = np.concatenate(self.parts) if self.parts else np.zeros(0, self.kind)
        step = BATCH * self.seq_len
        whole = len(run) // step * step
        for at in range(0, whole, step):
            self._batch(run[at : at + step], step)
        rest = run[whole:]
        if last and len(rest):
            full = -(-len(rest) // self.seq_len) * self.seq_len
            self._batch(np.concatenate([rest, np.zeros(full - len(rest), self.kind)]), len(rest))
            rest = rest[:0]
        self.parts, self.held = [rest], len(rest)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(cols, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()
        doc, start, n = zip(*self.docs)
        table = pa.table({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(n, pa.int64())})
        with self.files.open_output_stream(self.path + ".docs.arrow") as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)


class SequenceReader:
    """Sequences of one file by number, without copying where it can be mapped."""

    def __init__(self, uri: str):
        self.files, self.path = fs.FileSystem.from_uri(uri)
        if isinstance(self.files, fs.LocalFileSystem):
            self.source = pa.memory_map(self.path + ".ids.arrow")
        else:
            self.source = self.files.open_input_file(self.path + ".ids.arrow")
        self.reader = pa.ipc.open_file(self.source)
        self.seq_len = self.reader.schema.field("ids").type.list_size
        self._at, self._batch = -1, None

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return (n - 1) * BATCH + self.reader.get_batch(n - 1).num_rows if n else 0

    def _column(self, k: int, name: str) -> pa.FixedSizeListArray:
        if k != self._at:
            self._at, self._batch = k, self.reader.get_batch(k)
        return self._batch.column(name)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``k``; the ids are a view of the file."""
        b, i = divmod(k, BATCH)
        ids, mask = (self._column(b, x)[i].values for x in ("ids", "mask"))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """The ``n`` ids from ``start`` of the file's run."""
        step, out = BATCH * self.seq_len, []
        while n > 0:
            b, i = divmod(start, step)
            flat = self._column(b, "ids").flatten().to_numpy()[i : i + n]
            if not len(flat):
                raise ValueError("past the end of the file")
            out.append(flat)
            start, n = start + len(flat), n - len(flat)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint32)

    def docs(self) -> pa.Table:
        with self.files.open_input_file(self.path + ".docs.arrow") as f:
            return pa.ipc.open_file(f).read_all()


def _writer(uri: str, vocab: str, end_id: int, seq_len: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, first = None, f"{uri}/{uuid.uuid4().hex}", None
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(texts(batch, "text"), end_id, vocab)):
                if out is None:
                    files, path = fs.FileSystem.from_uri(name)
                    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out, first = SequenceWriter(files, path, seq_len, wide), doc_id
                out.add(doc_id, ids)
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([name]), pa.array([first], pa.int64()), pa.array([len(out.docs)], pa.int64()), pa.array([out.tokens], pa.int64())], names=["file", "first_doc", "docs", "tokens"])

    return run


def _clean(uri: str, written: set[str]) -> None:
    """Deletes the files below ``uri`` that are not of ``written``."""
    files, path = fs.FileSystem.from_uri(uri)
    for info in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.base_name.endswith(".arrow") and info.base_name.split(".", 1)[0] not in written:
            files.delete_file(info.path)


def write_token_files(docs: DataFrame, uri: str, vocab: str = "byte_bpe_50k.json", end_id: int = 0, seq_len: int = 2048) -> DataFrame:
    """Writes ``docs`` (doc_id, text) below ``uri``, a folder of its own; returns the manifest, a
    row for each file in order: file, first_doc, docs, tokens, start (the ids
    in all files before it). Only the manifest comes to the driver."""
    spark = docs.sparkSession
    wide = max(encoder(vocab).n_vocab, end_id + 1) > 1 << 16
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    done = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(_writer(uri, vocab, end_id, seq_len, wide), MANIFEST).collect()
    _clean(uri, {r["file"].rsplit("/", 1)[1] for r in done})
    done.sort(key=lambda r: (r["first_doc"] is not None, r["first_doc"] or 0))
    start, listed = 0, []
    for r in done:
        listed.append((*r, start))
        start += r["tokens"]
    return spark.createDataFrame(listed, MANIFEST + ", start long")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, before in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
            reader = SequenceReader(file)
            for part in reader.docs().to_batches(max_chunksize=20_000):
                start, n = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                crc = [crc32_ids(reader.ids(int(s), int(k)).astype("<u4").tobytes()) for s, k in zip(start, n)]
                yield pa.record_batch([part.column("doc_id"), pa.array(start + before), part.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    files = manifest.select("file", "start")
    spread = max(1, min(manifest.count(), 4096))
    return files.repartition(spread).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, shared_path(spark, "token-files")))
