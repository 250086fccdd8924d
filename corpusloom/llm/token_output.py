"""Token ids as Arrow files of fixed-length sequences.

Documents are dealt out by ranges of their id, so that the files one after another hold the corpus in id order. Each
task encodes its documents, appends the end id to each, and cuts the stream into sequences of one length; the last one
of a file is padded, and a mask tells padding from tokens. A sequence file is an Arrow IPC file whose record batches
have a fixed-size list of ids and one of mask bits, so sequence k of a mapped file is a view of its buffer. A second
file gives each document's place in the stream. Files are named by task attempt, and only the names that a finished
task returns are used, so lost or repeated tasks leave nothing wrong behind.

Null texts count as empty and give the end id alone. Rows whose id is null come first; rows that share an id stand in
the order of their text's hash. Extra columns are ignored. An empty table gives no files and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_uri, column, documents, fresh_path, slices
from ._pretokens import encoder, tokenizer_path

MANIFEST = "part int, tokens_path string, index_path string, n_docs long, n_tokens long"
END_ID = 2


class SequenceWriter:
    """Writes a stream of ids to an IPC file as sequences of one length."""

    def __init__(self, sink, length: int, dtype: np.dtype, rows: int = 256):
        self.length, self.dtype, self.rows = length, dtype, rows
        ids = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.ids = ids
        self.schema = pa.schema([("input_ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out, self.parts, self.held, self.n = pa.ipc.new_file(sink, self.schema), [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        if self.held >= self.length * self.rows:
            whole = np.concatenate(self.parts)
            end = self.held // (self.length * self.rows) * self.length * self.rows
            for at in range(0, end, self.length * self.rows):
                self._batch(whole[at : at + self.length * self.rows], self.length * self.rows)
            self.parts, self.held = [whole[end:]], self.held - end

    def _batch(self, ids: np.ndarray, full: int) -> None:
        mask = np.arange(full) < len(ids)
        ids = np.concatenate([ids, np.zeros(full - len(ids), self.dtype)])
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), self.length) for x, t in ((ids, self.ids), (mask, pa.bool_()))]
        self.out.write_batch(pa.record_batch(arrays, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._batch(np.concatenate(self.parts), -(-self.held // self.length) * self.length)
        self.out.close()


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, length: int = 1024, end_id: int = END_ID) -> DataFrame:
    """Encodes and writes all documents; returns a row for each pair of files, in the order of the stream.

    folder is any that Spark can name: without a scheme it is in Spark's default store, and it is shared by all executors.
    """
    folder = arrow_uri(docs.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, enc = TaskContext.get(), encoder(tokenizer)
        out = paths = None
        doc_ids, starts, counts = [], [], []
        for batch in slices(batches):
            if out is None:
                system, base = _file_system(folder)
                system.create_dir(base, recursive=True)
                paths = [f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.{kind}.arrow" for kind in ("ids", "index")]
                sink = system.open_output_stream(paths[0])
                out = SequenceWriter(sink, length, enc.dtype)
            for doc_id, ids in zip(column(batch, "doc_id").to_pylist(), enc.encode([x or "" for x in column(batch, "text").to_pylist()]), strict=True):
                starts.append(out.n)
                out.add(np.append(np.frombuffer(ids, enc.dtype), enc.dtype.type(end_id)))
                counts.append(out.n - starts[-1])
                doc_ids.append(doc_id)
        if out is None:
            return
        out.close()
        sink.close()
        table = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        with system.open_output_stream(paths[1]) as sink, pa.ipc.new_file(sink, table.schema) as index:
            index.write_table(table)
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([paths[0]]), pa.array([paths[1]]), pa.array([len(counts)], pa.int64()), pa.array([out.n], pa.int64())], names=["part", "tokens_path", "index_path", "n_docs", "n_tokens"])

    tie = F.xxhash64("text")
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    # one small row for each file; the driver needs the list to place the files in the stream
    rows = sorted(dealt.mapInArrow(write, MANIFEST).collect(), key=lambda r: r.part)
    return docs.sparkSession.createDataFrame(rows, MANIFEST)


def read_sequences(manifest: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """Reads the files back: doc_id, start in the whole stream, n_tokens, and the ids (or their crc32 as ids_crc32)."""
    folder, base, rows = arrow_uri(manifest.sparkSession, folder), 0, []
    for r in sorted(manifest.collect(), key=lambda r: r.part):
        rows.append((r.tokens_path, r.index_path, base))
        base += r.n_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, index, base in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                system, _ = _file_system(folder)
                with system.open_input_file(index) as source:
                    at = pa.ipc.open_file(source).read_all().combine_chunks()
                starts, counts = at["start"].to_numpy(), at["n_tokens"].to_numpy()
                with SequenceReader(system, tokens) as seqs:
                    for i in range(0, at.num_rows, 128):
                        s, c = starts[i : i + 128], counts[i : i + 128]
                        ids = (seqs.stream(int(a), int(a + b)).astype("<u4") for a, b in zip(s, c, strict=True))
                        last = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if digest else pa.array([x.tobytes() for x in ids], pa.binary())
                        yield pa.RecordBatch.from_arrays([at["doc_id"].chunk(0)[i : i + 128], pa.array(s + base), pa.array(c), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    files = manifest.sparkSession.createDataFrame(rows, "tokens_path string, index_path string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


class SequenceReader:
    """Random access to the sequences of one file; local files are mapped, so that a sequence is a view."""

    def __init__(self, system, path: str):
        from pyarrow import fs

        self.source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("input_ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.at, self.batch = -1, None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.source.close()

    def _flat(self, k: int, name: str = "input_ids") -> np.ndarray:
        if k != self.at:
            self.at, self.batch = k, self.file.get_batch(k)
        return self.batch.column(name).flatten().to_numpy(zero_copy_only=name == "input_ids")

    def sequence(self, k: int) -> np.ndarray:
        at = k % self.rows * self.length
        return self._flat(k // self.rows)[at : at + self.length]

    def mask(self, k: int) -> np.ndarray:
        at = k % self.rows * self.length
        return self._flat(k // self.rows, "mask")[at : at + self.length]

    def stream(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file's stream."""
        size, parts = self.rows * self.length, []
        for k in range(start // size, -(-end // size)):
            parts.append(self._flat(k)[max(0, start - k * size) : end - k * size])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "sequences")
    manifest = write_sequences(documents(spark, sf_dir), folder, tokenizer_path("byte_bpe_50k.json"))
    return read_sequences(manifest, folder, digest=True)
