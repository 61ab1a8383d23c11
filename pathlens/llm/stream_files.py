"""Token ids in Arrow files of equal-length sequences and masks.

Each Spark partition writes one file in Arrow's IPC file format, whose record batches hold
`input_ids`, a fixed-size list, and `mask`, one bit a token. Sequences are packed without
gaps, only a file's last one is padded. So sequence i of a file is a view into the mapped
file, without a copy. Beside it stands an index file: id, start and length of each document.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint_dir, distinct_ids
from .tokens import encoder
from .words import slices

#: Ids of a sequence, and sequences of a record batch.
LENGTH, BATCH = 2048, 128


class SequenceWriter:
    """Packs ids into sequences and writes them in batches."""

    def __init__(self, filesystem, path: str, kind: pa.DataType, length: int):
        self.length, self.kind, self.left, self.count = length, kind, np.zeros(0, kind.to_pandas_dtype()), 0
        self.schema = pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = filesystem.open_output_stream(path)
        self.file = ipc.new_file(self.sink, self.schema)

    def write(self, ids: np.ndarray) -> None:
        self.count += len(ids)
        self.left = np.concatenate([self.left, ids.astype(self.left.dtype)])
        size = self.length * BATCH
        for at in range(0, len(self.left) - size + 1, size):
            self._batch(self.left[at : at + size], size)
        self.left = self.left[len(self.left) // size * size :]

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        if real := len(self.left):
            self._batch(np.pad(self.left, (0, -real % self.length)), real)
        self.file.close()
        self.sink.close()


class SequenceReader:
    """Random access to the sequences of one file; local files are mapped, so that nothing is copied."""

    def __init__(self, uri: str):
        filesystem, path = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(filesystem, fs.LocalFileSystem) else filesystem.open_input_file(path)
        self.file = ipc.open_file(self.source)
        self.length = self.file.schema.field("input_ids").type.list_size

    def __enter__(self) -> SequenceReader:
        return self

    def __exit__(self, *_) -> None:
        self.source.close()

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        batch = self.file.get_batch(i // BATCH)
        row = i % BATCH
        ids = batch.column(0).values.slice(row * self.length, self.length)
        return ids.to_numpy(), batch.column(1).values.slice(row * self.length, self.length)

    def ids(self):
        """All ids in order, batch after batch, without the padding."""
        for i in range(self.file.num_record_batches):
            batch = self.file.get_batch(i)
            ids = batch.column(0).values.to_numpy()
            yield ids[: batch.column(1).values.true_count]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, id_column: str = "doc_id", text_column: str = "text", *, end_id: int = 2, length: int = LENGTH) -> list[dict]:
    """Write the ids of all texts in ascending id order; one entry for each file, in that order.

    Every document ends with `end_id`; null and empty texts consist of it alone. Null ids
    come first; rows that share an id, or have none, are in order of a hash of their text, and
    may be dealt to several files. Other columns are ignored; an
    empty table writes no file. A file's name holds the attempt that wrote it, and only files
    of successful attempts are named in the result, so a lost executor leaves nothing wrong.
    """

    def run(batches):
        task = TaskContext.get()
        name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}"
        own = encoder(tokenizer, False)
        kind = pa.uint16() if own.tokenizer.get_vocab_size() <= 1 << 16 else pa.uint32()
        filesystem, path = fs.FileSystem.from_uri(name)
        writer = index = sink = None
        documents = 0
        for batch in slices(batches, "text"):
            if writer is None:
                filesystem.create_dir(folder_path(folder), recursive=True)
                writer = SequenceWriter(filesystem, f"{path}.arrow", kind, length)
                sink = filesystem.open_output_stream(f"{path}-index.arrow")
                index = ipc.new_file(sink, index_schema(batch))
            ids, rows = own.encode(batch.column(1))
            ends = rows[1:] + np.arange(1, len(rows))
            out = np.full(len(ids) + batch.num_rows, end_id, np.uint32)
            inside = np.ones(len(out), bool)
            inside[ends - 1] = False
            out[inside] = ids
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(writer.count + np.append(0, ends[:-1])), pa.array(np.diff(ends, prepend=0))], schema=index_schema(batch)))
            writer.write(out)
            documents += batch.num_rows
        own.forget()
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()]), pa.array([f"{name}.arrow"]), pa.array([f"{name}-index.arrow"]), pa.array([documents]), pa.array([writer.count])], ["part", "file", "index", "documents", "tokens"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = distinct_ids(rows, "doc_id", "text", "row").repartitionByRange("row").sortWithinPartitions("row").select("doc_id", "text")
    files = rows.mapInArrow(run, "part long, file string, index string, documents long, tokens long").collect()
    return [row.asDict() for row in sorted(files, key=lambda row: row.part)]


def folder_path(folder: str) -> str:
    return fs.FileSystem.from_uri(folder)[1]


def index_schema(batch: pa.RecordBatch) -> pa.Schema:
    return pa.schema([("doc_id", batch.column(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])


def read_tokens(spark, files: list[dict], id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, read from the files.

    `start` counts the ids of all documents before; `ids_crc32` is the unsigned CRC-32 of the
    document's ids as little-endian unsigned 32-bit integers. One task reads one file, a batch
    of sequences at a time.
    """
    schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
    before = np.cumsum([0, *(f["tokens"] for f in files)]).tolist()

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from read_file(files[i], before[i])

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, schema)


def read_file(file: dict, before: int):
    with SequenceReader(file["file"]) as reader:
        chunks, have, done = reader.ids(), np.zeros(0, np.uint32), 0
        filesystem, path = fs.FileSystem.from_uri(file["index"])
        with filesystem.open_input_file(path) as source:
            index = ipc.open_file(source)
            for i in range(index.num_record_batches):
                rows = index.get_batch(i)
                sums = []
                for start, n in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                    have, done = have[start - done :], start
                    parts, size = [have], len(have)
                    while size < n:
                        parts.append(next(chunks).astype("<u4"))
                        size += len(parts[-1])
                    have = np.concatenate(parts) if len(parts) > 1 else have
                    sums.append(zlib.crc32(have[:n].astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(rows.column(1).to_numpy() + before), rows.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_report(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", *, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Write all documents' ids below the shared checkpoint folder and read them back: see `write_tokens`, `read_tokens`."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    files = write_tokens(docs, tokenizer, folder, id_column, text_column, end_id=end_id, length=length)
    return read_tokens(spark, files, docs.schema[id_column].dataType.simpleString())
