"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import byte_table, encoder, ragged
from .words import slices


class Decoder:
    """Bytes of ids: a gather from one buffer that holds the bytes of all ids."""

    def __init__(self, path: str):
        pieces = byte_table(path)
        self.buffer = np.frombuffer(b"".join(pieces), np.uint8)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The decoded bytes, and the offset in them of each id: an id may hold part of a character."""
        lengths = self.lengths[ids]
        return self.buffer[ragged(self.starts[ids], lengths)].tobytes(), np.cumsum(lengths) - lengths


def character_offsets(text: bytes, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets as character offsets; inside a split character, that of the character."""
    begins = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(begins)])[np.minimum(offsets + 1, len(text))] - 1 if len(text) else offsets


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", offsets: bool = False) -> DataFrame:
    """(doc_id, ids array<int>[, offsets array<int>]): ids of the whole texts without special tokens.

    `offsets` are the characters at which the ids begin. Null and empty texts have no ids.
    One row for each row of docs, whatever its id; other columns are ignored.
    """

    def run(batches):
        decoder = Decoder(path)
        for batch in slices(batches, "text"):
            ids, rows = encoder(path, True).encode(batch.column(1))
            arrays = [batch.column(0), pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids.astype(np.int32)))]
            if offsets:
                parts = [decoder.decode(ids[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
                arrays.append(pa.array([character_offsets(*p) for p in parts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "offsets"][: len(arrays)])
        encoder(path, True).forget()

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", offsets array<int>" * offsets)


def decoded(rows: DataFrame, path: str, ids_column: str = "ids") -> DataFrame:
    """rows with `text`: the ids' bytes by the reversed byte table, joined before they are read as UTF-8, so that
    characters split between ids come out whole; what isn't UTF-8 becomes U+FFFD. Null ids give a null text."""
    others = [f"`{c}` {t}" for c, t in rows.dtypes]

    def run(batches):
        decoder = Decoder(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_column))
            texts = [decoder.decode(x.values.to_numpy(zero_copy_only=False))[0].decode("utf-8", "replace") if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return rows.mapInArrow(run, ", ".join([*others, "text string"]))


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each row of docs: its ids as little-endian unsigned
    32-bit integers, and the bytes that those ids decode to. As `encoded` for nulls, empty texts and other columns."""

    def run(batches):
        decoder = Decoder(path)
        for batch in slices(batches, "text"):
            ids, rows = encoder(path, True).encode(batch.column(1))
            ids = ids.astype("<u4")
            each = [ids[a:b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(rows), pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in each], pa.string()),
                    pa.array([hashlib.sha256(decoder.decode(x)[0]).hexdigest() for x in each], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        encoder(path, True).forget()

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
