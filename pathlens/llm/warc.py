"""WARC archives, compressed record by record with a dictionary of their own.

An archive begins with a skippable Zstandard frame that holds a dictionary, built from the
archive's first records; then every record is a frame of its own, so that one record can be
read by its offset alone. Pages whose payload occurred before are revisit records, which
name the record that holds it and carry no payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint_dir, cut, distinct_ids, keep
from .stream_files import folder_path
from .words import slices

#: Magic number of the skippable frame that holds a dictionary, a fixed value of the format.
DICTIONARY_FRAME = 0x184D2A5D
#: Bytes of a dictionary, of the records that it is built from (an archive's first ones), and how many of them there must be.
DICTIONARY, SAMPLE, LEAST_RECORDS = 1 << 16, 2 << 20, 16
#: An archive of more bytes is closed, and the task goes on with another.
ARCHIVE = 1 << 28
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters that a header's address must not hold as they are: blanks, controls, angle brackets.
UNSAFE = re.compile(r"[\x00-\x20<>\x7F-￿\U00010000-\U0010FFFF]")
INDEX = "row long, archive string, offset long, length long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    """Names of records: the page's id, empty for none, and the row's number, which no other has."""
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def page_of(name: str) -> int | None:
    page = name.split(":")[2]
    return int(page) if page else None


def record(page_id: int | None, row: int, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit of the record `refers_to` without it."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = record_id(page_id, row)
    address = UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url) if url else name[1:-1]
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Target-URI: {address}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
        payload = b""
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return b"".join([("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode(), http, payload, b"\r\n\r\n"])


class ArchiveWriter:
    """One archive: records wait until there are enough of them for a dictionary, then each is written as a frame."""

    def __init__(self, filesystem, path: str):
        self.sink = filesystem.open_output_stream(path, compression=None)  # else the name would have the stream compressed once more
        self.size, self.waiting, self.waiting_bytes, self.compressor = 0, [], 0, None

    def write(self, row: int, data: bytes) -> list[tuple[int, int, int]]:
        """(row, offset, length) of each record that was written now."""
        if self.compressor is not None:
            return [self._frame(row, data)]
        self.waiting.append((row, data))
        self.waiting_bytes += len(data)
        return self._begin() if self.waiting_bytes >= SAMPLE else []

    def _frame(self, row: int, data: bytes) -> tuple[int, int, int]:
        frame = self.compressor.compress(data)
        self.sink.write(frame)
        at, self.size = self.size, self.size + len(frame)
        return row, at, len(frame)

    def _begin(self) -> list[tuple[int, int, int]]:
        built = dictionary([data for _, data in self.waiting])
        if built is None:
            self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        else:
            self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=built)
            content = built.as_bytes()
            self.sink.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
            self.size = 8 + len(content)
        waiting, self.waiting = self.waiting, []
        return [self._frame(row, data) for row, data in waiting]

    def close(self) -> list[tuple[int, int, int]]:
        rest = self._begin() if self.compressor is None else []
        self.sink.close()
        return rest


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary built from records; none where they are too few or too much alike to build one, which the format allows."""
    if len(records) < LEAST_RECORDS:
        return None
    size = min(DICTIONARY, max(1024, sum(map(len, records)) // 16))
    try:
        return zstandard.train_dictionary(size, records, k=1024, d=8)
    except zstandard.ZstdError:
        return None


def opened(filesystem, path: str) -> tuple[io.RawIOBase, zstandard.ZstdDecompressor]:
    """An archive, placed behind its dictionary, and what decompresses its frames."""
    source = filesystem.open_input_file(path)
    head = source.read(8)
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_FRAME:
        return source, zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(struct.unpack("<II", head)[1])))
    source.seek(0)
    return source, zstandard.ZstdDecompressor()


def fields(stream) -> dict[str, str]:
    """Header lines up to the empty one; names in lower case."""
    out = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.partition(b":")
        out[name.decode().lower()] = value.strip().decode()
    return out


def records(stream) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(headers, the message's headers, payload) of each record of a decompressed stream; one record is in memory at a time."""
    while first := stream.readline():
        if not first.startswith(b"WARC/1."):
            raise ValueError(f"a record begins with {first[:20]!r}")
        head = fields(stream)
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {head.get('warc-record-id')} doesn't end where it should")
        message = io.BytesIO(block)
        message.readline()
        yield head, fields(message), message.read()


def read_record(archive: str, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """One record of an archive, by the offset and length that the index has."""
    filesystem, path = fs.FileSystem.from_uri(archive)
    source, decompressor = opened(filesystem, path)
    with source:
        source.seek(offset)
        return next(records(io.BytesIO(decompressor.decompress(source.read(length)))))


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", *, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page and return the index: (row, archive, offset, length) for each record.

    Of pages with equal payloads (compared by SHA-256) of at least `least_bytes` bytes, the one
    with the smallest id is a response and the others revisit it. Null html is the empty
    payload, a null address is replaced by the record's name. Rows that share an id stay rows
    of their own, and the first of them by a hash of the payload and their place counts as
    smaller; null ids come last. Other columns are ignored; an empty table writes no archive.

    Only digests are grouped, and only the rows of revisits meet the pages again, so payloads
    aren't shuffled unless there are many revisits. Each task writes archives of its own, whose
    names hold the attempt: only archives of successful attempts are in the index.
    """
    html = F.coalesce(F.col(html_column), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), html.alias("payload"))
    rows = distinct_ids(rows, "page_id", "payload", "row", nulls_first=False)
    keyed = rows.filter(F.octet_length("payload") >= least_bytes).select("row", "page_id", F.unhex(F.sha2("payload", 256)).alias("key"))
    groups = keyed.groupBy("key").agg(F.min(F.struct("row", "page_id")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first")
    first = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first.page_id").cast("string"), F.lit("")), F.lit(":"), F.col("first.row"), F.lit(">"))
    revisits = cut(keyed.join(groups, "key").filter(F.col("row") != F.col("first.row")).select("row", first.alias("refers_to")))

    def run(batches):
        task = TaskContext.get()
        filesystem, path = fs.FileSystem.from_uri(folder)
        writer, written = None, 0

        def found(places):
            if places:
                row, offset, length = (pa.array(x, pa.int64()) for x in zip(*places, strict=True))
                yield pa.RecordBatch.from_arrays([row, pa.array([f"{folder}/{name}"] * len(places)), offset, length], ["row", "archive", "offset", "length"])

        for batch in slices(batches, "payload"):
            places = []
            for row, page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("row", "page_id", "url", "payload", "refers_to")), strict=True):
                if writer is None:
                    filesystem.create_dir(folder_path(folder), recursive=True)
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{written}.warc.zst"
                    writer, written = ArchiveWriter(filesystem, f"{path}/{name}"), written + 1
                places += writer.write(row, record(page_id, row, url, payload, refers_to, date))
                if writer.size >= ARCHIVE:
                    yield from found(places + writer.close())
                    writer, places = None, []
            yield from found(places)
        if writer is not None:
            yield from found(writer.close())

    return keep(rows.join(revisits, "row", "left").sortWithinPartitions("row").mapInArrow(run, INDEX))


def read_archives(spark, archives: list[str]) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, row) of all records, read from the archives.

    One task streams through one archive. A response's digest is computed from the payload
    that was read and must equal the one in its header; a revisit has its own from its
    headers.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, row long"
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "row"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)], names)

    def run(batches):
        for numbers in batches:
            for i in numbers.column(0).to_pylist():
                found = []
                filesystem, path = fs.FileSystem.from_uri(archives[i])
                source, decompressor = opened(filesystem, path)
                with source, decompressor.stream_reader(source, read_across_frames=True) as plain:
                    for head, message, payload in records(io.BufferedReader(plain, 1 << 16)):
                        digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                        size = len(payload) if kind == "response" else int(message["content-length"])
                        if kind == "response" and digest != payload_digest(payload):
                            raise ValueError(f"the payload of {head['warc-record-id']} isn't the one that was written")
                        own, first = head["warc-record-id"].strip("<>"), head.get("warc-refers-to")
                        found.append((page_of(own), size, digest, kind, page_of(first.strip("<>")) if first else None, int(own.split(":")[3])))
                        if len(found) >= 4096:
                            yield batch(found)
                            found = []
                if found:
                    yield batch(found)

    return spark.range(0, len(archives), 1, max(1, len(archives))).mapInArrow(run, schema)


def archive_report(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", *, least_bytes: int = 0) -> DataFrame:
    """Write all pages below the shared checkpoint folder and read the archives back: see `write_archives`, `read_archives`."""
    spark = pages.sparkSession
    index = write_archives(pages, f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}", id_column, url_column, html_column, least_bytes=least_bytes)
    archives = sorted(row.archive for row in index.select("archive").distinct().collect())
    return read_archives(spark, archives)
