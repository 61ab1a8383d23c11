"""Suffix-array dedup: byte strings of a given length that occur earlier are removed.

Winnowing with fingerprint grouping, not prefix doubling over (rank, position) pairs: names
of 32 bytes are formed by doubling inside a task, longer ones are hashes of the whole string.
Only selected positions ("anchors", the least name of 32 bytes in each window of 100) are
grouped; every window has one, and equal windows have it at the same place. Spark groups
the anchors by longer and longer contexts: what is unique is dropped, the rest is split,
until whole blocks or single windows of 100 bytes are decided. `doubled_repeats` is plain
prefix doubling of every position, for which the README has figures.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bitmap, cut, discard, distinct_ids, in_bitmap, keep, release, slot
from .words import STEP, U, buffers, mix, slices, span_names

THRESHOLD, SEED = 100, 32
#: Windows that one rank decides together, from block to single window.
WIDTHS = (9, 1)


def doubled_names(data: np.ndarray, length: int) -> np.ndarray:
    """Names of all strings of `length` bytes (a power of two), by doubling the offset."""
    names, offset = mix(data.astype(U) + U(1)), 1
    while offset < length:
        second = names[offset:] * U(0xC2B2AE3D27D4EB4F)
        second ^= second >> U(29)
        names = names[:-offset] * U(0x9FB21C651E98DF25) + second
        offset *= 2
    return mix(names)


def anchors(data: np.ndarray, rows: np.ndarray, threshold: int, seed: int):
    """Blocks of windows with one anchor: row, start in the row, anchor's distance, windows, seed's name, block's name."""
    for begin in range(0, max(0, len(data) - threshold + 1), STEP):
        part = data[begin : begin + STEP + threshold - 1]
        names = doubled_names(part, seed)
        least = (names & U(0xFFFFFFFFFF000000)) | np.arange(len(names), dtype=U)
        width, span = 1, threshold - seed + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: width - span], least[span - width :])
        whole = np.ones(len(least), bool)
        for end in rows[1:][(rows[1:] > begin)] - begin:
            if end - threshold + 1 >= len(whole):
                break
            whole[max(0, end - threshold + 1) : end] = False
        start = np.flatnonzero(whole)
        if not len(start):
            continue
        anchor = (least[start] & U(0xFFFFFF)).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(start) > 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(start)))
        left, at = start[first], anchor[first]
        row = np.searchsorted(rows, left + begin, "right") - 1
        yield row, left + begin - rows[row], at - left, count, names[at], span_names(part, left, left + count - 1 + threshold)


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(did, text, own): the text's bytes with a number that no two rows share (null ids come first), and all columns but
    the text in a struct, where no name clashes."""
    others = [c for c in docs.columns if c != text_column]
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.struct(*others).alias("own"))
    rows = distinct_ids(plain, "id", "text", "did")
    return rows.select("did", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.col("text").isNull().alias("empty"), "own")


def _chosen(keyed: DataFrame, found, inside: bool, columns: list[str]) -> DataFrame:
    """The rows whose number is (or isn't) in the bitmap."""
    bits, mask = found

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bits.value, batch.column(batch.num_columns - 1).to_numpy()) == inside)).select(range(batch.num_columns - 1))

    rows = keyed.select(*columns)
    return rows.withColumn("slot", slot("did", mask)).mapInArrow(run, rows.schema)


def _blocks(keyed: DataFrame, threshold: int, seed: int, found=None) -> DataFrame:
    """(core, block, did, pos, shape) of all anchors whose seed is in the bitmap; core alone, of all anchors, without one."""

    def seeds(batches):
        for batch in slices(batches, "text"):
            data, rows = buffers(batch.column(1))
            for *_, name, _ in anchors(data, rows, threshold, seed):
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64))], ["core"])

    def full(batches):
        bits, mask = found
        for batch in slices(batches, "text"):
            data, rows = buffers(batch.column(1))
            did = batch.column(0).to_numpy()
            for row, start, back, count, name, block in anchors(data, rows, threshold, seed):
                name = name.view(np.int64)
                use = in_bitmap(bits.value, name & mask)
                row, start, back, count = row[use], start[use], back[use], count[use]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[use]), pa.array(block[use].view(np.int64)), pa.array(did[row]), pa.array(start), pa.array((back * 128 + count).astype(np.int32))],
                    ["core", "block", "did", "pos", "shape"],
                )

    rows = keyed.select("did", "text")
    return rows.mapInArrow(seeds, "core long") if found is None else rows.mapInArrow(full, "core long, block long, did long, pos long, shape int")


def _ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rank positions by (core, block): what repeats an earlier block, and blocks that others share in part.

    Ranks are written before they are joined back, so that both sides of the joins are dealt
    out for them alone and Spark can split the many rows of a passage that is everywhere.
    The rows' own table goes when both results are written.
    """
    classes = keep(rows.groupBy("core", "block").agg(F.min(F.struct("did", "pos")).alias("first")))
    several = cut(classes.groupBy("core").count().filter("count > 1").select("core"))
    marked = rows.join(classes, ["core", "block"]).withColumn("earliest", F.struct("did", "pos") == F.col("first"))
    windows = F.col("shape").bitwiseAND(127)
    repeats = marked.filter("not earliest").select("did", "pos", windows.alias("windows"))
    requests = marked.filter("earliest").join(several, "core", "left_semi").select("did", "pos", "shape")
    repeats, requests = keep(repeats), keep(requests)
    discard(rows, classes)
    return repeats, requests


def _by_document(rows: DataFrame, *what) -> DataFrame:
    return rows.select("did", F.struct(F.col("pos").alias("at"), *what).alias("span")).distinct().groupBy("did").agg(F.collect_list("span").alias("spans"))


def _split(keyed: DataFrame, requests: DataFrame, width: int, threshold: int, seed: int) -> DataFrame:
    """Cut blocks by the distance to their anchor into runs of `width` windows, with new cores and block names."""
    most = threshold - seed

    def run(batches):
        for batch in slices(batches, "text", STEP):
            data, rows = buffers(batch.column(1))
            did, spans = batch.column(0).to_numpy(), batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
            left, shape = spans.flatten().field(0).to_numpy(), spans.flatten().field(1).to_numpy().astype(np.int64)
            back, count = shape >> 7, shape & 127
            low, high = (back - count + 1) // width, back // width
            times = high - low + 1
            row, left, back, count, low = (np.repeat(x, times) for x in (row, left, back, count, low))
            part = low + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            far, near = np.minimum(back, part * width + width - 1), np.maximum(back - count + 1, part * width)
            anchor = rows[row] + left + back
            core = mix(span_names(data, anchor - part * width, anchor - np.minimum(part * width + width - 1, most) + threshold) + part.astype(U))
            block = mix(span_names(data, anchor - far, anchor - near + threshold) + (far * 128 + near).astype(U))
            start = left + back - far
            yield pa.RecordBatch.from_arrays(
                [pa.array(core.view(np.int64)), pa.array(block.view(np.int64)), pa.array(did[row]), pa.array(start), pa.array((far * 128 + far - near + 1).astype(np.int32))],
                ["core", "block", "did", "pos", "shape"],
            )

    texts = _chosen(keyed, bitmap(requests, "did"), True, ["did", "text"])
    asked = _by_document(requests, "shape")
    return texts.join(asked, "did").select("did", "text", "spans").mapInArrow(run, "core long, block long, did long, pos long, shape int")


def thinned_repeats(keyed: DataFrame, threshold: int, seed: int) -> DataFrame:
    """(did, pos, windows): runs of strings of `threshold` bytes that also start earlier."""
    shared = cut(_blocks(keyed, threshold, seed).groupBy("core").count().filter("count > 1").select("core"))
    found = bitmap(shared, "core", spread=False)
    rows = keep(_blocks(keyed, threshold, seed, found).join(shared, "core", "left_semi"))
    repeats, requests = _ranked(rows)
    for width in WIDTHS:
        parts = keep(_split(keyed, requests, width, threshold, seed))
        discard(requests)
        release(keyed.sparkSession)
        more, requests = _ranked(parts)
        repeats = repeats.union(more)
    discard(requests)
    release(keyed.sparkSession)
    return repeats


def _named(keyed: DataFrame, length: int, found=None) -> DataFrame:
    """(did, pos, rank) of all strings of `length` bytes whose name is in the bitmap; rank alone, of all strings, without one."""

    def run(batches):
        for batch in slices(batches, "text"):
            data, rows = buffers(batch.column(1))
            did = batch.column(0).to_numpy()
            for begin in range(0, len(data) - length + 1, STEP):
                rank = doubled_names(data[begin : begin + STEP + length - 1], length).view(np.int64)
                at = np.arange(begin, begin + len(rank))
                row = np.searchsorted(rows, at, "right") - 1
                use = at + length <= rows[row + 1]
                if found is not None:
                    bits, mask = found
                    use &= in_bitmap(bits.value, rank & mask)
                    at, row = at[use], row[use]
                    yield pa.RecordBatch.from_arrays([pa.array(did[row]), pa.array(at - rows[row]), pa.array(rank[use])], ["did", "pos", "rank"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(rank[use])], ["rank"])

    return keyed.select("did", "text").mapInArrow(run, "rank long" if found is None else "did long, pos long, rank long")


def doubled_repeats(keyed: DataFrame, threshold: int, seed: int = SEED) -> DataFrame:
    """The same by prefix doubling of every position, in Spark.

    The first ranks are names of `seed` bytes (a power of two), doubled inside a task; of
    them only those that occur more than once leave it. Each round joins a position's rank
    with the one at the offset, sorts the pairs, and gives those that occur more than once
    their place as the new rank; others go. The last offset is what lacks to the threshold.
    A round's tables are removed when the next is written.
    """
    length = 1 << min(threshold, seed).bit_length() - 1
    shared = cut(_named(keyed, length).groupBy("rank").count().filter("count > 1").select("rank"))
    release(keyed.sparkSession)
    named = _named(keyed, length, bitmap(shared, "rank", spread=False))
    ranked = keep(named.join(shared, "rank", "left_semi").select("did", "pos", "rank"))
    first = F.min(F.struct("did", "pos")).alias("earliest")
    if length == threshold:
        groups = keep(ranked.groupBy("rank").agg(first))
        done = keep(ranked.join(groups, "rank"))
        discard(ranked, groups)
        ranked = done
    while length < threshold:
        offset = min(length, threshold - length)
        second = ranked.select("did", (F.col("pos") - offset).alias("pos"), F.col("rank").alias("then"))
        pairs = keep(ranked.select("did", "pos", "rank").join(second, ["did", "pos"]))
        discard(ranked)
        groups = pairs.groupBy("rank", "then").agg(F.count("*").alias("n"), first).filter("n > 1")
        groups = keep(groups.orderBy("rank", "then").withColumn("place", F.monotonically_increasing_id()))
        ranked = keep(pairs.join(groups, ["rank", "then"]).select("did", "pos", F.col("place").alias("rank"), "earliest"))
        discard(pairs, groups)
        release(keyed.sparkSession)
        length += offset
    repeats = keep(ranked.filter(F.struct("did", "pos") != F.col("earliest")).select("did", "pos", F.lit(1).alias("windows")))
    discard(ranked)
    return repeats


def _with_repeats(docs: DataFrame, id_column: str, text_column: str, threshold: int, seed: int, every: bool, finish, columns: list[str], schema) -> DataFrame:
    """What `finish` makes of record batches (columns, text, spans) of all rows: `spans` (start, windows) of what repeats an
    earlier string, null where nothing does. Texts without repeats aren't shuffled and pass one Python worker only."""
    keyed = _keyed(docs, id_column, text_column)
    repeats = doubled_repeats(keyed, threshold, seed) if every else thinned_repeats(keyed, threshold, seed)
    bits, mask = found = bitmap(repeats, "did")
    spans = _by_document(repeats, "windows")

    def touched(batches):
        for batch in slices(batches, "text"):
            yield finish(batch)

    def clean(batches):
        kept = (batch.filter(pa.array(~in_bitmap(bits.value, batch.column(len(columns) + 1).to_numpy()))) for batch in batches)
        for batch in slices(kept, "text"):
            yield finish(pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.nulls(batch.num_rows)], [*columns, "text", "spans"]))

    out = [F.col(c) for c in columns]
    with_runs = _chosen(keyed, found, True, ["own", "empty", "text", "did"]).join(spans, "did", "left").select(*out, "text", "spans")
    without = keyed.select(*out, "text", slot("did", mask).alias("slot"))
    return with_runs.mapInArrow(touched, schema).union(without.mapInArrow(clean, schema))


def _cut_out(batch: pa.RecordBatch, threshold: int):
    """For each row of (..., text, spans): the text, and the runs of bytes to remove as start and end."""
    texts, spans = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)
    for text, found in zip(texts, spans, strict=True):
        if not found.is_valid or not len(found):
            yield text, np.zeros((0, 2), np.int64)
            continue
        start, windows = (found.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate((start + windows - 1 + threshold)[order])
        new = np.ones(len(start), bool)
        new[1:] = start[1:] > end[:-1]
        last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
        yield text, np.stack([start[new], end[last]], 1)


def _kept(text: bytes, runs: np.ndarray) -> bytes:
    edges = [0, *runs.reshape(-1).tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def repeat_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, threshold: int = THRESHOLD, seed: int = SEED, every: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of `docs`.

    A byte goes when a string of `threshold` bytes covers it that also starts earlier in the
    input (smaller id, or the same document and an earlier start); strings may overlap.
    Null texts are empty; texts shorter than the threshold lose nothing. A null id is the
    smallest. Rows that share an id, or have none, are documents of their own, in the order of
    a hash of their text; of equal ones the first keeps it. Other columns are ignored; no rows
    give none. `every` doubles prefixes of every position (see `doubled_repeats`).
    """

    def finish(batch):
        out = [(len(text), runs, hashlib.sha256(_kept(text, runs)).hexdigest()) for text, runs in _cut_out(batch, threshold)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([int((x[1][:, 1] - x[1][:, 0]).sum()) for x in out], pa.int64()), pa.array([len(x[1]) for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    plain = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _with_repeats(plain, "doc_id", "text", threshold, seed, every, finish, ["own.doc_id"], schema)


def _widened(text: bytes, runs: np.ndarray) -> np.ndarray:
    """Runs whose ends stand between characters: a character that loses a byte goes as a whole."""
    out = runs.copy()
    for run in out:
        while run[0] > 0 and text[run[0]] & 0xC0 == 0x80:
            run[0] -= 1
        while run[1] < len(text) and text[run[1]] & 0xC0 == 0x80:
            run[1] += 1
    return out


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = None, *, threshold: int = THRESHOLD, seed: int = SEED, every: bool = False) -> DataFrame:
    """docs with the repeated strings cut out of their texts, all columns kept.

    As `repeat_report`; characters that lose a byte go as a whole. Null texts stay null.
    `length_column`, if given, gets the new number of characters. Documents that had text
    and lose all of it go.
    """

    def finish(batch):
        texts = [_kept(text, _widened(text, runs)).decode("utf-8", "ignore") for text, runs in _cut_out(batch, threshold)]
        had = pa.array([len(text) for text in batch.column(2).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), had, pa.array(texts, pa.string())], ["own", "empty", "had", "left"])

    others = T.StructType([docs.schema[c] for c in docs.columns if c != text_column])
    schema = T.StructType().add("own", others, False).add("empty", "boolean", False).add("had", "long").add("left", "string")
    out = _with_repeats(docs, id_column, text_column, threshold, seed, every, finish, ["own", "empty"], schema).filter((F.length("left") > 0) | (F.col("had") == 0))
    values = {c: F.col(f"own.`{c}`") for c in docs.columns if c != text_column} | {text_column: F.when(~F.col("empty"), F.col("left"))}
    if length_column:
        values[length_column] = F.length(values[text_column]).cast(docs.schema[length_column].dataType)
    return out.select(*(values[c].alias(c) for c in docs.columns))
