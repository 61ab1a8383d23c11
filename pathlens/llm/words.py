"""Words, shingles and names of byte strings in UTF-8 text, computed on whole Arrow batches.

Texts stay the byte buffers that Arrow hands over; no Python string is made for a word. A name
is a 64-bit hash: eight bytes at a time go through multiplications and shifts that aren't
linear, so regular strings collide no more often than others, with odds of about 2**-64.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Steps of eight bytes that numpy takes over all spans at once; longer spans are named one by one.
EIGHTS = 32
MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)], U)
#: Bytes that one step of the numpy code looks at: its arrays fit a processor's cache. Larger texts are cut at separators.
STEP = 1 << 18
#: Bytes of text that are worked on together.
TOGETHER = 1 << 21
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators are the ASCII blanks: every other byte belongs to a word.
BLANK_WORDS = np.ones(256, bool)
BLANK_WORDS[[9, 10, 11, 12, 13, 32]] = False
#: Words of ASCII letters, digits and all bytes beyond ASCII.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[65:91] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True

def mix(x: np.ndarray) -> np.ndarray:
    """Finish a fingerprint so that all its bits depend on all of its input."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of spans of one byte buffer."""
    lengths = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    odd = U(0x9FB21C651E98DF25)
    out = mix(lengths.astype(U) * odd + U(1))
    whole = lengths >> 3
    left = np.flatnonzero((whole > 0) & (whole < EIGHTS))
    k = 0
    while len(left):
        out[left] = mix((out[left] ^ eight[starts[left] + 8 * k]) * odd)
        k += 1
        left = left[whole[left] > k]
    rest = lengths & 7
    short = np.flatnonzero((rest > 0) & (whole < EIGHTS))
    out[short] = mix((out[short] ^ (eight[starts[short] + 8 * whole[short]] & MASKS[rest[short]])) * odd)
    for i in np.flatnonzero(whole >= EIGHTS).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; nulls are empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text, or of one row."""
    for batch in batches:
        _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Hand unused memory back to the system at the end of a task: workers live on, beside an executor that needs it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def pieces(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Spans of about `step` bytes that end at a row's end or before a separator, so that no word is cut."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + step)
        if to < n:
            row = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if row > at:
                to = row
            else:
                while to < n and table[data[to]] and to not in (end := offsets[np.searchsorted(offsets, to)],):
                    blank = np.flatnonzero(~table[data[to : min(end, to + step)]])
                    to = to + int(blank[0]) if len(blank) else min(int(end), to + step)
        yield at, to
        at = to


class Words:
    """Words of a column: `starts`, `lengths`, `names`, and `offsets` of each row's words.

    A-Z is lower-cased unless `lower` is false; `table` says which bytes belong to words; there
    are no `names` unless `named`.
    Rows may be null or empty.
    """

    def __init__(self, column: pa.Array, table: np.ndarray = BLANK_WORDS, lower: bool = True, named: bool = True):
        raw, rows = buffers(column)
        self.data = LOWER[raw] if lower else raw
        self.rows = rows
        starts, lengths, names = [], [], []
        for at, to in pieces(self.data, rows, table):
            part = self.data[at:to]
            inside = np.zeros(len(part) + 2, bool)
            inside[1:-1] = table[part]
            cuts = rows[(rows > at) & (rows < to)] - at
            begin = inside[1:-1] & ~inside[:-2]
            begin[cuts[cuts < len(part)]] = inside[1:-1][cuts[cuts < len(part)]]
            end = inside[1:-1] & ~inside[2:]
            end[cuts - 1] |= inside[1:-1][cuts - 1]
            s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
            starts.append(s + at)
            lengths.append(e - s)
            if named:
                names.append(span_names(part, s, e))
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.names = np.concatenate(names) if names else np.zeros(0, U)
        self.offsets = np.searchsorted(self.starts, rows)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()


_STEPS = [pow(0xA0761D6478BD642F, j + 1, 1 << 64) for j in range(64)]


def shingles(names: np.ndarray, size: int) -> np.ndarray:
    """Names of all runs of `size` words; of fewer words, the whole sequence is the only one."""
    n = len(names)
    if not n:
        return names
    width = min(size, n)
    out = np.full(n - width + 1, width, U)
    for j in range(width):
        out += names[j : n - width + 1 + j] * U(_STEPS[j])
    return mix(out)


def row_shingles(words: Words, size: int) -> Iterator[np.ndarray]:
    """For each row its shingles in order; one numpy pass serves all rows."""
    names, offsets = words.names, words.offsets
    every = shingles(names, size) if len(names) >= size else names[:0]
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield every[a : b - size + 1] if b - a >= size else shingles(names[a:b], size)
