"""Encoding with the tokenizers library, each distinct stretch of text once.

A text falls into units that the tokenizer can't join: its matches never go past the place
where a unit begins. Texts are mostly made of units seen before, so a worker encodes the
distinct units of its batches and puts the ids of whole texts together. Units are told apart
by their bytes.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa

from .words import Words, buffers, give_back

#: Bytes that a worker remembers of units and their ids before it forgets them all, with what an entry costs besides; longer units aren't remembered.
REMEMBERED, ENTRY, LONGEST = 32 << 20, 160, 256
#: New units that are encoded in one go.
JOINED = 4096
#: What the names of files of ranks end with.
RANKS = ".tiktoken"
#: What ends a word in a vocabulary that marks words' ends.
WORD_END = "</w>"
#: UTF-8 of the white space beyond ASCII (Unicode property White_Space), fixed values.
WIDE_BLANKS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
BLANKS = "\t\n\v\f\r "
WIDE = re.compile("[" + "".join(blank.decode() for blank in WIDE_BLANKS) + "]")
#: 1 for ASCII letters, 2 for ASCII digits and punctuation but the apostrophe, which begins matches with letters.
KINDS = np.zeros(256, np.int8)
KINDS[33:127] = 2
KINDS[[*range(65, 91), *range(97, 123)]] = 1
KINDS[39] = 0


def load(path: str, plain: bool):
    """The tokenizer of a file (JSON, or ranks of byte strings as tiktoken has them); with `plain`, special tokens' strings in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = of_ranks(byte_table(path)) if path.endswith(RANKS) else Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    return tokenizer


def of_ranks(table: list[bytes]):
    """A byte-level tokenizer whose id is the rank: a byte string of more than one byte comes from the
    two strings that the ranks below its own leave of it."""
    import public_tokenizers
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    character = {b: c for c, b in byte_characters().items()}
    spelt = ["".join(character[b] for b in piece) for piece in table]
    rank = {piece: i for i, piece in enumerate(table)}
    merges = []
    for i, piece in enumerate(table):
        if len(piece) > 1:
            a, b = _halves(piece, i, rank)
            merges.append((spelt[rank[a]], spelt[rank[b]]))
    tokenizer = Tokenizer(models.BPE({piece: i for i, piece in enumerate(spelt)}, merges))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


def _halves(piece: bytes, limit: int, rank: dict[bytes, int]) -> list[bytes]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], limit))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of runs that begin at `starts` and have `lengths`."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for
    themselves, the others in ascending order for the characters from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@cache
def pieces_of(path: str) -> list[str]:
    """The vocabulary's piece of each id."""
    with open(path) as file:
        vocabulary = json.load(file)["model"]["vocab"]
    out = [""] * (max(vocabulary.values()) + 1)
    for piece, number in vocabulary.items():
        out[number] = piece
    return out


@cache
def byte_table(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    if path.endswith(RANKS):
        with open(path, "rb") as file:
            ranks = {int(number): base64.b64decode(piece) for piece, number in map(bytes.split, file)}
        return [ranks[i] for i in range(len(ranks))]
    table = byte_characters()
    return [bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode() for piece in pieces_of(path)]


class UnitEncoder:
    """Ids of whole texts. `leading`: a unit is the blanks and the word after them, else a word without the
    ASCII punctuation and digits beside its letters, which are units of their own, and in lower case.

    New units are joined for the tokenizer and its ids split again: by the bytes that they
    stand for, or by the pieces that end a word. Units that this might not suit go one by one.
    """

    def __init__(self, path: str, leading: bool):
        self.tokenizer, self.leading, self.known, self.size = load(path, leading), leading, {}, 0
        self.special = [] if leading else [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        if leading:
            self.bytes_of = np.array([len(b) for b in byte_table(path)], np.int64)
        else:
            self.ends_word = np.array([piece.endswith(WORD_END) for piece in pieces_of(path)] + [False] * 64)

    def forget(self) -> None:
        """At the end of a task: what is remembered goes, the tokenizer stays."""
        self.known.clear()
        self.size = 0
        give_back()

    def _joinable(self, text: str) -> bool:
        if self.leading:
            return text[0] in BLANKS and text[-1] not in BLANKS and (text.isascii() or not WIDE.search(text))
        return text.isalpha() if text.isascii() else text.lower().isalpha()

    def _split(self, ids: np.ndarray, texts: list[str]) -> np.ndarray | None:
        """Where each joined text's ids end."""
        if not self.leading:
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            return ends if len(ends) == len(texts) and ends[-1] == len(ids) else None
        wanted = np.cumsum([len(t.encode()) for t in texts])
        reached = np.cumsum(self.bytes_of[ids])
        ends = np.searchsorted(reached, wanted) + 1
        return ends if ends[-1] == len(ids) and (reached[ends - 1] == wanted).all() else None

    def _encode_units(self, keys: list[bytes]) -> dict[bytes, bytes]:
        found: dict[bytes, bytes] = {}
        single: list[int] = []
        texts = [key.decode() for key in keys]
        joinable = self._joinable
        joined = [i for i, text in enumerate(texts) if joinable(text)]
        if len(joined) < len(texts):
            chosen = set(joined)
            single = [i for i in range(len(texts)) if i not in chosen]
        for at in range(0, len(joined), JOINED):
            part = joined[at : at + JOINED]
            some = [texts[i] for i in part]
            ids = array("I", self.tokenizer.encode_batch_fast([("" if self.leading else " ").join(some)], add_special_tokens=False)[0].ids)
            ends = self._split(np.frombuffer(ids, np.uint32), some)
            if ends is None:
                single += part
                continue
            whole, start = ids.tobytes(), 0
            for i, end in zip(part, ends.tolist(), strict=True):
                found[keys[i]] = whole[4 * start : 4 * end]
                start = end
        for i, encoding in zip(single, self.tokenizer.encode_batch_fast([texts[i] for i in single], add_special_tokens=False), strict=True):
            found[keys[i]] = array("I", encoding.ids).tobytes()
        return found

    def _remember(self, found: dict[bytes, bytes]) -> None:
        short = found if max(map(len, found), default=0) <= LONGEST else {key: ids for key, ids in found.items() if len(key) <= LONGEST}
        size = ENTRY * len(short) + sum(map(len, short)) + sum(map(len, short.values()))
        if self.size + size > REMEMBERED:
            self.known.clear()
            self.size = 0
        if size <= REMEMBERED:
            self.known |= short
            self.size += size

    def _units(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each unit, all of them in order."""
        starts, ends = words.starts, words.starts + words.lengths
        if not self.leading:
            kind = KINDS[words.data]
            cuts = np.flatnonzero((kind[1:] + kind[:-1] == 3) & (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
            inside = np.searchsorted(starts, cuts, "right") - 1
            cuts = cuts[(inside >= 0) & (cuts > starts[inside]) & (cuts < ends[inside])] if len(starts) else cuts[:0]
            return np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        rows = words.rows
        before = np.zeros(len(starts), np.int64)
        before[1:] = ends[:-1]
        row = np.searchsorted(rows, starts, "right") - 1
        starts = np.maximum(before, rows[row])
        last = rows[:-1].copy()  # where the blanks at a row's end begin
        full = np.diff(words.offsets) > 0
        last[full] = ends[words.offsets[1:][full] - 1]
        tail = last < rows[1:]
        starts, ends = np.concatenate([starts, last[tail]]), np.concatenate([ends, rows[1:][tail]])
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order]

    def _whole_rows(self, data: np.ndarray, raw: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Rows with white space beyond ASCII, whose blanks may join, or with strings of special tokens, which are told by case, are one unit each, as they were."""
        text = raw.tobytes()
        if self.leading and text.isascii():
            return starts, ends
        at = [i for what in (WIDE_BLANKS if self.leading else self.special) for i in _places(text, what)]
        if not at:
            return starts, ends
        odd = np.unique(np.searchsorted(rows, at, "right") - 1)
        if not self.leading:
            for a, b in zip(rows[odd].tolist(), rows[odd + 1].tolist(), strict=True):
                data[a:b] = raw[a:b]
        keep = ~np.isin(np.searchsorted(rows, starts, "right") - 1, odd)
        starts, ends = np.concatenate([starts[keep], rows[odd]]), np.concatenate([ends[keep], rows[odd + 1]])
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column's texts one after the other, and the offsets of its rows."""
        words = Words(column, lower=not self.leading, named=False)
        rows = words.rows
        data = words.data
        starts, ends = self._whole_rows(data, data if self.leading else buffers(column)[0], rows, *self._units(words))
        keys, inverse = _distinct(data, starts, ends)
        found = self._encode_units([key for key in keys if key not in self.known])
        parts = [found[key] if key in found else self.known[key] for key in keys]
        self._remember(found)
        sizes = np.array([len(p) // 4 for p in parts], np.int64)
        flat = np.frombuffer(b"".join(parts), np.uint32)
        lengths = sizes[inverse]
        ids = flat[ragged((np.cumsum(sizes) - sizes)[inverse], lengths)] if len(inverse) else flat
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return ids, sums[np.searchsorted(starts, rows)]


def _places(text: bytes, what: bytes):
    at = text.find(what)
    while at >= 0:
        yield at
        at = text.find(what, at + 1)


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different byte strings of spans in order (and of what lies between them), and the place of each span's."""
    edges, step = np.stack([starts, ends], 1).reshape(-1), 2
    if (ends[:-1] == starts[1:]).all():
        edges, step = np.append(starts, ends[-1:]), 1
    if not len(starts):
        return [], np.zeros(0, np.int64)
    spans = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
    coded = spans.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()[::step]


@cache
def encoder(path: str, leading: bool) -> UnitEncoder:
    """A worker's encoder, which goes on from task to task with what it remembers."""
    return UnitEncoder(path, leading)
