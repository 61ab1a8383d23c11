"""LM scoring by the subword lattice: the probability of a text over all its segmentations.

The vocabulary is an existing one; the probabilities of its pieces are learned here, from
the training words' segmentations. A text's lattice falls apart at its blanks, so the
forward recursion runs once for each distinct word of the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep
from .words import TOGETHER, Words, slices

MARK = "▁"  # stands before a word's first character in the vocabulary
#: Words that make up at least this share of all training tokens: never more than 2**18.
FREQUENT = 2.0**-18


class Lattice:
    """Forward recursion in log space (base e) over a vocabulary's pieces."""

    def __init__(self, scores: dict[str, float], byte_scores: list[float]):
        self.scores, self.byte_scores = scores, byte_scores
        self.beginnings = {piece[:i] for piece in scores for i in range(1, len(piece) + 1)}

    def log_probability(self, word: str) -> float:
        text = MARK + word
        n = len(text)
        forward: list[float | None] = [None] * (n + 1)
        forward[0] = 0.0
        scores, beginnings = self.scores, self.beginnings
        for i in range(n):
            here = forward[i]
            if here is None:
                continue
            if text[i] not in scores:  # by its bytes
                x = here + sum(self.byte_scores[b] for b in text[i].encode())
                forward[i + 1] = x if forward[i + 1] is None else _add(forward[i + 1], x)
            for end in range(i + 1, n + 1):
                piece = text[i:end]
                if piece not in beginnings:
                    break
                if (score := scores.get(piece)) is not None:
                    x, y = here + score, forward[end]
                    forward[end] = x if y is None else _add(x, y)
        return forward[n]


def _add(x: float, y: float) -> float:
    return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))


def vocabulary(model: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=model)


def piece_scores(model: str, counts: dict[int, int], ends: int) -> tuple[Lattice, float]:
    """Log probabilities of the pieces with one added to each count, and of a text's end."""
    processor = vocabulary(model)
    usable = [i for i in range(len(processor)) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i))]
    total = math.log(sum(counts.get(i, 0) + 1 for i in usable) + ends + 1)
    scores, bytes_ = {}, [0.0] * 256
    for i in usable:
        score = math.log(counts.get(i, 0) + 1) - total
        if processor.is_byte(i):
            bytes_[int(processor.id_to_piece(i)[3:5], 16)] = score
        else:
            scores[processor.id_to_piece(i)] = score
    return Lattice(scores, bytes_), math.log(ends + 1) - total


def word_counts(rows: DataFrame) -> DataFrame:
    """(name, word, count): all distinct words of `text`, and their number in training rows."""

    def run(batches):
        for batch in slices(batches, "text", 4 * TOGETHER):
            words = Words(batch.column(0))
            train = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(words.offsets))
            names, first, inverse = np.unique(words.names, return_index=True, return_inverse=True)
            counts = np.bincount(inverse, train, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array([words.word(i) for i in first], pa.binary()), pa.array(counts)], ["name", "word", "count"])

    return rows.mapInArrow(run, "name long, word binary, count long").groupBy("name", "word").agg(F.sum("count").alias("count"))


def _piece_counts(words: DataFrame, model: str) -> dict[int, int]:
    """Occurrences of each piece in the training words, segmented as the vocabulary does: a number a piece."""

    def run(batches):
        processor = vocabulary(model)
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            ids = processor.encode(texts, num_threads=1)
            weights = np.repeat(batch.column(1).to_numpy(), [len(x) for x in ids])
            flat = np.fromiter((i for x in ids for i in x), np.int64, len(weights))
            counts = np.bincount(flat, weights, len(processor)).astype(np.int64)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["piece", "count"])

    rows = words.select("word", "count").mapInArrow(run, "piece long, count long").groupBy("piece").agg(F.sum("count").alias("count"))
    return {row.piece: row["count"] for row in rows.collect()}


def lattice_scores(docs: DataFrame, model: str, train: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs.

    `train` says which rows the counts and the pieces' probabilities are learned from. Words
    end at blanks and have A-Z lower-cased; a text is its words and one end. base_score adds
    log10((c+1)/(N+V+1)) over tokens; score is log10 of the text's probability over all
    segmentations of its words into the vocabulary's pieces. Null texts are empty: they
    consist of their end. Rows may share ids; other columns are ignored; no rows give none.

    Frequent words (at most 2**18, whatever the corpus) are looked up in a broadcast table,
    all others are joined, so no word is the key of many rows.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    words = keep(word_counts(rows.select("text", "train")))
    ends = rows.filter("train").count()
    held = words.filter("count > 0").agg(F.sum("count"), F.count("*")).first()
    tokens, distinct = (held[0] or 0) + ends, held[1] + (ends > 0)
    lattice, end_score = piece_scores(model, _piece_counts(words.filter("count > 0"), model), ends)
    shared = docs.sparkSession.sparkContext.broadcast(lattice)

    def score(batches):
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column(1).to_pylist()]
            scores = [shared.value.log_probability(w) / math.log(10) for w in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], ["name", "count", "lattice"])

    table = keep(words.select("name", "word", "count").mapInArrow(score, "name long, count long, lattice double"))
    often = table.filter((F.col("count") > 0) & (F.col("count") >= tokens * FREQUENT)).toArrow().sort_by("name")
    frequent = docs.sparkSession.sparkContext.broadcast([often.column(c).to_numpy() for c in ("name", "count", "lattice")])
    log_total = math.log10(tokens + distinct + 1)
    end_base, end_lattice = math.log10((ends + 1)) - log_total, end_score / math.log(10)

    def look_up(batches):
        names, counts, lattices = frequent.value
        bases = np.log10(counts + 1.0) - log_total
        for batch in slices(batches, "text"):
            words, n = Words(batch.column(1)), batch.num_rows
            name, row = words.names.view(np.int64), np.repeat(np.arange(n), np.diff(words.offsets))
            at = np.minimum(np.searchsorted(names, name), max(0, len(names) - 1))
            hit = names[at] == name if len(names) else np.zeros(len(name), bool)
            at, mine = at[hit], row[hit]
            total = [np.bincount(mine, x, n) for x in (np.ones(len(mine)), bases[at], lattices[at])]
            identity = batch.column(0)
            yield _rows(
                identity,
                pa.array(mix_ids(identity)),
                np.zeros(n, np.int32),
                batch.column(2),
                np.diff(words.offsets) + 1,
                total[0].astype(np.int64) + (ends > 0),
                total[1] + end_base,
                total[2] + end_lattice,
            )
            name, row = name[~hit], row[~hit]
            order = np.lexsort((name, row))
            name, row = name[order], row[order]
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            often = np.diff(np.append(first, len(name))).astype(np.int32)
            yield _rows(identity.take(pa.array(row[first])), pa.array(name[first]), often, batch.column(2).take(pa.array(row[first])))

    parts = rows.select(F.monotonically_increasing_id().alias("row"), "text", F.struct("doc_id", "train").alias("of")).mapInArrow(
        look_up, f"row long, name long, times int, of struct<doc_id: {docs.schema[id_column].dataType.simpleString()}, train: boolean>, n long, known long, base double, lattice double"
    )
    looked = parts.join(table.select("name", "count", F.col("lattice").alias("word_lattice")), "name", "left")
    times = F.col("times")
    rare = F.coalesce(times * (F.log10(F.col("count") + 1) - F.lit(log_total)), F.lit(0.0))
    sums = looked.groupBy("row", "of.doc_id", "of.train").agg(
        F.sum("n").alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(F.col("count") > 0, times).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(rare)).alias("base_score"),
        (F.sum("lattice") + F.sum(F.coalesce(times * F.col("word_lattice"), F.lit(0.0)))).alias("score"),
    )
    return sums.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def mix_ids(rows: pa.Array) -> np.ndarray:
    """Join keys of the rows that stand for whole documents: spread, and no word's name but by chance, when 0 is added."""
    from .words import U, mix

    return mix(rows.to_numpy().astype(U) * U(0x9E3779B97F4A7C15) + U(7)).view(np.int64)


def _rows(row, name, times, of, *totals) -> pa.RecordBatch:
    n = len(row)
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
    totals = [pa.array(x, k) for x, k in zip(totals, kinds, strict=True)] if totals else [pa.nulls(n, k) for k in kinds]
    return pa.RecordBatch.from_arrays([row, name, pa.array(times, pa.int32()), of, *totals], ["row", "name", "times", "of", "n", "known", "base", "lattice"])
