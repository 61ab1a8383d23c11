"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with the follow-the-regularised-leader update and elastic-net penalties on a bounded
sample, calibrated by a temperature on a part of the sample kept apart.
"""

from __future__ import annotations

import math
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import STEP, U, buffers, slices

#: Hashed n-grams of 1 to 3 characters: features' number as a power of 2.
BITS, ORDERS = 16, (1, 2, 3)
#: Bound of the sample: labelled documents of a language that are learned from; every fifth calibrates.
PER_LANGUAGE, CALIBRATE = 500, 5
#: Bound of the whole sample, whatever the number of languages.
SAMPLE = 100_000
#: Step size, its smoothing, the penalties on absolute values and on squares, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-4, 1e-3, 6
#: Frequencies are small; this makes the features' usual size about 1.
SCALE = 100.0
UNDETERMINED = "und"


@cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it isn't a letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (char := chr(c)).isalpha():
            low = char.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts (one row of the array an order), which count, and the offsets of the texts.

    Whatever isn't a letter is a blank; n-grams of blanks alone and those across texts don't count.
    """
    data, rows = buffers(texts)
    starts = (data & 0xC0) != 0x80
    offsets = np.concatenate([[0], np.cumsum(starts)])[rows]
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    chars = letters()[points].astype(U)
    n = len(chars)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(n)
    hashed, counts = np.zeros((len(ORDERS), n), np.int64), np.zeros((len(ORDERS), n), bool)
    run, any_letter = np.zeros(n, U), np.zeros(n, bool)
    for i, order in enumerate(ORDERS):
        following = np.zeros(n, U)
        following[: n - order + 1] = chars[order - 1 :]
        run = run * U(0x100000001B3) + following + U(1)
        any_letter = any_letter | (following > 0)
        mixed = (run ^ U(order)) * U(0x9E3779B97F4A7C15)
        hashed[i] = ((mixed ^ (mixed >> U(29))) * U(0xBF58476D1CE4E5B9) >> U(64 - BITS)).astype(np.int64)
        counts[i] = any_letter & (at + order <= ends)
    return hashed, counts, offsets


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray  # features x labels, times their inverse document frequency
    bias: np.ndarray
    temperature: float


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model | None:
    """A model of (label, features, frequencies) rows; None without any."""
    if not rows:
        return None
    labels = sorted({label for label, *_ in rows})
    number = {label: i for i, label in enumerate(labels)}
    size, k = 1 << BITS, len(labels)
    seen = np.zeros(size)
    for _, features, _ in rows:
        seen[features] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    held = [row for i, row in enumerate(rows) if i % CALIBRATE == CALIBRATE - 1]
    taught = [row for i, row in enumerate(rows) if i % CALIBRATE < CALIBRATE - 1]
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def solve(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return -np.sign(zs) * np.maximum(np.abs(zs) - L1, 0) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for label, features, frequencies in taught:
            at = np.append(features, size)  # the last one is the bias
            x = np.append(frequencies * idf[features] * SCALE, 1.0)
            w = solve(at)
            error = _softmax(x @ w)
            error[number[label]] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = solve(np.arange(size + 1))
    weights, bias = w[:size] * idf[:, None] * SCALE, w[size]
    logits = np.array([f @ weights[a] + bias for _, a, f in held]).reshape(-1, k)
    right = [number[label] for label, *_ in held]
    # as if one more text had each of the languages in equal parts: a sample without errors gives no certainty
    aim = (np.eye(k)[right] + 1 / (k * (len(held) + 1))) if held else np.zeros((0, k))
    steps = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
    loss = [-(aim * np.log(np.maximum(_softmax(logits / t), 1e-30))).sum() for t in steps]
    return Model(labels, weights.astype(np.float32), bias.astype(np.float32), float(steps[int(np.argmin(loss))]) if held else 1.0)


def sample(rows: DataFrame, per_language: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Features of at most so many labelled texts of each language, those of the smallest hashes of id and text, in their order.

    The rows of each language are counted first, and a bound on the hash leaves few more than
    are wanted before any text is shuffled, however many rows a language has. Languages are
    few; where a column has very many labels, each gives fewer texts, so that all features
    together stay below `SAMPLE`.
    """
    counts = {row.lang: row["count"] for row in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    wanted = max(1, min(per_language, SAMPLE // len(counts)))
    most = wanted + 8 * math.sqrt(wanted) + 16  # expected below the bound: fewer than wanted are below it once in 10**12 times
    bound = F.lit(None).cast("long")
    for n in sorted({c for c in counts.values() if c > most}):
        names = [lang for lang, c in counts.items() if c == n]
        bound = F.when(F.col("lang").isin(names), F.lit(int(most / n * 2**64) - 2**63)).otherwise(bound)
    by_draw = Window.partitionBy("lang").orderBy("draw")
    drawn = rows.withColumn("draw", F.xxhash64("doc_id", "text")).filter(F.coalesce(F.col("draw") < bound, F.lit(True)))
    drawn = drawn.withColumn("place", F.row_number().over(by_draw)).filter(F.col("place") <= wanted)

    def run(batches):
        for batch in slices(batches, "text", STEP):
            hashed, counts, offsets = ngrams(batch.column(0))
            features, frequencies = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                f, c = np.unique(hashed[:, a:b][counts[:, a:b]], return_counts=True)
                features.append(f.astype(np.int32))
                frequencies.append((c / max(1, c.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(features, pa.list_(pa.int32())), pa.array(frequencies, pa.list_(pa.float32()))], ["lang", "draw", "features", "frequencies"])

    found = drawn.select("text", "lang", "draw").mapInArrow(run, "lang string, draw long, features array<int>, frequencies array<float>").toArrow()
    found = found.sort_by([("draw", "ascending"), ("lang", "ascending")])
    return [(label, f.values.to_numpy(), c.values.to_numpy().astype(np.float64)) for label, f, c in zip(found["lang"].to_pylist(), found["features"], found["frequencies"], strict=True) if len(f.values)]


def predict(model: Model | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    hashed, counts, offsets = ngrams(texts)
    labels, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    total = np.concatenate([[0], np.cumsum(counts.sum(axis=0))])
    total = np.diff(total[offsets])
    full = np.flatnonzero(total > 0)
    if model is None or not len(full):
        return labels, scores
    sums = np.zeros((len(texts), len(model.labels)))
    weights = np.vstack([model.weights, np.zeros((1, len(model.labels)), np.float32)])
    limit = 1 << 18  # n-grams whose weights are looked up at once
    for i in range(len(ORDERS)):
        index = np.where(counts[i], hashed[i], len(weights) - 1)
        for part in np.split(full, np.flatnonzero(np.diff(offsets[full] // limit)) + 1):
            low, high = offsets[part[0]], offsets[part[-1] + 1]
            if high - low <= 2 * limit:
                sums[part] += np.add.reduceat(weights[index[low:high]], offsets[part] - low, axis=0, dtype=np.float64)
            else:
                for row in part:
                    for at in range(offsets[row], offsets[row + 1], limit):
                        sums[row] += weights[index[at : min(at + limit, offsets[row + 1])]].sum(axis=0, dtype=np.float64)
    logits = sums[full] / total[full, None] + model.bias
    chances = _softmax(logits / model.temperature)
    for row, best, chance in zip(full.tolist(), chances.argmax(axis=1).tolist(), chances.max(axis=1).tolist(), strict=True):
        labels[row], scores[row] = model.labels[best], min(1.0, chance)
    return labels, scores


def fitted(docs: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """The model of a bounded sample of the rows that `learn` marks; their text and language alone are looked at."""
    rows = docs.filter(F.coalesce(learn, F.lit(False)) & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    return train(sample(rows.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")), per_language))


def identified(docs: DataFrame, model: Model | None, text_column: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the prediction and its score in two more columns, named by `names`; columns of docs that have these names give way.

    Null, empty and letterless texts are `und` with the score 0; so is all, if there was
    nothing to learn from. The score is the calibrated probability of the prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*names)

    def run(batches):
        for batch in slices(batches, text_column, STEP):
            labels, scores = predict(shared.value, batch.column(batch.schema.get_field_index(text_column)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))
