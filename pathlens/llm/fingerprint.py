"""Document fingerprints by consistent weighted sampling.

Terms are words, weighted by their number in the text. For each of the samples a term draws
two gamma variates and a uniform one, which depend on nothing but the term and the sample;
the term whose quantised weight gives the least value is the sample. Two texts agree in a
sample with the probability of their generalised Jaccard similarity, sum of the smaller
weights over sum of the larger.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import distinct_ids
from .words import U, Words, mix, slices

SAMPLES = 64
#: Each variate is one of so many quantiles of its distribution, chosen by 16 bits of a hash.
QUANTILES = 1 << 16


def gamma_quantiles(n: int = QUANTILES) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 and scale 1, by Newton's method on 1-(1+x)exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    x = np.where(p < 0.5, np.sqrt(2 * p), 2 - np.log1p(-p))
    for _ in range(40):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), x / 4)
    return x


class WeightedSampler:
    """Signatures of texts: `samples` numbers of 16 bits each, all 0 for a text without words."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        gamma = gamma_quantiles()
        self.r, self.ln_c = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        self.beta = ((np.arange(QUANTILES) + 0.5) / QUANTILES).astype(np.float32)
        self.salts = mix(np.arange(1, samples + 1, dtype=U) * U(0x9E3779B97F4A7C15))

    def _values(self, names: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each term and sample the value to be minimised, and in the low bits what is sampled."""
        draw = mix(names[:, None] ^ self.salts)
        low = U(QUANTILES - 1)
        r = self.r[draw & low]
        beta = self.beta[(draw >> U(16)) & low]
        step = np.floor(np.log(weights.astype(np.float32))[:, None] / r + beta)
        least = self.ln_c[(draw >> U(32)) & low] - r * (step - beta + np.float32(1))
        bits = least.view(np.uint32)  # floats in an order that unsigned integers have too
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(U)
        sampled = (draw >> U(48)) ^ (step.astype(np.int64).view(U) * U(40503)) & low
        return (bits << U(32)) | sampled

    def signatures(self, column: pa.Array) -> np.ndarray:
        words = Words(column)
        n = len(column)
        out = np.zeros((n, self.samples), np.uint16)
        row = np.repeat(np.arange(n), np.diff(words.offsets))
        order = np.lexsort((words.names, row))
        name, row = words.names[order], row[order]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            return out
        weight = np.diff(np.append(first, len(name)))
        name, row = name[first], row[first]
        _, some, which = np.unique(mix(name + weight.astype(U)), return_index=True, return_inverse=True)
        bounds = np.searchsorted(row, np.arange(n + 1))
        table = np.empty((len(some), self.samples), U)
        for at in range(0, len(some), 1 << 15):
            part = some[at : at + (1 << 15)]
            table[at : at + len(part)] = self._values(name[part], weight[part])
        limit = 1 << 15  # rows of the table that are gathered at once
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        for part in np.split(full, np.flatnonzero(np.diff(bounds[full] // limit)) + 1):
            low, high = bounds[part[0]], bounds[part[-1] + 1]
            if high - low <= 2 * limit:
                out[part] = np.minimum.reduceat(table[which[low:high]], bounds[part] - low, axis=0)
                continue
            for i in part:  # among them is a very long text
                own = which[bounds[i] : bounds[i + 1]]
                out[i] = np.min([table[own[j : j + limit]].min(axis=0) for j in range(0, len(own), limit)], axis=0)
        return out


def _hex(signatures: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signatures.astype(">u2")]


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint), one row for each row of docs; null, empty and blank texts have a fingerprint of zeros."""

    def run(batches):
        sampler = WeightedSampler(samples)
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_hex(sampler.signatures(batch.column(1))))], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_column].dataType.simpleString()}, fingerprint string")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def neighbours(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, text, ahead) dealt out in descending id order, each partition in order and ending with the row that comes next.

    Rows have numbers in the order of their ids, one by one where ids repeat or are null. The
    partitions begin at numbers found by a quantile sketch; the first row of each is also
    dealt to the one before, and the very first row to the last.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = distinct_ids(plain, "doc_id", "text", "row")
    shares = F.array(*(F.lit(i / n) for i in range(1, n + 1)))
    cuts = rows.agg(F.percentile_approx("row", shares, 100 * n).alias("at"), F.max("row").alias("top")).first()
    starts = np.array(sorted({*(cuts.at or []), *([] if cuts.top is None else [cuts.top])}), np.int64)  # ascending
    count = max(1, len(starts))

    @F.pandas_udf("array<struct<part: int, ahead: boolean>>")
    def places(numbers: pd.Series) -> pd.Series:
        value = numbers.to_numpy(np.int64)
        part = count - 1 - np.searchsorted(starts, value)
        begins = np.isin(value, starts)
        return pd.Series([[(int(p), False), (int(p - 1) % count, True)] if b else [(int(p), False)] for p, b in zip(part, begins, strict=True)])

    dealt = rows.withColumn("place", F.explode(places("row"))).select("row", "doc_id", "text", "place.part", "place.ahead")
    return dealt.repartitionById(count, "part").sortWithinPartitions("ahead", F.desc("row")).select("doc_id", "text", "ahead")


def edit_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each row of docs.

    The edited text has its last third (rounded down) of code points replaced by the first as
    many (or all) of the next document's, in descending id order, the first after the last.
    A likeness is the share of equal samples. Null texts are empty; texts without words are
    alike. Null ids come last; rows that share an id, or have none, are in the order of a hash
    of their texts. A table of one row is its own next. Other columns are ignored; no rows give none.
    """

    def run(batches):
        sampler = WeightedSampler(samples)
        ids, texts, ahead, signatures = [], [], [], np.zeros((0, samples), np.uint16)
        for batch in slices(batches, "text"):
            ids = ids[-1:] + batch.column(0).to_pylist()
            texts = texts[-1:] + batch.column(1).to_pylist()
            ahead = ahead[-1:] + batch.column(2).to_pylist()
            own = [i for i in range(len(ids) - 1) if not ahead[i]]
            edited = []
            for i in own:
                third = len(texts[i]) // 3
                edited.append(texts[i][: len(texts[i]) - third] + texts[i + 1][:third])
            # both at once: the words of an edited text are mostly those of its neighbours
            both = sampler.signatures(pa.concat_arrays([batch.column(1).cast(pa.string()), pa.array(edited, pa.string())]))
            signatures, other = np.concatenate([signatures[-1:], both[: batch.num_rows]]), both[batch.num_rows :]
            mine, following = signatures[own], signatures[[i + 1 for i in own]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in own], pa.int64()),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                    pa.array(_hex(mine), pa.string()),
                    pa.array(_hex(other), pa.string()),
                    pa.array(likeness(mine, other), pa.float64()),
                    pa.array(likeness(mine, following), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return neighbours(docs, id_column, text_column).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
