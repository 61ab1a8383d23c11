"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by their exact length. For each source the whole copies are taken
first, then nearly the same share of every length, and what is left of the budget is filled
by bounded-knapsack dynamic programming over the lengths. Which documents of a length are
taken is drawn by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a budget that are left to the dynamic programme.
LAST_WORDS = 8192
#: Hash buckets a length's documents fall into, so that no long list of equal lengths has to be ranked in one task.
BUCKETS = 4096


def knapsack(sizes: Sequence[int], counts: Sequence[int], budget: int) -> dict[int, int]:
    """Numbers to take of each size, at most its count, whose sum is the largest that doesn't exceed the budget.

    Reachable sums are the bits of one integer, after each power-of-two share of a count.
    """
    mask, reached, steps = (1 << (budget + 1)) - 1, 1, []
    for size, count in zip(sizes, counts, strict=True):
        share = 1
        while count > 0 and size > 0 and not reached >> budget & 1:
            n = min(share, count)
            if n * size <= budget:
                steps.append((size, n, reached))
                reached |= reached << (n * size) & mask
            count, share = count - n, share * 2
    total, taken = reached.bit_length() - 1, {}
    for size, n, before in reversed(steps):
        if not before >> total & 1:
            total -= n * size
            taken[size] = taken.get(size, 0) + n
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """Numbers to take of each size so that their words come as near to the budget as can be, from below.

    Of the words before the last `LAST_WORDS` every size gives the same share, then the longest
    that are left fill up; the last ones are fitted by dynamic programming.
    """
    total = int((sizes * counts).sum())
    if total == 0 or budget >= total:
        return counts.copy() if total else np.zeros_like(counts)
    take = np.floor(counts * (max(0.0, budget - LAST_WORDS) / total)).astype(np.int64)
    left = int(budget) - int((take * sizes).sum())
    order = np.argsort(-sizes, kind="stable")
    for i in order:
        if sizes[i] > 0:
            more = min(int(counts[i] - take[i]), max(0, left - LAST_WORDS) // int(sizes[i]))
            take[i] += more
            left -= more * int(sizes[i])
    last = knapsack(sizes[order].tolist(), (counts - take)[order].tolist(), max(0, left))
    return take + np.array([last.get(int(s), 0) for s in sizes], np.int64)


def targets(by_source: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """by_source (source, known, source_size) with `target`: all targets' sum is `share` of all sizes, dealt by weight.

    Sources in code point order, null last, repeat the weights. No target exceeds `cap` times
    its source's size; the excess is dealt again by weight. In the order of their caps per
    weight, words per weight of what the sources before leave over rise as long as those exceed
    their caps, and fall from then on; so the largest is the level of all sources below theirs.
    The table has one row for each source, and so have the windows.
    """
    in_order = Window.orderBy(F.desc("known"), "source")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(cap))
    rows = by_source.withColumn("weight", weight).withColumn("limit", limit).withColumn("level", F.col("limit") / F.col("weight"))
    by_level = Window.orderBy("level", F.desc("known"), "source")
    before, every = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    heavier = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("share", rest / heavier)
    return rows.withColumn("target", F.least("limit", F.max("share").over(every) * F.col("weight"))).select("source", "known", "source_size", "target")


def mix(docs: DataFrame, columns: Sequence[str] = ("doc_id",), text_column: str = "text", source_column: str = "source", id_column: str = "doc_id", **options) -> DataFrame:
    """The given columns of docs, with `size`, `source_size`, `target`, `taken` and `copies`, one row for each row.

    size counts words (0 for a null text); taken is size times copies, the number of times
    that the mix holds the document, at most `cap` rounded down. Null is a source of its own,
    the last. Documents without words are taken as often as the whole source is. Equal rows
    are drawn one by one. Draws depend on the seed, id and text, then on the other given columns,
    so reruns agree. An
    empty table gives no rows. Columns that bear the names above give way to them.

    options: weights=(5, 2, 1), share=1.5, cap=2.0, seed=17; see `targets`.
    """
    rows = _mixed(docs, columns, text_column, source_column, id_column, **options)
    return rows.select(*(F.col(f"own.`{c}`") for c in columns if c.lower() not in MEASURES), *MEASURES)


MEASURES = ("size", "source_size", "target", "taken", "copies")


def _mixed(docs: DataFrame, columns: Sequence[str], text_column: str, source_column: str, id_column: str, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """(own, size, source_size, target, taken, copies): the given columns stand in a struct, where no name clashes."""
    rows = docs.select(
        F.struct(*columns).alias("own"),
        F.coalesce(F.col(source_column), F.lit("")).alias("source"),
        F.col(source_column).isNotNull().alias("known"),
        F.coalesce(F.regexp_count(text_column, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column)).alias("draw"),
    ).withColumn("bucket", F.pmod("draw", F.lit(BUCKETS)))
    # rows of equal id and text may differ elsewhere: then all that is given of them decides
    tie = F.xxhash64(*(F.to_json(F.struct(F.col(f"own.`{c}`"))) if "map" in docs.schema[c].dataType.simpleString() else F.col(f"own.`{c}`") for c in columns))
    key = ["source", "known", "size"]
    buckets = keep(rows.groupBy(*key, "bucket").agg(F.count("*").alias("held")))
    lengths = buckets.groupBy(*key).agg(F.sum("held").alias("held"))
    sources = lengths.groupBy("source", "known").agg(F.sum(F.col("size") * F.col("held")).alias("source_size"))
    aims = targets(sources, weights, share, cap)

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        total, target = int(group.source_size.iloc[0]), float(group.target.iloc[0])
        whole = int(target // total) if total else 0
        take = fit(group["size"].to_numpy(np.int64), group.held.to_numpy(np.int64), target - whole * total)
        return group.assign(whole=whole, take=take)

    kind = "source string, known boolean, size long, held long, source_size long, target double"
    planned = lengths.join(aims, ["source", "known"]).select("source", "known", "size", "held", "source_size", "target").groupBy("source", "known").applyInPandas(plan, f"{kind}, whole long, take long")
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = buckets.join(planned.drop("held"), key).withColumn("quota", F.col("take") - F.coalesce(F.sum("held").over(before), F.lit(0)))
    ranked = rows.join(quota.drop("take", "held"), [*key, "bucket"]).withColumn("place", F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("draw", tie)))
    copies = F.col("whole") + (F.col("place") <= F.col("quota")).cast("long")
    return ranked.withColumn("copies", copies).select("own", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "copies")


def repeated(docs: DataFrame, text_column: str = "text", source_column: str = "source", id_column: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each row of docs as often as `mix` takes it, with the columns of docs."""
    mixed = _mixed(docs, docs.columns, text_column, source_column, id_column, **options).filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*(F.col(f"own.`{c}`") for c in docs.columns))
