"""Metrics, paired comparison, bootstrap, lift and audits."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio
from .journey import CENSORED, HIT, MISSED
from .relational import exact_quantiles, in_segments, mean_of_means, running_by_score

FLOOR = 1e-15


def hit_metrics(rows: DataFrame, scores: str = "scores", action: str = "action") -> DataFrame:
    """Top-1, top-5 and reciprocal rank of the realised action, multiclass and any-target Brier.

    `scores` maps actions to probabilities. A score of 0 never counts as a hit. The rank is 1
    + the number of better actions, ties by name. Metrics are null for censored cases; hits
    are null unless the action was observed.
    """
    p = F.coalesce(F.try_element_at(scores, F.col(action)), F.lit(0.0))
    better = F.size(F.filter(F.map_entries(scores), lambda e: (e.value > p) | ((e.value == p) & (e.key < F.col(action)))))
    rank = F.when((F.col("label_status") == HIT) & (p > 0), better + 1)
    observed = F.col("label_status") == HIT
    resolved = F.col("label_status") != CENSORED
    squares = F.aggregate(F.map_values(scores), F.lit(0.0), lambda s, x: s + x * x)
    total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda s, x: s + x)
    none = F.greatest(1 - total, F.lit(0.0))
    real = F.when(observed, p).otherwise(none)
    return rows.withColumn("p_real", F.when(resolved, real)).withColumn("rank_real", rank).withColumns(
        {
            "top1": F.when(observed, F.coalesce((F.col("rank_real") == 1).cast("double"), F.lit(0.0))),
            "top5": F.when(observed, F.coalesce((F.col("rank_real") <= 5).cast("double"), F.lit(0.0))),
            "mrr": F.when(observed, F.coalesce(1 / F.col("rank_real"), F.lit(0.0))),
            "brier": F.when(resolved, squares + none * none + 1 - 2 * real),
            "any_brier": F.when(resolved, F.pow(total - observed.cast("double"), F.lit(2))),
        }
    )


def log_losses(rows: DataFrame, probability: Column, lost: Column | None = None, floor: float = FLOOR) -> DataFrame:
    """Log loss with a floor and whether it was clipped; the optimistic bound credits lost mass to an unobserved target."""
    out = rows.withColumn("log_loss", F.when(probability.isNotNull(), -F.log(F.greatest(probability, F.lit(floor))))).withColumn("clipped", (probability < floor).cast("int"))
    if lost is not None:
        out = out.withColumn("log_loss_optimistic", F.when(probability.isNotNull(), -F.log(F.greatest(probability + F.when(F.col("label_status") == MISSED, lost).otherwise(0.0), F.lit(floor)))))
    return out


def temporal_gain(rows: DataFrame, with_time: str, without: str, keys: list[str]) -> DataFrame:
    """Mean log loss with and without the age, and the gain."""
    loss = lambda c: F.avg(-F.log(F.greatest(F.col(c), F.lit(FLOOR))))
    out = rows.groupBy(*keys).agg(F.count("*").alias("cases"), loss(without).alias("loss_without"), loss(with_time).alias("loss_with"))
    return out.withColumn("gain", F.col("loss_without") - F.col("loss_with"))


def destination_metrics(q: DataFrame, realised: DataFrame, case: list[str], keys: list[str]) -> DataFrame:
    """Top-1 and top-5 of the realised destination by q (with age) and p (without), over cases that have a model."""
    order = lambda c: Window.partitionBy(*case).orderBy(F.desc(c), F.asc("dest"))
    ranked = q.withColumn("rank_q", F.row_number().over(order("q"))).withColumn("rank_p", F.row_number().over(order("p")))
    rows = realised.join(ranked.select(*case, "dest", "rank_q", "rank_p", "q", "p"), [*case, "dest"], "left")
    modelled = rows.join(q.select(*case, F.lit(True).alias("modelled")).distinct(), case, "left")
    share = lambda c, k: F.avg(F.when(F.col("modelled"), F.coalesce((F.col(c) <= k).cast("double"), F.lit(0.0))))
    nll = F.avg(F.when(F.col("modelled"), -F.log(F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(FLOOR)))))
    return modelled.groupBy(*keys).agg(F.count("*").alias("cases"), F.avg(F.coalesce("modelled", F.lit(False)).cast("double")).alias("coverage"), share("rank_q", 1).alias("top1_time"), share("rank_p", 1).alias("top1_static"), share("rank_q", 5).alias("top5_time"), share("rank_p", 5).alias("top5_static"), nll.alias("nll"))


def complete_pairs(rows: DataFrame, case: list[str], variants: int) -> DataFrame:
    """Cases that every variant has scored."""
    return rows.withColumn("_v", F.size(F.collect_set("variant").over(Window.partitionBy(*case)))).filter(F.col("_v") == variants).drop("_v")


def entity_summary(rows: DataFrame, keys: list[str], measures: list[str], segments: dict[str, Column]) -> DataFrame:
    """Means of entities' means by segment and keys."""
    return mean_of_means(in_segments(rows, segments), "entity", ["segment", *keys], measures)


PRIME = 2**31 - 1


#: Distribution function of Poisson(1) at 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
#: Weights of so many entities and replicates are drawn together.
DRAWN = 1 << 20


def _uniform_numbers(*texts: str) -> list[int]:
    """From the first 8 hex digits of a text's md5, below the prime."""
    return [int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % PRIME for text in texts]


def _replicate_sums(replicates: int, salt: str, n_keys: int):
    """A task's sums of each replicate, two arrays a key: weights and weighted differences; an entity stays one row."""
    powers = np.array([_uniform_numbers(*(f"{salt}|{r}|{c}" for c in ("c3", "c2", "c1", "c0"))) for r in range(1, replicates + 1)], np.int64).T

    def run(batches):
        sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True)) if n_keys else [()] * batch.num_rows
            number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            of = np.array([number[k] for k in keys], np.int64)
            x, d = (batch.column(n_keys + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for key, i in number.items():
                total = sums.setdefault(key, (np.zeros(replicates, np.int64), np.zeros(replicates)))
                mine = np.flatnonzero(of == i)
                step = max(1, DRAWN // replicates)
                for at in range(0, len(mine), step):
                    part = mine[at : at + step]
                    u = np.broadcast_to(powers[0], (len(part), replicates))
                    for c in powers[1:]:
                        u = (u * x[part][:, None] + c) % PRIME
                    u = u / float(PRIME)
                    w = sum((u > c).astype(np.int8) for c in POISSON)
                    total[0][:] += w.sum(0, dtype=np.int64)
                    total[1][:] += d[part] @ w
        for key, (w, s) in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([k], batch.schema.field(i).type) for i, k in enumerate(key)), pa.array([w.tolist()], pa.list_(pa.int64())), pa.array([s.tolist()], pa.list_(pa.float64()))], [*batch.schema.names[:n_keys], "w", "s"])

    return run


def bootstrap(pairs: DataFrame, reference: str, candidate: str, replicates: int = 2000, salt: str = "bootstrap", keys: tuple[str, ...] = ()) -> DataFrame:
    """Paired bootstrap over entities: mean gain (reference - candidate), its 95 % percentile interval, relative skill.

    Each entity is drawn with a Poisson(1) weight in each replicate, so that any run gives the
    same interval: an entity has one hash, and a replicate a polynomial of degree 3 modulo the
    prime 2**31 - 1, which turns the hash into a uniform number; draws of any four entities
    are independent. Entities stay one row each: a task adds up their weights' arrays and gives
    one array a key, whose elements are then summed over tasks.
    """
    own = pairs.groupBy(*keys, "entity").agg(F.avg(reference).alias("a"), F.avg(candidate).alias("b")).filter("a is not null and b is not null")
    total = own.groupBy(*keys).agg(F.count("*").alias("entities"), F.avg(F.col("a") - F.col("b")).alias("gain"), (1 - safe_ratio(F.avg("b"), F.avg("a"))).alias("skill"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), "entity")), 1, 8), 16, 10).cast("long") % PRIME
    drawn = own.select(*keys, number.alias("x"), (F.col("a") - F.col("b")).alias("d"))
    kinds = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keys)
    sums = drawn.mapInArrow(_replicate_sums(replicates, salt, len(keys)), ", ".join(filter(None, [kinds, "w array<long>, s array<double>"])))
    sums = sums.select(*keys, F.posexplode(F.arrays_zip("w", "s")).alias("replicate", "e")).groupBy(*keys, "replicate").agg(F.sum("e.w").alias("w"), F.sum("e.s").alias("s")).filter("w > 0")
    interval = sums.groupBy(*keys).agg(F.expr("percentile(s / w, array(0.025, 0.975))").alias("i"), F.count("*").alias("replicates"))  # as many rows as replicates
    rows = interval.join(total, list(keys)) if keys else interval.join(F.broadcast(total))
    return with_reading(rows.select(*keys, "entities", "gain", "skill", F.col("i")[0].alias("low"), F.col("i")[1].alias("high"), "replicates"))


def with_reading(rows: DataFrame, least: int = 2) -> DataFrame:
    """What an interval says."""
    # The names that results bear.
    reading = F.when((F.col("entities") < least) | F.col("low").isNull(), "insuficiente").when(F.col("low") > 0, "ganho").when(F.col("high") < 0, "perda").otherwise("inclui_zero")
    return rows.withColumn("reading", reading)


def weighted_bands(rows: DataFrame, score: str, weight: Column, positive: Column, bands: list[tuple[str, float, float]], keys: tuple[str, ...] = ()) -> DataFrame:
    """Rate, lift and capture in bands of the total weight from the top, ties shared out by fractions.

    Within equal scores the order doesn't matter: a band takes the expected part of them. A
    constant score gives a lift of 1.
    """
    blocks = running_by_score(rows, score, {"w": F.sum(weight), "pos": F.sum(weight * positive)}, keys)
    parts = F.explode(F.array(*(F.struct(F.lit(n).alias("band"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for n, a, b in bands)))
    cut = blocks.withColumn("b", parts).select("*", "b.band", "b.low", "b.high")
    take = F.greatest(F.lit(0.0), F.least(F.col("w_before") + F.col("w"), F.col("w_total") * F.col("high")) - F.greatest(F.col("w_before"), F.col("w_total") * F.col("low")))
    cut = cut.withColumn("take", take.cast("double")).filter("take > 0").withColumn("part", F.col("take") / F.col("w"))
    out = cut.groupBy(*keys, "band").agg(
        F.sum("take").alias("weight"), F.sum(F.col("part") * F.col("pos")).alias("positives"), F.sum(F.col("take") * F.col(score)).alias("_scores"), F.max("w_total").alias("w_total"), F.max("pos_total").alias("pos_total")
    )
    rate = safe_ratio(F.col("positives"), F.col("weight"))
    base = safe_ratio(F.col("pos_total"), F.col("w_total"))
    return out.select(*keys, "band", "weight", "positives", safe_ratio(F.col("_scores"), F.col("weight")).alias("mean_score"), rate.alias("rate"), safe_ratio(rate, base).alias("lift"), safe_ratio(F.col("positives"), F.col("pos_total")).alias("capture"))


def calibration_curve(rows: DataFrame, score: str, positive: Column, n: int = 10) -> DataFrame:
    """Mean score and observed rate in n bands of equal mass."""
    return weighted_bands(rows, score, F.lit(1.0), positive, [(f"{i + 1:02d}", i / n, (i + 1) / n) for i in range(n)])


def calibration_bins(rows: DataFrame, score: str, positive: Column, bins: int = 10) -> DataFrame:
    """Bins at quantiles of the score, equal edges dropped: rows, mean score, observed rate."""
    edges = exact_quantiles(rows, score, [i / bins for i in range(1, bins)]).select(F.array_distinct("q").alias("_e"))
    binned = rows.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col(score))))
    return binned.groupBy("bin").agg(F.count("*").alias("rows"), F.avg(score).alias("mean_score"), F.avg(positive.cast("double")).alias("rate"))


def action_summary(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Of each target its support, one-against-rest Brier, recall at 1 and 5 by entity and precision at 1; targets never seen have 0.

    rows: keys, entity, scores (a map), label_status, action, rank_real; targets (target) is a small table.
    """
    resolved = rows.filter(F.col("label_status") != CENSORED)
    grid = resolved.crossJoin(F.broadcast(targets))  # the configured targets
    p = F.coalesce(F.try_element_at("scores", F.col("target")), F.lit(0.0))
    first = F.expr("case when size(scores) > 0 then array_sort(map_entries(scores), (x, y) -> case when x.value > y.value or (x.value = y.value and x.key < y.key) then -1 else 1 end)[0] end")
    real = F.coalesce((F.col("action") == F.col("target")) & (F.col("label_status") == HIT), F.lit(False))
    grid = grid.withColumn("p", p).withColumn("real", real).withColumn("_f", first).withColumn("first", F.coalesce((F.col("_f.key") == F.col("target")) & (F.col("_f.value") > 0), F.lit(False)))
    recall = lambda k: F.when(F.col("real"), F.coalesce((F.col("rank_real") <= k).cast("double"), F.lit(0.0)))
    grid = grid.withColumns({"brier": F.pow(F.col("p") - F.col("real").cast("double"), F.lit(2)), "recall1": recall(1), "recall5": recall(5), "precision1": F.when(F.col("first"), F.col("real").cast("double"))})
    means = mean_of_means(grid, "entity", [*keys, "target"], ["brier", "recall1", "recall5", "precision1"])
    support = grid.groupBy(*keys, "target").agg(F.count_if("real").alias("support"), F.countDistinct(F.when(F.col("real"), F.col("entity"))).alias("support_entities"))
    return means.join(support, [*keys, "target"])


def binary_backtest(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """Brier, log loss, mean score, base rate, area under the ROC and under the precision-recall curve of a probability."""
    y = positive.cast("double")
    clipped = F.least(F.greatest(F.col(score), F.lit(FLOOR)), F.lit(1 - FLOOR))
    plain = rows.agg(F.count("*").alias("cases"), F.avg(F.pow(F.col(score) - y, F.lit(2))).alias("brier"), F.avg(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("log_loss"), F.avg(score).alias("mean_score"), F.avg(y).alias("base_rate"))
    blocks = running_by_score(rows, score, {"n": F.count("*"), "pos": F.sum(y)})
    neg = F.col("n") - F.col("pos")
    above = F.col("n_before") + F.col("n")
    areas = blocks.agg(
        safe_ratio(F.sum(neg * (F.col("pos_before") + F.col("pos") / 2)), F.max("pos_total") * (F.max("n_total") - F.max("pos_total"))).alias("roc_auc"),
        safe_ratio(F.sum(F.col("pos") * (F.col("pos_before") + F.col("pos")) / above), F.max("pos_total")).alias("pr_auc"),
    )
    return plain.join(F.broadcast(areas))


def paired_losses(pairs: DataFrame, reference: str, candidate: str, keys: list[str]) -> DataFrame:
    """Mean losses, mean difference, and how many cases got better, worse or stayed."""
    delta = F.col(candidate) - F.col(reference)
    return pairs.groupBy(*keys).agg(F.count("*").alias("cases"), F.avg(reference).alias("reference"), F.avg(candidate).alias("candidate"), F.avg(delta).alias("delta"), F.count_if(delta < 0).alias("better"), F.count_if(delta > 0).alias("worse"))


def lost_mass_sensitivity(rows: DataFrame, lost: str, thresholds: list[float], measures: list[str]) -> DataFrame:
    """The measures' means over cases whose lost mass is within each threshold."""
    marks = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    return rows.withColumn("threshold", marks).filter(F.col(lost) <= F.col("threshold")).groupBy("threshold").agg(F.count("*").alias("cases"), *(F.avg(m).alias(m) for m in measures))


def decomposed(pairs: DataFrame, delta: str, dimensions: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Contributions of groups to the mean of entities' mean differences; over all groups they add up to it."""
    weight = 1 / F.count("*").over(Window.partitionBy(*keys, "entity"))
    rows = pairs.withColumn("_w", weight)
    people = pairs.groupBy(*keys).agg(F.countDistinct("entity").alias("_entities"))
    out = rows.groupBy(*keys, *dimensions).agg(F.count("*").alias("cases"), F.countDistinct("entity").alias("entities"), F.sum("_w").alias("mass"), F.sum(F.col(delta) * F.col("_w")).alias("_s"))
    out = out.join(people, list(keys)) if keys else out.join(F.broadcast(people))
    return out.withColumn("contribution", F.col("_s") / F.col("_entities")).drop("_s", "_entities")


def deterioration(pairs: DataFrame, delta: str, worst: tuple[int, ...] = (1, 5, 10), keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of the positive differences that the worst entities have, and quantiles of the entities' means."""
    own = pairs.groupBy(*keys, "entity").agg(F.avg(delta).alias("d"))
    top = own.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, F.lit(0)).orderBy(F.desc("d"), "entity"))).filter(F.col("_n") <= max(worst))
    heads = top.groupBy(*keys).agg(*(F.sum(F.when((F.col("_n") <= k) & (F.col("d") > 0), F.col("d"))).alias(f"_w{k}") for k in worst))
    whole = own.groupBy(*keys).agg(F.count("*").alias("entities"), F.sum(F.when(F.col("d") > 0, F.col("d"))).alias("_total"))
    spread = exact_quantiles(own, "d", [0.05, 0.5, 0.95], keys)
    whole = whole.join(spread, list(keys)) if keys else whole.join(F.broadcast(spread))
    rows = whole.join(heads, list(keys)) if keys else whole.join(F.broadcast(heads))
    return rows.select(*keys, "entities", *(safe_ratio(F.col(f"_w{k}"), F.col("_total")).alias(f"worst_{k}_share") for k in worst), F.col("q")[0].alias("q05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q95"))


def triage(rows: DataFrame, thin: int = 30) -> DataFrame:
    """The likeliest cause of an error: no model, beyond the data, thin tail, parameter at a bound, none of these."""
    # The names that results bear.
    cause = F.when(F.col("at_risk").isNull(), "sem_suporte").when(F.col("extrapolated"), "extrapolado").when(F.col("at_risk") < thin, "cauda_rala").when(F.col("at_bound"), "no_limite").otherwise("nenhum")
    return rows.withColumn("cause", cause)


def recomputed_differences(published: DataFrame, again: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows of published values that a recomputation doesn't confirm: missing, null on one side, or off by more than the tolerance."""
    new = again.select(*keys, *(F.col(v).alias(f"{v}_again") for v in values), F.lit(True).alias("_b"))
    both = published.select(*keys, *values, F.lit(True).alias("_a")).join(new, keys, "full")
    differs = [F.col(v).isNull() != F.col(f"{v}_again").isNull() for v in values] + [F.coalesce(F.abs(F.col(v) - F.col(f"{v}_again")) > tolerance, F.lit(False)) for v in values]
    return both.filter(reduce(lambda a, b: a | b, differs, F.col("_a").isNull() | F.col("_b").isNull()))


def not_identical(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys of both tables whose values aren't the same, nulls included."""
    other = b.select(*keys, *(F.col(v).alias(f"{v}_b") for v in values))
    return a.join(other, keys).filter(reduce(lambda x, v: x | ~F.col(v).eqNullSafe(F.col(f"{v}_b")), values, F.lit(False)))


def extremes(rows: DataFrame, probability: str, keys: list[str], very_low: float = 1e-3, floor: float = FLOOR) -> DataFrame:
    """Very low, clipped and missing probabilities."""
    p = F.col(probability)
    return rows.groupBy(*keys).agg(F.count("*").alias("cases"), F.count_if(p < very_low).alias("very_low"), F.count_if(p < floor).alias("clipped"), F.count_if(p.isNull()).alias("missing"), F.min(p).alias("least"))


def coverage_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cases and entities by status and label."""
    return rows.groupBy(*keys).agg(F.count("*").alias("cases"), F.countDistinct("entity").alias("entities"))
