"""Samples, splits and gates.

A gate is an operator that returns the offending rows; `require_empty` turns it into a stop.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_bucket, hash_order, is_finite


def sample_entities(df: DataFrame, modulus: int, remainder: int = 0, salt: str = "sample", entity: str = "entity") -> DataFrame:
    """The whole history of a reproducible share of the entities."""
    return df.filter(hash_bucket(entity, salt, modulus) == remainder)


def with_holdout(df: DataFrame, modulus: int = 5, salt: str = "holdout", entity: str = "entity") -> DataFrame:
    """`holdout`, the same for all rows of an entity, independent of the sample."""
    return df.withColumn("holdout", hash_bucket(entity, salt, modulus) == 0)


def audience(df: DataFrame, mode: str, *, ids: Iterable[str] = (), modulus: int = 1000, salt: str = "audience", snapshot: str | None = None, cut: str | None = None, max_age_days: int | None = None) -> DataFrame:
    """B03, DM15: distinct entities of the latest snapshot in the scope ALL, SAMPLE (with extra ids) or IDS; stale snapshots stop it."""
    rows = df
    if snapshot:
        last = df.agg(F.max(snapshot).alias("last"))
        if max_age_days is not None:
            age = last.select(F.datediff(F.lit(cut).cast("date"), "last")).first()[0]
            if age is None or not 0 <= age <= max_age_days:
                raise ValueError(f"the latest snapshot is {age} days old")
        rows = df.join(F.broadcast(last), F.col(snapshot) == F.col("last"), "left_semi")  # one row
    chosen = F.col("entity").isin(list(ids))
    scope = {"ALL": F.lit(True), "SAMPLE": (hash_bucket("entity", salt, modulus) == 0) | chosen, "IDS": chosen}[mode]
    return rows.filter(F.col("entity").isNotNull() & scope).select("entity").distinct()


def capped_per_key(df: DataFrame, cap: int, keys: list[str], order: list[str], salt: str = "cap") -> DataFrame:
    """At most `cap` rows a key, those of the smallest hashes; Spark drops the others before the shuffle."""
    by_hash = Window.partitionBy(*keys).orderBy(hash_order(salt, *order), *order)
    return df.withColumn("_place", F.row_number().over(by_hash)).filter(F.col("_place") <= cap).drop("_place")


def event_problems(events: DataFrame, synthetic: str = "sem_acao|__") -> DataFrame:
    """One row with the number of events of each defect."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return events.agg(
        F.count("*").alias("events"),
        F.count_if(blank("entity")).alias("no_entity"),
        F.count_if(blank("state")).alias("no_state"),
        F.count_if(F.col("ts").isNull()).alias("no_time"),
        F.count_if(F.coalesce(F.col("state").rlike(synthetic), F.lit(False))).alias("synthetic_state"),
        F.count_if(F.col("depth").isNotNull() & ~is_finite("depth")).alias("odd_depth"),
    )


def require_empty(df: DataFrame, what: str) -> None:
    """Stop if there are rows."""
    if not df.isEmpty():
        raise ValueError(f"{what}: {df.limit(5).collect()}")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def odd_durations(steps: DataFrame) -> DataFrame:
    """Steps whose bounds don't fit their kind of censoring."""
    low, high = F.col("dur_min"), F.col("dur_max")
    valid = (
        F.when(F.col("censoring") == "exata", (low > 0) & (low == high))
        .when(F.col("censoring") == "intervalo", (low >= 0) & (high > low))
        .when(F.col("censoring") == "direita", (low >= 0) & high.isNull())
        .when(F.col("censoring") == "origem_ambigua", F.lit(True))
    )
    return steps.filter(~F.coalesce(valid, F.lit(False)))


def odd_probabilities(df: DataFrame, keys: list[str], p: str = "p", tolerance: float = 1e-8) -> DataFrame:
    """Keys with probabilities that are null, NaN or outside [0, 1], or that don't add up to 1."""
    bad = F.count_if(F.col(p).isNull() | F.isnan(p) | ~F.col(p).between(0, 1)).alias("bad")
    return df.groupBy(*keys).agg(bad, F.sum(p).alias("total")).filter((F.col("bad") > 0) | (F.abs(F.col("total") - 1) > tolerance))


def coverage_gap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two tables has."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, keys, "left_anti").withColumn("only_in", F.lit("left")).union(right.join(left, keys, "left_anti").withColumn("only_in", F.lit("right")))


def time_leaks(steps: DataFrame, cut: str) -> DataFrame:
    """Steps with evidence after them, times that don't rise or reach the cut, or entities in both splits."""
    by_step = Window.partitionBy("entity").orderBy("step")
    whole = Window.partitionBy("entity")
    rows = steps.withColumn("_before", F.lag("ts").over(by_step)).withColumn("_both", F.min("holdout").over(whole) != F.max("holdout").over(whole))
    late = F.col("evidence_step") > F.col("step") if "evidence_step" in steps.columns else F.lit(False)
    bad = late | (F.col("ts") <= F.col("_before")) | (F.col("ts") >= F.lit(cut).cast("timestamp")) | F.col("_both")
    return rows.filter(F.coalesce(bad, F.lit(False))).drop("_before", "_both")


def odd_rankings(lists: DataFrame, k: int = 5, entity: str = "entity") -> DataFrame:
    """Entities whose ranks have gaps or leave 1..k, whose actions repeat or whose scores rise."""
    by_rank = Window.partitionBy(entity).orderBy("rank")
    rows = lists.withColumn("_above", F.lag("score").over(by_rank))
    found = rows.groupBy(entity).agg(
        F.min("rank").alias("first"), F.max("rank").alias("last"), F.count("*").alias("rows"), F.countDistinct("rank").alias("ranks"), F.countDistinct("action").alias("actions"), F.count_if(F.col("score") > F.col("_above")).alias("rising")
    )
    n = F.col("rows")
    return found.filter((F.col("first") != 1) | (F.col("last") > k) | (F.col("last") != n) | (F.col("ranks") != n) | (F.col("actions") != n) | (F.col("rising") > 0))


def open_masses(df: DataFrame, masses: list[str], tolerance: float = 1e-8) -> DataFrame:
    """Rows whose masses are null, negative or don't add up to 1."""
    total = sum((F.col(c) for c in masses), F.lit(0.0))
    negative = F.least(*masses, F.lit(0.0)) < -tolerance
    return df.filter(F.coalesce((F.abs(total - 1) > tolerance) | negative, F.lit(True)))


def freshness(events: DataFrame, now: str, cut: str | None = None, max_lag_hours: float = 72) -> DataFrame:
    """The cut (given, or the last time that isn't in the future), its lag in hours, whether that is too long, and future events."""
    present = F.lit(now).cast("timestamp")
    seen = events.agg(F.min("ts").alias("first_ts"), F.max(F.when(F.col("ts") <= present, F.col("ts"))).alias("last_ts"), F.count_if(F.col("ts") > present).alias("future_events"))
    cut_ts = F.lit(cut).cast("timestamp") if cut else F.col("last_ts")
    lag = (F.unix_micros(present) - F.unix_micros(cut_ts)) / F.lit(3.6e9)
    return seen.withColumn("cut", cut_ts).withColumn("lag_hours", lag).withColumn("stale", F.coalesce(lag > max_lag_hours, F.lit(True)))


def daily_coverage(events: DataFrame, days: DataFrame) -> DataFrame:
    """Events and entities of each calendar day, 0 for missing days."""
    found = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"), F.countDistinct("entity").alias("entities"))
    return days.join(found, "day", "left").fillna(0, ["events", "entities"])


def normalised_ids(df: DataFrame, column: str, digits: int = 11) -> DataFrame:
    """Trimmed ids with `valid` (so many digits, nothing else) and `repeated`."""
    text = F.trim(F.col(column).cast("string"))
    rows = df.withColumn(column, text).withColumn("valid", F.coalesce(F.col(column).rlike(f"^[0-9]{{{digits}}}$"), F.lit(False)))
    return rows.withColumn("repeated", F.count("*").over(Window.partitionBy(column)) > 1)


def name_differences(found: Iterable[str], expected: Iterable[str]) -> dict[str, list[str]]:
    """Names that only one list has."""
    a, b = set(found), set(expected)
    return {"unexpected": sorted(a - b), "missing": sorted(b - a)}


def table_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with their number, that only one of two tables has."""
    columns = a.columns
    b = b.select(*columns)
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).union(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def count_reconciliation(tables: Mapping[str, DataFrame], keys: list[str], measures: Mapping[str, Column]) -> DataFrame:
    """The same measures of several tables by key, side by side, 0 where a table lacks the key, and whether all agree."""
    out, names = None, []
    for name, df in tables.items():
        part = df.groupBy(*keys).agg(*(m.alias(f"{name}_{c}") for c, m in measures.items()))
        out = part if out is None else out.join(part, keys, "full")
        names += [f"{name}_{c}" for c in measures]
    out = out.fillna(0, names)
    same = F.lit(True)
    for c in measures:
        values = [F.col(f"{name}_{c}") for name in tables]
        same = same & (F.greatest(*values) == F.least(*values))
    return out.withColumn("agree", same)


def within_limit(df: DataFrame, n: int, what: str) -> DataFrame:
    """Df, if it has at most n rows; it is never cut."""
    if df.limit(n + 1).count() > n:
        raise ValueError(f"{what} has more than {n} rows")
    return df
