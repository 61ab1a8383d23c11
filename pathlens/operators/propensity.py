"""Weekly propensity cycle: features, bands, test and control, outcomes, uplift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean_number, safe_ratio
from ..sources.tables import shared_folder
from .relational import any_event_between, average_percent_rank, first_values, history_before

# Upper ends of the percent-rank bands and their names.
BANDS = [(0.01, "Top 1%"), (0.05, "Top 5%"), (0.10, "Top 10%"), (0.20, "Top 20%"), (0.30, "Top 30%"), (0.50, "Top 50%"), (1.0, "Bottom 50%")]
BOTTOM = "Bottom 50%"
TEST, CONTROL = 0, 1


def weekly_window(cohorts: DataFrame, cohort: str = "cohort", hour: int = 5, zone: str = "America/Sao_Paulo") -> DataFrame:
    """[Monday - 7 days, Monday) at `hour` local time as instants; cohorts (yyyyMMdd) that aren't Mondays are marked invalid."""
    day = F.try_to_date(F.col(cohort), "yyyyMMdd")
    at = lambda d: F.to_utc_timestamp(F.timestamp_seconds(F.unix_seconds(d.cast("timestamp")) + hour * 3600), zone)
    rows = cohorts.withColumn("_d", day).withColumn("valid", F.coalesce(F.dayofweek("_d") == 2, F.lit(False)))
    return rows.withColumn("window_start", F.when(F.col("valid"), at(F.date_sub("_d", 7)))).withColumn("window_end", F.when(F.col("valid"), at(F.col("_d")))).drop("_d")


def current_cohort(moments: DataFrame, now: str = "now", hour: int = 5, zone: str = "America/Sao_Paulo") -> DataFrame:
    """The cohort of a moment: the Monday whose `hour` has come, local time."""
    local = F.from_utc_timestamp(F.col(now), zone)
    shifted = F.timestamp_seconds(F.unix_seconds(local) - hour * 3600)
    return moments.withColumn("cohort", F.date_format(F.date_trunc("week", shifted), "yyyyMMdd"))


def eligible_anchors(proposals: DataFrame, statuses: Sequence[str], start: str, end: str, *, status: str = "status", ts: str = "status_ts", product: str | None = None, products: Sequence[str] = ()) -> DataFrame:
    """Distinct proposals of the statuses (and products) whose time lies in [start, end)."""
    at = F.col(ts)
    rows = proposals.filter(F.col(status).isin(list(statuses)) & (at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp")))
    return (rows.filter(F.col(product).isin(list(products))) if product else rows).distinct()


def normalised_people(people: DataFrame, document: str, flags: Sequence[str]) -> DataFrame:
    """Documents reduced to digits, yes/no letters to 1 and 0 (anything else null)."""
    flag = lambda c: F.when(F.upper(F.trim(c)) == "S", 1).when(F.upper(F.trim(c)) == "N", 0)
    return people.withColumn(document, F.regexp_replace(F.col(document).cast("string"), "[^0-9]", "")).withColumns({c: flag(c) for c in flags})


def anchor_table(anchors: DataFrame, people: DataFrame, person: str) -> DataFrame:
    """One row for each person and proposal."""
    return anchors.join(people, person).distinct()


def history_features(anchors: DataFrame, history: DataFrame, entity: str, anchor_ts: str, anchor_id: str, ts: str, record_id: str, statuses: Mapping[str, str], status: str = "status", distinct: Sequence[str] = ()) -> DataFrame:
    """Before the anchor: records, first and last time, counts by status, days since the last, length of the window, no-history
    flag, and of each column in `distinct` (stores, products) the number of different values.

    Records are distinct by id, so counting them is counting proposals; different values count over all rows of history.
    Records and first values stand on one time line, which is written before its rows are
    counted, so that what `history` was joined from is worked out for it once.
    """
    plain = history.select(entity, ts, record_id, status).dropDuplicates([record_id])
    wanted = {"previous": ("count", F.col(record_id)), "first_ts": ("min", F.col("_record_ts") if distinct else F.col(ts)), "last_ts": ("max", F.col("_record_ts") if distinct else F.col(ts))}
    wanted |= {f"previous_{name}": ("sum", (F.col(status) == value).cast("long")) for name, value in statuses.items()}
    names = [f"distinct_{n}" for n in distinct]
    if distinct:
        plain = plain.withColumn("_record_ts", F.col(ts)).unionByName(first_values(history, entity, ts, list(distinct), names), allowMissingColumns=True)
        shared_folder(anchors.sparkSession)
        plain = plain.checkpoint()
        wanted |= {n: ("sum", F.col(n)) for n in names}
    rows = anchors.join(history_before(anchors, plain, entity, anchor_ts, anchor_id, ts, wanted), anchor_id)
    rows = rows.fillna(0, ["previous", *(f"previous_{n}" for n in statuses), *names])
    days = lambda a, b: F.datediff(b, a)
    return rows.withColumn("days_since_last", days(F.col("last_ts"), F.col(anchor_ts))).withColumn("history_days", days(F.col("first_ts"), F.col(anchor_ts))).withColumn("no_history", (F.col("previous") == 0).cast("int")).drop("first_ts", "last_ts")


def relationship_features(anchors: DataFrame, contracts: DataFrame, entity: str, anchor_ts: str, anchor_id: str, start: str, end: str, overdue: Column, products: Mapping[str, Column]) -> DataFrame:
    """Contracts begun before the anchor: active and ended ones, longest, tenure, overdue, and product flags.

    Everything that depends on the anchor only through "before" is a running aggregate;
    contracts ended before it are counted by a second time line.
    """
    begun = {
        "contracts": ("count", F.col(start)),
        "longest_days": ("max", F.datediff(end, start)),
        "first_start": ("min", F.col(start)),
        "overdue": ("max", overdue.cast("int")),
        **{f"has_{n}": ("max", c.cast("int")) for n, c in products.items()},
    }
    rows = history_before(anchors, contracts, entity, anchor_ts, anchor_id, start, begun)
    closed = contracts.filter((F.col(end) > F.col(start)) & F.col(end).isNotNull())
    ended = history_before(anchors, closed, entity, anchor_ts, anchor_id, end, {"ended": ("count", F.col(end))})
    out = anchors.join(rows, anchor_id).join(ended, anchor_id)
    out = out.withColumn("active", F.col("contracts") - F.col("ended")).withColumn("tenure_days", F.datediff(anchor_ts, "first_start"))
    return out.fillna(0, ["contracts", "ended", "active", "overdue", *(f"has_{n}" for n in products)]).drop("first_start")


def mean_features(anchors: DataFrame, history: DataFrame, entity: str, anchor_ts: str, anchor_id: str, ts: str, columns: Sequence[str]) -> DataFrame:
    """Means of numbers over distinct earlier records."""
    plain = history.select(entity, ts, *columns).distinct()
    return history_before(anchors, plain, entity, anchor_ts, anchor_id, ts, {f"mean_{c}": ("avg", F.col(c).cast("double")) for c in columns})


def feature_rows(anchors: DataFrame, anchor_id: str, parts: Sequence[DataFrame], zero: Sequence[str], flagged: Sequence[str]) -> DataFrame:
    """P10: left joins of feature tables; counts become 0, other missing values get a flag; the target is null."""
    out = anchors
    for part in parts:
        out = out.join(part.drop(*(c for c in part.columns if c in out.columns and c != anchor_id)), anchor_id, "left")
    out = out.fillna(0, list(zero)).withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in flagged})
    return out.withColumn("target", F.lit(None).cast("int"))


def cleaned_features(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys and the features in fixed order as finite numbers or nulls."""
    return df.select(*keys, *(clean_number(c).alias(c) for c in columns))


def score_group(score: str | Column, cuts: Sequence[float]) -> Column:
    """1 + the number of cut points below the score; a score at a cut is in the lower group."""
    value = F.col(score) if isinstance(score, str) else score
    return F.when(value.isNotNull(), F.lit(1) + sum(((value > c).cast("int") for c in sorted(cuts)), F.lit(0)))


def with_bands(df: DataFrame, score: str = "score") -> DataFrame:
    """`percent_rank` (descending, ties at their average) and `band`."""
    rows = average_percent_rank(df, score)
    band = F.lit(None).cast("string")
    for top, name in reversed(BANDS):
        band = F.when(F.col("percent_rank") <= top, name).otherwise(band)
    return rows.withColumn("band", F.when(F.col("percent_rank").isNotNull(), band))


def assigned(df: DataFrame, cohort: str, fraction: float = 0.9, *, entity: str = "entity", record: str = "record_id", score: str = "score", salt: str = "experiment") -> DataFrame:
    """Test (0) or control (1) for each entity, the same for all its records.

    The record of the lowest score (ties by id) sets the entity's stratum, its band. The bottom
    band is all control; of any other the first floor(fraction * n) by a salted hash are test.
    Ranks within a stratum are found in two steps, by hash prefixes first, so that no task has
    to sort a whole stratum.
    """
    lowest = df.groupBy(entity).agg(F.min_by("band", F.struct(score, record)).alias("stratum"))
    digest = F.sha2(F.concat_ws("|", F.lit(cohort), F.col(entity).cast("string"), F.lit(salt)), 256)
    people = lowest.withColumn("_h", digest).withColumn("_prefix", F.substring("_h", 1, 2))
    prefixes = people.groupBy("stratum", "_prefix").agg(F.count("*").alias("_k"))
    down = Window.partitionBy("stratum").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    prefixes = prefixes.withColumn("_before", F.coalesce(F.sum("_k").over(down), F.lit(0))).withColumn("_size", F.sum("_k").over(Window.partitionBy("stratum"))).drop("_k")
    ranked = people.join(F.broadcast(prefixes), ["stratum", "_prefix"])  # 256 prefixes a band at most
    place = F.col("_before") + F.row_number().over(Window.partitionBy("stratum", "_prefix").orderBy("_h", entity))
    test = (F.col("stratum") != BOTTOM) & (place <= F.floor(F.col("_size") * fraction + 1e-9))
    groups = ranked.select(entity, "stratum", F.when(test, TEST).otherwise(CONTROL).alias("test_digit"), F.when(F.col("stratum") == BOTTOM, "controle_score_baixo").when(test, "teste").otherwise("controle").alias("control_type"))
    return df.join(groups, entity)


def scored(df: DataFrame, coefficients: Mapping[str, float], intercept: float, threshold: float = 0.5, calibrator: tuple[float, float] | None = None) -> DataFrame:
    """Logistic score of the features (nulls count 0), calibrated on its logit if asked, and whether it passes the threshold."""
    logit = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in coefficients.items()), F.lit(float(intercept)))
    if calibrator:
        logit = logit * calibrator[0] + calibrator[1]
    rows = df.withColumn("score", 1 / (1 + F.exp(-logit)))
    return rows.withColumn("passes", (F.col("score") >= threshold).cast("int"))


def fixed_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order and types; what is missing is null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def matured(cohorts: DataFrame, now: str, days: int = 30, start: str = "window_end") -> DataFrame:
    """Cohorts with so many complete days whose target is still null."""
    return cohorts.filter(F.col("target").isNull() & (F.datediff(F.lit(now).cast("date"), F.to_date(start)) > days))


def attributed(cases: DataFrame, payments: DataFrame, entity: str, start: str, cut: str, ts: str) -> DataFrame:
    """Whether the entity has a payment in [cohort start, run cut)."""
    return any_event_between(cases.withColumn("_cut", F.lit(cut).cast("timestamp")), payments, entity, start, "_cut", ts).drop("_cut").withColumnRenamed("outcome", "target")


def uplift(people: DataFrame, approved: DataFrame, entity: str = "entity", channel: str = "channel", group: str = "control_type") -> DataFrame:
    """Of each channel the test's and control's approvals and rates, the difference in points, the lift in percent, and the control's projected increment; null where a rate has no base."""
    rows = people.select(entity, channel, group).distinct().join(approved.select(entity, F.lit(1).alias("_ok")).distinct(), entity, "left")
    count = lambda g, ok=False: F.count_if((F.col(group) == g) & (F.col("_ok") == 1 if ok else F.lit(True)))
    out = rows.groupBy(channel).agg(count("teste").alias("n_test"), count("teste", True).alias("approved_test"), count("controle").alias("n_control"), count("controle", True).alias("approved_control"))
    t, c = safe_ratio(F.col("approved_test"), F.col("n_test")), safe_ratio(F.col("approved_control"), F.col("n_control"))
    return out.withColumns({"rate_test": F.round(100 * t, 2), "rate_control": F.round(100 * c, 2), "delta_pp": F.round(100 * (t - c), 2), "lift": F.round(100 * (safe_ratio(t, c) - 1), 2), "projected": F.round(F.col("n_control") * (t - c), 2)})


def training_output(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """P20: reference rows for training: target kept, experiment columns absent, a technical key from the row's own key."""
    return df.select(F.sha2(F.concat_ws("|", *(F.col(k).cast("string") for k in keys)), 256).alias("technical_key"), *columns, "target")
