"""The journey tables of the driver's data, from events to steps with memory, labels and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import journey as J
from ..operators import models as K
from ..operators import quality as B
from ..operators import scoring as L
from ..sources import tables as A

CUT, NOW = "2024-01-28", "2024-01-30"
DEBOUNCE, TIMEOUT = 21600.0, 21600.0
TECHNICAL, TARGETS = ["view", "click"], ["error", "purchase", "signup"]
AGES = [0.0, 1800.0, 86400.0, 604800.0]
CHANGES = 3


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to the hour, so that some fall together; state `event type:::band of the value`, depth the value."""
    df = A.read_table(spark, f"{sf_dir}/events.parquet", ["user_id", "ts", "event_type", "value"])
    band = F.when(F.col("value") < 20, "topo").when(F.col("value") < 60, "navegacao").otherwise("sucesso")
    events = A.as_events(df.withColumn("ts", F.date_trunc("hour", F.col("ts").cast("timestamp"))), "user_id", "ts", F.concat_ws(":::", "event_type", band), "value")
    return A.read_events(events, None, CUT)


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.debounced(J.instants_by_depth(raw_events(spark, sf_dir)), DEBOUNCE)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.catalog(raw_events(spark, sf_dir), TECHNICAL)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with censoring, holdout flag, memory, context and weights."""
    rows = B.with_holdout(J.transitions(actions(spark, sf_dir), CUT))
    return J.with_weights(J.with_memory(rows, states(spark, sf_dir)))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.sessions(J.instants(raw_events(spark, sf_dir)), TIMEOUT)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.first_target_labels(steps(spark, sf_dir), TARGETS, CHANGES)


def written_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps, written once for all that a run makes of them."""
    return K.checkpointed(steps(spark, sf_dir))


def current(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Every user of the events with the current state, or none if all events are later than the cut. `rows`: the steps, if they are at hand."""
    people = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("entity")).filter("entity is not null").distinct()
    return J.current_states(steps(spark, sf_dir) if rows is None else rows, people, CUT)


def duration_groups(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Destinations with group, r and p; groups with pi and a Weibull curve by moments of the log."""
    rows = (steps(spark, sf_dir) if rows is None else rows).filter("not holdout and state is not null")
    dests = K.pooled_destinations(rows, ["state"], min_n=20, min_entities=5)
    exact = rows.filter("eligible and censoring = 'exata'").join(dests.select("state", "dest", "grp"), ["state", "dest"])
    fits = K.fit_families(exact, ["state", "grp"]).filter("family = 'weibull'")
    share = dests.groupBy("state", "grp").agg(F.sum("p").alias("pi"))
    return dests, share.join(fits.select("state", "grp", "family", "p1", "p2"), ["state", "grp"])


def censored_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """As `duration_groups`, with log-normal curves fitted to exact and right-censored steps."""
    rows = steps(spark, sf_dir).filter("not holdout and state is not null")
    dests = K.pooled_destinations(rows, ["state"], min_n=20, min_entities=5)
    fits = K.fit_competing_lognormal(rows, dests, ["state"])
    return dests, fits.select("state", "grp", "family", F.col("mu").alias("p1"), F.col("sigma").alias("p2"), "pi")


def silence_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and silences as steps with durations: an action that a silence follows ends at its last event and the timeout."""
    rows = B.with_holdout(J.with_silence(sessions(spark, sf_dir), TIMEOUT, CUT)).withColumnRenamed("next_state", "dest")
    known = F.col("dest").isNotNull() & ~F.coalesce("next_ambiguous", F.lit(True))
    rows = rows.withColumn("dur_min", J.seconds_between("ts", "end_ts")).withColumn("censoring", F.when(F.col("ambiguous"), J.BARRIER).when(known, J.EXACT).otherwise(J.RIGHT))
    return rows.withColumn("dest", F.when(known, F.col("dest"))).withColumn("eligible", ~F.col("ambiguous") & (F.col("dur_min") > 0))


def edges(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Transition edges between states."""
    p = K.transition_frequencies((steps(spark, sf_dir) if rows is None else rows).filter("not holdout"))
    return p.select(F.col("state").alias("src"), F.col("dest").alias("dst"), "p")


def next_state_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = K.transition_frequencies(steps(spark, sf_dir).filter("not holdout"))
    rows = L.next_states(current(spark, sf_dir), model)
    return rows.select("entity", "state", F.round("age", 3).alias("age"), "prediction_status", "rank", F.col("dest").alias("next_state"), F.round("p", 9).alias("p"), F.col("n").alias("support"))
