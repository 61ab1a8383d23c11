"""Descriptive diagnostics of journeys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio
from .relational import distinct_day_gaps, exact_quantiles, share_of, with_constants


def presence(rows: DataFrame, what: str = "macro") -> DataFrame:
    """Share of the volume, share of entities that have it, mean share within entities (0 where they lack it)."""
    own = rows.groupBy("entity", what).agg(F.count("*").alias("n"))
    own = share_of(own, ["entity"], "n", "own_share")
    totals = rows.agg(F.count("*").alias("_rows"), F.countDistinct("entity").alias("_entities"))
    out = with_constants(own.groupBy(what).agg(F.sum("n").alias("volume"), F.count("*").alias("entities"), F.sum("own_share").alias("_s")), totals)
    return out.select(what, "volume", "entities", (F.col("volume") / F.col("_rows")).alias("volume_share"), (F.col("entities") / F.col("_entities")).alias("penetration"), (F.col("_s") / F.col("_entities")).alias("mean_share"))


def concentration(rows: DataFrame, what: str = "macro", bands: tuple[int, ...] = (10, 100)) -> DataFrame:
    """Of each entity the Herfindahl index, effective number, entropy in bits, dominant share and volume band."""
    own = share_of(rows.groupBy("entity", what).agg(F.count("*").alias("n")), ["entity"], "n", "p")
    out = own.groupBy("entity").agg(F.sum("n").alias("volume"), F.sum(F.col("p") * F.col("p")).alias("hhi"), F.sum(-F.col("p") * F.log2("p")).alias("entropy"), F.max("p").alias("dominant"))
    band = F.size(F.filter(F.array(*(F.lit(b) for b in bands)), lambda b: b <= F.col("volume")))
    return out.withColumn("effective", 1 / F.col("hhi")).withColumn("volume_band", band)


def context_dependence(triples: DataFrame, least: int = 1) -> DataFrame:
    """p(next | previous, focus) beside p(next | focus), for complete triples."""
    known = triples.filter("complete")
    pairs = known.groupBy("previous", "focus", "next").agg(F.count("*").alias("n"))
    pairs = pairs.withColumn("given", F.sum("n").over(Window.partitionBy("previous", "focus"))).withColumn("p_given", F.col("n") / F.col("given"))
    base = known.groupBy("focus", "next").agg(F.count("*").alias("m"))
    base = base.withColumn("p_all", F.col("m") / F.sum("m").over(Window.partitionBy("focus"))).drop("m")
    order = Window.partitionBy("previous", "focus").orderBy(F.desc("n"), "next")
    return pairs.filter(F.col("given") >= least).join(base, ["focus", "next"]).withColumn("difference", F.col("p_given") - F.col("p_all")).withColumn("rank", F.row_number().over(order))


def calendar_rates(rows: DataFrame, actions: list[str]) -> DataFrame:
    """Share of active entity-days with each action, by third of the month, weekday and month."""
    days = rows.groupBy("entity", F.to_date("ts").alias("day")).agg(*(F.max((F.col("macro") == a).cast("int")).alias(f"_{i}") for i, a in enumerate(actions)))
    third = F.when(F.dayofmonth("day") <= 10, "inicio").when(F.dayofmonth("day") <= 20, "meio").otherwise("fim")
    parts = F.explode(F.array(F.struct(F.lit("third").alias("calendar"), third.alias("part")), F.struct(F.lit("weekday").alias("calendar"), F.dayofweek("day").cast("string").alias("part")), F.struct(F.lit("month").alias("calendar"), F.date_format("day", "yyyy-MM").alias("part"))))
    sums = days.withColumn("c", parts).groupBy("c.calendar", "c.part").agg(F.count("*").alias("active_days"), *(F.sum(f"_{i}").alias(f"_{i}") for i in range(len(actions))))
    stacked = F.explode(F.array(*(F.struct(F.lit(a).alias("action"), F.col(f"_{i}").alias("days")) for i, a in enumerate(actions))))
    return sums.withColumn("a", stacked).select("calendar", "part", "a.action", "active_days", F.col("a.days").alias("action_days"), safe_ratio(F.col("a.days"), F.col("active_days")).alias("rate"))


def recurrence(rows: DataFrame) -> DataFrame:
    """Quantiles of the days between an entity's distinct days of an action, and entities and months that have it."""
    gaps = distinct_day_gaps(rows, ["entity", "macro"], "ts")
    out = gaps.groupBy("macro").agg(F.count("gap_days").alias("gaps"), F.countDistinct("entity").alias("entities"), F.countDistinct("entity", F.trunc("day", "month")).alias("entity_months"))
    out = out.join(exact_quantiles(gaps, "gap_days", [0.25, 0.5, 0.75], ("macro",)), "macro", "left")
    return out.select("macro", "gaps", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "entities", "entity_months")


def collisions(events: DataFrame) -> DataFrame:
    """Combinations of states at one time of one entity, and whether families or only stages differ."""
    at = events.groupBy("entity", "ts").agg(F.sort_array(F.collect_set("state")).alias("states"), F.countDistinct(F.split("state", ":::")[0]).alias("families")).filter(F.size("states") > 1)
    kind = F.when(F.col("families") > 1, "familias").otherwise("etapas")
    return at.groupBy(kind.alias("kind"), F.array_join("states", "+").alias("combination")).agg(F.count("*").alias("instants"), F.countDistinct("entity").alias("entities"))


def debounce_effect(instants: DataFrame, actions: DataFrame) -> DataFrame:
    """Instants and actions, bursts of several instants, and instants absorbed."""
    a = instants.agg(F.count("*").alias("instants"), F.count_if("ambiguous").alias("ambiguous"))
    b = actions.agg(F.count("*").alias("actions"), F.count_if(F.col("n_instants") > 1).alias("bursts"), F.sum(F.col("n_instants") - 1).alias("absorbed"))
    return a.join(F.broadcast(b))


def self_transitions(steps: DataFrame, quick: tuple[float, ...] = (30, 300)) -> DataFrame:
    """Exact self-transitions of each state and the shares of quick ones."""
    rows = steps.filter("self_transition")
    return rows.groupBy("state").agg(F.count("*").alias("self_transitions"), *(F.avg((F.col("dur_min") <= q).cast("double")).alias(f"within_{q:g}s") for q in quick))


def censoring_by_state(steps: DataFrame) -> DataFrame:
    """Steps by kind of censoring, and exact quantiles of exact durations."""
    exact = F.when(F.col("censoring") == "exata", F.col("dur_min"))
    rows = steps.filter("state is not null").withColumn("_d", exact).groupBy("state").agg(F.count("*").alias("steps"), F.count("_d").alias("exact"), F.count_if(F.col("censoring") == "direita").alias("right_censored"))
    rows = rows.join(exact_quantiles(steps.filter("state is not null").withColumn("_d", exact), "_d", [0.5, 0.9], ("state",)), "state", "left")
    return rows.select("state", "steps", "exact", "right_censored", F.col("q")[0].alias("median"), F.col("q")[1].alias("q90"))


def list_concentration(lists: DataFrame, k: int = 5) -> DataFrame:
    """Different lists, share of the commonest, mean margin of the first over the second, mass in and outside the list."""
    own = lists.groupBy("entity").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("rank", "action"))), lambda e: e.action)).alias("signature"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.sum("score").alias("mass"))
    by = own.groupBy("signature").agg(F.count("*").alias("n"))
    heads = by.agg(F.count("*").alias("lists"), F.max("n").alias("_most"), F.sum("n").alias("entities"))
    tails = own.agg(F.avg(F.col("first") - F.coalesce("second", F.lit(0.0))).alias("margin"), F.avg("mass").alias("mass"))
    return heads.join(F.broadcast(tails)).select("entities", "lists", (F.col("_most") / F.col("entities")).alias("commonest_share"), "margin", "mass", (1 - F.col("mass")).alias("outside"))


def target_coverage(lists: DataFrame, targets: DataFrame) -> DataFrame:
    """Of each target the entities that have it in their list, at the first place, and quantiles of its score; absent targets stay."""
    totals = lists.agg(F.countDistinct("entity").alias("_all"))
    found = lists.groupBy("action").agg(F.countDistinct("entity").alias("entities"), F.count_if(F.col("rank") == 1).alias("first"), F.avg("score").alias("mean_score"))
    found = found.join(exact_quantiles(lists, "score", [0.5], ("action",)), "action", "left").withColumn("median_score", F.col("q")[0]).drop("q")
    out = with_constants(targets.select("action").distinct().join(found, "action", "left").fillna(0, ["entities", "first"]), totals)
    return out.withColumn("share", safe_ratio(F.col("entities"), F.col("_all"))).drop("_all")


def first_by_condition(lists: DataFrame, edges: tuple[float, ...] = (1800, 86400, 604800)) -> DataFrame:
    """The first action by state, memory and band of the age."""
    band = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= F.col("age")))
    rows = lists.filter("rank = 1").groupBy("state", F.coalesce("memory", F.lit("-")).alias("memory"), band.alias("age_band"), "action").agg(F.count("*").alias("entities"))
    return share_of(rows, ["state", "memory", "age_band"], "entities")


def target_evidence(steps: DataFrame, targets: DataFrame) -> DataFrame:
    """Prepared steps, entities and exact entries of each target in training."""
    entries = ~F.coalesce(F.lag("macro").over(Window.partitionBy("entity").orderBy("step")) == F.col("macro"), F.lit(False))
    rows = steps.withColumn("_entry", entries).filter(~F.col("holdout"))
    found = rows.groupBy(F.col("macro").alias("action")).agg(F.count("*").alias("steps"), F.countDistinct("entity").alias("entities"), F.count_if(F.col("_entry") & (F.col("step") > 1)).alias("entries"))
    return targets.select("action").distinct().join(found, "action", "left").fillna(0)


def outside_lists(kernels: DataFrame, case: list[str], k: int = 5) -> DataFrame:
    """Targets with a positive score beyond the k best of a kernel: how often, and their best rank."""
    rows = kernels.filter("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy(*case).orderBy(F.desc("score"), "action")))
    return rows.groupBy("action").agg(F.count("*").alias("kernels"), F.count_if(F.col("rank") > k).alias("outside"), F.min("rank").alias("best_rank"))


def memory_coverage(steps: DataFrame) -> DataFrame:
    """Steps and entities by context kind and split, with the weights' sums."""
    kind = F.when(F.col("context").isNull(), "barreira").when(F.col("context").isin("__BASE__", "__SEM_MEMORIA__"), F.col("context")).otherwise("memoria")
    return steps.groupBy(kind.alias("context_kind"), "holdout").agg(F.count("*").alias("steps"), F.countDistinct("entity").alias("entities"), F.sum("event_weight").alias("event_weight"), F.sum("entity_weight").alias("entity_weight"))


def operational_audit(people: DataFrame, lists: DataFrame) -> DataFrame:
    """Coverage of the audience, spread of the scores, and different first actions."""
    missing = people.select("entity").distinct().join(lists.select("entity").distinct(), "entity", "left_anti").agg(F.count("*").alias("without_list"))
    size = people.agg(F.countDistinct("entity").alias("audience"))
    spread = lists.agg(F.countDistinct("entity").alias("with_list"), F.stddev_pop("score").alias("score_sd"), F.countDistinct(F.when(F.col("rank") == 1, F.col("action"))).alias("first_actions"))
    return size.join(F.broadcast(missing)).join(F.broadcast(spread))


def list_shapes(lists: DataFrame, k: int = 5) -> DataFrame:
    """How many lists have which shape: rows, different ranks and actions, first and last rank, scores that are null, NaN or
    outside [0, 1], rising scores; and whether the shape is an anomaly for lists of k."""
    above = F.lag("score").over(Window.partitionBy("entity").orderBy("rank"))
    invalid = F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1)
    own = lists.withColumn("_above", above).groupBy("entity").agg(
        F.count("*").alias("rows"), F.countDistinct("rank").alias("ranks"), F.countDistinct("action").alias("actions"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"),
        F.count_if(invalid).alias("invalid_scores"), F.count_if(F.col("score") > F.col("_above")).alias("rising_scores"),
    )
    odd = (F.col("rows") != k) | (F.col("ranks") != k) | (F.col("actions") != k) | (F.col("first_rank") != 1) | (F.col("last_rank") != k) | (F.col("invalid_scores") > 0) | (F.col("rising_scores") > 0)
    return own.groupBy(*own.columns[1:]).agg(F.count("*").alias("lists")).withColumn("anomaly", odd)


def variation_by_state(people: DataFrame, lists: DataFrame) -> DataFrame:
    """Of each state the entities, their different contexts and first actions, and the spread of the first scores; entities without a list count too."""
    top = lists.filter("rank = 1").select("entity", "action", "score")
    rows = people.filter("state is not null").select("entity", "state", "context").dropDuplicates(["entity"]).join(top, "entity", "left")
    return rows.groupBy("state").agg(F.count("*").alias("entities"), F.countDistinct("context").alias("contexts"), F.countDistinct("action").alias("first_actions"), F.countDistinct(F.round("score", 6)).alias("scores"), F.stddev_pop("score").alias("score_sd"))
