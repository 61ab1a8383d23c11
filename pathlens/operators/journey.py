"""State sequences: from events to instants, actions, steps, memory and labels.

Columns: events have entity, ts, state, depth; instants one row for each entity and time;
actions one for each burst, with `step` counting from 1. All windows are partitioned by the
entity, so one shuffle by entity serves a whole chain of these operators.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micros, seconds_between, state_part

# The names that results bear.
NO_MEMORY, BASE = "__SEM_MEMORIA__", "__BASE__"
EXACT, INTERVAL, RIGHT, BARRIER = "exata", "intervalo", "direita", "origem_ambigua"
SILENCE = "sem_acao"
HIT, MISSED, CENSORED = "ALVO_OBSERVADO", "HORIZONTE_OBSERVADO_SEM_ALVO", "CENSURADO_ANTES_HORIZONTE"


def by_time():
    return Window.partitionBy("entity").orderBy("ts")


def by_step():
    return Window.partitionBy("entity").orderBy("step")


to_here = (Window.unboundedPreceding, Window.currentRow)


def islands(df: DataFrame, starts: Column, name: str, order=None) -> DataFrame:
    """`name` counts the rows so far at which an island starts."""
    return df.withColumn(name, F.sum(starts.cast("int")).over((order or by_time()).rowsBetween(*to_here)))


def instants(events: DataFrame) -> DataFrame:
    """All states of an entity at one time, sorted; more than one is ambiguous and has no state."""
    rows = events.groupBy("entity", "ts").agg(F.sort_array(F.collect_set("state")).alias("states"), F.count("*").alias("n_events"))
    ambiguous = F.size("states") > 1
    return rows.select("entity", "ts", F.when(~ambiguous, F.try_element_at("states", F.lit(1))).alias("state"), ambiguous.alias("ambiguous"), "n_events", "states")


def instants_by_depth(events: DataFrame) -> DataFrame:
    """The state of the greatest depth (null counts -1) at each time; a tie is ambiguous."""
    states = events.groupBy("entity", "ts", "state").agg(F.coalesce(F.max("depth"), F.lit(-1.0)).alias("depth"), F.count("*").alias("n"))
    deepest = F.col("depth") == F.max("depth").over(Window.partitionBy("entity", "ts"))
    rows = states.withColumn("deepest", deepest).groupBy("entity", "ts")
    rows = rows.agg(F.count_if("deepest").alias("tied"), F.count("*").alias("candidates"), F.max(F.when(F.col("deepest"), F.col("state"))).alias("state"), F.sum("n").alias("n_events"))
    single = F.col("tied") == 1
    return rows.select("entity", "ts", F.when(single, F.col("state")).alias("state"), (~single).alias("ambiguous"), "n_events", (single & (F.col("candidates") > 1)).alias("resolved_by_depth"))


def instants_with_candidates(events: DataFrame) -> DataFrame:
    """As C02, with the array of all states that tie at the greatest depth; depths are compared null-safe."""
    top = F.max("depth").over(Window.partitionBy("entity", "ts"))
    rows = events.withColumn("_top", top).filter(F.col("depth").eqNullSafe(F.col("_top")))
    rows = rows.groupBy("entity", "ts").agg(F.sort_array(F.collect_set("state")).alias("candidates"), F.count("*").alias("n_events"))
    return rows.withColumn("ambiguous", F.size("candidates") > 1).withColumn("state", F.when(~F.col("ambiguous"), F.try_element_at("candidates", F.lit(1))))


def imprecise_days(events: DataFrame, rows: DataFrame, cut: str) -> DataFrame:
    """Days for which an entity has rows without time of day (ts at midnight in `rows`) become one barrier from
    midnight to the next midnight or the cut; other events of such a day go."""
    days = rows.select("entity", F.to_date("ts").alias("day")).distinct()
    kept = events.withColumn("day", F.to_date("ts")).join(days, ["entity", "day"], "left_anti").drop("day")
    end = F.least(F.date_add("day", 1).cast("timestamp"), F.lit(cut).cast("timestamp"))
    barriers = days.select("entity", F.col("day").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("state"), F.lit(True).alias("ambiguous"), end.alias("end_ts"), F.lit(True).alias("imprecise"))
    return kept.withColumn("ambiguous", F.lit(False)).withColumn("end_ts", F.col("ts")).withColumn("imprecise", F.lit(False)).unionByName(barriers, allowMissingColumns=True)


def sessions(rows: DataFrame, timeout: float) -> DataFrame:
    """Blocks of one state whose gaps, from the end of what was indefinite before, are within the timeout."""
    end = F.col("end_ts") if "end_ts" in rows.columns else F.col("ts")
    gap = seconds_between(F.lag(end).over(by_time()), "ts")
    same = (F.col("state") == F.lag("state").over(by_time())) & ~F.col("ambiguous") & ~F.lag("ambiguous").over(by_time()) & (gap <= timeout)
    marked = islands(rows.withColumn("_end", end), ~F.coalesce(same, F.lit(False)), "block")
    return marked.groupBy("entity", "block").agg(F.min("ts").alias("start_ts"), F.max("_end").alias("last_ts"), F.max("state").alias("state"), F.max("ambiguous").alias("ambiguous"), F.count("*").alias("n_instants"))


def debounced(rows: DataFrame, seconds: float) -> DataFrame:
    """Repeats of a state within so many seconds of the instant before, neither ambiguous, are one action, timed by its last instant."""
    previous = F.lag("state").over(by_time())
    quick = seconds_between(F.lag("ts").over(by_time()), "ts") <= seconds
    repeat = (F.col("state") == previous) & ~F.col("ambiguous") & ~F.coalesce(F.lag("ambiguous").over(by_time()), F.lit(False)) & quick
    bursts = islands(rows, ~F.coalesce(repeat, F.lit(False)), "step")
    return bursts.groupBy("entity", "step").agg(F.max("ts").alias("ts"), F.min("ts").alias("first_ts"), F.max("state").alias("state"), F.max("ambiguous").alias("ambiguous"), F.sum("n_events").alias("n_events"), F.count("*").alias("n_instants"))


def with_silence(blocks: DataFrame, timeout: float, cut: str) -> DataFrame:
    """Blocks and the silences between them, numbered: the silence starts exactly at the last event + timeout,
    if that lies before the cut and the next block. Carries the last action, and whether the start was observed."""
    order = Window.partitionBy("entity").orderBy("block")
    end = F.lit(cut).cast("timestamp")
    imprecise = F.col("imprecise") if "imprecise" in blocks.columns else F.lit(False)
    rows = blocks.withColumn("next_start", F.lead("start_ts").over(order))
    limit = F.timestamp_micros((micros("last_ts") + F.lit(int(timeout * 1e6))).cast("long"))
    rows = rows.withColumn("timeout_ts", limit)
    silent = ~imprecise & (F.col("timeout_ts") < end) & (F.col("next_start").isNull() | (F.col("timeout_ts") < F.col("next_start")))
    rows = rows.withColumn("silent", silent)
    seen = F.lag("start_ts").over(order).isNotNull() & (~F.coalesce(F.lag("ambiguous").over(order), F.lit(True)) | F.coalesce(F.lag("silent").over(order), F.lit(False)))
    rows = rows.withColumn("start_observed", seen)
    after = F.coalesce("next_start", end)
    active = rows.select("entity", "block", F.lit(0).alias("part"), F.col("start_ts").alias("ts"), "state", "ambiguous", F.col("state").alias("last_action"), F.when(F.col("silent"), F.col("timeout_ts")).otherwise(after).alias("end_ts"), "start_observed")
    quiet = rows.filter("silent").select("entity", "block", F.lit(1).alias("part"), F.col("timeout_ts").alias("ts"), F.lit(SILENCE).alias("state"), F.lit(False).alias("ambiguous"), F.col("state").alias("last_action"), after.alias("end_ts"), F.lit(True).alias("start_observed"))
    numbered = Window.partitionBy("entity").orderBy("block", "part")
    both = active.unionByName(quiet)
    return both.withColumn("step", F.row_number().over(numbered)).withColumn("next_state", F.lead("state").over(numbered)).withColumn("next_ambiguous", F.lead("ambiguous").over(numbered))


def interval_censored(blocks: DataFrame, timeout: float, cut: str) -> DataFrame:
    """Blocks and silences on the session clock, where it isn't known when in the timeout an action ended.

    Exact if the next block starts within the timeout; right-censored if the closing time
    isn't before the cut; else between the block's span and span + timeout. A silence lasts
    between gap - timeout and gap, or, without a next block, at least to the cut.
    """
    order = Window.partitionBy("entity").orderBy("block")
    end = F.lit(cut).cast("timestamp")
    rows = blocks.withColumn("next_start", F.lead("start_ts").over(order)).withColumn("next_block_state", F.lead("state").over(order)).withColumn("next_block_ambiguous", F.lead("ambiguous").over(order))
    span, gap = seconds_between("start_ts", "last_ts"), seconds_between("last_ts", "next_start")
    to_cut = seconds_between("last_ts", end)
    rows = rows.withColumn("span", span).withColumn("gap", gap).withColumn("to_cut", to_cut)
    quick = F.coalesce(F.col("gap") <= timeout, F.lit(False))
    open_end = F.col("next_start").isNull() & (F.col("to_cut") <= timeout)
    kind = F.when(F.col("ambiguous"), BARRIER).when(open_end, RIGHT).when(quick, EXACT).otherwise(INTERVAL)
    rows = rows.withColumn("censoring", kind)
    exact = F.col("span") + F.col("gap")
    active = rows.select(
        "entity", "block", F.lit(0).alias("part"), "state", "ambiguous", "censoring",
        F.when(F.col("censoring") == EXACT, exact).when(F.col("censoring") == RIGHT, F.col("span") + F.col("to_cut")).otherwise(F.col("span")).alias("dur_min"),
        F.when(F.col("censoring") == EXACT, exact).when(F.col("censoring") == INTERVAL, F.col("span") + timeout).alias("dur_max"),
    )
    followed = F.col("next_start").isNotNull()
    quiet = rows.filter(~open_end & ~quick).select(
        "entity", "block", F.lit(1).alias("part"), F.lit(SILENCE).alias("state"), F.lit(False).alias("ambiguous"),
        F.when(followed, INTERVAL).otherwise(RIGHT).alias("censoring"),
        F.when(followed, F.col("gap") - timeout).otherwise(F.col("to_cut") - timeout).alias("dur_min"),
        F.when(followed, F.col("gap")).alias("dur_max"),
    )
    numbered = Window.partitionBy("entity").orderBy("block", "part")
    both = active.unionByName(quiet)
    both = both.withColumn("step", F.row_number().over(numbered)).withColumn("dest", F.lead("state").over(numbered)).withColumn("_dest_ambiguous", F.lead("ambiguous").over(numbered))
    status = F.when(F.col("ambiguous"), "origem_ambigua").when(F.col("censoring") == RIGHT, "censurada").when(F.col("_dest_ambiguous"), "destino_ambiguo").otherwise("observada")
    return both.withColumn("status", status).withColumn("eligible", ~F.col("ambiguous")).drop("_dest_ambiguous")


def transitions(actions: DataFrame, cut: str) -> DataFrame:
    """C11: steps with destination and duration, exact or right-censored (no next action, or an ambiguous one)."""
    following = F.lead("ts").over(by_time())
    rows = actions.withColumn("_next", following).withColumn("_dest", F.lead("state").over(by_time())).withColumn("_barrier", F.lead("ambiguous").over(by_time()))
    kind = F.when(F.col("ambiguous"), BARRIER).when(F.col("_next").isNull() | F.col("_barrier"), RIGHT).otherwise(EXACT)
    rows = rows.withColumn("censoring", kind).withColumn("dur_min", seconds_between("ts", F.coalesce("_next", F.lit(cut).cast("timestamp"))))
    exact = F.col("censoring") == EXACT
    return (
        rows.withColumn("dest", F.when(exact, F.col("_dest")))
        .withColumn("dur_max", F.when(exact, F.col("dur_min")))
        .withColumn("eligible", ~F.col("ambiguous") & (F.col("dur_min") > 0))
        .withColumn("self_transition", F.coalesce(F.col("dest") == F.col("state"), F.lit(False)))
        .drop("_next", "_dest", "_barrier")
    )


def current_states(actions: DataFrame, people: DataFrame, cut: str) -> DataFrame:
    """C14: each entity's last action with its age at the cut; entities without history stay."""
    latest = Window.partitionBy("entity").orderBy(F.desc("ts"))
    keep = [c for c in ("state", "ambiguous", "ts", "step", "memory", "context") if c in actions.columns]
    last = actions.join(people, "entity", "left_semi").withColumn("_n", F.row_number().over(latest)).filter("_n = 1").select("entity", *keep)
    status = F.when(F.col("ts").isNull(), "sem_historico").when(F.col("ambiguous"), "ambiguo").otherwise("ok")
    return people.join(last, "entity", "left").withColumn("input_status", status).withColumn("age", seconds_between("ts", F.lit(cut).cast("timestamp")))


def catalog(events: DataFrame, technical: list[str], service: str = "atendimento") -> DataFrame:
    """C15, DM3: states with funnel (null for service channels), stage, type, macro action and whether technical."""
    family, stage = state_part("state", 0), state_part("state", 1)
    channel = F.coalesce(family == service, F.lit(False))
    return events.select("state").filter("state is not null").distinct().select(
        "state",
        F.when(~channel, family).alias("funnel"),
        F.when(~channel, stage).alias("stage"),
        F.when(channel, "canal").when(family.isin(technical), "tecnico").otherwise("negocio").alias("kind"),
        F.when(channel, F.concat(F.lit(f"{service}_"), F.coalesce(stage, F.lit("")))).otherwise(family).alias("macro"),
        family.isin(technical).alias("technical"),
    )


def macro_summary(events: DataFrame, states: DataFrame) -> DataFrame:
    """Events, states and the sorted stages and kinds of each macro action."""
    counts = events.groupBy("state").agg(F.count("*").alias("n"))
    joined = states.join(counts, "state", "left")
    return joined.groupBy("macro").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.countDistinct("state").alias("states"), F.sort_array(F.collect_set("stage")).alias("stages"), F.sort_array(F.collect_set("kind")).alias("kinds"))


def with_memory(steps: DataFrame, states: DataFrame, gap: bool = True) -> DataFrame:
    """`memory`, the last business funnel so far with its step and time, and the `context` that models use.

    Memory is kept within a segment: a new one starts at the first step, at a barrier, after
    one, and at a gap of step numbers. Service channels keep it and never set it. `states` is
    the catalog, a row a state.
    """
    rows = steps.join(states.select("state", "funnel", "macro", "technical"), "state", "left")
    barrier = F.col("ambiguous") | F.col("state").isNull()
    rows = rows.withColumn("barrier", barrier)
    broken = F.lag("step").over(by_step()).isNull() | F.col("barrier") | F.coalesce(F.lag("barrier").over(by_step()), F.lit(True))
    if gap:
        broken = broken | (F.col("step") - F.lag("step").over(by_step()) > 1)
    rows = islands(rows, broken, "segment", by_step())
    evidence = F.when(~F.col("barrier") & F.col("funnel").isNotNull() & ~F.col("technical"), F.struct(F.col("funnel").alias("funnel"), F.col("step").alias("step"), F.col("ts").alias("ts")))
    prefix = Window.partitionBy("entity", "segment").orderBy("step").rowsBetween(*to_here)
    rows = rows.withColumn("_m", F.last(evidence, ignorenulls=True).over(prefix))
    rows = rows.withColumn("memory", F.col("_m.funnel")).withColumn("evidence_step", F.col("_m.step")).withColumn("evidence_ts", F.col("_m.ts")).drop("_m")
    context = F.when(F.col("barrier"), F.lit(None)).when(F.col("technical"), F.coalesce("memory", F.lit(NO_MEMORY))).otherwise(F.lit(BASE))
    return rows.withColumn("context", context)


def with_weights(steps: DataFrame) -> DataFrame:
    """C20: weight 1 an event, and 1/n for an entity's n eligible training rows of one origin; none for the holdout."""
    used = F.col("eligible") & ~F.col("holdout")
    n = F.sum(used.cast("int")).over(Window.partitionBy("entity", "state"))
    return steps.withColumn("event_weight", F.when(used, F.lit(1.0))).withColumn("entity_weight", F.when(used, 1 / n))


def funnel_blocks(steps: DataFrame) -> DataFrame:
    """Runs of steps of one macro action, with the state that entered them."""
    changed = ~F.coalesce(F.col("macro") == F.lag("macro").over(by_step()), F.lit(False))
    rows = islands(steps, changed, "block", by_step())
    entry = F.min(F.struct("step", "state", "ts"))
    return rows.groupBy("entity", "block").agg(F.max("macro").alias("macro"), entry.alias("e"), F.count("*").alias("steps"), F.max("ts").alias("last_ts")).select("entity", "block", "macro", F.col("e.step").alias("first_step"), F.col("e.state").alias("entry_state"), F.col("e.ts").alias("start_ts"), "last_ts", "steps")


def block_triples(blocks: DataFrame) -> DataFrame:
    """Previous, focus and next block, and whether both neighbours are known."""
    order = Window.partitionBy("entity").orderBy("block")
    rows = blocks.select("entity", "block", F.lag("macro").over(order).alias("previous"), F.col("macro").alias("focus"), F.lead("macro").over(order).alias("next"), "entry_state")
    return rows.withColumn("complete", F.col("previous").isNotNull() & F.col("next").isNotNull())


def trajectories(steps: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """`trajectory` numbers runs of steps that are linked: exact, consecutive, destination and duration as the next step has them."""
    linked = (
        (F.col("censoring") == EXACT)
        & (F.lead("step").over(by_step()) == F.col("step") + 1)
        & F.col("eligible")
        & ~F.coalesce(F.lead("ambiguous").over(by_step()), F.lit(True))
        & F.col("dest").eqNullSafe(F.lead("state").over(by_step()))
        & (F.abs(seconds_between("ts", F.lead("ts").over(by_step())) - F.col("dur_min")) <= tolerance)
    )
    rows = steps.withColumn("linked", F.coalesce(linked, F.lit(False)))
    return islands(rows, ~F.coalesce(F.lag("linked").over(by_step()), F.lit(False)), "trajectory", by_step())


def first_target_labels(steps: DataFrame, targets: list[str], k: int, tolerance: float = 1e-3) -> DataFrame:
    """For each step the first target among the next k macro actions of its trajectory, or why there is none.

    Runs of one macro are one block; coming back after leaving counts. An incomplete future
    is censored, never a miss.
    """
    rows = trajectories(steps, tolerance)
    order = Window.partitionBy("entity", "trajectory").orderBy("step")
    changed = ~F.col("macro").eqNullSafe(F.lag("macro").over(order)) | F.lag("step").over(order).isNull()
    rows = islands(rows, changed, "run", order)
    runs = rows.groupBy("entity", "trajectory", "run").agg(F.max("macro").alias("macro"), F.min("ts").alias("start_ts"))
    ahead = Window.partitionBy("entity", "trajectory").orderBy("run")
    options = []
    for h in range(1, k + 1):
        macro = F.lead("macro", h).over(ahead)
        options.append(F.when(macro.isin(targets), F.struct(macro.alias("action"), F.lit(h).alias("change"), F.lead("start_ts", h).over(ahead).alias("ts"))))
    known = reduce(lambda a, b: a + b, (F.lead("run", h).over(ahead).isNotNull().cast("int") for h in range(1, k + 1)))
    labels = runs.withColumn("hit", F.coalesce(*options)).withColumn("changes_seen", known)
    status = F.when(F.col("hit").isNotNull(), HIT).when(F.col("changes_seen") == k, MISSED).otherwise(CENSORED)
    labels = labels.select("entity", "trajectory", "run", status.alias("label_status"), F.col("hit.action").alias("action"), F.col("hit.change").alias("change"), F.col("hit.ts").alias("action_ts"), "changes_seen")
    return rows.join(labels, ["entity", "trajectory", "run"])


def step_hits(steps: DataFrame, is_target: Column, k: int, salt: str = "snapshot") -> DataFrame:
    """Whether one of the next k states is a target, for steps whose k next states are all known; one step an entity, by hash."""
    from ..functions.columns import hash_order

    rows = steps.withColumn("_t", is_target.cast("int"))
    hits = [F.lead("_t", h).over(by_step()) for h in range(1, k + 1)]
    rows = rows.withColumn("known", F.lead("_t", k).over(by_step()).isNotNull()).withColumn("hit_step", F.coalesce(*(F.when(x == 1, F.lit(h)) for h, x in enumerate(hits, 1))))
    rows = rows.filter("known").withColumn("hit", F.col("hit_step").isNotNull()).drop("_t", "known")
    chosen = Window.partitionBy("entity").orderBy(hash_order(salt, "entity", "step"), "step")
    return rows.withColumn("_n", F.row_number().over(chosen)).filter("_n = 1").drop("_n")


def age_snapshots(steps: DataFrame, ages: list[float], cut: str) -> DataFrame:
    """Cases at risk at each age: duration beyond it, and the moment before the cut."""
    rows = steps.withColumn("age", F.explode(F.array(*(F.lit(float(a)) for a in ages)))).filter(F.col("dur_min") > F.col("age"))
    at = F.timestamp_micros((micros("ts") + (F.col("age") * 1e6).cast("long")).cast("long"))
    return rows.withColumn("snapshot_ts", at).filter(F.col("snapshot_ts") < F.lit(cut).cast("timestamp"))


def calendar_features(steps: DataFrame, windows: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """Day of month, days to its end, weekday; days since the action before of the same macro and their number in the last days."""
    day = 86400
    rows = steps.withColumn("_s", F.unix_seconds("ts"))
    same = Window.partitionBy("entity", "macro").orderBy("_s")
    rows = rows.withColumn("day_of_month", F.dayofmonth("ts")).withColumn("days_to_month_end", F.datediff(F.last_day("ts"), F.to_date("ts"))).withColumn("weekday", F.dayofweek("ts"))
    rows = rows.withColumn("days_since_same", (F.col("_s") - F.lag("_s").over(same)) / day)
    for n in windows:
        rows = rows.withColumn(f"same_in_{n}_days", F.count("*").over(same.rangeBetween(-n * day, -1)))
    return rows.drop("_s")


def with_snapshot_id(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A reproducible id of a snapshot from its key."""
    return rows.withColumn("snapshot_id", F.sha2(F.to_json(F.struct(*keys)), 256))


def candidate_targets(states: DataFrame) -> DataFrame:
    """All funnels but the technical ones."""
    return states.filter(F.col("funnel").isNotNull() & ~F.col("technical")).select(F.col("funnel").alias("target")).distinct()
