"""Joins, aggregations, window and set forms that the journey queries share (D, E, F, G, H)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micros, safe_ratio
from ..sources.tables import shared_folder


def enrich(df: DataFrame, dimension: DataFrame, on: str | list[str]) -> DataFrame:
    """A left join; Spark broadcasts the dimension if its measured size allows."""
    return df.join(dimension, on, "left")


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """The columns of a one-row table (totals) on every row."""
    return df.join(F.broadcast(one_row.limit(1)))


#: An entity with more rows than this on a time line is cut into slices of about as many.
SLICE_ROWS = 1_000_000
#: Cuts of hot entities that may be broadcast (8 MB); beyond, they are joined.
FEW_CUTS = 1_000_000


def in_slices(line: DataFrame, entity: list[str], t: str, slices: int | None = None) -> DataFrame:
    """A time line with `_entity` (the keys as one value, which may hold nulls) and, where it is cut, `_slice`.

    Rows are counted by entity first. Those of an entity that has more than `SLICE_ROWS` are
    cut at quantiles of its own times and so spread over many tasks; `running` carries what
    came before from slice to slice. Other entities stay whole. A given number of slices cuts
    all entities at quantiles of the whole line, 1 cuts none and counts nothing. Rows of equal
    times stay together. A cut line is read more than once, so it is written here.
    """
    whole = line.withColumn("_entity", F.col(entity[0]) if len(entity) == 1 else F.struct(*entity))
    keyed = line.withColumn("_entity", F.struct(*entity))
    at = lambda n: F.percentile_approx(t, F.array(*(F.lit(i / n) for i in range(1, n))), max(1000, 10 * n)).alias("_cuts")
    if slices is None:
        hot = keyed.groupBy("_entity").count().filter(F.col("count") > SLICE_ROWS)
        found = hot.agg(F.count("*").alias("entities"), F.max("count").alias("most")).first()
        if not found.entities:
            return whole
        slices = -(-found.most // SLICE_ROWS)
        few = F.broadcast if found.entities * slices <= FEW_CUTS else lambda df: df
        cuts = keyed.join(few(hot.select("_entity")), "_entity").groupBy("_entity").agg(at(slices))
        placed = keyed.join(few(cuts), "_entity", "left")
    elif slices == 1:
        return whole
    else:
        placed = keyed.join(F.broadcast(line.agg(at(slices))))
    place = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(t))))
    shared_folder(line.sparkSession)
    return placed.withColumn("_slice", place).drop("_cuts").checkpoint()


def running(line: DataFrame, order: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """running aggregates over each entity's rows so far, in the order given, which begins with the time of `in_slices`.

    values: name -> (kind, column), kind one of sum, count, max, min, last (not null); with `_before`
    appended (as in `max_before`) the row itself doesn't count. Slices run on their own; an
    entity's totals by slice, one row each, are summed up before and joined back, so that no
    task holds an entity. Rows are dealt by entity and slice once.
    """
    run = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: F.coalesce(a, F.lit(0)) + b, "max": F.greatest, "min": F.least, "last": lambda a, b: F.coalesce(b, a)}
    rows = line.withColumns({f"_v_{name}": column for name, (_, column) in values.items()})
    sliced = "_slice" in line.columns
    inside = Window.partitionBy("_entity", *(["_slice"] if sliced else [])).orderBy(*order)
    frames = {True: inside.rowsBetween(Window.unboundedPreceding, -1), False: inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)}
    kinds = {name: kind.removesuffix("_before") for name, (kind, _) in values.items()}
    rows = rows.withColumns({f"_w_{name}": run[kinds[name]](F.col(f"_v_{name}")).over(frames[kind.endswith("_before")]) for name, (kind, _) in values.items()})
    if not sliced:
        return rows.withColumns({name: F.col(f"_w_{name}") for name in kinds}).drop(*(f"_{x}_{name}" for x in "vw" for name in kinds))
    # the last value of a slice is the one of its latest row that has any
    latest = F.struct(*order)
    whole = {name: F.max_by(f"_v_{name}", F.when(F.col(f"_v_{name}").isNotNull(), latest)) if kind == "last" else run[kind](f"_v_{name}") for name, kind in kinds.items()}
    totals = rows.groupBy("_entity", "_slice").agg(*(e.alias(f"_t_{name}") for name, e in whole.items()))
    earlier = Window.partitionBy("_entity").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    outer = run | {"count": F.sum}
    before = totals.select("_entity", "_slice", *(outer[kind](F.col(f"_t_{name}")).over(earlier).alias(f"_p_{name}") for name, kind in kinds.items()))
    joined = rows.join(before, ["_entity", "_slice"])
    return joined.withColumns({name: both[kind](F.col(f"_p_{name}"), F.col(f"_w_{name}")) for name, kind in kinds.items()}).drop(*(f"_{x}_{name}" for x in "vwp" for name in kinds))


def as_of(anchors: DataFrame, history: DataFrame, entity: str, anchor_ts: str, anchor_id: str, known_ts: str, entry_ts: str, record_id: str, columns: list[str], slices: int | None = None) -> DataFrame:
    """Of each anchor the latest earlier record of its entity, or nulls.

    A record counts if it became known strictly before the anchor, is another record, and
    entered strictly before, or at the anchor's time with a smaller id. The latest by known
    time, entry time and id wins. Instead of joining all pairs of an entity, both tables are
    laid on one time line, records at the later of their two times, and the two largest so
    far are read off, the second where the first is the anchor itself; so that an entity of n
    rows costs n, and a hot entity's line is cut into slices, so that it isn't one task's.
    """
    record = F.struct(F.col(known_ts).alias("known"), F.col(entry_ts).alias("entry"), F.col(record_id).alias("rid"), *(F.col(c).alias(f"h_{c}") for c in columns))
    past = history.filter(F.col(known_ts).isNotNull() & F.col(entry_ts).isNotNull())
    # at equal times records that were known before stand among the anchors in the order of ids, those known at that very time after all of them
    past = past.select(F.col(entity).alias("_e"), F.greatest(known_ts, entry_ts).alias("_t"), (F.col(known_ts) >= F.col(entry_ts)).alias("_after"), F.col(record_id).cast(anchors.schema[anchor_id].dataType).alias("_id"), F.lit(1).alias("_side"), record.alias("_record"))
    asked = anchors.select(F.col(entity).alias("_e"), F.col(anchor_ts).alias("_t"), F.lit(False).alias("_after"), F.col(anchor_id).alias("_id"), F.lit(0).alias("_side"), F.lit(None).cast(past.schema["_record"].dataType).alias("_record"))
    line, order = in_slices(asked.unionByName(past), ["_e"], "_t", slices), ["_t", "_after", "_id", "_side"]
    rows = running(line, order, {"_first": ("max", F.col("_record")), "_above": ("max_before", F.col("_record"))})
    lower = F.when(F.col("_record").isNotNull() & F.col("_above").isNotNull(), F.when(F.col("_record") < F.col("_above"), F.col("_record")).otherwise(F.col("_above")))
    found = running(rows, order, {"_second": ("max", lower)}).filter("_side = 0")
    found = found.withColumn("_latest", F.when(F.col("_first.rid") == F.col("_id"), F.col("_second")).otherwise(F.col("_first")))
    names = [F.col(f"_latest.h_{c}").alias(f"previous_{c}") for c in columns]
    return found.select(F.col("_id").alias(anchor_id), F.col("_latest.rid").alias("previous_id"), F.col("_latest.known").alias("previous_known"), *names, F.col("_latest").isNull().alias("no_history"))


def history_before(anchors: DataFrame, history: DataFrame, entity: str, anchor_ts: str, anchor_id: str, ts: str, aggregates: dict[str, tuple[str, Column]], slices: int | None = None) -> DataFrame:
    """Running aggregates (sum, count, max, min, avg of a column) over an entity's rows strictly before each anchor.

    One time line of both tables, in slices: linear in an entity's rows, where a range join would pair them all.
    """
    plain: dict[str, tuple[str, Column]] = {}
    for name, (kind, expression) in aggregates.items():
        plain |= {f"{name}_sum": ("sum", expression), f"{name}_n": ("count", expression)} if kind == "avg" else {name: (kind, expression)}
    values = {name: expression.alias(f"_x_{name}") for name, (_, expression) in plain.items()}
    past = history.select(F.col(entity).alias("_e"), F.col(ts).alias("_t"), F.lit(1).alias("_side"), *values.values())
    nothing = [F.lit(None).cast(past.schema[f"_x_{name}"].dataType).alias(f"_x_{name}") for name in plain]
    asked = anchors.select(F.col(entity).alias("_e"), F.col(anchor_ts).alias("_t"), F.lit(0).alias("_side"), *nothing, F.col(anchor_id).alias("_id"))
    both = asked.unionByName(past.withColumn("_id", F.lit(None).cast(anchors.schema[anchor_id].dataType)))
    out = running(in_slices(both, ["_e"], "_t", slices), ["_t", "_side"], {name: (kind, F.col(f"_x_{name}")) for name, (kind, _) in plain.items()}).filter("_side = 0")
    means = {name: safe_ratio(F.col(f"{name}_sum"), F.col(f"{name}_n")) for name, (kind, _) in aggregates.items() if kind == "avg"}
    return out.withColumns(means).select(F.col("_id").alias(anchor_id), *aggregates) if means else out.select(F.col("_id").alias(anchor_id), *aggregates)


def first_values(history: DataFrame, entity: str, ts: str, values: list[str], names: list[str]) -> DataFrame:
    """(entity, ts, *names): the number of values of each column that an entity has for the first time then; nulls don't count.

    The history is read once for all columns. What comes first at one time is summed up there,
    so that a time line gets no row for each value.
    """
    own = history.select(F.col(entity).alias("_h"), F.col(ts).alias("_first"), *(F.col(v).alias(f"_v{i}") for i, v in enumerate(values)))
    sets = [["_h", f"_v{i}"] for i in range(len(values))]
    which = [(F.grouping(f"_v{i}") == 0).cast("int").alias(f"_is{i}") for i in range(len(values))]
    firsts = own.groupingSets(sets, "_h", *(f"_v{i}" for i in range(len(values)))).agg(F.min("_first").alias("_first"), *which)
    flags = [F.sum((F.col(f"_v{i}").isNotNull() & (F.col(f"_is{i}") == 1)).cast("long")).alias(n) for i, n in enumerate(names)]
    rows = firsts.groupBy("_h", "_first").agg(*flags)
    return rows.select(F.col("_h").alias(entity), F.col("_first").alias(ts), *names)


def distinct_before(anchors: DataFrame, history: DataFrame, entity: str, anchor_ts: str, anchor_id: str, ts: str, values: list[str], slices: int | None = None) -> DataFrame:
    """Of each anchor the number of different values (stores, products) that its entity had strictly before it, for each column; nulls don't count.

    Only the first time that an entity has a value counts: these numbers, not sets of values, are
    summed along the time line.
    """
    names = [f"distinct_{n}" for n in values]
    counted = history_before(anchors, first_values(history, entity, ts, values, names), entity, anchor_ts, anchor_id, ts, {n: ("sum", F.col(n)) for n in names}, slices)
    return counted.fillna(0, names)


def next_event(cases: DataFrame, events: DataFrame, entity: str, start: str, ts: str, name: str, slices: int | None = None) -> DataFrame:
    """Cases with the time of their entity's first event at or after `start`, or null; linear in an entity's rows.

    Cases and events lie on one line that is read backwards: the latest event passed is the next
    one. Events without entity belong to no case.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in cases.columns))
    asked = cases.select(F.col(entity).alias("_e"), (-micros(start)).alias("_t"), F.lit(1).alias("_side"), own.alias("_case"), F.lit(None).cast("timestamp").alias("_at"))
    there = events.filter(F.col(entity).isNotNull() & F.col(ts).isNotNull()).select(F.col(entity).alias("_e"), (-micros(ts)).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(asked.schema["_case"].dataType).alias("_case"), F.col(ts).cast("timestamp").alias("_at"))
    rows = running(in_slices(asked.unionByName(there), ["_e"], "_t", slices), ["_t", "_side"], {"_next": ("last", F.col("_at"))}).filter("_side = 1")
    found = F.when(F.col("_t").isNotNull() & F.col("_e").isNotNull(), F.col("_next"))
    return rows.select("_case.*", found.alias(name))


def any_event_between(cases: DataFrame, payments: DataFrame, entity: str, start: str, end: str, ts: str) -> DataFrame:
    """Cases with `outcome`: whether the entity has an event in [start, end), which its next event decides."""
    rows = next_event(cases, payments, entity, start, ts, "_next")
    return rows.withColumn("outcome", F.coalesce(F.col("_next") < F.col(end), F.lit(False)).cast("int")).drop("_next")


def member_of(df: DataFrame, sets: DataFrame, on: str, value: str, members: str, inside: bool = True) -> DataFrame:
    """Rows whose value is (or isn't) in the array of their key's row."""
    found = F.coalesce(F.array_contains(members, F.col(value)), F.lit(False))
    return df.join(sets.select(on, members), on, "left").filter(found if inside else ~found).drop(members)


def excluded(df: DataFrame, listed: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key isn't listed."""
    return df.join(listed, on, "left_anti")


def lookup(cases: DataFrame, kernels: DataFrame, on: list[str], key: str, table: str, name: str) -> DataFrame:
    """The value that a kernel's map has for a case's key; null if it has none."""
    return cases.join(kernels, on, "left").withColumn(name, F.try_element_at(table, F.col(key)))


def paired(df: DataFrame, variant: str, reference: str, candidate: str, keys: list[str], measures: list[str]) -> DataFrame:
    """Two variants of each case side by side, in one aggregation instead of a self-join."""
    of = lambda v, m: F.max(F.when(F.col(variant) == v, F.col(m)))
    columns = [of(v, m).alias(f"{m}_{side}") for m in measures for side, v in (("reference", reference), ("candidate", candidate))]
    both = F.count_if(F.col(variant).isin(reference, candidate)).alias("variants")
    return df.groupBy(*keys).agg(both, *columns).filter("variants = 2").drop("variants")


def in_segments(df: DataFrame, segments: dict[str, Column]) -> DataFrame:
    """A row for each segment that it belongs to, `ALL` included."""
    names = F.array(F.lit("ALL"), *(F.when(condition, F.lit(name)) for name, condition in segments.items()))
    return df.withColumn("segment", F.explode(F.array_compact(names)))


def mean_of_means(df: DataFrame, entity: str, keys: list[str], measures: list[str]) -> DataFrame:
    """The mean of the entities' means, with the number of entities that have the measure."""
    own = df.groupBy(*keys, entity).agg(*(F.avg(m).alias(m) for m in measures))
    return own.groupBy(*keys).agg(*(f for m in measures for f in (F.avg(m).alias(m), F.count(m).alias(f"{m}_entities"))))


def to_map(df: DataFrame, keys: list[str], key: str, value: str, name: str) -> DataFrame:
    """A map of each group's entries."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(name))


def exact_quantiles(df: DataFrame, value: str, quantiles: list[float], keys: tuple[str, ...] = (), name: str = "q") -> DataFrame:
    """(keys, q): the array of exact quantiles of a column, interpolated between neighbouring ranks; nulls don't count.

    Values are counted first; the counts of distinct values are cut into pieces and summed up
    piece by piece (see `running_by_score`), and of each quantile only the one or two values
    that hold its rank are kept. So no task holds a group's values, however many it has. A
    group without values has no row; without keys there is one row, of null if there are no values.
    """
    ranked = running_by_score(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value")), "_value", {"_n": F.count("*")}, keys)
    marks = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("at")) for i, q in enumerate(quantiles))))
    rows = ranked.withColumn("_m", marks).withColumn("_rank", F.col("_m.at") * (F.col("_n_total") - 1))
    first, last = F.col("_n_total") - F.col("_n_before") - F.col("_n"), F.col("_n_total") - F.col("_n_before") - 1
    below, above = F.floor("_rank"), F.ceil("_rank")
    holds = lambda rank: (first <= rank) & (rank <= last)
    rows = rows.filter(holds(below) | holds(above))
    found = rows.groupBy(*keys, F.col("_m.i").alias("_i")).agg(F.max(F.when(holds(below), F.col("_value"))).alias("_low"), F.max(F.when(holds(above), F.col("_value"))).alias("_high"), F.max("_rank").alias("_rank"))
    low, high = F.col("_low").cast("double"), F.col("_high").cast("double")
    between = F.when(F.col("_low") == F.col("_high"), low).otherwise((F.ceil("_rank") - F.col("_rank")) * low + (F.col("_rank") - F.floor("_rank")) * high)
    found = found.select(*keys, F.struct("_i", between.alias("v")).alias("_p"))
    parts = F.array_sort(F.collect_list("_p"))
    return found.groupBy(*keys).agg(F.when(F.size(parts) > 0, F.transform(parts, lambda p: p.v)).alias(name))


def pareto(df: DataFrame, value: str, quantiles: list[float]) -> DataFrame:
    """Share of the total of the rows at or above each exact quantile."""
    total = df.agg(F.sum(value).alias("total"))
    cuts = total.join(F.broadcast(exact_quantiles(df, value, quantiles, name="c")), how="left").select(F.posexplode("c").alias("_i", "threshold"), "total")
    cuts = cuts.withColumn("quantile", F.element_at(F.array(*(F.lit(q) for q in quantiles)), F.col("_i") + 1))
    rows = df.join(F.broadcast(cuts), F.col(value) >= F.col("threshold"), "right")  # as many rows as quantiles
    return rows.groupBy("quantile", "threshold", "total").agg(F.count(value).alias("rows"), F.coalesce(F.sum(value), F.lit(0)).alias("volume")).withColumn("share", safe_ratio(F.col("volume"), F.col("total")))


def top_k(df: DataFrame, keys: list[str], by: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark limits each task's rows before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col(name) <= k)


def share_of(df: DataFrame, keys: list[str], value: str, name: str = "share") -> DataFrame:
    """the value's share of its group's total."""
    return df.withColumn(name, safe_ratio(F.col(value), F.sum(value).over(Window.partitionBy(*keys))))


def average_percent_rank(df: DataFrame, score: str, name: str = "percent_rank", keys: list[str] | None = None) -> DataFrame:
    """descending percent rank, ties at their average.

    Without keys the rank is over the whole table: scores are counted first, and the running
    sum goes over the distinct scores of range partitions, not over all rows in one task.
    """
    if keys:
        tied, whole = Window.partitionBy(*keys, score), Window.partitionBy(*keys)
        rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(score))) + (F.count("*").over(tied) - 1) / 2
        return df.withColumn(name, rank / F.count("*").over(whole))
    ranked = running_by_score(df.filter(F.col(score).isNotNull()), score, {"_n": F.count("*")})
    ranked = ranked.withColumn(name, (F.col("_n_before") + (F.col("_n") + 1) / 2) / F.col("_n_total")).select(score, name)
    return df.join(ranked, score, "left")


def running_by_score(df: DataFrame, score: str, sums: dict[str, Column], keys: tuple[str, ...] = (), pieces: int = 256) -> DataFrame:
    """for each distinct score (of each key) its sums, the sums of strictly higher scores (`_before`) and of all (`_total`).

    Two levels: scores are cut at quantiles into pieces; the pieces' totals, at most `pieces` a
    key, are summed up first, then each piece runs on its own. No window holds a whole key.
    """
    blocks = df.groupBy(*keys, score).agg(*(e.alias(n) for n, e in sums.items()))
    cuts = blocks.agg(F.percentile_approx(score, F.array(*(F.lit(i / pieces) for i in range(1, pieces))), 10000).alias("_cuts"))
    blocks = blocks.join(F.broadcast(cuts)).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c >= F.col(score)))).drop("_cuts")
    totals = blocks.groupBy(*keys, "_piece").agg(*(F.sum(n).alias(f"_p_{n}") for n in sums))
    down = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    for n in sums:
        totals = totals.withColumn(f"_b_{n}", F.coalesce(F.sum(f"_p_{n}").over(down), F.lit(0))).withColumn(f"{n}_total", F.sum(f"_p_{n}").over(Window.partitionBy(*keys)))
    rows = blocks.join(totals.drop(*(f"_p_{n}" for n in sums)), [*keys, "_piece"])
    inside = Window.partitionBy(*keys, "_piece").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    for n in sums:
        rows = rows.withColumn(f"{n}_before", F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"_b_{n}"))
    return rows.drop("_piece", *(f"_b_{n}" for n in sums))


def first_share(df: DataFrame, keys: list[str], order: list[Column], fraction: float, name: str) -> DataFrame:
    """whether a row is among the first `fraction` of its group: position / size <= fraction."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, place <= F.floor(F.count("*").over(Window.partitionBy(*keys)) * fraction + 1e-9))


def distinct_day_gaps(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """days between successive distinct days of a key."""
    days = df.select(*keys, F.to_date(ts).alias("day")).distinct()
    return days.withColumn("gap_days", F.datediff("day", F.lag("day").over(Window.partitionBy(*keys).orderBy("day"))))


def union_all(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """Tables stacked by column name, each named in a column."""
    tagged = [df.withColumn(name, F.lit(n)) for n, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
