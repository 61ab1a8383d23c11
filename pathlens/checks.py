"""Queries of gates and comparisons on rows that violate them, audits of lists, passages by age and scores with silences."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .audits import CASES, PASSAGE, _lists
from .operators import describe as N
from .operators import evaluation as M
from .operators import journey as J
from .operators import models as K
from .operators import quality as B
from .operators import scoring as L
from .oracles import FREQUENCIES, RAW, STEPS, sql
from .plans import journeys as S
from .queries import TOP, _cases, query
from .scores import ORACLE_SQL, QUERIES
from .sources import tables as A

__all__ = ["ORACLE_SQL", "QUERIES"]

SPOILT = "('0x' || substr(md5('spoilt|' || {}), 1, 8))::bigint % {}"


def _spoilt(column: str, modulus: int):
    from .functions.columns import hash_bucket

    return hash_bucket(column, "spoilt", modulus)


@query(sql(FREQUENCIES + f""",
sp as (select state, case when {SPOILT.format("dest", 5)} = 0 then null when state like 'view%' then p * 1.5 when state like 'click%' and {SPOILT.format("dest", 3)} = 0 then p - 1 else p end as p from freq)""",
"select state, count(*) filter (p is null or p not between 0 and 1) as bad, round(sum(p), 9) as total from sp group by state having count(*) filter (p is null or p not between 0 and 1) > 0 or abs(sum(p) - 1) > 1e-8"))
def spoilt_probabilities(spark, d):
    """B09 on probabilities of which some are null, too large or negative."""
    model = K.transition_frequencies(S.steps(spark, d).filter("not holdout"))
    p = F.when(_spoilt("dest", 5) == 0, None).when(F.col("state").like("view%"), F.col("p") * 1.5).when(F.col("state").like("click%") & (_spoilt("dest", 3) == 0), F.col("p") - 1).otherwise(F.col("p"))
    return B.odd_probabilities(model.withColumn("p", p), ["state"]).select("state", "bad", F.round("total", 9).alias("total"))


@query(sql(RAW, f"""select count(*) as events, count(*) filter (k = 0) as no_entity, count(*) filter (k = 1) as no_state, count(*) filter (k = 2) as no_time, count(*) filter (k = 3) as synthetic_state, count(*) filter (k in (4, 5)) as odd_depth
    from (select *, {SPOILT.format("entity || '|' || epoch(ts)::bigint || '|' || state", 9)} as k from raw)"""))
def spoilt_events(spark, d):
    """B05 on events of which some lack an entity, a state or a time, bear a synthetic state, or have no finite depth."""
    rows = S.raw_events(spark, d).withColumn("k0", F.concat_ws("|", "entity", F.unix_timestamp("ts").cast("string"), "state"))
    rows = rows.withColumn("k", _spoilt("k0", 9))
    k = F.col("k")
    return B.event_problems(rows.select(
        F.when(k == 0, " ").otherwise(F.col("entity")).alias("entity"), F.when(k == 1, None).when(k == 3, "sem_acao:::x").otherwise(F.col("state")).alias("state"),
        F.when(k != 2, F.col("ts")).alias("ts"), F.when(k == 4, float("nan")).when(k == 5, float("-inf")).otherwise(F.col("depth")).alias("depth"),
    ))


@query(sql(STEPS + """,
sp as (select *, eligible and not (state like 'click%' and censoring = 'exata') and not (state like 'view%' and step % 50 <> 0) as used from st),
fs as (select state, count(*) filter (censoring = 'exata') as n, count(distinct entity) filter (censoring = 'exata') as k from sp where used group by state),
nm as (select state, case when n = 0 then 'sem_destino_exato' when n >= 500 and k >= 20 then 'ajustado' else 'suporte_insuficiente' end as fit_status from fs),
ho as (select state, count(*) as steps, count(distinct entity) as entities from st where holdout group by state)""",
"select fit_status, count(*) as origins, coalesce(sum(steps), 0)::bigint as holdout_steps, coalesce(sum(entities), 0)::bigint as holdout_entities from nm left join ho using (state) where fit_status <> 'ajustado' group by fit_status"))
def unfitted_origins(spark, d):
    """K19 where some origins have no exact step and some too few."""
    rows = S.steps(spark, d)
    used = F.col("eligible") & ~(F.col("state").like("click%") & (F.col("censoring") == "exata")) & ~(F.col("state").like("view%") & (F.col("step") % 50 != 0))
    return K.failure_summary(K.fit_status(rows.withColumn("eligible", F.coalesce(used, F.lit(False))), min_n=500), rows.filter("holdout"))


@query(sql(CASES, "select entity, dest, case when dest like 'view%' then 'off' when dest like 'click%' then 'missing' else 'null' end as defect from qq where dest like 'view%' or dest like 'click%' or dest like 'error%'"))
def unconfirmed_probabilities(spark, d):
    """Of a recomputation by another way some rows are off, some are missing, some are null."""
    dests, groups = (K.checkpointed(x) for x in S.duration_groups(spark, d))
    cases = K.checkpointed(_cases(spark, d))
    q = L.conditioned(cases, groups, dests, ["state"], ["entity"]).select("entity", "dest", "q")
    s = groups.join(cases, "state").withColumn("lm", F.log("pi") - F.pow(F.col("age") / 86400 / F.col("p2"), F.col("p1")))
    s = s.join(s.groupBy("entity").agg(F.max("lm").alias("top")), "entity").withColumn("m", F.exp(F.col("lm") - F.col("top")))
    again = s.join(s.groupBy("entity").agg(F.sum("m").alias("t")), "entity").join(dests.select("state", "dest", "grp", "r"), ["state", "grp"]).select("entity", "dest", (F.col("m") / F.col("t") * F.col("r")).alias("q"))
    again = again.filter("dest not like 'click%'").withColumn("q", F.when(F.col("dest").like("view%"), F.col("q") + 0.001).when(~F.col("dest").like("error%"), F.col("q")))
    found = M.recomputed_differences(q, again, ["entity", "dest"], ["q"], 1e-6)
    return found.select("entity", "dest", F.when(F.col("_b").isNull(), "missing").when(F.col("q_again").isNull(), "null").otherwise("off").alias("defect"))


@query(sql(STEPS, """select count(*) as rows, {} from (select sha256('{{"funnel":"' || funnel || '","kind":"' || case when technical then 'tecnico' else 'negocio' end || '","macro":"' || macro || '","stage":"' || stage || '","state":"' || state || '","technical":' || technical || '}}') as h from cat)""".format(
    ", ".join(f"sum(('0x' || substr(h, {1 + 16 * i}, 16))::ubigint::hugeint)::decimal(38, 0) as sum_{i}" for i in range(4)))))
def catalog_signature(spark, d):
    """The signature of the catalog of states."""
    return A.signature(S.states(spark, d))


@query(sql(STEPS, "select row_number() over (order by state desc) as line, state, count(*)::bigint as steps from st where state is not null group by state"))
def ordered_csv(spark, d):
    """The lines of an exported report in the order in which they stand in the file."""
    folder = f"{A.shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = S.steps(spark, d).filter("state is not null").groupBy("state").agg(F.count("*").alias("steps"))
    A.export_csv(rows.orderBy(F.desc("state")), folder, 10_000)
    back = spark.read.schema("state string, steps long").option("header", True).csv(folder)
    return back.withColumn("line", F.monotonically_increasing_id() + 1)  # one file, one partition


@query(TOP + f""", sp as (select entity, next_state as action, case when {SPOILT.format("entity", 4)} = 0 then rank + 1 else rank end as rank, case when {SPOILT.format("entity", 4)} = 1 and rank = 2 then 2.0 else p end as score from li where rank is not null),
ab as (select *, lag(score) over (partition by entity order by rank) as above from sp),
ow as (select entity, count(*) as rows, count(distinct rank) as ranks, count(distinct action) as actions, min(rank) as first_rank, max(rank) as last_rank, count(*) filter (score is null or score < 0 or score > 1) as invalid_scores, count(*) filter (score > above) as rising_scores from ab group by entity)
select rows, ranks, actions, first_rank, last_rank, invalid_scores, rising_scores, count(*) as lists, rows <> 5 or ranks <> 5 or actions <> 5 or first_rank <> 1 or last_rank <> 5 or invalid_scores > 0 or rising_scores > 0 as anomaly from ow group by all""")
def list_shapes(spark, d):
    """N18 on lists of which some begin at rank 2 and some have a score above 1."""
    rows = _lists(spark, d)
    bucket = _spoilt("entity", 4)
    score = F.when((bucket == 1) & (F.col("rank") == 2), 2.0).otherwise(F.col("score"))
    return N.list_shapes(rows.withColumn("score", score).withColumn("rank", F.when(bucket == 0, F.col("rank") + 1).otherwise(F.col("rank"))))


@query(sql(FREQUENCIES + """,
best as (select *, row_number() over (partition by state order by p desc, dest) as rank from freq),
lt as (select * from st qualify row_number() over (partition by entity order by ts desc) = 1),
va as (select lt.entity, lt.state, lt.context, best.dest as action, best.p as score from lt left join best on best.state = lt.state and rank = 1 where lt.state is not null)""",
"select state, count(*) as entities, count(distinct context) as contexts, count(distinct action) as first_actions, count(distinct round(score, 6)) as scores, round(stddev_pop(score), 7) as score_sd from va group by state"))
def variation_by_state(spark, d):
    """Contexts and first actions of each state."""
    return N.variation_by_state(S.current(spark, d), _lists(spark, d)).withColumn("score_sd", F.round("score_sd", 7))


@query(sql(CASES + PASSAGE[len(STEPS):] + """,
fs as (select nw.entity, dest, e / tt * r as q from nw join (select entity, sum(e) as tt from nw group by entity) using (entity) join dests using (state, grp)),
g1 as (select src as start, dst, p, dst like 'purchase%' as hit from e),
g2 as (select start, e.dst, g1.p * e.p as p, e.dst like 'purchase%' as hit from g1 join e on g1.dst = e.src where not g1.hit),
ps as (select start, coalesce(sum(p) filter (hit), 0) as reached, coalesce(sum(p) filter (not hit and last), 0) as surviving from (select *, false as last from g1 union all select *, true from g2) group by start)""",
"select entity, round(sum(case when dest like 'purchase%' then q else q * coalesce(reached, 0) end), 6) as reached, round(sum(case when dest like 'purchase%' then 0 else q * coalesce(surviving, 0) end), 6) as surviving from fs left join ps on ps.start = fs.dest group by entity"))
def age_first_passage(spark, d):
    """L08 with the temporal kernel: each case's chance to reach a purchase in three transitions, of which the first knows its age."""
    rows = S.written_steps(spark, d)
    dests, groups = (K.checkpointed(x) for x in S.duration_groups(spark, d, rows))
    first = L.conditioned(S.current(spark, d, rows).filter("input_status = 'ok'").select("entity", "state", "age"), groups, dests, ["state"], ["entity"])
    out = L.first_passage_by_age(first, K.checkpointed(S.edges(spark, d, rows)), F.col("dst").like("purchase%"), 3, ["entity"])
    return out.select("entity", F.round("reached", 6).alias("reached"), F.round("surviving", 6).alias("surviving"))


@query()
def silence_scores(spark, d):
    """Every case's next states, silence among them, and those within a day, by curves whose silences begin at the timeout with an atom."""
    rows = K.checkpointed(S.silence_steps(spark, d))
    train = rows.filter("not holdout and state is not null")
    dests = K.checkpointed(K.pooled_destinations(train, ["state"], min_n=20, min_entities=5))
    fits = K.checkpointed(K.fit_competing_lognormal(train, dests, ["state"], timeout=S.TIMEOUT, iterations=10))
    groups = fits.select("state", "grp", "family", F.col("mu").alias("p1"), F.col("sigma").alias("p2"), "pi", "shift", "atom")
    last = rows.withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("step")))).filter("n = 1 and state is not null")
    cases = K.checkpointed(last.select("entity", "state", J.seconds_between("ts", F.lit(S.CUT).cast("timestamp")).alias("age")))
    q = L.conditioned(cases, groups, dests, ["state"], ["entity"]).select("entity", "dest", "q")
    return q.join(L.horizon(cases, groups, dests, ["state"], ["entity"], 86400.0), ["entity", "dest"], "left")


def _rounded(name: str, like: str, *columns: tuple[str, int]):
    """The SQL of a rounded query for the query itself, whose columns are then rounded alike."""
    plain = QUERIES[name]

    def run(spark, d):
        return plain(spark, d).withColumns({c: F.round(c, k) for c, k in columns})

    QUERIES[name], ORACLE_SQL[name] = run, ORACLE_SQL[like]


_rounded("horizon_probabilities", "horizon_shares", ("within", 7), ("no_exit", 7))
_rounded("temporal_variation", "time_variation", ("variation", 6))
_rounded("operational_audit", "audience_audit", ("score_sd", 7))
