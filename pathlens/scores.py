"""Queries of scores by routed models, step coefficients and the memory graph, with their SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .audits import CASES, ORACLE_SQL, QUERIES, WALK
from .operators import journey as J
from .operators import models as K
from .operators import propensity as P
from .operators import relational as R
from .operators import scoring as L
from .oracles import RAW, STEPS, TARGETS, sql
from .plans import journeys as S
from .plans import propensity as Q
from .queries import query
from .sources import tables as A
from .streaming import journeys as I

__all__ = ["ORACLE_SQL", "QUERIES"]


def _cases(spark, d, rows):
    return S.current(spark, d, rows).filter("input_status = 'ok'").select("entity", "state", "memory", "context", "age")


def _macros(spark, d):
    return K.checkpointed(S.states(spark, d).select(F.col("state").alias("node"), "macro", "state"))


def _contexts(rows, dests):
    """Supported contexts, and their shrunk probabilities."""
    supported = K.context_support(rows)
    return supported, K.shrunk_contexts(rows, dests, supported.filter("support_status = 'candidato'"))


#: Contexts with a model of their own: their probabilities, shrunk to the origin's, with the origin's groups.
CHILDREN = """,
cx as (select state, context, count(*) as n, count(distinct entity) as k from st where eligible and not holdout group by state, context),
fit as (select state, context from cx where context not in ('__BASE__', '__SEM_MEMORIA__') and n >= 80 and k >= 20),
own as (select state, context, dest, count(*) as k from st join fit using (state, context) where eligible and not holdout and censoring = 'exata' group by state, context, dest),
tot as (select state, context, sum(k) as total from own group by state, context),
sh as (select state, context, dest, grp, (coalesce(k, 0) + 20 * p) / (total + 20) as p from tot join dests using (state) left join own using (state, context, dest)),
pic as (select state, context, grp, sum(p) as pi from sh group by all)"""


@query(sql(CASES[: CASES.index("cs as")].rstrip().removesuffix(",") + CHILDREN + """,
cu as (select entity, state, context, epoch(TIMESTAMP '2024-01-28') - epoch(ts) as age from (select * from st qualify row_number() over (partition by entity order by ts desc) = 1) where not ambiguous),
gp as (select state, '__BASE__' as model, grp, pi, p1, p2 from grps union all select pic.state, context, pic.grp, pic.pi, p1, p2 from pic join grps using (state, grp)),
dp as (select state, '__BASE__' as model, dest, grp, r, p from dests union all select sh.state, sh.context, dest, sh.grp, sh.p / pic.pi, sh.p from sh join pic on pic.state = sh.state and pic.context = sh.context and pic.grp = sh.grp),
ro as (select cu.*, case when g.state is null then 'sem_modelo_origem' when f.state is not null then 'contexto' when cu.context = '__BASE__' then 'origem_nao_tecnica' when cu.context = '__SEM_MEMORIA__' then 'sem_memoria'
              when n is null then 'contexto_nao_visto' when n < 80 or k < 20 then 'contexto_raro' else 'ajuste_filho_falhou' end as route
       from cu left join (select distinct state from grps) g on g.state = cu.state left join (select distinct state, model from gp) f on f.state = cu.state and f.model = cu.context and f.model <> '__BASE__'
       left join cx on cx.state = cu.state and cx.context = cu.context),
mc as (select *, case when route = 'contexto' then context when route <> 'sem_modelo_origem' then '__BASE__' end as model_context from ro),
wl as (select entity, mc.state, model_context, grp, ln(pi) - pow(age / 86400 / p2, p1) as lm from mc join gp on gp.state = mc.state and gp.model = mc.model_context),
we as (select *, exp(lm - max(lm) over (partition by entity)) as e from wl),
wn as (select *, e / sum(e) over (partition by entity) as weight from we)""",
"select mc.entity, route, mc.model_context, dest, round(p, 9) as p, round(weight * r, 7) as q from mc left join (select entity, dest, p, weight, r from wn join dp on dp.state = wn.state and dp.model = wn.model_context and dp.grp = wn.grp) s on s.entity = mc.entity"))
def routed_scores(spark, d):
    """Every current case with its route, its model and the age-conditioned next states."""
    rows = S.written_steps(spark, d)
    dests, groups = (K.checkpointed(x) for x in S.duration_groups(spark, d, rows))
    supported, child = _contexts(rows, dests)
    out = L.routed_scores(_cases(spark, d, rows), supported, (dests, groups), K.recombined(child, dests, groups), ["entity"])
    return out.select("entity", "route", "model_context", "dest", F.round("p", 9).alias("p"), F.round("q", 7).alias("q"))


#: Targets of a case at each of three macro changes: its own destinations first, then the walks from them.
STEPPED = CASES + """,
fs as (select nw.entity, nw.state, dest, e / tt * r as q from nw join (select entity, sum(e) as tt from nw group by entity) using (entity) join dests on dests.state = nw.state and dests.grp = nw.grp)""" + WALK[len(STEPS):] + f""",
k1 as (select src as start, dst, p from jm),
k2 as (select start, j.dst, sum(k1.p * j.p) as p from k1 join jm j on j.src = k1.dst where split_part(k1.dst, ':::', 1) not in {TARGETS} group by 1, 2),
k3 as (select start, j.dst, sum(k2.p * j.p) as p from k2 join jm j on j.src = k2.dst where split_part(k2.dst, ':::', 1) not in {TARGETS} group by 1, 2),
ks as (select start, split_part(dst, ':::', 1) as action, change, sum(p) as score from (select *, 1 as change from k1 union all select *, 2 from k2 union all select *, 3 from k3) where split_part(dst, ':::', 1) in {TARGETS} group by all),
fm as (select *, split_part(dest, ':::', 1) as macro, split_part(dest, ':::', 1) <> split_part(state, ':::', 1) as away from fs),
sc as (
    select entity, macro as action, 1 as change, q as score from fm where away and macro in {TARGETS}
    union all select entity, action, change + away::int, q * score from fm join ks on ks.start = fm.dest where not (away and macro in {TARGETS}) and change + away::int <= 3
)"""  # fmt: skip


def _step_scores(spark, d):
    rows = S.written_steps(spark, d)
    dests, groups = (K.checkpointed(x) for x in S.duration_groups(spark, d, rows))
    macros = _macros(spark, d)
    passage = L.passage_by_step(L.macro_jumps(S.edges(spark, d, rows), macros), macros, S.TARGETS, S.CHANGES)
    known = dests.join(macros.select("state", F.col("macro").alias("own")), "state")
    table = L.step_coefficients(passage, known, macros, S.TARGETS, ["state"], F.col("dest"), S.CHANGES, F.col("own"))
    return L.step_scores(L.group_weights(_cases(spark, d, rows), groups, ["state"], ["entity"]), table, ["state"], ["entity"])


@query("with recursive" + sql(STEPPED, "select entity, action, change, round(sum(score), 6) as score from sc group by all union all select entity, null, null, round(1 - sum(score), 6) from (select entity, score from sc union all select distinct entity, 0.0 from fs) group by entity")[4:])
def step_scores(spark, d):
    """Each case's targets by macro change, and all residual masses in one row: with the scores they add up to 1."""
    out = _step_scores(spark, d)
    target = F.col("kind") == "target"
    rows = out.groupBy("entity", "action", F.when(target, F.col("change")).alias("change")).agg(F.sum("score").alias("score"))
    return rows.withColumn("score", F.round("score", 6))


@query("with recursive" + sql(STEPPED + """,
su as (select entity, action, sum(score) as score from sc group by all),
rk as (select *, (row_number() over (partition by entity order by score desc, action))::int as rank from su where score > 0)""",
"select entity, rank, action, round(score, 6) as score, '{\"cut\":\"2024-01-28\"}' as context_json, 'ok' as row_status from rk where rank <= 5")[4:])
def compiled_scores(spark, d):
    """Each case's five likeliest targets within three macro changes, from coefficients that are made once."""
    scores = _step_scores(spark, d).filter("kind = 'target'").groupBy("entity", "action").agg(F.sum("score").alias("score"))
    return L.to_long(L.to_lists(scores, ["entity"]), ["entity"], {"cut": F.lit(S.CUT)}).withColumn("score", F.round("score", 6))


#: The graph of states with memory, walked within macros.
MEMORY_WALK = CASES[: CASES.index("cs as")].rstrip().removesuffix(",") + CHILDREN + """,
mem as (select '__SEM_MEMORIA__' as memory union select distinct funnel from cat where not technical),
nd as (select state, funnel, technical, memory from cat, mem where technical or memory = funnel),
bo as (select state, '__BASE__' as context, dest, p from dests union all select state, context, dest, p from sh),
ed as (
    select nd.state || '|' || nd.memory as src, bo.dest || '|' || case when c2.technical then nd.memory else c2.funnel end as dst, bo.p, split_part(nd.state, ':::', 1) = split_part(bo.dest, ':::', 1) as same
    from nd left join (select distinct state, context from sh) f on f.state = nd.state and f.context = nd.memory and nd.technical
    join bo on bo.state = nd.state and bo.context = coalesce(f.context, '__BASE__') join cat c2 on c2.state = bo.dest
)""" + WALK[WALK.index(",\nwalk as"):]  # fmt: skip


@query("with recursive" + sql(MEMORY_WALK + f""",
k1 as (select src as start, dst, p from jm),
k2 as (select start, j.dst, sum(k1.p * j.p) as p from k1 join jm j on j.src = k1.dst where split_part(k1.dst, ':::', 1) not in {TARGETS} group by 1, 2),
k3 as (select start, j.dst, sum(k2.p * j.p) as p from k2 join jm j on j.src = k2.dst where split_part(k2.dst, ':::', 1) not in {TARGETS} group by 1, 2),
ks as (select start, split_part(dst, ':::', 1) as action, sum(p) as score from (select * from k1 union all select * from k2 union all select * from k3) where split_part(dst, ':::', 1) in {TARGETS} group by all)""",
"select start as src, action, round(score, 6) as score from ks union all select src, null, round(1 - coalesce(t, 0), 6) from (select distinct src from ed) left join (select start as src, sum(score) as t from ks group by start) using (src)")[4:])
def memory_graph_scores(spark, d):
    """Targets within three macro changes from every state with every memory, and what is left to 1."""
    rows = S.written_steps(spark, d)
    dests = K.checkpointed(S.duration_groups(spark, d, rows)[0])
    _, child = _contexts(rows.filter("not holdout"), dests)
    both = dests.select("state", F.lit(J.BASE).alias("context"), "dest", "p").unionByName(child.select("state", "context", "dest", "p"))
    edges, macros = L.memory_graph(both, K.checkpointed(S.states(spark, d)), A.dimension(spark, [(J.NO_MEMORY,)], "memory string"))
    edges, macros = K.checkpointed(edges), K.checkpointed(macros)
    found = L.macro_first_passage(L.macro_jumps(edges, macros), macros, S.TARGETS, S.CHANGES)
    return found.groupBy("src", "action").agg(F.round(F.sum("score"), 6).alias("score"))


# ---- histories, quantiles, likelihoods


@query("""with i as (select o_custkey, o_orderdate, o_orderkey, o_orderstatus, l_suppkey, l_partkey from orders join lineitem on l_orderkey = o_orderkey)
    select a.o_orderkey, count(distinct i.o_orderkey) as previous, count(distinct i.o_orderkey) filter (i.o_orderstatus = 'F') as previous_closed, count(distinct l_suppkey) as distinct_l_suppkey, count(distinct l_partkey) as distinct_l_partkey
    from orders a left join i on i.o_custkey = a.o_custkey and i.o_orderdate < a.o_orderdate where a.o_orderstatus = 'O' and a.o_orderdate >= timestamp '2000-01-01' group by a.o_orderkey""")  # fmt: skip
def distinct_history(spark, d):
    """Suppliers and parts that a customer had before each order."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_partkey").join(Q.orders(spark, d), "o_orderkey")
    rows = P.history_features(Q.anchors(spark, d), items, "o_custkey", "o_orderdate", "o_orderkey", "o_orderdate", "o_orderkey", {"closed": "F"}, "o_orderstatus", ["l_suppkey", "l_partkey"])
    return rows.select("o_orderkey", "previous", "previous_closed", "distinct_l_suppkey", "distinct_l_partkey")


@query("""select l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.01), 6) as q01, round(quantile_cont(l_extendedprice, 0.5), 6) as median, round(quantile_cont(l_extendedprice, 0.99), 6) as q99 from lineitem group by all""")
def price_quantiles(spark, d):
    """Exact quantiles of groups that no task holds."""
    rows = R.exact_quantiles(spark.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice", [0.01, 0.5, 0.99], ("l_returnflag", "l_linestatus"))
    return rows.select("l_returnflag", "l_linestatus", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q01", "median", "q99"))))


@query("""select a.o_orderkey, min(b.o_orderdate) as next_paid from orders a left join orders b on b.o_custkey = a.o_custkey and b.o_orderstatus = 'F' and b.o_orderdate >= a.o_orderdate
    where a.o_orderstatus = 'O' and a.o_orderdate >= timestamp '2000-01-01' group by a.o_orderkey""")
def next_paid_order(spark, d):
    """Each order's first paid order of the same customer from then on."""
    paid = Q.orders(spark, d).filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderdate").alias("paid_at"))
    return R.next_event(Q.anchors(spark, d), paid, "o_custkey", "o_orderdate", "paid_at", "next_paid").select("o_orderkey", "next_paid")


#: Newton steps in mu and ln sigma from moments, as often as suffices, each over all exact and right-censored steps.
NEWTON = STEPS + """,
du as (select state, censoring = 'exata' as exact, dur_min / 86400 as t, count(*) as w from st where eligible and not holdout and state is not null and dur_min > 0 and censoring in ('exata', 'direita') group by all),
mo as (select state, sum(w * ln(t)) / sum(w) as m, sqrt(sum(w * ln(t) ** 2) / sum(w) - (sum(w * ln(t)) / sum(w)) ** 2) as s from du where exact group by state having sum(w) >= 2 and count(*) >= 2),
it as (
    select state, 'weibull' as family, m + 0.5772156649015329 * s * sqrt(6) / pi() as mu, ln(s * sqrt(6) / pi()) as ls, 0 as i from mo
    union all select state, 'loglogistic', m, ln(s * sqrt(3) / pi()), 0 from mo
    union all
    select state, family, mu - greatest(-1, least(1, (hll * gm - hml * gl) / (hmm * hll - hml * hml))), ls - greatest(-1, least(1, (hmm * gl - hml * gm) / (hmm * hll - hml * hml))), i + 1 from (
        select state, family, mu, ls, i, sum(w * -one / exp(ls)) as gm, sum(w * (-z * one - exact::int)) as gl, sum(w * two / exp(2 * ls)) as hmm, sum(w * (two * z + one) / exp(ls)) as hml, sum(w * (z * one + z * z * two)) as hll from (
            select *, case when family = 'weibull' then exact::int - exp(z) else exact::int - (1 + exact::int) / (1 + exp(-z)) end as one,
                   case when family = 'weibull' then -exp(z) else -(1 + exact::int) / (1 + exp(-z)) * (1 - 1 / (1 + exp(-z))) end as two
            from (select it.*, exact, t, w, (ln(t) - mu) / exp(ls) as z from it join du using (state) where i < 25)
        ) group by state, family, mu, ls, i
    )
),
fin as (select * from it where i = 25),
lk as (
    select state, family, exp(-any_value(ls)) as p1, exp(any_value(mu)) as p2, sum(w)::bigint as n,
           sum(w * case when family = 'weibull' then (case when exact then z - ls - ln(t) else 0 end) - exp(z) else (case when exact then z - ls - ln(t) else 0 end) - (1 + exact::int) * ln(1 + exp(z)) end) as ll
    from (select fin.*, exact, t, w, (ln(t) - mu) / exp(ls) as z from fin join du using (state)) group by state, family
),
every as (
    select * from lk union all
    select state, 'exponential', 1.0, sum(w * t) / sum(w) filter (exact), sum(w)::bigint, -(sum(w) filter (exact)) * ln(sum(w * t) / sum(w) filter (exact)) - sum(w) filter (exact)
    from du where state in (select state from mo) group by state
)"""


@query("with recursive" + sql(NEWTON, "select state, family, n, round(p1, 5) as p1, round(p2, 5) as p2, round(ll, 4) as log_likelihood, round(2 * if(family = 'exponential', 1, 2) - 2 * ll, 4) as aic from every")[4:])
def likelihood_families(spark, d):
    """Families at their maximum likelihood on exact and right-censored steps."""
    rows = S.written_steps(spark, d).filter("not holdout and state is not null")
    out = K.maximise_families(rows, ["state"], families=("exponential", "weibull", "loglogistic"))
    return out.select("state", "family", "n", F.round("p1", 5).alias("p1"), F.round("p2", 5).alias("p2"), F.round("log_likelihood", 4).alias("log_likelihood"), F.round("aic", 4).alias("aic"))


# ---- streams and versions


def _batches(spark, d, folder: str, started, days: int = 7):
    """The events as batches of a stream: each comes up to two days late, so that batches overlap and none is in order.

    A batch is as many files as there are tasks; `started` starts the query anew when it is
    written, from the checkpoint of the one before. Returns the last one.
    """
    late = F.pmod(F.xxhash64("entity", "ts", "state"), F.lit(172800))
    rows = K.checkpointed(S.raw_events(spark, d).filter(F.col("ts").isNotNull()).withColumn("batch", F.floor((F.unix_timestamp("ts") + late) / (86400 * days))))
    done = None
    for row in rows.select("batch").distinct().orderBy("batch").collect():  # a few weeks
        rows.filter(F.col("batch") == row.batch).drop("batch").sortWithinPartitions(F.xxhash64("ts", "entity")).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("entity string, ts timestamp, state string, depth double").parquet(f"{folder}/in")
        done = started(stream)
        done.awaitTermination()
    return done


@query(ORACLE_SQL["streamed_states"])
def disordered_states(spark, d):
    """The events in batches that overlap in time; each entity's state after the last is what all events in order say."""
    folder = f"{A.shared_folder(spark)}/{uuid.uuid4().hex}"
    sink = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{folder}/out")
    _batches(spark, d, folder, lambda stream: I.current_states(stream, S.TECHNICAL).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start())
    last = spark.read.parquet(f"{folder}/out").groupBy("entity").agg(F.max_by(F.struct("ts", "state", "memory", "ambiguous", "events"), "batch").alias("l")).select("entity", "l.*")
    return last.select("entity", F.floor(F.unix_timestamp("ts")).alias("ts"), "state", "memory", "ambiguous", "events")


@query(sql(RAW, """select entity, state, epoch(min(ts))::bigint as start_ts, epoch(max(ts))::bigint + 21600 as end_ts, count(*) as n_events, max(depth) as depth from (
    select *, sum(fresh) over (partition by entity, state order by ts rows unbounded preceding) as block from (
        select *, case when epoch(ts) - epoch(lag(ts) over (partition by entity, state order by ts)) <= 21600 then 0 else 1 end as fresh from raw)) group by entity, state, block"""))
def streamed_sessions(spark, d):
    """Sessions of the same disordered batches, as they stand after the last."""
    folder = f"{A.shared_folder(spark)}/{uuid.uuid4().hex}"
    sink = lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out-{i % 2}")
    done = _batches(spark, d, folder, lambda stream: I.sessions(stream, "6 hours").writeStream.foreachBatch(sink).outputMode("complete").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start())
    rows = spark.read.parquet(f"{folder}/out-{done.lastProgress['batchId'] % 2}")
    return rows.select("entity", "state", *(F.unix_timestamp(c).alias(c) for c in ("start_ts", "end_ts")), "n_events", "depth")


@query(sql(RAW, """select version, weekday, state, events + wrong as events from (select (dayofweek(ts) + 1)::int as weekday, state, count(*) as events from raw group by all),
    (select 7 as version, 1 as wrong union all select 14, 0) union all select 1, 1, state, count(*) + 1 from raw where dayofweek(ts) = 0 group by state"""))
def versioned_slices(spark, d):
    """Every weekday's slice is published twice; the first version, the one between and the newest are read."""
    folder = f"{A.shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = K.checkpointed(S.raw_events(spark, d).groupBy(F.dayofweek("ts").alias("weekday"), "state").agg(F.count("*").alias("events")))
    for wrong in (1, 0):
        for day in range(1, 8):
            A.publish_slice(rows.filter(F.col("weekday") == day).withColumn("events", F.col("events") + wrong), folder, {"weekday": day})
    read = [A.read_version(spark, folder, v).withColumn("version", F.lit(n)) for v, n in ((1, 1), (7, 7), (None, 14))]
    return read[0].unionByName(read[1]).unionByName(read[2]).select("version", "weekday", "state", "events")
