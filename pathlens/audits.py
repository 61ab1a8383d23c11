"""Queries of run control, gates, routes, comparisons, cohorts and streams, with their SQL oracles."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import describe as N
from .operators import evaluation as M
from .operators import journey as J
from .operators import models as K
from .operators import propensity as P
from .operators import quality as B
from .operators import relational as R
from .operators import scoring as L
from .oracles import BLOCKS, CUT, FREQUENCIES, GROUPS, RAW, STEPS, TARGETS, sql
from .plans import journeys as S
from .plans import propensity as Q
from .queries import BASELINE, HITS, ORACLE_SQL, PASSAGE, QUERIES, TOP, _cases, _evaluated, _lists, query, seconds
from .sources import tables as A
from .streaming import journeys as I

__all__ = ["ORACLE_SQL", "QUERIES"]


def _folder(spark) -> str:
    return f"{A.shared_folder(spark)}/{uuid.uuid4().hex}"


# ---- run control


@query(sql(STEPS, "select macro, count(*) as steps, 'full' as mode, 2::bigint as runs from st where macro is not null group by macro"))
def run_control(spark, d):
    """Two runs are written with manifests; the newest completed one is chosen and read."""
    folder = _folder(spark)
    rows = A.with_provenance(S.steps(spark, d).filter("macro is not null").groupBy("macro").agg(F.count("*").alias("steps")), mode="full")
    for i in (1, 2):
        A.write_run(rows, f"{folder}/data", f"{folder}/manifests", f"r{i}", "full", "m", datetime(2024, 1, 28), datetime(2024, 1, 28 + i), {"cut": S.CUT})
    manifests = spark.read.parquet(f"{folder}/manifests")
    newest = A.latest_run(manifests).first().run_id
    chosen = A.choose_run(manifests, "m", newest).first().run_id
    done = manifests.filter(F.col("status") == A.COMPLETED).agg(F.count("*").alias("runs"))
    return R.with_constants(A.single_run(A.completed_only(A.read_run(spark, f"{folder}/data", chosen), manifests), newest), done).select("macro", "steps", "mode", "runs")


@query(sql(RAW, "select (dayofweek(ts) + 1)::int as weekday, state, count(*) as events from raw group by all"))
def replaced_slices(spark, d):
    """A table is created, its copy replaced, and every weekday's slice overwritten twice."""
    folder = _folder(spark)
    A.create_only(S.raw_events(spark, d).groupBy(F.dayofweek("ts").alias("weekday"), "state").agg(F.count("*").alias("events")), f"{folder}/source")
    rows = spark.read.parquet(f"{folder}/source")
    A.replace_table(rows.limit(0), f"{folder}/copy")
    A.replace_table(rows, f"{folder}/copy")
    rows = spark.read.parquet(f"{folder}/copy")
    for wrong in (1, 0):
        for day in range(1, 8):
            A.overwrite_slice(rows.filter(F.col("weekday") == day).withColumn("events", F.col("events") + wrong), f"{folder}/slices", {"weekday": day})
    return spark.read.parquet(f"{folder}/slices").select("weekday", "state", "events")


@query(sql(FREQUENCIES, "select 'catalog' as report, count(*) as rows from cat union all select 'frequencies', count(*) from freq"))
def packaged_tables(spark, d):
    """Two tables are packed with signatures, read back unchanged, and reported as rows."""
    folder = _folder(spark)
    tables = {"catalog": S.states(spark, d), "frequencies": K.transition_frequencies(S.steps(spark, d).filter("not holdout")).select("state", "dest", "n")}
    A.write_package(tables, folder, "p1")
    back = A.read_package(spark, folder, "p1")
    A.same_source(A.signature(tables["catalog"]), A.signature(back["catalog"]))
    return A.report_rows(back).groupBy("report").agg(F.count("*").alias("rows"))


@query(sql(STEPS, "select state, count(*) as n from st where state is not null and dur_min > 3600 group by state"))
def shared_view_sql(spark, d):
    """Steps are shared as a view that SQL with a named parameter reads."""
    A.share_view(S.steps(spark, d), "pathlens_steps")
    return A.parameterised(spark, "select state, count(*) as n from pathlens_steps where state is not null and dur_min > :least group by state", ["state", "n"], least=3600.0)


@query(sql(STEPS, "select state, count(*)::bigint as steps from st where state is not null group by state"))
def exported_csv(spark, d):
    """An ordered report of checked size as CSV, read back."""
    folder = _folder(spark)
    rows = B.within_limit(S.steps(spark, d).filter("state is not null").groupBy("state").agg(F.count("*").alias("steps")), 10_000, "states")
    A.export_csv(rows.orderBy("state"), folder, 10_000)
    return spark.read.schema("state string, steps long").option("header", True).csv(folder)


@query(sql(STEPS, "select state, steps, row_number() over (order by steps desc, state) as line from (select state, count(*)::bigint as steps from st where state is not null group by state)"))
def ordered_report(spark, d):
    """The lines of an exported report stand in the order asked for, as numbered when its one file is read."""
    folder = _folder(spark)
    rows = S.steps(spark, d).filter("state is not null").groupBy("state").agg(F.count("*").alias("steps"))
    A.export_csv(rows.orderBy(F.desc("steps"), "state"), folder, 10_000)
    return spark.read.schema("state string, steps long").option("header", True).csv(folder).withColumn("line", F.monotonically_increasing_id() + 1)


@query(sql(FREQUENCIES, "select state, 'changed' as change, count(*) as rows from freq where state like 'view%' group by state"))
def refitted_parameters(spark, d):
    """Only refitted origins' parameters may change."""
    old = K.transition_frequencies(S.steps(spark, d).filter("not holdout")).select("state", "dest", "n", "p")
    refit = F.col("state").like("view%")
    new = old.withColumn("p", F.when(refit, F.col("p") / 2).otherwise(F.col("p")))
    A.require_unchanged(old, new, ["state", "dest"], old.filter(refit).select("state", "dest"))
    B.require_empty(old.filter("p is null"), "probabilities")
    return A.changed_parameters(old, new, ["state", "dest"]).groupBy("state", "change").agg(F.count("*").alias("rows"))


ORACLE_SQL["snapshot_ids"] = sql(STEPS, f"""select sha256('{{"entity":"' || entity || '","step":' || step || ',"age":' || printf('%.1f', age) || '}}') as snapshot_id, entity, step, age
    from st, (select unnest([0.0, 1800.0, 86400.0, 604800.0])::double as age) where dur_min > age and epoch(ts) + age < epoch({CUT})""")
ORACLE_SQL["model_routes"] = sql(FREQUENCIES + """,
cs as (select state, context, count(*) as n, count(distinct entity) as k from st where eligible and not holdout group by state, context),
rt as (select entity, case when n >= 80 and k >= 20 and context not in ('__BASE__', '__SEM_MEMORIA__') and o.state is not null then 'contexto' when o.state is null then 'sem_modelo_origem' when context = '__BASE__' then 'origem_nao_tecnica'
        when context = '__SEM_MEMORIA__' then 'sem_memoria' when n is null then 'contexto_nao_visto' when n < 80 or k < 20 then 'contexto_raro' else 'ajuste_filho_falhou' end as route
       from st left join cs using (state, context) left join (select distinct state from freq) o on o.state = st.state where st.context is not null)""", "select route, count(*) as cases, count(distinct entity) as entities from rt group by route")


# ---- gates


@query(sql(RAW, "select 'ALL' as scope, count(distinct entity) as entities from raw union all select 'SAMPLE', count(distinct entity) from raw where ('0x' || substr(md5('audience|' || entity), 1, 8))::bigint % 3 = 0 or entity in ('1', '2') union all select 'IDS', count(distinct entity) from raw where entity in ('1', '2')"))
def audience_scopes(spark, d):
    raw = S.raw_events(spark, d)
    scopes = {mode: B.audience(raw, mode, ids=["1", "2"], modulus=3) for mode in ("ALL", "SAMPLE", "IDS")}
    return R.union_all(scopes, "scope").groupBy("scope").agg(F.count("*").alias("entities"))


@query(sql(RAW, "select entity, epoch(ts)::bigint as ts, count(*) as rows from raw group by all having count(*) > 1"))
def repeated_events(spark, d):
    return B.repeated_keys(S.raw_events(spark, d), ["entity", "ts"]).select("entity", seconds("ts"), "rows")


@query(sql(FREQUENCIES, "select state, round(sum(p), 9) as total from freq where n > 3 group by state having abs(sum(p) - 1) > 1e-8"))
def open_probabilities(spark, d):
    model = K.transition_frequencies(S.steps(spark, d).filter("not holdout")).filter("n > 3")
    return B.odd_probabilities(model, ["state"]).select("state", F.round("total", 9).alias("total"))


@query(sql(STEPS, "select entity, step, case when step % 5 = 0 then 'right' when step % 7 = 0 then 'order' else 'kind' end as defect from st where not coalesce(case when step % 5 = 0 then false when step % 7 = 0 then dur_min < 0 when step % 11 = 0 then false else true end, false)"))
def broken_durations(spark, d):
    """B08 on rows whose bounds or kinds were spoilt."""
    rows = S.steps(spark, d)
    five, seven, eleven = (F.col("step") % n == 0 for n in (5, 7, 11))
    spoilt = rows.withColumn("dur_max", F.when(five, F.lit(1.0)).when(seven, F.col("dur_min") - 1).otherwise(F.coalesce("dur_max", "dur_min")))
    spoilt = spoilt.withColumn("censoring", F.when(five, J.RIGHT).when(seven, J.INTERVAL).when(eleven, "?").otherwise(J.BARRIER))
    return B.odd_durations(spoilt).select("entity", "step", F.when(five, "right").when(seven, "order").otherwise("kind").alias("defect"))


@query(sql(STEPS, "select distinct state, 'left' as only_in from st where state is not null and state not like 'view%' and state like '%topo' union select distinct state, 'right' from st where state like 'view%' and state not like '%topo'"))
def uncovered_states(spark, d):
    states = S.steps(spark, d).filter("state is not null").select("state")
    return B.coverage_gap(states.filter("state like '%topo'"), states.filter("state like 'view%'"), ["state"])


@query(sql(STEPS + """,
sp as (select entity, step, case when step % 9 = 0 then ts - interval 400 day else ts end as moved, case when step % 13 = 0 then step + 1 else evidence_step end as seen from st),
lg as (select *, lag(moved) over (partition by entity order by step) as before from sp)""", f"select entity, step from lg where seen > step or moved >= {CUT} or moved <= before"))
def leaking_steps(spark, d):
    """B11 on rows whose evidence or order was spoilt."""
    rows = S.steps(spark, d).withColumn("evidence_step", F.when(F.col("step") % 13 == 0, F.col("step") + 1).otherwise(F.col("evidence_step")))
    rows = rows.withColumn("ts", F.when(F.col("step") % 9 == 0, F.timestamp_seconds(F.unix_seconds("ts") - 400 * 86400)).otherwise(F.col("ts")))
    return B.time_leaks(rows, S.CUT).select("entity", "step")


@query(TOP + " select entity, count(*) as rows from li where rank is not null and ('0x' || substr(md5('spoilt|' || entity), 1, 8))::bigint % 2 = 0 group by entity")
def gapped_rankings(spark, d):
    """B12, F14 on lists of which half have their ranks doubled."""
    from .functions.columns import hash_bucket

    rows = _lists(spark, d).withColumn("rank", F.when(hash_bucket("entity", "spoilt", 2) == 0, F.col("rank") * 2).otherwise(F.col("rank")))
    return B.odd_rankings(rows).select("entity", "rows")


@query(sql(FREQUENCIES, "select distinct state as start from freq where state like 'view%'"))
def open_mass_rows(spark, d):
    """B13 on masses that were spoilt for some starts."""
    rows = L.first_passage(S.edges(spark, d), F.col("dst").like("purchase%"), 3)
    return B.open_masses(rows.withColumn("surviving", F.col("surviving") + F.when(F.col("start").like("view%"), 0.5).otherwise(0.0)), ["reached", "surviving", "lost"]).select("start")


@query("select p_partkey, contains(lower(p_name), 'cold') or contains(lower(p_name), 'small') as named, case when p_size > 40 then 'grande' when p_retailprice < 950 then 'barato' else 'comum' end as status from part")
def part_reasons(spark, d):
    """B18, B19."""
    from .functions.columns import first_match, status_chain

    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", first_match("p_name", ["COLD", "small"]).alias("named"), status_chain([(F.col("p_size") > 40, "grande"), (F.col("p_retailprice") < 950, "barato")], "comum").alias("status"))


@query("with f as (select column_name as name from (describe events)), e as (select unnest(['event_id', 'ts', 'user_id', 'state']) as name) select 'unexpected' as side, name from f where name not in (select name from e) union all select 'missing', name from e where name not in (select name from f)")
def schema_differences(spark, d):
    """B20, H03."""
    events = spark.read.parquet(f"{d}/events.parquet")
    found = B.name_differences(events.columns, ["event_id", "ts", "user_id", "state"])
    return A.dimension(spark, [(side, name) for side, names in found.items() for name in names], "side string, name string")


@query("with a as (select o_custkey, o_orderpriority from orders where o_orderstatus <> 'P'), b as (select o_custkey, o_orderpriority from orders where o_orderstatus <> 'F') select only_in, count(*) as rows from (select *, 'left' as only_in from (from a except all from b) union all select *, 'right' from (from b except all from a)) group by only_in")
def differing_rows(spark, d):
    """B21, H02."""
    rows = Q.orders(spark, d)
    a, b = (rows.filter(F.col("o_orderstatus") != s).select("o_custkey", "o_orderpriority") for s in "PF")
    return B.table_differences(a, b).groupBy("only_in").agg(F.count("*").alias("rows"))


# ---- joins, windows


@query("""with h as (select o_orderkey, o_custkey, o_totalprice, o_orderdate + interval 1 day * (o_orderkey % 40)::int as known, o_orderdate + interval 1 day * ((o_custkey + 7 * o_orderkey) % 30)::int as entry from orders),
    a as (select o_orderkey as id, o_custkey, o_orderdate as at from orders where o_orderstatus = 'O' and o_orderdate >= timestamp '2000-01-01')
    select a.id as o_orderkey, h.o_orderkey as previous_id, h.o_totalprice as previous_o_totalprice, h.o_orderkey is null as no_history
    from a left join h on h.o_custkey = a.o_custkey and h.o_orderkey <> a.id and h.known < a.at and (h.entry < a.at or h.entry = a.at and h.o_orderkey < a.id)
    qualify row_number() over (partition by a.id order by h.known desc nulls last, h.entry desc nulls last, h.o_orderkey desc nulls last) = 1""")  # fmt: skip
def latest_known_order(spark, d):
    """D10, P06 where a record's entry and the time it became known differ."""
    days = lambda c, n: F.timestamp_seconds(F.unix_seconds("o_orderdate") + (c % n) * 86400)
    rows = Q.orders(spark, d).withColumn("known", days(F.col("o_orderkey"), 40)).withColumn("entry", days(F.col("o_custkey") + 7 * F.col("o_orderkey"), 30))
    return R.as_of(Q.anchors(spark, d), rows, "o_custkey", "o_orderdate", "o_orderkey", "known", "entry", "o_orderkey", ["o_totalprice"]).drop("previous_known")


@query(sql(FREQUENCIES, "select st.entity, st.step, round(freq.p, 9) as p from st left join freq on freq.state = st.state and freq.dest = st.dest where holdout and censoring = 'exata'"))
def kernel_lookups(spark, d):
    """The probability of the realised destination from each origin's map."""
    rows = S.steps(spark, d)
    kernels = R.to_map(K.transition_frequencies(rows.filter("not holdout")), ["state"], "dest", "p", "kernel")
    cases = rows.filter("holdout and censoring = 'exata'").select("entity", "step", "state", "dest")
    return R.lookup(cases, kernels, ["state"], "dest", "kernel", "p").select("entity", "step", F.round("p", 9).alias("p"))


@query(sql(STEPS, "select macro, count(*) filter (place <= floor(size * 0.25 + 1e-9)) as first_quarter, count(*) as steps from (select macro, row_number() over (partition by macro order by entity, step) as place, count(*) over (partition by macro) as size from st where macro is not null) group by macro"))
def first_quarters(spark, d):
    rows = R.first_share(S.steps(spark, d).filter("macro is not null"), ["macro"], [F.asc("entity"), F.asc("step")], 0.25, "early")
    return rows.groupBy("macro").agg(F.count_if("early").alias("first_quarter"), F.count("*").alias("steps"))


@query(sql(STEPS, "select st.state, cat.funnel, cat.stage, count(*) as steps from st join cat on cat.state = st.state group by all"))
def enriched_steps(spark, d):
    """Steps with their state's catalog row."""
    rows = R.enrich(S.steps(spark, d).filter("state is not null").select("state", "step"), S.states(spark, d).select("state", "funnel", "stage"), "state")
    return rows.groupBy("state", "funnel", "stage").agg(F.count("*").alias("steps"))


# ---- models


@query(sql(STEPS + """,
us as (select * from st where eligible and not holdout),
cx as (select state, context from us where context not in ('__BASE__', '__SEM_MEMORIA__') group by state, context having count(*) >= 80 and count(distinct entity) >= 20)""", "select model_context, count(*) as rows, count(distinct state) as origins from (select state, '__BASE__' as model_context from us union all select us.state, us.context from us join cx using (state, context)) group by model_context"))
def parent_and_child_rows(spark, d):
    """K17."""
    rows = S.steps(spark, d)
    supported = K.context_support(rows).filter("support_status = 'candidato'")
    return K.parent_and_child(rows, supported).groupBy("model_context").agg(F.count("*").alias("rows"), F.countDistinct("state").alias("origins"))


@query(sql(GROUPS, "select state, grp, 'p1' as parameter, case when p1 <= 0.6 then 'low' else 'high' end as side, round(least(greatest(p1, 0.6), 0.9), 9) as value from grps where p1 <= 0.6 or p1 >= 0.9"))
def parameters_at_bounds(spark, d):
    """Shapes that a narrow interval would cut off."""
    groups = S.duration_groups(spark, d)[1].withColumn("p1", F.least(F.greatest("p1", F.lit(0.6)), F.lit(0.9)))
    return K.at_bounds(groups, None, ["state"], {"p1": (0.6, 0.9)}).select("state", "grp", "parameter", "side", F.round("value", 9).alias("value"))


@query(sql(GROUPS + """,
cx as (select state, context from st where eligible and not holdout and context not in ('__BASE__', '__SEM_MEMORIA__') group by state, context having count(*) >= 80 and count(distinct entity) >= 20),
par as (select state, grp, m as mu0, s as sigma0 from mom where n >= 2 and s > 0),
own as (select state, context, grp, count(*) as n, avg(ln(dur_min / 86400)) as mean, greatest(sqrt(greatest(avg(ln(dur_min / 86400) ** 2) - avg(ln(dur_min / 86400)) ** 2, 0)), 0.15) as dev
        from st join cx using (state, context) join dests using (state, dest) where eligible and not holdout and censoring = 'exata' group by state, context, grp)""",
"select state, context, grp, n, round((n * mean + 20 * mu0) / (n + 20), 7) as mu, round(exp((n * ln(dev) + 20 * ln(sigma0)) / (n + 20)), 7) as sigma from own join par using (state, grp)"))
def shrunk_context_durations(spark, d):
    """Duration parameters of supported contexts, drawn to the origin's."""
    rows = S.steps(spark, d)
    dests, _ = S.duration_groups(spark, d)
    exact = rows.filter("not holdout and state is not null and eligible and censoring = 'exata'").join(dests.select("state", "dest", "grp"), ["state", "dest"])
    parent = K.fit_families(exact, ["state", "grp"]).filter("family = 'lognormal'").select("state", "grp", F.col("p1").alias("mu"), F.col("p2").alias("sigma"))
    out = K.shrunk_durations(rows, dests, parent, K.context_support(rows).filter("support_status = 'candidato'"))
    return out.select("state", "context", "grp", F.col("n").cast("long").alias("n"), F.round("mu", 7).alias("mu"), F.round("sigma", 7).alias("sigma"))


INTERVALS = "with iv as (" + ORACLE_SQL["interval_censored"] + """),
lo as (select *, dur_min / 86400 as t, dur_max / 86400 as u, ('0x' || substr(md5('holdout|' || entity), 1, 8))::bigint % 5 = 0 as holdout from iv where censoring <> 'origem_ambigua'),
mo as (select state, avg(t) as mean, avg(ln(t)) as m, stddev_pop(ln(t)) as s from lo where censoring = 'exata' and t > 0 group by state having count(*) >= 2 and stddev_pop(ln(t)) > 0),
fam as (
    select state, 'exponential' as family, 1.0::double as p1, mean as p2, 1 as parameters from mo
    union all select state, 'weibull', pi() / sqrt(6) / s, exp(m + 0.5772156649015329 / (pi() / sqrt(6) / s)), 2 from mo
    union all select state, 'loglogistic', pi() / sqrt(3) / s, exp(m), 2 from mo
),
sv as (select state, holdout, censoring, t, u, family, p1, p2, parameters, case when family = 'loglogistic' then -ln(1 + pow(t / p2, p1)) else -pow(t / p2, p1) end as a, case when family = 'loglogistic' then -ln(1 + pow(u / p2, p1)) else -pow(u / p2, p1) end as b
       from lo join fam using (state) where t > 0 or censoring = 'intervalo'),
ll as (select *, case censoring when 'direita' then a when 'intervalo' then a + ln(greatest(1 - exp(b - a), 1e-300)) else ln(p1 / p2) + (p1 - 1) * ln(t / p2) + case when family = 'loglogistic' then 2 * a else a end end as ll from sv)"""


@query(INTERVALS + " select state, family, round(sum(ll) filter (not holdout), 4) as log_likelihood, round(2 * parameters - 2 * sum(ll) filter (not holdout), 4) as aic, round(avg(-ll) filter (holdout and censoring = 'exata'), 6) as holdout_nll_exact, round(avg(-ll) filter (holdout and censoring = 'direita'), 6) as holdout_nll_right from ll group by state, family, parameters")
def interval_families(spark, d):
    """Families judged on exact, right- and interval-censored durations of the session clock."""
    rows = B.with_holdout(J.interval_censored(S.sessions(spark, d), S.TIMEOUT, S.CUT))
    out = K.compare_families(rows, K.fit_families(rows, ["state"]).filter("family <> 'lognormal'"), ["state"])
    return out.select("state", "family", F.round("log_likelihood", 4).alias("log_likelihood"), F.round("aic", 4).alias("aic"), F.round("holdout_nll_exact", 6).alias("holdout_nll_exact"), F.round("holdout_nll_right", 6).alias("holdout_nll_right"))


@query("with si as (" + ORACLE_SQL["silences"] + """),
ex as (select last_action, end_ts - ts as past from si where state = 'sem_acao' and next_state is not null),
ag as (select last_action, count(*) as n, count(*) filter (abs(past) <= 1) as at_timeout, avg(ln(past / 86400)) filter (past > 1) as mu, stddev_pop(ln(past / 86400)) filter (past > 1) as sd from ex group by last_action)
select last_action, n, case when at_timeout / n >= 0.999 then 'atom' when at_timeout / n <= 0.001 then 'shifted_lognormal' else 'mixture' end as family, round(at_timeout / n, 9) as atom,
       case when at_timeout / n < 0.999 then round(mu, 7) end as mu, case when at_timeout / n < 0.999 then round(least(greatest(sd, 0.15), 4.5), 7) end as sigma from ag""")  # fmt: skip
def timeout_atoms(spark, d):
    """K08, rounded."""
    return QUERIES["timeout_atom"](spark, d).select("last_action", "n", "family", *(F.round(c, k).alias(c) for c, k in (("atom", 9), ("mu", 7), ("sigma", 7))))


@query(sql(GROUPS + """,
cx as (select state, context from st where eligible and not holdout and context not in ('__BASE__', '__SEM_MEMORIA__') group by state, context having count(*) >= 80 and count(distinct entity) >= 20),
own as (select state, context, dest, count(*) as k from st join cx using (state, context) where eligible and not holdout and censoring = 'exata' group by state, context, dest),
tot as (select state, context, sum(k) as total from own group by state, context),
sh as (select state, context, grp, (coalesce(k, 0) + 20 * p) / (total + 20) as p from tot join dests using (state) left join own using (state, context, dest))""",
"select state, context, grp, round(sum(p), 9) as pi, round(any_value(p1), 7) as p1, round(any_value(p2), 7) as p2 from sh join grps using (state, grp) group by state, context, grp"))
def recombined_groups(spark, d):
    """K13, rounded."""
    rows = QUERIES["recombined_model"](spark, d)
    return rows.select("state", "context", "grp", *(F.round(c, k).alias(c) for c, k in (("pi", 9), ("p1", 7), ("p2", 7))))


# ---- scoring


CASES = GROUPS + f""",
cs as (select entity, state, memory, epoch({CUT}) - epoch(ts) as age from st qualify row_number() over (partition by entity order by ts desc) = 1),
lw as (select entity, state, age, grp, pi, p1, p2, pi * exp(-pow(age / 86400 / p2, p1)) as m, pi * exp(-pow((age + 604800) / 86400 / p2, p1)) as m7 from cs join grps using (state) where state is not null),
tw as (select *, sum(m) over (partition by entity) as tot, sum(m7) over (partition by entity) as tot7, ln(pi) - pow(age / 86400 / p2, p1) as lm from lw),
nw as (select *, exp(lm - max(lm) over (partition by entity)) as e from tw),
qq as (select entity, state, age, dest, grp, r, p, m, m7, tot, tot7, e / sum(e) over (partition by entity, dest_) * r as q from (select nw.*, dest, r, p, 0 as dest_ from nw join dests using (state, grp)))"""


@query(sql(CASES, "select entity, dest, round(case when tot > 0 then (m - m7) / tot * r end, 7) as within, round(case when tot > 0 then tot7 / tot end, 7) as no_exit from qq"))
def horizon_shares(spark, d):
    """L02, rounded."""
    dests, groups = S.duration_groups(spark, d)
    return L.horizon(_cases(spark, d), groups, dests, ["state"], ["entity"], 604800.0).select("entity", "dest", F.round("within", 7).alias("within"), F.round("no_exit", 7).alias("no_exit"))


@query(sql(CASES + ", we as (select entity, grp, e / sum(e) over (partition by entity) as weight from nw)", "select qq.entity, round(0.5 * sum(abs(weight * qq.r - qq.p)), 6) as variation from qq join we on we.entity = qq.entity and we.grp = qq.grp group by qq.entity"))
def time_variation(spark, d):
    """L04, rounded."""
    dests, groups = S.duration_groups(spark, d)
    return L.temporal_variation(L.conditioned(_cases(spark, d), groups, dests, ["state"], ["entity"]), ["entity"]).select("entity", F.round("variation", 6).alias("variation"))


@query(sql(CASES + """,
old as (select state, grp, max(dur_min) as longest from train join dests using (state, dest) group by state, grp)""", "select time_status, count(*) as rows from (select case when longest is null then 'sem_modelo' when age > longest then 'fora_do_suporte' when grp = 0 then 'grupo_comum' else 'grupo_proprio' end as time_status from lw left join old using (state, grp)) group by time_status"))
def time_statuses(spark, d):
    """L03."""
    dests, groups = S.duration_groups(spark, d)
    exact = S.steps(spark, d).filter("not holdout and state is not null and eligible and censoring = 'exata'").join(dests.select("state", "dest", "grp"), ["state", "dest"])
    oldest = exact.groupBy("state", "grp").agg(F.max("dur_min").alias("max_duration"))
    rows = _cases(spark, d).join(groups.select("state", "grp"), "state")
    return L.time_status(rows, oldest, ["state", "grp"]).groupBy("time_status").agg(F.count("*").alias("rows"))


@query(sql(PASSAGE + """,
g1 as (select src as start, dst, p, nullif(action, split_part(src, ':::', 1)) as action from e),
g2 as (select start, e.dst, g1.p * e.p as p, nullif(e.action, split_part(start, ':::', 1)) as action from g1 join e on g1.dst = e.src where g1.action is null),
g3 as (select start, e.dst, g2.p * e.p as p, nullif(e.action, split_part(start, ':::', 1)) as action from g2 join e on g2.dst = e.src where g2.action is null)""",
"select start, action, round(sum(p), 8) as score from (select * from g1 union all select * from g2 union all select * from g3) where action is not null group by start, action"))
def other_relevant_action(spark, d):
    """The start's own action doesn't count over the whole horizon."""
    states = S.states(spark, d)
    actions = states.filter(F.col("macro").isin(S.TARGETS)).select(F.col("state").alias("dst"), F.col("macro").alias("action"))
    own = states.select(F.col("state").alias("start"), F.col("macro").alias("action"))
    return L.first_action(S.edges(spark, d), actions, 3, own).select("start", "action", F.round("score", 8).alias("score"))


@query(sql(FREQUENCIES, f"select distinct c.state, round(epoch({CUT}) - epoch(c.ts), 3) as age from (select * from st qualify row_number() over (partition by entity order by ts desc) = 1) c where not ambiguous"))
def score_conditions(spark, d):
    """Every condition to be scored, once."""
    return L.distinct_conditions(_cases(spark, d).withColumn("age", F.round("age", 3)), ["state", "age"])


@query(sql(CASES + PASSAGE[len(STEPS):] + """,
fs as (select nw.entity, dest, e / tt * r as q from nw join (select entity, sum(e) as tt from nw group by entity) using (entity) join dests using (state, grp)),
l2 as (select start, action, sum(p) as score from (select start, action, p from h1 union all select start, action, p from h2) where action is not null group by start, action)""",
f"select entity, action, round(sum(q), 6) as score from (select entity, split_part(dest, ':::', 1) as action, q from fs where split_part(dest, ':::', 1) in {TARGETS} union all select entity, l2.action, q * score from fs join l2 on l2.start = fs.dest where split_part(dest, ':::', 1) not in {TARGETS}) group by entity, action"))
def first_action_scores(spark, d):
    """Each entity's first relevant action in three transitions, the first of which knows its age; rounded."""
    dests, groups = S.duration_groups(spark, d)
    return _first_actions(spark, d, dests, groups).withColumn("score", F.round("score", 6))


@query()
def censored_first_action_scores(spark, d):
    """As `first_action_scores`, with curves that censored steps take part in."""
    return _first_actions(spark, d, *S.censored_groups(spark, d))


def _first_actions(spark, d, dests, groups):
    first = L.conditioned(_cases(spark, d), groups, dests, ["state"], ["entity"])
    actions = S.states(spark, d).filter(F.col("macro").isin(S.TARGETS)).select(F.col("state").alias("dst"), F.col("macro").alias("action"))
    return L.first_action_by_age(first, S.edges(spark, d), actions, 3, ["entity"])


COUNTED = FREQUENCIES + """,
cm as (select entity, split_part(freq.dest, ':::', 1) as macro, sum(n)::double as score from (select * from st qualify row_number() over (partition by entity order by ts desc) = 1) c join freq using (state) where not c.ambiguous group by 1, 2),
rk as (select *, (row_number() over (partition by entity order by score desc, macro))::int as rank from cm)"""


def _counts(spark, d):
    model = K.transition_frequencies(S.steps(spark, d).filter("not holdout"))
    return _cases(spark, d).join(model.select("state", "dest", F.col("n").cast("double").alias("q")), "state")


@query(sql(COUNTED, "select entity, macro, score, rank from rk where rank <= 5"))
def immediate_macro_counts(spark, d):
    """L21."""
    return L.immediate_macros(_counts(spark, d), S.states(spark, d), ["entity"])


@query(sql(COUNTED, "select entity, rank, macro as action, score, 'ok' as row_status from rk where rank <= 5"))
def score_rows(spark, d):
    """Scores as lists, and the lists as rows."""
    scores = L.immediate_macros(_counts(spark, d), S.states(spark, d), ["entity"], 99).select("entity", F.col("macro").alias("action"), "score")
    return L.to_long(L.to_lists(scores, ["entity"]), ["entity"], {"cut": F.lit(S.CUT)}).select("entity", "rank", "action", "score", "row_status")


@query(sql(COUNTED + """,
sn as (select entity, dest, n::double as score, (row_number() over (partition by entity order by n desc, dest))::int as rank from (select c.entity, f.dest, f.n from (select * from st qualify row_number() over (partition by entity order by ts desc) = 1) c join freq f on f.state = c.state where not c.ambiguous))""",
"select entity, rank, a.dest as raw_action, a.score as raw_score, b.macro as useful_action, b.score as useful_score from (select * from sn where rank <= 5) a full join (select * from rk where rank <= 5) b using (entity, rank)"))
def aligned_lists(spark, d):
    """The likeliest states beside the likeliest macro actions."""
    counts = _counts(spark, d)
    raw = L.to_lists(counts.select("entity", F.col("dest").alias("action"), F.col("q").alias("score")), ["entity"]).select("entity", F.col("top").alias("raw"))
    useful = L.to_lists(L.immediate_macros(counts, S.states(spark, d), ["entity"], 99).select("entity", F.col("macro").alias("action"), "score"), ["entity"]).select("entity", F.col("top").alias("useful"))
    return L.aligned(raw.join(useful, "entity"), ["entity"], "raw", "useful")


WALK = FREQUENCIES + """,
ed as (select state as src, dest as dst, p, split_part(state, ':::', 1) = split_part(dest, ':::', 1) as same from freq),
walk as (
    select src as start, src as node, 1.0::double as mass, 0 as n from (select distinct src from ed)
    union all select w.start, e.dst, sum(w.mass * e.p), w.n + 1 from walk w join ed e on e.src = w.node where e.same and w.n < 400 and w.mass > 1e-16 group by w.start, e.dst, w.n
),
jm as (select start as src, e.dst, sum(mass * e.p) as p from walk join ed e on e.src = node where not e.same group by start, e.dst)"""


@query("with recursive" + sql(WALK, "select src, dst, round(p, 7) as p from jm where p > 1e-6")[4:])
def macro_jump_table(spark, d):
    """The first state in another macro action, from every state."""
    macros = S.states(spark, d).select(F.col("state").alias("node"), "macro", "state")
    rows = L.macro_jumps(S.edges(spark, d), macros).filter("kind = 'jump' and p > 1e-6")
    return rows.select("src", "dst", F.round("p", 7).alias("p"))


@query("with recursive" + sql(WALK + f""",
k1 as (select src as start, dst, p from jm),
k2 as (select start, j.dst, sum(k1.p * j.p) as p from k1 join jm j on j.src = k1.dst where split_part(k1.dst, ':::', 1) not in {TARGETS} group by 1, 2),
k3 as (select start, j.dst, sum(k2.p * j.p) as p from k2 join jm j on j.src = k2.dst where split_part(k2.dst, ':::', 1) not in {TARGETS} group by 1, 2)""",
f"select start as src, split_part(dst, ':::', 1) as action, change, round(sum(p), 7) as score from (select *, 1 as change from k1 union all select *, 2 from k2 union all select *, 3 from k3) where split_part(dst, ':::', 1) in {TARGETS} group by all")[4:])
def macro_targets(spark, d):
    """Targets by the number of macro changes."""
    macros = S.states(spark, d).select(F.col("state").alias("node"), "macro", "state")
    rows = L.macro_first_passage(L.macro_jumps(S.edges(spark, d), macros), macros, S.TARGETS, S.CHANGES)
    return rows.filter("kind = 'target'").select("src", "action", "change", F.round("score", 7).alias("score"))


@query("with recursive" + sql(WALK + """,
cu as (select entity, state from (select * from st qualify row_number() over (partition by entity order by ts desc) = 1) where not ambiguous),
fs as (select entity, f.state, f.dest, f.p from cu join freq f on f.state = cu.state),
ms as (select entity, split_part(dest, ':::', 1) as macro, p as q from fs where split_part(dest, ':::', 1) <> split_part(state, ':::', 1) union all select entity, split_part(j.dst, ':::', 1), fs.p * j.p from fs join jm j on j.src = fs.dest where split_part(dest, ':::', 1) = split_part(state, ':::', 1))""", "select entity, macro, round(sum(q), 6) as score from ms group by entity, macro")[4:])
def next_macro_scores(spark, d):
    """Each entity's next different macro action."""
    macros = S.states(spark, d).select(F.col("state").alias("node"), "macro", "state")
    model = K.transition_frequencies(S.steps(spark, d).filter("not holdout")).select("state", "dest", F.col("p").alias("q"))
    first = _cases(spark, d).join(model, "state").select("entity", "state", "dest", "q")
    return L.macro_scores(first, L.macro_jumps(S.edges(spark, d), macros), macros, ["entity"]).select("entity", "macro", F.round("score", 6).alias("score"))


# ---- evaluation


REALISED = FREQUENCIES + """,
rl as (select s.entity, s.step, s.state, s.dest, f.p, f.n / (f.origin_n + 5) as q, f.n, f.state is not null as hit, exists(select 1 from freq g where g.state = s.state) as modelled,
       (select count(*) from freq g where g.state = s.state and (g.n > f.n or g.n = f.n and g.dest <= f.dest)) as place from st s left join freq f on f.state = s.state and f.dest = s.dest where s.holdout and s.censoring = 'exata')"""


def _realised(spark, d):
    rows = S.steps(spark, d)
    model = K.transition_frequencies(rows.filter("not holdout")).select("state", "dest", "p", (F.col("n") / (F.col("origin_n") + 5)).alias("q"))
    cases = rows.filter("holdout and censoring = 'exata'").select("entity", "step", "state", "dest")
    return cases, model


@query(sql(REALISED, "select state, count(*) as cases, round(avg(modelled::int), 8) as coverage, round(avg(case when modelled then (hit and place <= 1)::int end), 8) as top1_time, round(avg(case when modelled then (hit and place <= 5)::int end), 8) as top5_static, round(avg(case when modelled then -ln(greatest(coalesce(q, 0), 1e-15)) end), 7) as nll from rl group by state"))
def destination_hits(spark, d):
    """M05, M07."""
    cases, model = _realised(spark, d)
    q = cases.select("entity", "step", "state").join(model, "state").drop("state")
    out = M.destination_metrics(q, cases, ["entity", "step"], ["state"])
    return out.select("state", "cases", F.round("coverage", 8).alias("coverage"), F.round("top1_time", 8).alias("top1_time"), F.round("top5_static", 8).alias("top5_static"), F.round("nll", 7).alias("nll"))


@query(sql(REALISED, "select state, count(*) as cases, round(avg(-ln(greatest(p, 1e-15))), 8) as loss_without, round(avg(-ln(greatest(q, 1e-15))), 8) as loss_with, round(avg(-ln(greatest(p, 1e-15))) - avg(-ln(greatest(q, 1e-15))), 8) as gain from rl where hit group by state"))
def gains_by_state(spark, d):
    """M04."""
    cases, model = _realised(spark, d)
    out = M.temporal_gain(cases.join(model, ["state", "dest"]), "q", "p", ["state"])
    return out.select("state", "cases", *(F.round(c, 8).alias(c) for c in ("loss_without", "loss_with", "gain")))


@query("select o_custkey, o_orderkey, o_orderstatus as variant from orders where o_custkey in (select o_custkey from orders group by o_custkey having count(distinct o_orderstatus) = 3)")
def complete_customers(spark, d):
    """M06."""
    return M.complete_pairs(Q.orders(spark, d).select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("variant")), ["o_custkey"], 3)


@query("""with c as (select o_custkey, o_orderstatus as variant, max(o_totalprice) as loss from orders group by all),
    p as (select a.o_custkey % 5 as bucket, a.loss as r, b.loss as c from c a join c b on a.o_custkey = b.o_custkey and a.variant = 'F' and b.variant = 'O')
    select bucket, count(*) as cases, round(avg(c - r), 4) as delta, count(*) filter (c < r) as better, count(*) filter (c > r) as worse from p group by bucket""")
def paired_loss_counts(spark, d):
    """M16."""
    rows = Q.orders(spark, d).groupBy("o_custkey", F.col("o_orderstatus").alias("variant")).agg(F.max("o_totalprice").alias("loss"))
    pairs = R.paired(rows, "variant", "F", "O", ["o_custkey"], ["loss"]).withColumn("bucket", F.col("o_custkey") % 5)
    return M.paired_losses(pairs, "loss_reference", "loss_candidate", ["bucket"]).select("bucket", "cases", F.round("delta", 4).alias("delta"), "better", "worse")


@query(sql(STEPS + """,
ts_ as (select state, age, count(*) as at_risk from st, (select unnest([0.0, 1800.0, 86400.0, 604800.0])::double as age) where eligible and dur_min > age group by state, age),
mx as (select state, max(dur_min) as longest from st where eligible and not holdout and censoring = 'exata' group by state)""", "select cause, count(*) as rows from (select case when at_risk is null then 'sem_suporte' when a.age > coalesce(longest, 0) then 'extrapolado' when at_risk < 30 then 'cauda_rala' else 'nenhum' end as cause from (select distinct state, age from (select distinct state from st where state is not null), (select unnest([0.0, 1800.0, 86400.0, 604800.0, 1e9])::double as age)) a left join ts_ using (state, age) left join mx using (state)) group by cause"))
def error_causes(spark, d):
    """Causes by state and age."""
    rows = S.steps(spark, d)
    support = K.tail_support(rows, ["state"], S.AGES).select("state", "age", "at_risk")
    longest = rows.filter("eligible and not holdout and censoring = 'exata'").groupBy("state").agg(F.max("dur_min").alias("longest"))
    ages = F.explode(F.array(*(F.lit(float(a)) for a in [*S.AGES, 1e9])))
    grid = rows.filter("state is not null").select("state").distinct().withColumn("age", ages).join(support, ["state", "age"], "left").join(longest, "state", "left")
    judged = M.triage(grid.withColumn("extrapolated", F.col("age") > F.coalesce("longest", F.lit(0.0))).withColumn("at_bound", F.lit(False)))
    return judged.groupBy("cause").agg(F.count("*").alias("rows"))


@query(sql(STEPS + """,
wh as (select state, dest, count(*) as n from st where eligible and censoring = 'exata' group by state, dest),
tr as (select state, dest, count(*) as n from st where eligible and censoring = 'exata' and not holdout group by state, dest)""", "select state, dest, wh.n, tr.n as n_b from wh join tr using (state, dest) where wh.n <> tr.n"))
def changed_counts(spark, d):
    """M23."""
    rows = S.steps(spark, d)
    whole, train = (K.transition_frequencies(x).select("state", "dest", "n") for x in (rows, rows.filter("not holdout")))
    return M.not_identical(whole, train, ["state", "dest"], ["n"]).select("state", "dest", "n", "n_b")


@query(sql(REALISED, "select state, count(*) as cases, count(*) filter (p < 0.05) as very_low, count(*) filter (p < 0.02) as clipped, count(*) filter (p is null) as missing, round(min(p), 9) as least from rl group by state"))
def extreme_probabilities(spark, d):
    """M24."""
    cases, model = _realised(spark, d)
    out = M.extremes(cases.join(model, ["state", "dest"], "left"), "p", ["state"], very_low=0.05, floor=0.02)
    return out.withColumn("least", F.round("least", 9))


@query(sql(HITS + """,
ct as (select m.age, target, entity, (label_status = 'ALVO_OBSERVADO' and action = target)::int as re, b.p as p, rank_real from (select * from mt where label_status <> 'CENSURADO_ANTES_HORIZONTE') m, (select unnest(['error', 'purchase', 'signup']) as target) t join base b on b.age = m.age and b.outcome = target)""",
"select age, target, round(avg(b), 8) as brier, round(avg(r1), 8) as recall1, sum(k)::bigint as support from (select age, target, entity, avg((p - coalesce(re, 0)) ** 2) as b, avg(case when re = 1 then coalesce((rank_real <= 1)::int, 0) end) as r1, sum(coalesce(re, 0)) as k from ct group by all) group by age, target"))
def target_scores(spark, d):
    """M14, rounded."""
    rows, targets = _evaluated(spark, d)
    out = M.action_summary(rows, targets.withColumnRenamed("action", "target"), ["age"])
    return out.select("age", "target", F.round("brier", 8).alias("brier"), F.round("recall1", 8).alias("recall1"), "support")


# ---- diagnostics


@query(TOP + f""" select li.state, coalesce(c.memory, '-') as memory, ((li.age >= 1800)::int + (li.age >= 86400)::int + (li.age >= 604800)::int)::int as age_band, next_state as action, count(*) as entities
    from li join (select entity, memory from st qualify row_number() over (partition by entity order by ts desc) = 1) c using (entity) where rank = 1 group by all""")
def first_actions(spark, d):
    """N14."""
    lists = _lists(spark, d).join(S.current(spark, d).select("entity", "memory"), "entity")
    return N.first_by_condition(lists).drop("share")


@query(sql(FREQUENCIES, "select dest as action, count(*) as kernels, count(*) filter (place > 5) as outside, min(place)::int as best_rank from (select dest, row_number() over (partition by state order by p desc, dest) as place from freq) group by dest"))
def beyond_lists(spark, d):
    """N16."""
    model = K.transition_frequencies(S.steps(spark, d).filter("not holdout"))
    return N.outside_lists(model.select("state", F.col("dest").alias("action"), F.col("p").alias("score")), ["state"])


@query(sql(STEPS, "select (case when n >= 100 then 3 when n >= 20 then 2 when n >= 5 then 1 else 0 end)::int as volume_band, count(*) as entities, sum(n)::bigint as volume from (select entity, count(*) as n from st where macro is not null group by entity) group by 1"))
def volume_bands(spark, d):
    """N02 with the bands 5, 20 and 100."""
    rows = N.concentration(S.steps(spark, d).filter("macro is not null"), bands=(5, 20, 100))
    return rows.groupBy("volume_band").agg(F.count("*").alias("entities"), F.sum("volume").alias("volume"))


@query(sql(BLOCKS + """,
tr as (select lag(macro) over w as previous, entry_state as focus, lead(macro) over w as next from bl window w as (partition by entity order by block)),
ok as (select * from tr where previous is not null and next is not null)""", "select previous, focus, next, n, round(n / given, 9) as p_given, round(m / fm, 9) as p_all from (select previous, focus, next, count(*) as n, sum(count(*)) over (partition by previous, focus) as given from ok group by previous, focus, next) join (select focus, next, count(*) as m, sum(count(*)) over (partition by focus) as fm from ok group by focus, next) using (focus, next)"))
def entry_dependence(spark, d):
    """Conditioned on the state that entered the block."""
    triples = J.block_triples(J.funnel_blocks(S.steps(spark, d))).withColumn("focus", F.col("entry_state"))
    return N.context_dependence(triples.filter("focus is not null")).select("previous", "focus", "next", "n", F.round("p_given", 9).alias("p_given"), F.round("p_all", 9).alias("p_all"))


@query(TOP + f""" select (select count(distinct user_id) from events) as audience, (select count(distinct user_id::varchar) from events where user_id::varchar not in (select entity from li where rank is not null)) as without_list, count(distinct entity) as with_list, round(stddev_pop(p), 7) as score_sd, count(distinct next_state) filter (rank = 1) as first_actions from li where rank is not null""")
def audience_audit(spark, d):
    """N18, rounded."""
    return N.operational_audit(S.current(spark, d), _lists(spark, d)).withColumn("score_sd", F.round("score_sd", 7))


# ---- propensity


@query(sql(RAW, "select strftime(w + interval 7 day, '%Y%m%d') as cohort, true as valid, epoch(w + interval 8 hour)::bigint as window_start, epoch(w + interval 7 day + interval 8 hour)::bigint as window_end, count(*) as events, count(distinct entity) as entities from (select *, date_trunc('week', ts - interval 8 hour)::timestamp as w from raw) group by w"))
def weekly_events(spark, d):
    """Events of each cohort's window, the week before its Monday."""
    rows = P.current_cohort(S.raw_events(spark, d), "ts")
    following = F.date_format(F.date_add(F.to_date("cohort", "yyyyMMdd"), 7), "yyyyMMdd")
    weeks = rows.groupBy(following.alias("cohort")).agg(F.count("*").alias("events"), F.countDistinct("entity").alias("entities"))
    return P.weekly_window(weeks).select("cohort", "valid", seconds("window_start"), seconds("window_end"), "events", "entities")


@query("select o_orderkey, c_name, document, active from (select o_orderkey, o_custkey from orders where o_orderstatus = 'O' and o_orderdate >= timestamp '2000-01-01') join (select c_custkey, c_name, regexp_replace(c_name, '[^0-9]', '', 'g') as document, case when c_nationkey % 3 = 0 then 1 when c_nationkey % 3 = 1 then 0 end::int as active from customer) on c_custkey = o_custkey")
def anchored_people(spark, d):
    """P04, P05."""
    people = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_name").alias("document"), F.element_at(F.array(F.lit(" s"), F.lit("N"), F.lit("?")), (F.col("c_nationkey") % 3 + 1).cast("int")).alias("active"))
    people = P.normalised_people(people, "document", ["active"])
    return P.anchor_table(Q.anchors(spark, d), people, "o_custkey").select("o_orderkey", "c_name", "document", "active")


@query("select event_id, case when event_id % 3 = 0 then null when event_id % 3 = 1 then value end as value, null::double as missing from events")
def cleaned_values(spark, d):
    """What isn't a finite number is null; columns that lack are null."""
    events = spark.read.parquet(f"{d}/events.parquet")
    text = F.when(F.col("event_id") % 3 == 0, "odd").when(F.col("event_id") % 3 == 1, F.col("value").cast("string")).otherwise("Infinity")
    clean = P.cleaned_features(events.withColumn("value", text), ["event_id"], ["value"])
    return P.fixed_schema(clean, T.StructType().add("event_id", "long").add("value", "double").add("missing", "double"))


@query(sql(RAW, "select strftime(w, '%Y%m%d') as cohort, count(*) as events from (select *, date_trunc('week', ts - interval 8 hour) as w from raw) where w + interval 8 hour < timestamp '2024-01-17' group by w having date_diff('day', (w + interval 8 hour)::date, date '2024-02-16') > 30"))
def matured_cohorts(spark, d):
    """Cohorts that are old enough to be judged."""
    rows = P.current_cohort(S.raw_events(spark, d), "ts").groupBy("cohort").agg(F.count("*").alias("events"))
    windows = P.weekly_window(rows).withColumn("target", F.lit(None).cast("int"))
    return P.matured(windows, "2024-02-16").select("cohort", "events")


@query("select sha256(o_orderkey || '|' || o_custkey) as technical_key, o_totalprice, (o_orderstatus = 'F')::int as target from orders")
def training_rows(spark, d):
    """P20."""
    rows = Q.orders(spark, d).withColumn("target", (F.col("o_orderstatus") == "F").cast("int"))
    return P.training_output(rows, ["o_orderkey", "o_custkey"], ["o_totalprice"])


# ---- streams


@query(sql(STEPS, "select l.entity, epoch(l.ts)::bigint as ts, l.state, l.memory, l.ambiguous, n.events from (select * from st qualify row_number() over (partition by entity order by ts desc) = 1) l join (select entity, count(*) as events from raw group by entity) n using (entity)"))
def streamed_states(spark, d):
    """The events as a stream; each entity's state after the last batch."""
    folder = _folder(spark)
    S.raw_events(spark, d).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("entity string, ts timestamp, state string, depth double").parquet(f"{folder}/in")
    out = I.current_states(stream, S.TECHNICAL).writeStream.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{folder}/out"))
    out.outputMode("update").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{folder}/out").groupBy("entity").agg(F.max_by(F.struct("ts", "state", "memory", "ambiguous", "events"), "batch").alias("l")).select("entity", "l.*")
    return last.select("entity", seconds("ts"), "state", "memory", "ambiguous", "events")


@query("select epoch(date_trunc('day', ts))::bigint as day, count(*) as events from events where ts > timestamp '2024-01-20' group by 1")
def streamed_future(spark, d):
    """Events beyond the present by day, counted as they come."""
    folder = _folder(spark)
    spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("ts timestamp").parquet(f"{folder}/in")
    out = I.future_events(stream, "2024-01-20").writeStream.foreachBatch(lambda df, i: df.select(F.col("day.start").alias("day"), "count").withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{folder}/out"))
    out.outputMode("update").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{folder}/out").groupBy("day").agg(F.max_by("count", "batch").alias("events"))
    return last.select(seconds("day"), "events")
