"""Registry of the journey queries and of their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import hash_bucket, micros
from .operators import describe as N
from .operators import evaluation as M
from .operators import journey as J
from .operators import models as K
from .operators import propensity as P
from .operators import quality as B
from .operators import relational as R
from .operators import scoring as L
from .oracles import ACTIONS, BANDED, BLOCKS, CUT, FREQUENCIES, GROUPS, INSTANTS, LABELS, RAW, STEPS, TARGETS, TIMEOUT, sql
from .plans import journeys as S
from .plans import propensity as Q
from .sources import tables as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def r9(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9).alias(c if isinstance(c, str) else "value")


def seconds(c: str) -> Column:
    return F.floor(micros(c) / 1000000).alias(c)


# ---- sources, samples, gates


@query(sql(RAW, "select count(*) as events, 0::bigint as no_entity, count(*) filter (state is null)::bigint as no_state, 0::bigint as no_time, 0::bigint as synthetic_state, 0::bigint as odd_depth from raw"))
def event_problems(spark, d):
    return B.event_problems(S.raw_events(spark, d))


@query(sql(RAW, "select entity, count(*) as events, ('0x' || substr(md5('holdout|' || entity), 1, 8))::bigint % 5 = 0 as holdout from raw where ('0x' || substr(md5('sample|' || entity), 1, 8))::bigint % 3 = 1 group by entity"))
def entity_sample(spark, d):
    return B.with_holdout(B.sample_entities(S.raw_events(spark, d), 3, 1)).groupBy("entity", "holdout").agg(F.count("*").alias("events"))


@query(sql(STEPS, "select state, entity, step from st where state is not null qualify row_number() over (partition by state order by sha256(concat_ws('|', entity, step::varchar, 'cap')), entity, step) <= 20"))
def capped_per_origin(spark, d):
    return B.capped_per_key(S.steps(spark, d).filter("state is not null"), 20, ["state"], ["entity", "step"]).select("state", "entity", "step")


@query("select day::date as day, count(entity)::bigint as events, count(distinct entity)::bigint as entities from (select unnest(generate_series(date '2023-12-30', date '2024-01-31', interval 1 day)) as day) left join (select user_id as entity, ts from events where date_trunc('hour', ts) < " + CUT + ") on ts::date = day::date group by day")
def daily_coverage(spark, d):
    return B.daily_coverage(S.raw_events(spark, d), A.calendar(spark, "2023-12-30", "2024-01-31")).select("day", "events", "entities")


@query(sql(RAW, "select epoch(min(ts))::bigint as first_ts, epoch(max(ts))::bigint as last_ts, 0::bigint as future_events, round((epoch(timestamp '2024-01-30') - epoch(max(ts))) / 3600, 6) as lag_hours, (epoch(timestamp '2024-01-30') - epoch(max(ts))) / 3600 > 72 as stale from raw"))
def freshness(spark, d):
    return B.freshness(S.raw_events(spark, d), S.NOW).select(seconds("first_ts"), seconds("last_ts"), "future_events", F.round("lag_hours", 6).alias("lag_hours"), "stale")


@query("with n as (select user_id::varchar as id from events) select count(*) as rows, count(*) filter (regexp_full_match(trim(id), '[0-9]{2}')) as valid from n")
def identifier_check(spark, d):
    ids = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("id"))
    return B.normalised_ids(ids, "id", 2).agg(F.count("*").alias("rows"), F.count_if("valid").alias("valid"))


@query(sql(FREQUENCIES, "select state, round(sum(p), 9) as total from freq group by state having abs(sum(p) - 1) > 1e-8"))
def odd_probabilities(spark, d):
    model = K.transition_frequencies(S.steps(spark, d).filter("not holdout"))
    return B.odd_probabilities(model, ["state"]).select("state", F.round("total", 9).alias("total"))


@query(sql(STEPS, "select entity, step from st where not coalesce(case censoring when 'exata' then dur_min > 0 and dur_min = dur_max when 'direita' then dur_min >= 0 and dur_max is null else true end, false)"))
def odd_durations(spark, d):
    return B.odd_durations(S.steps(spark, d)).select("entity", "step")


@query(sql(STEPS, "select dest as state, 'right' as only_in from st where not holdout and dest is not null and dest not in (select state from st where holdout and state is not null) group by dest union select state, 'left' from st where holdout and state is not null and state not in (select dest from st where not holdout and dest is not null) group by state"))
def coverage_gap(spark, d):
    rows = S.steps(spark, d)
    return B.coverage_gap(rows.filter("holdout and state is not null"), rows.filter("not holdout and dest is not null").select(F.col("dest").alias("state")), ["state"])


@query(sql(STEPS, "select entity, step from (select *, lag(ts) over (partition by entity order by step) as before from st) where evidence_step > step or ts <= before or ts >= " + CUT))
def time_leaks(spark, d):
    return B.time_leaks(S.steps(spark, d), S.CUT).select("entity", "step")


@query(sql(STEPS, "select state, count(*) filter (not holdout)::bigint as train_n, count(*) filter (holdout)::bigint as holdout_n, count(*) filter (not holdout) = count(*) filter (holdout) as agree from st where state is not null group by state"))
def split_reconciliation(spark, d):
    rows = S.steps(spark, d).filter("state is not null")
    return B.count_reconciliation({"train": rows.filter("not holdout"), "holdout": rows.filter("holdout")}, ["state"], {"n": F.count("*")})


@query(f"""with {RAW},
hashed as (select sha256('{{"depth":' || coalesce(depth::varchar, 'null') || ',"entity":"' || entity || '","state":"' || state || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') || '"}}') as h from raw)
select count(*) as rows, sum(('0x' || h[1:16])::ubigint)::varchar as sum_0, sum(('0x' || h[17:32])::ubigint)::varchar as sum_1, sum(('0x' || h[33:48])::ubigint)::varchar as sum_2, sum(('0x' || h[49:64])::ubigint)::varchar as sum_3 from hashed""")
def content_signature(spark, d):
    found = A.signature(S.raw_events(spark, d))
    return found.select("rows", *(F.col(f"sum_{i}").cast("string").alias(f"sum_{i}") for i in range(4)))


@query(sql(STEPS, "select state, 'changed' as change from (select state, count(*) as n, count(*) filter (not holdout) as m from st where state is not null group by state) where n <> m and m > 0 union all select state, 'removed' from (select state, count(*) filter (not holdout) as m from st where state is not null group by state) where m = 0"))
def changed_parameters(spark, d):
    rows = S.steps(spark, d).filter("state is not null")
    count = lambda x: x.groupBy("state").agg(F.count("*").alias("n"))
    return A.changed_parameters(count(rows), count(rows.filter("not holdout")), ["state"])


# ---- state sequences


@query(sql(RAW, "select entity, epoch(ts)::bigint as ts, case when count(distinct state) = 1 then max(state) end as state, count(distinct state) > 1 as ambiguous, count(*) as n_events from raw group by entity, ts"))
def instants(spark, d):
    return J.instants(S.raw_events(spark, d)).select("entity", seconds("ts"), "state", "ambiguous", "n_events")


@query(sql(INSTANTS, "select entity, epoch(ts)::bigint as ts, state, ambiguous, n_events, resolved_by_depth from inst"))
def instants_by_depth(spark, d):
    return J.instants_by_depth(S.raw_events(spark, d)).select("entity", seconds("ts"), "state", "ambiguous", "n_events", "resolved_by_depth")


@query(sql(RAW, "select entity, epoch(ts)::bigint as ts, string_agg(distinct state, '+' order by state) as candidates from (select *, max(depth) over (partition by entity, ts) as top from raw) where depth is not distinct from top group by entity, ts"))
def instant_candidates(spark, d):
    return J.instants_with_candidates(S.raw_events(spark, d)).select("entity", seconds("ts"), F.array_join("candidates", "+").alias("candidates"))


@query(sql(RAW, "select entity, epoch(ts)::bigint as ts, false as imprecise, count(*) as n from raw where depth >= 1 and (entity, ts::date) not in (select entity, ts::date from raw where depth < 1) group by entity, ts union all select distinct entity, epoch(ts::date)::bigint, true, 1 from raw where depth < 1"))
def imprecise_days(spark, d):
    raw = S.raw_events(spark, d)
    rows = J.imprecise_days(raw.filter("depth >= 1"), raw.filter("depth < 1"), S.CUT)
    return rows.groupBy("entity", seconds("ts"), "imprecise").agg(F.count("*").alias("n"))


SESSIONS = f"""{RAW},
ins as (select entity, ts, case when count(distinct state) = 1 then max(state) end as state, count(distinct state) > 1 as ambiguous from raw group by entity, ts),
mk as (select *, coalesce(state = lag(state) over w and not ambiguous and not lag(ambiguous) over w and epoch(ts) - epoch(lag(ts) over w) <= {TIMEOUT}, false) as same from ins window w as (partition by entity order by ts)),
bk as (select *, sum(case when same then 0 else 1 end) over (partition by entity order by ts rows unbounded preceding) as block from mk),
ses as (select entity, block::bigint as block, min(ts) as start_ts, max(ts) as last_ts, max(state) as state, bool_or(ambiguous) as ambiguous, count(*) as n_instants from bk group by entity, block)"""


@query(sql(SESSIONS, "select entity, block, epoch(start_ts)::bigint as start_ts, epoch(last_ts)::bigint as last_ts, state, ambiguous, n_instants from ses"))
def sessions(spark, d):
    return S.sessions(spark, d).select("entity", "block", seconds("start_ts"), seconds("last_ts"), "state", "ambiguous", "n_instants")


@query(sql(SESSIONS + f""",
nx as (select *, lead(start_ts) over w as next_start, last_ts + interval {TIMEOUT} second as timeout_ts, lag(start_ts) over w is not null as has_before, lag(ambiguous) over w as was from ses window w as (partition by entity order by block)),
si as (select *, timeout_ts < {CUT} and (next_start is null or timeout_ts < next_start) as silent from nx),
ob as (select *, has_before and (not coalesce(was, true) or coalesce(lag(silent) over (partition by entity order by block), false)) as start_observed from si),
un as (
    select entity, block, 0 as part, start_ts as ts, state, ambiguous, state as last_action, case when silent then timeout_ts else coalesce(next_start, {CUT}) end as end_ts, start_observed from ob
    union all select entity, block, 1, timeout_ts, 'sem_acao', false, state, coalesce(next_start, {CUT}), true from ob where silent
)""", "select entity, row_number() over w as step, epoch(ts)::bigint as ts, epoch(end_ts)::bigint as end_ts, state, last_action, ambiguous, start_observed, lead(state) over w as next_state from un window w as (partition by entity order by block, part)"))  # fmt: skip
def silences(spark, d):
    rows = J.with_silence(S.sessions(spark, d), S.TIMEOUT, S.CUT)
    return rows.select("entity", F.col("step").cast("long").alias("step"), seconds("ts"), seconds("end_ts"), "state", "last_action", "ambiguous", "start_observed", "next_state")


@query(sql(SESSIONS + f""",
nx as (select *, epoch(last_ts) - epoch(start_ts) as span, epoch(lead(start_ts) over w) - epoch(last_ts) as gap, epoch({CUT}) - epoch(last_ts) as to_cut from ses window w as (partition by entity order by block)),
ty as (select *, gap is null and to_cut <= {TIMEOUT} as open_end, coalesce(gap <= {TIMEOUT}, false) as quick from nx),
ce as (select *, case when ambiguous then 'origem_ambigua' when open_end then 'direita' when quick then 'exata' else 'intervalo' end as censoring from ty),
un as (
    select entity, block, 0 as part, state, censoring, case censoring when 'exata' then span + gap when 'direita' then span + to_cut else span end as dur_min, case censoring when 'exata' then span + gap when 'intervalo' then span + {TIMEOUT} end as dur_max from ce
    union all select entity, block, 1, 'sem_acao', case when gap is null then 'direita' else 'intervalo' end, coalesce(gap, to_cut) - {TIMEOUT}, gap from ce where not open_end and not quick
)""", "select entity, row_number() over (partition by entity order by block, part) as step, state, censoring, round(dur_min, 3) as dur_min, round(dur_max, 3) as dur_max from un"))  # fmt: skip
def interval_censored(spark, d):
    rows = J.interval_censored(S.sessions(spark, d), S.TIMEOUT, S.CUT)
    return rows.select("entity", F.col("step").cast("long").alias("step"), "state", "censoring", F.round("dur_min", 3).alias("dur_min"), F.round("dur_max", 3).alias("dur_max"))


@query(sql(ACTIONS, "select entity, step, epoch(ts)::bigint as ts, epoch(first_ts)::bigint as first_ts, state, ambiguous, n_events, n_instants from act"))
def debounced_actions(spark, d):
    return S.actions(spark, d).select("entity", "step", seconds("ts"), seconds("first_ts"), "state", "ambiguous", "n_events", "n_instants")


@query(sql(STEPS, "select entity, step, state, dest, censoring, round(dur_min, 3) as dur_min, round(dur_max, 3) as dur_max, eligible, self_transition, holdout from st"))
def transitions(spark, d):
    return S.steps(spark, d).select("entity", "step", "state", "dest", "censoring", F.round("dur_min", 3).alias("dur_min"), F.round("dur_max", 3).alias("dur_max"), "eligible", "self_transition", "holdout")


@query(sql(STEPS, "select entity, step, memory, evidence_step, context, segment::bigint as segment, event_weight::double as event_weight, round(entity_weight, 9)::double as entity_weight from st"))
def memory_and_weights(spark, d):
    return S.steps(spark, d).select("entity", "step", "memory", "evidence_step", "context", "segment", "event_weight", F.round("entity_weight", 9).alias("entity_weight"))


@query(sql(STEPS, f"select p.entity, state, memory, round(epoch({CUT}) - epoch(ts), 3) as age, case when ts is null then 'sem_historico' when ambiguous then 'ambiguo' else 'ok' end as input_status from (select distinct user_id::varchar as entity from events) p left join (select * from st qualify row_number() over (partition by entity order by ts desc) = 1) l on l.entity = p.entity"))
def current_states(spark, d):
    return S.current(spark, d).select("entity", "state", "memory", F.round("age", 3).alias("age"), "input_status")


@query(sql(STEPS, "select state, funnel, stage, case when technical then 'tecnico' else 'negocio' end as kind, macro, technical from cat"))
def state_catalog(spark, d):
    return S.states(spark, d)


@query(sql(STEPS, "select macro, count(*) as events, count(distinct raw.state) as states, string_agg(distinct stage, '+' order by stage) as stages from raw join cat using (state) group by macro"))
def macro_summary(spark, d):
    return J.macro_summary(S.raw_events(spark, d), S.states(spark, d)).select("macro", "events", "states", F.array_join("stages", "+").alias("stages"))


@query(sql(STEPS, "select distinct funnel as target from cat where not technical"))
def candidate_targets(spark, d):
    return J.candidate_targets(S.states(spark, d))


@query(sql(BLOCKS, "select entity, block, macro, first_step, entry_state, epoch(start_ts)::bigint as start_ts, epoch(last_ts)::bigint as last_ts, steps from bl"))
def funnel_blocks(spark, d):
    return J.funnel_blocks(S.steps(spark, d)).select("entity", "block", "macro", "first_step", "entry_state", seconds("start_ts"), seconds("last_ts"), "steps")


@query(sql(BLOCKS, "select entity, block, lag(macro) over w as previous, macro as focus, lead(macro) over w as next, coalesce(lag(macro) over w is not null and lead(macro) over w is not null, false) as complete from bl window w as (partition by entity order by block)"))
def block_triples(spark, d):
    return J.block_triples(J.funnel_blocks(S.steps(spark, d))).drop("entry_state")


@query(sql(LABELS, "select entity, step, trajectory::bigint as trajectory, label_status, action, change, changes_seen from lab"))
def first_target_labels(spark, d):
    return S.labels(spark, d).select("entity", "step", "trajectory", "label_status", "action", "change", "changes_seen")


@query(sql(STEPS, """select entity, step, hit_step is not null as hit, hit_step from (
    select entity, step, case when h1 then 1 when h2 then 2 when h3 then 3 end as hit_step from (
        select *, macro = 'purchase' as h0, lead(coalesce(macro, '-') = 'purchase', 1) over w as h1, lead(coalesce(macro, '-') = 'purchase', 2) over w as h2, lead(coalesce(macro, '-') = 'purchase', 3) over w as h3
        from st window w as (partition by entity order by step)) where h3 is not null)
    qualify row_number() over (partition by entity order by sha256(concat_ws('|', entity, step::varchar, 'snapshot')), step) = 1"""))  # fmt: skip
def step_hits(spark, d):
    return J.step_hits(S.steps(spark, d), F.coalesce(F.col("macro"), F.lit("-")) == "purchase", 3).select("entity", "step", "hit", "hit_step")


@query(sql(STEPS, f"select entity, step, age, epoch(ts)::bigint + age::bigint as snapshot_ts from st, (select unnest([0.0, 1800.0, 86400.0, 604800.0])::double as age) where dur_min > age and epoch(ts) + age < epoch({CUT})"))
def age_snapshots(spark, d):
    return J.age_snapshots(S.steps(spark, d), S.AGES, S.CUT).select("entity", "step", "age", seconds("snapshot_ts"))


@query(sql(STEPS, "select entity, step, day(ts)::int as day_of_month, date_diff('day', ts::date, last_day(ts::date))::int as days_to_month_end, (dayofweek(ts) + 1)::int as weekday, round((epoch(ts) - epoch(lag(ts) over w)) / 86400, 6) as days_since_same, count(*) over (partition by entity, macro order by ts range between interval 7 day preceding and interval 1 second preceding) as same_in_7_days from st where macro is not null window w as (partition by entity, macro order by ts)"))
def calendar_features(spark, d):
    rows = J.calendar_features(S.steps(spark, d).filter("macro is not null"))
    return rows.select("entity", "step", "day_of_month", "days_to_month_end", "weekday", F.round("days_since_same", 6).alias("days_since_same"), "same_in_7_days")


@query()
def snapshot_ids(spark, d):
    return J.with_snapshot_id(J.age_snapshots(S.steps(spark, d), S.AGES, S.CUT), ["entity", "step", "age"]).select("snapshot_id", "entity", "step", "age")


# ---- joins and aggregations


@query("""select a.o_orderkey, b.o_orderkey as previous_id, b.o_totalprice as previous_o_totalprice, b.o_orderkey is null as no_history
    from orders a left join orders b on a.o_custkey = b.o_custkey and b.o_orderdate < a.o_orderdate
    where a.o_orderstatus = 'O' and a.o_orderdate >= timestamp '2000-01-01'
    qualify row_number() over (partition by a.o_orderkey order by b.o_orderdate desc nulls last, b.o_orderkey desc nulls last) = 1""")  # fmt: skip
def latest_prior_order(spark, d):
    rows = R.as_of(Q.anchors(spark, d), Q.orders(spark, d), "o_custkey", "o_orderdate", "o_orderkey", "o_orderdate", "o_orderdate", "o_orderkey", ["o_totalprice"])
    return rows.drop("previous_known")


@query("""select a.o_orderkey, count(b.o_orderkey) as previous, count(*) filter (b.o_orderstatus = 'F') as previous_closed, count(*) filter (b.o_orderstatus = 'P') as previous_pending,
    date_diff('day', max(b.o_orderdate)::date, any_value(a.o_orderdate)::date)::int as days_since_last, date_diff('day', min(b.o_orderdate)::date, any_value(a.o_orderdate)::date)::int as history_days, (count(b.o_orderkey) = 0)::int as no_history
    from orders a left join orders b on a.o_custkey = b.o_custkey and b.o_orderdate < a.o_orderdate where a.o_orderstatus = 'O' and a.o_orderdate >= timestamp '2000-01-01' group by a.o_orderkey""")  # fmt: skip
def order_history(spark, d):
    rows = P.history_features(Q.anchors(spark, d), Q.orders(spark, d), "o_custkey", "o_orderdate", "o_orderkey", "o_orderdate", "o_orderkey", {"closed": "F", "pending": "P"}, "o_orderstatus")
    return rows.drop("o_custkey", "o_totalprice", "o_orderdate")


@query("""with items as (select o_custkey, o_orderdate as begun, l_shipdate as ended, l_discount from orders join lineitem on l_orderkey = o_orderkey),
    a as (select * from orders where o_orderstatus = 'O' and o_orderdate >= timestamp '2000-01-01')
    select o_orderkey, count(i.begun) as contracts, count(i.begun) filter (i.ended > i.begun and i.ended < a.o_orderdate) as ended, count(i.begun) - count(i.begun) filter (i.ended > i.begun and i.ended < a.o_orderdate) as active,
           max(date_diff('day', i.begun::date, i.ended::date))::int as longest_days, coalesce(max((l_discount > 0.05)::int), 0)::int as overdue, date_diff('day', min(i.begun)::date, any_value(a.o_orderdate)::date)::int as tenure_days
    from a left join items i on i.o_custkey = a.o_custkey and i.begun < a.o_orderdate group by o_orderkey""")  # fmt: skip
def contract_features(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.col("l_shipdate").cast("timestamp").alias("ended"), "l_discount")
    contracts = items.join(Q.orders(spark, d).select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderdate").alias("begun")), "l_orderkey")
    rows = P.relationship_features(Q.anchors(spark, d), contracts, "o_custkey", "o_orderdate", "o_orderkey", "begun", "ended", F.col("l_discount") > 0.05, {})
    return rows.select("o_orderkey", "contracts", "ended", "active", "longest_days", "overdue", "tenure_days")


@query("""select a.o_orderkey, round(avg(b.p), 6) as mean_o_totalprice from orders a left join (select distinct o_custkey, o_orderdate, o_totalprice as p from orders) b on a.o_custkey = b.o_custkey and b.o_orderdate < a.o_orderdate
    where a.o_orderstatus = 'O' and a.o_orderdate >= timestamp '2000-01-01' group by a.o_orderkey""")
def mean_features(spark, d):
    rows = P.mean_features(Q.anchors(spark, d), Q.orders(spark, d), "o_custkey", "o_orderdate", "o_orderkey", "o_orderdate", ["o_totalprice"])
    return rows.select("o_orderkey", F.round("mean_o_totalprice", 6).alias("mean_o_totalprice"))


@query("""select o_orderkey, exists(select 1 from orders b where b.o_custkey = a.o_custkey and b.o_orderstatus = 'F' and b.o_orderdate >= a.o_orderdate and b.o_orderdate < timestamp '2001-07-01')::int as target
    from orders a where o_orderstatus = 'O' and o_orderdate >= timestamp '2000-01-01'""")
def attributed_outcomes(spark, d):
    paid = Q.orders(spark, d).filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderdate").alias("paid_at"))
    return P.attributed(Q.anchors(spark, d), paid, "o_custkey", "o_orderdate", "2001-07-01", "paid_at").select("o_orderkey", "target")


@query("select o_orderkey from orders where o_orderstatus = 'O' and o_orderdate >= timestamp '2000-01-01' and o_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def excluded_customers(spark, d):
    pending = Q.orders(spark, d).filter("o_orderstatus = 'P'").select("o_custkey")
    return R.excluded(Q.anchors(spark, d), pending, "o_custkey").select("o_orderkey")


@query("select o_orderkey from orders o where not exists (select 1 from orders p where p.o_custkey = o.o_custkey and p.o_orderstatus = 'P' and p.o_orderpriority = o.o_orderpriority)")
def priority_not_pending(spark, d):
    rows = Q.orders(spark, d)
    held = rows.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("priorities"))
    return R.member_of(rows, held, "o_custkey", "o_orderpriority", "priorities", inside=False).select("o_orderkey")


@query("""with c as (select o_custkey, o_orderstatus as variant, avg(o_totalprice) as loss from orders group by all)
    select a.o_custkey, round(a.loss, 6) as loss_reference, round(b.loss, 6) as loss_candidate from c a join c b on a.o_custkey = b.o_custkey and a.variant = 'F' and b.variant = 'O'""")
def variant_pairs(spark, d):
    rows = Q.orders(spark, d).groupBy("o_custkey", F.col("o_orderstatus").alias("variant")).agg(F.avg("o_totalprice").alias("loss"))
    return R.paired(rows, "variant", "F", "O", ["o_custkey"], ["loss"]).select("o_custkey", F.round("loss_reference", 6).alias("loss_reference"), F.round("loss_candidate", 6).alias("loss_candidate"))


@query(sql(STEPS, """select segment, round(avg(m), 6) as dur_min, count(m) as dur_min_entities from (
    select segment, entity, avg(dur_min) as m from (select 'ALL' as segment, entity, dur_min from st where eligible union all select 'TECHNICAL', entity, dur_min from st where eligible and technical) group by segment, entity) group by segment"""))
def mean_by_segment(spark, d):
    rows = R.in_segments(S.steps(spark, d).filter("eligible"), {"TECHNICAL": F.coalesce(F.col("technical"), F.lit(False))})
    return R.mean_of_means(rows, "entity", ["segment"], ["dur_min"]).select("segment", F.round("dur_min", 6).alias("dur_min"), "dur_min_entities")


@query(sql(RAW + """,
en as (select entity, count(*) as n from raw group by entity),
cu as (select unnest([0.5, 0.9, 0.95])::double as quantile, unnest((select quantile_cont(n, [0.5, 0.9, 0.95]) from en)) as threshold)""", "select quantile, threshold, count(n) as rows, coalesce(sum(n), 0)::bigint as volume, round(coalesce(sum(n), 0) / (select sum(n) from en), 9) as share from cu left join en on n >= threshold group by quantile, threshold"))
def pareto_entities(spark, d):
    rows = S.raw_events(spark, d).groupBy("entity").agg(F.count("*").alias("n"))
    return R.pareto(rows, "n", [0.5, 0.9, 0.95]).select("quantile", "threshold", "rows", "volume", F.round("share", 9).alias("share"))


@query(sql(STEPS, "select macro, entity, n, rank from (select macro, entity, count(*) as n, (row_number() over (partition by macro order by count(*) desc, entity))::int as rank from st where macro is not null group by macro, entity) where rank <= 3"))
def top_entities(spark, d):
    rows = S.steps(spark, d).filter("macro is not null").groupBy("macro", "entity").agg(F.count("*").alias("n"))
    return R.top_k(rows, ["macro"], [F.desc("n"), F.asc("entity")], 3)


@query(sql(RAW, "select entity, string_agg(k || '=' || n, ',' order by k) as counts from (select entity, split_part(state, ':::', 1) as k, count(*) as n from raw group by entity, k) group by entity"))
def state_maps(spark, d):
    rows = S.raw_events(spark, d).groupBy("entity", F.split("state", ":::")[0].alias("k")).agg(F.count("*").alias("n"))
    return R.to_map(rows, ["entity"], "k", "n", "m").select("entity", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",").alias("counts"))


# ---- models


@query(sql(FREQUENCIES, "select state, dest, n, entities, origin_n, origin_entities, origin_steps, round(p, 9) as p, round(coverage, 9) as coverage from freq"))
def transition_frequencies(spark, d):
    rows = K.transition_frequencies(S.steps(spark, d).filter("not holdout"))
    return rows.withColumn("p", F.round("p", 9)).withColumn("coverage", F.round("coverage", 9))


@query(sql(STEPS, """select state, dest, n::bigint as n, origin_entities, round(n / sum(n) over (partition by state), 9) as p_events, round(shares / origin_entities, 9) as p_entities, round(shares / origin_entities - n / sum(n) over (partition by state), 9) as delta
    from (select state, dest, sum(n) as n, sum(own_p) as shares from (select entity, state, dest, count(*) as n, count(*) / sum(count(*)) over (partition by entity, state) as own_p from st where eligible and censoring = 'exata' group by entity, state, dest) group by state, dest)
    join (select state, count(distinct entity) as origin_entities from st where eligible and censoring = 'exata' group by state) using (state)"""))  # fmt: skip
def weighted_transitions(spark, d):
    rows = K.weighted_transitions(S.steps(spark, d))
    return rows.withColumns({c: F.round(c, 9) for c in ("p_events", "p_entities", "delta")})


@query(sql(STEPS, "select state, count(*) as steps, round(avg((dur_min = 0)::int), 9) as zero_share, count(*) filter (self_transition) as self_transitions, count(*) filter (censoring = 'direita') as right_censored from st where state is not null group by state"))
def origin_profile(spark, d):
    return K.origin_profile(S.steps(spark, d)).withColumn("zero_share", F.round("zero_share", 9))


@query(sql(STEPS, "select state, censoring, round(dur_min, 3) as dur_min, round(dur_max, 3) as dur_max, count(*) as weight from st where eligible group by state, censoring, dur_min, dur_max"))
def grouped_durations(spark, d):
    return K.grouped_durations(S.steps(spark, d), ["state"]).withColumn("dur_min", F.round("dur_min", 3)).withColumn("dur_max", F.round("dur_max", 3))


@query(sql(GROUPS, "select state, dest, n, entities, grp, round(r, 9) as r, round(p, 9) as p from dests"))
def pooled_destinations(spark, d):
    return S.duration_groups(spark, d)[0].withColumn("r", F.round("r", 9)).withColumn("p", F.round("p", 9))


FAMILIES = f"""{STEPS},
mo as (select state, count(*) as n, avg(dur_min / 86400) as mean, avg(ln(dur_min / 86400)) as m, stddev_pop(ln(dur_min / 86400)) as s from st where eligible and censoring = 'exata' and dur_min > 0 group by state having count(*) >= 2 and stddev_pop(ln(dur_min / 86400)) > 0),
fam as (
    select state, n, 'exponential' as family, 1.0::double as p1, mean as p2, 1 as parameters from mo
    union all select state, n, 'weibull', pi() / sqrt(6) / s, exp(m + 0.5772156649015329 / (pi() / sqrt(6) / s)), 2 from mo
    union all select state, n, 'loglogistic', pi() / sqrt(3) / s, exp(m), 2 from mo
)"""


@query(sql(FAMILIES + """,
ll as (
    select state, family, parameters, holdout, censoring, case censoring
        when 'exata' then case family when 'exponential' then -ln(p2) - t / p2 when 'weibull' then ln(p1 / p2) + (p1 - 1) * ln(t / p2) - pow(t / p2, p1) else ln(p1 / p2) + (p1 - 1) * ln(t / p2) - 2 * ln(1 + pow(t / p2, p1)) end
        when 'direita' then case family when 'exponential' then -t / p2 when 'weibull' then -pow(t / p2, p1) else -ln(1 + pow(t / p2, p1)) end end as ll
    from (select state, holdout, censoring, dur_min / 86400 as t from st where eligible and dur_min > 0) join fam using (state)
)""", """select state, family, round(sum(ll) filter (not holdout), 5) as log_likelihood, round(2 * parameters - 2 * sum(ll) filter (not holdout), 5) as aic, round(avg(-ll) filter (holdout and censoring = 'exata'), 6) as holdout_nll_exact, round(avg(-ll) filter (holdout and censoring = 'direita'), 6) as holdout_nll_right from ll group by state, family, parameters"""))  # fmt: skip
def duration_families(spark, d):
    rows = S.steps(spark, d)
    fits = K.fit_families(rows, ["state"]).filter("family <> 'lognormal'")
    out = K.compare_families(rows, fits, ["state"])
    return out.select("state", "family", F.round("log_likelihood", 5).alias("log_likelihood"), F.round("aic", 5).alias("aic"), F.round("holdout_nll_exact", 6).alias("holdout_nll_exact"), F.round("holdout_nll_right", 6).alias("holdout_nll_right"))


@query()
def duration_families_lognormal(spark, d):
    rows = S.steps(spark, d)
    return K.compare_families(rows, K.fit_families(rows, ["state"]), ["state"]).select("state", "family", "log_likelihood", "aic", "delta_aic")


@query(sql(FAMILIES, """select state, family, age, round(1 - exp(case family when 'exponential' then -((age + 604800) / 86400) / p2 + age / 86400 / p2 when 'weibull' then pow(age / 86400 / p2, p1) - pow((age + 604800) / 86400 / p2, p1) else ln(1 + pow(age / 86400 / p2, p1)) - ln(1 + pow((age + 604800) / 86400 / p2, p1)) end), 9) as exit
    from fam, (select unnest([0.0, 1800.0, 86400.0, 604800.0])::double as age)"""))
def horizon_exit(spark, d):
    fits = K.fit_families(S.steps(spark, d), ["state"]).filter("family <> 'lognormal'")
    return K.horizon_exit(fits, S.AGES, 604800.0).select("state", "family", "age", F.round("exit", 9).alias("exit"))


@query()
def competing_lognormal(spark, d):
    rows = S.steps(spark, d).filter("not holdout and state is not null")
    dests, _ = S.duration_groups(spark, d)
    return K.fit_competing_lognormal(rows, dests, ["state"])


@query()
def timeout_atom(spark, d):
    rows = J.with_silence(S.sessions(spark, d), S.TIMEOUT, S.CUT).filter(F.col("state") == J.SILENCE)
    rows = rows.withColumn("dur_min", S.TIMEOUT + J.seconds_between("ts", "end_ts")).withColumn("censoring", F.when(F.col("next_state").isNull(), J.RIGHT).otherwise(J.EXACT)).withColumn("eligible", F.lit(True))
    return K.fit_timeout_atom(rows, ["last_action"], S.TIMEOUT)


@query(sql(STEPS, "select state, context, count(*) as n, count(distinct entity) as entities, case when context = '__BASE__' then 'origem' when context = '__SEM_MEMORIA__' then 'sem_memoria' when count(*) >= 80 and count(distinct entity) >= 20 then 'candidato' else 'raro' end as support_status from st where eligible and not holdout group by state, context"))
def context_support(spark, d):
    return K.context_support(S.steps(spark, d))


@query(sql(FREQUENCIES + """,
cx as (select state, context from st where eligible and not holdout and context not in ('__BASE__', '__SEM_MEMORIA__') group by state, context having count(*) >= 80 and count(distinct entity) >= 20),
own as (select state, context, dest, count(*) as k from st join cx using (state, context) where eligible and not holdout and censoring = 'exata' group by state, context, dest),
tot as (select state, context, sum(k) as total from own group by state, context)""", "select state, context, dest, coalesce(k, 0) as n, round((coalesce(k, 0) + 20 * p) / (total + 20), 9) as p from tot join freq using (state) left join own using (state, context, dest)"))
def shrunk_contexts(spark, d):
    rows = S.steps(spark, d)
    supported = K.context_support(rows).filter("support_status = 'candidato'")
    parent = K.transition_frequencies(rows.filter("not holdout"))
    return K.shrunk_contexts(rows, parent, supported).withColumn("p", F.round("p", 9))


@query()
def recombined_model(spark, d):
    rows = S.steps(spark, d).filter("not holdout")
    dests, groups = S.duration_groups(spark, d)
    supported = K.context_support(rows).filter("support_status = 'candidato'")
    child = K.shrunk_contexts(rows, dests, supported)
    return K.recombined(child, dests, groups)[1].select("state", "context", "grp", "pi", "p1", "p2")


@query(sql(STEPS + """,
ex as (select state, dur_min, count(*) as k from st where eligible and censoring = 'exata' and dur_min > 0 group by state, dur_min)""", """select state, any_value(n) as n, any_value(modal_time) as modal_time, round(any_value(modal_n) / any_value(n), 9) as modal_share, round(any_value(q05), 4) as q05, round(any_value(median), 4) as median, round(any_value(q95), 4) as q95, round(any_value(sd_log), 6) as sd_log, any_value(distinct_times) as distinct_times from
    (select state, count(*) as n, quantile_cont(dur_min, 0.05) as q05, quantile_cont(dur_min, 0.5) as median, quantile_cont(dur_min, 0.95) as q95, stddev_pop(ln(dur_min)) as sd_log from st where eligible and censoring = 'exata' and dur_min > 0 group by state)
    join (select state, arg_max(dur_min, (k, -dur_min)) as modal_time, max(k) as modal_n, count(*) as distinct_times from ex group by state) using (state) group by state"""))  # fmt: skip
def duration_profile(spark, d):
    rows = K.duration_profile(S.steps(spark, d), ["state"], S.TIMEOUT).drop("share_at_timeout")
    return rows.withColumns({"modal_share": F.round("modal_share", 9), "q05": F.round("q05", 4), "median": F.round("median", 4), "q95": F.round("q95", 4), "sd_log": F.round("sd_log", 6)})


@query(sql(STEPS, "select state, age, count(*) as at_risk, count(distinct entity) as entities, count(*) filter (censoring = 'exata') as exact, count(*) filter (censoring = 'direita') as censored from st, (select unnest([0.0, 1800.0, 86400.0, 604800.0])::double as age) where eligible and dur_min > age group by state, age"))
def tail_support(spark, d):
    return K.tail_support(S.steps(spark, d), ["state"], S.AGES)


@query(sql(STEPS, "select fit_status, count(*) as origins, sum(hs)::bigint as holdout_steps, sum(he)::bigint as holdout_entities from (select state, case when count(*) filter (eligible and censoring = 'exata') = 0 then 'sem_destino_exato' when count(*) filter (eligible and censoring = 'exata') >= 80 and count(distinct entity) filter (eligible and censoring = 'exata') >= 20 then 'ajustado' else 'suporte_insuficiente' end as fit_status, (select count(*) from st h where h.holdout and h.state = st.state) as hs, (select count(distinct entity) from st h where h.holdout and h.state = st.state) as he from st where eligible group by state) where fit_status <> 'ajustado' group by fit_status"))
def failure_summary(spark, d):
    rows = S.steps(spark, d)
    return K.failure_summary(K.fit_status(rows), rows.filter("holdout"))


@query(sql(STEPS, "select state, count(*) as whole_steps, count(distinct entity) as whole_entities, count(*) filter (s) as sample_steps, count(distinct entity) filter (s) as sample_entities, round(count(*) filter (s) / count(*), 9) as share from (select *, ('0x' || substr(md5('sample|' || entity), 1, 8))::bigint % 3 = 1 as s from st where eligible) group by state"))
def sample_support(spark, d):
    rows = S.steps(spark, d)
    return K.sample_support(B.sample_entities(rows, 3, 1), rows).withColumn("share", F.round("share", 9))


BASELINE = LABELS + """,
snap as (select lab.*, age from lab, (select unnest([0.0, 86400.0])::double as age) where dur_min > age),
res as (select *, coalesce(action, '__none__') as outcome, 1.0 / count(*) over (partition by age, entity) as w from snap where not holdout and label_status <> 'CENSURADO_ANTES_HORIZONTE'),
grid as (select age, outcome, total from (select age, sum(w) as total from res group by age), (select unnest(['error', 'purchase', 'signup', '__none__']) as outcome)),
base as (select g.age, g.outcome, count(r.w) as cases, coalesce(sum(r.w), 0) / any_value(total) as p from grid g left join res r on r.age = g.age and r.outcome = g.outcome group by g.age, g.outcome)"""


def _baseline(spark, d):
    snaps = J.age_snapshots(S.labels(spark, d), [0.0, 86400.0], "2100-01-01")
    targets = A.dimension(spark, [(t,) for t in S.TARGETS], "action string")
    return snaps, targets, K.frequency_baseline(snaps.filter("not holdout"), targets, ["age"])


@query(sql(BASELINE, "select age, outcome, cases, round(p, 9) as p, case when outcome <> '__none__' then (row_number() over (partition by age order by (outcome = '__none__')::int, p desc, outcome))::int end as rank from base"))
def frequency_baseline(spark, d):
    return _baseline(spark, d)[2].withColumn("p", F.round("p", 9))


# ---- scoring


@query(sql(FREQUENCIES + f""",
best as (select *, row_number() over (partition by state order by p desc, dest) as rank from freq),
cur as (select p.entity, state, epoch({CUT}) - epoch(ts) as age, case when ts is null then 'sem_historico' when ambiguous then 'ambiguo' else 'ok' end as input_status
        from (select distinct user_id::varchar as entity from events) p left join (select * from st qualify row_number() over (partition by entity order by ts desc) = 1) l on l.entity = p.entity)""",
"select entity, cur.state, round(age, 3) as age, case when input_status <> 'ok' then input_status when rank is null then 'sem_modelo' else 'ok' end as prediction_status, rank::int as rank, dest as next_state, round(p, 9) as p, n as support from cur left join best on best.state = cur.state and rank <= 5"))
def next_state_top5(spark, d):
    return S.next_state_top5(spark, d)


Q_AGE = GROUPS + f""",
cs as (select entity, state, epoch({CUT}) - epoch(ts) as age from st qualify row_number() over (partition by entity order by ts desc) = 1),
lw as (select entity, state, age, grp, pi * exp(-pow(age / 86400 / p2, p1)) as m, pi * exp(-pow((age + 604800) / 86400 / p2, p1)) as m7 from cs join grps using (state) where state is not null),
qa as (select entity, state, dest, r, p, m / sum(m) over (partition by entity, dest_id) as x, grp, m, m7 from (select lw.*, dest, r, p, dest as dest_id from lw join dests using (state, grp)))"""


def _cases(spark, d):
    return S.current(spark, d).filter("input_status = 'ok'").select("entity", "state", "memory", "age")


@query(sql(GROUPS + f""",
cs as (select entity, state, epoch({CUT}) - epoch(ts) as age from st qualify row_number() over (partition by entity order by ts desc) = 1),
lw as (select entity, state, age, grp, ln(pi) - pow(age / 86400 / p2, p1) as lm from cs join grps using (state) where state is not null),
wt as (select *, exp(lm - max(lm) over (partition by entity)) as m from lw),
nw as (select *, m / sum(m) over (partition by entity) as weight from wt)""", "select entity, dest, round(weight * r, 7) as q, round(p, 9) as p from nw join dests using (state, grp)"))  # fmt: skip
def age_conditioned(spark, d):
    dests, groups = S.duration_groups(spark, d)
    return L.conditioned(_cases(spark, d), groups, dests, ["state"], ["entity"]).select("entity", "dest", F.round("q", 7).alias("q"), F.round("p", 9).alias("p"))


@query()
def horizon_probabilities(spark, d):
    dests, groups = S.duration_groups(spark, d)
    return L.horizon(_cases(spark, d), groups, dests, ["state"], ["entity"], 604800.0)


@query()
def temporal_variation(spark, d):
    dests, groups = S.duration_groups(spark, d)
    return L.temporal_variation(L.conditioned(_cases(spark, d), groups, dests, ["state"], ["entity"]), ["entity"])


@query()
def model_routes(spark, d):
    rows = S.steps(spark, d)
    supported = K.context_support(rows)
    origins = K.transition_frequencies(rows.filter("not holdout")).select("state").distinct()
    fitted = supported.filter("support_status = 'candidato'").select("state", "context")
    return L.routed(rows.filter("context is not null").select("entity", "step", "state", "context"), supported, origins, fitted).groupBy("route").agg(F.count("*").alias("cases"), F.countDistinct("entity").alias("entities"))


@query(sql(FREQUENCIES + """,
e as (select state as src, dest as dst, p from freq),
s1 as (select src as start, dst as node, sum(p) as mass from e group by 1, 2),
s2 as (select start, dst as node, sum(mass * p) as mass from s1 join e on node = src group by 1, 2),
s3 as (select start, dst as node, sum(mass * p) as mass from s2 join e on node = src group by 1, 2)""", "select start, 1 as step, node, round(mass, 8) as mass from s1 union all select start, 2, node, round(mass, 8) from s2 union all select start, 3, node, round(mass, 8) from s3"))
def step_distribution(spark, d):
    return L.step_distribution(S.edges(spark, d), 3).select("start", "step", "node", F.round("mass", 8).alias("mass"))


PASSAGE = FREQUENCIES + """,
e as (select state as src, dest as dst, p, case when split_part(dest, ':::', 1) in ('error', 'purchase', 'signup') then split_part(dest, ':::', 1) end as action from freq),
h1 as (select src as start, dst, p, action from e),
h2 as (select start, e.dst, h1.p * e.p as p, e.action from h1 join e on h1.dst = e.src where h1.action is null),
h3 as (select start, e.dst, h2.p * e.p as p, e.action from h2 join e on h2.dst = e.src where h2.action is null)"""


@query(sql(PASSAGE, "select start, action, round(sum(p), 8) as score, arg_max(step, (m, -step))::int as best_step from (select start, action, step, sum(p) as p, round(sum(p), 12) as m from (select *, 1 as step from h1 union all select *, 2 from h2 union all select *, 3 from h3) where action is not null group by start, action, step) group by start, action"))
def first_relevant_action(spark, d):
    actions = S.states(spark, d).filter(F.col("macro").isin(S.TARGETS)).select(F.col("state").alias("dst"), F.col("macro").alias("action"))
    return L.first_action(S.edges(spark, d), actions, 3).select("start", "action", F.round("score", 8).alias("score"), "best_step")


@query(sql(FREQUENCIES + """,
e as (select state as src, dest as dst, p, dest like 'purchase%' as hit from freq),
h1 as (select src as start, dst, p, hit from e),
h2 as (select start, e.dst, h1.p * e.p as p, e.hit from h1 join e on h1.dst = e.src where not h1.hit),
h3 as (select start, e.dst, h2.p * e.p as p, e.hit from h2 join e on h2.dst = e.src where not h2.hit)""", "select start, round(coalesce(sum(p) filter (hit), 0), 8) as reached, round(coalesce(sum(p) filter (not hit and last), 0), 8) as surviving from (select *, false as last from h1 union all select *, false from h2 union all select *, true from h3) group by start"))
def first_passage(spark, d):
    return L.first_passage(S.edges(spark, d), F.col("dst").like("purchase%"), 3).select("start", F.round("reached", 8).alias("reached"), F.round("surviving", 8).alias("surviving"))


def _macros(spark, d):
    return S.states(spark, d).select(F.col("state").alias("node"), "macro", "state")


@query()
def macro_jumps(spark, d):
    return L.macro_jumps(S.edges(spark, d), _macros(spark, d)).groupBy("src", "kind").agg(F.sum("p").alias("p"))


@query()
def macro_first_passage(spark, d):
    macros = _macros(spark, d)
    return L.macro_first_passage(L.macro_jumps(S.edges(spark, d), macros), macros, S.TARGETS, S.CHANGES)


@query(sql(FREQUENCIES + """,
mq as (select entity, split_part(freq.dest, ':::', 1) as macro, sum(p) as score from (select * from st qualify row_number() over (partition by entity order by ts desc) = 1) c join freq using (state) group by 1, 2)""", "select entity, macro, round(score, 9) as score, (row_number() over (partition by entity order by round(score, 9) desc, macro))::int as rank from mq"))
def immediate_macros(spark, d):
    model = K.transition_frequencies(S.steps(spark, d).filter("not holdout"))
    q = _cases(spark, d).join(model.select("state", "dest", F.col("p").alias("q")), "state")
    summed = q.join(S.states(spark, d).select(F.col("state").alias("dest"), "macro"), "dest").groupBy("entity", "macro").agg(F.round(F.sum("q"), 9).alias("score"))
    return R.top_k(summed, ["entity"], [F.desc("score"), F.asc("macro")], 5)


# ---- evaluation


def _evaluated(spark, d):
    snaps, targets, base = _baseline(spark, d)
    maps = R.to_map(base.filter("outcome <> '__none__'"), ["age"], "outcome", "p", "scores")
    rows = snaps.filter("holdout").select("entity", "step", "age", "state", "context", "technical", "label_status", "action", "change")
    return M.hit_metrics(rows.join(F.broadcast(maps), "age")), targets


HITS = BASELINE + """,
ev as (
    select s.entity, s.step, s.age, s.technical, s.label_status, s.action, b.p as pb, n.p as pn, sq, tot,
           case when s.label_status = 'ALVO_OBSERVADO' and b.p > 0 then 1 + (select count(*) from base c where c.age = s.age and c.outcome <> '__none__' and (c.p > b.p or c.p = b.p and c.outcome < s.action)) end as rank_real
    from snap s left join base b on b.age = s.age and b.outcome = s.action join (select age, sum(p * p) as sq, sum(p) as tot from base where outcome <> '__none__' group by age) t on t.age = s.age join base n on n.age = s.age and n.outcome = '__none__'
    where s.holdout
),
mt as (
    select *, case when label_status = 'ALVO_OBSERVADO' then coalesce((rank_real = 1)::int, 0)::double end as top1, case when label_status = 'ALVO_OBSERVADO' then coalesce(1.0 / rank_real, 0) end as mrr,
           case when label_status <> 'CENSURADO_ANTES_HORIZONTE' then sq + greatest(1 - tot, 0) ** 2 + 1 - 2 * case when label_status = 'ALVO_OBSERVADO' then coalesce(pb, 0) else greatest(1 - tot, 0) end end as brier,
           case when label_status <> 'CENSURADO_ANTES_HORIZONTE' then case when label_status = 'ALVO_OBSERVADO' then coalesce(pb, 0) else greatest(1 - tot, 0) end end as p_real
    from ev
)"""


@query(sql(HITS, "select entity, step, age, rank_real::int as rank_real, top1, round(mrr, 9)::double as mrr, round(brier, 9) as brier from mt"))
def hit_metrics(spark, d):
    return _evaluated(spark, d)[0].select("entity", "step", "age", "rank_real", "top1", F.round("mrr", 9).alias("mrr"), F.round("brier", 9).alias("brier"))


@query(sql(HITS, "select entity, step, age, round(case when p_real is not null then -ln(greatest(p_real, 1e-15)) end, 8) as log_loss, (p_real < 1e-15)::int as clipped from mt"))
def log_losses(spark, d):
    return M.log_losses(_evaluated(spark, d)[0], F.col("p_real")).select("entity", "step", "age", F.round("log_loss", 8).alias("log_loss"), "clipped")


@query(sql(HITS + """,
sg as (select 'ALL' as segment, * from mt union all select 'TECHNICAL', * from mt where technical)""", "select segment, age, round(avg(b), 8) as brier, count(b) as brier_entities, round(avg(t), 8) as top1 from (select segment, age, entity, avg(brier) as b, avg(top1) as t from sg group by all) group by segment, age"))
def entity_summary(spark, d):
    rows = M.entity_summary(_evaluated(spark, d)[0], ["age"], ["brier", "top1"], {"TECHNICAL": F.coalesce(F.col("technical"), F.lit(False))})
    return rows.select("segment", "age", F.round("brier", 8).alias("brier"), "brier_entities", F.round("top1", 8).alias("top1"))


@query(sql(HITS, "select label_status, age, count(*) as cases, count(distinct entity) as entities from mt group by all"))
def coverage_report(spark, d):
    return M.coverage_report(_evaluated(spark, d)[0], ["label_status", "age"])


@query(sql(HITS + """,
own as (select entity, avg(brier) as a, avg(-ln(greatest(p_real, 1e-15))) as b from mt where brier is not null group by entity),
cf as (select r, ('0x' || substr(md5(concat_ws('|', 'bootstrap', r::varchar, 'c3')), 1, 8))::bigint % 2147483647 as c3,
    ('0x' || substr(md5(concat_ws('|', 'bootstrap', r::varchar, 'c2')), 1, 8))::bigint % 2147483647 as c2,
    ('0x' || substr(md5(concat_ws('|', 'bootstrap', r::varchar, 'c1')), 1, 8))::bigint % 2147483647 as c1,
    ('0x' || substr(md5(concat_ws('|', 'bootstrap', r::varchar, 'c0')), 1, 8))::bigint % 2147483647 as c0 from (select unnest(generate_series(1, 2000)) as r)),
sd as (select a, b, ('0x' || substr(md5(concat_ws('|', 'bootstrap', entity)), 1, 8))::bigint % 2147483647 as x from own),
dr as (select r as replicate, a, b, ((((((c3 * x + c2) % 2147483647) * x + c1) % 2147483647) * x + c0) % 2147483647) / 2147483647.0 as u from sd, cf),
wd as (select replicate, sum(w) as w, sum(w * (a - b)) as s from (select *, (u > 0.36787944117144233)::int + (u > 0.7357588823428847)::int + (u > 0.9196986029286058)::int + (u > 0.9810118431238462)::int + (u > 0.9963401531726563)::int + (u > 0.9994058151824183)::int + (u > 0.9999167588507119)::int as w from dr) group by replicate having sum(w) > 0)""",
"select (select count(*) from own) as entities, round((select avg(a - b) from own), 7) as gain, round(quantile_cont(s / w, 0.025), 7) as low, round(quantile_cont(s / w, 0.975), 7) as high, count(*) as replicates from wd"))
def paired_bootstrap(spark, d):
    rows = M.log_losses(_evaluated(spark, d)[0], F.col("p_real")).filter("brier is not null")
    return M.bootstrap(rows, "brier", "log_loss").select("entities", F.round("gain", 7).alias("gain"), F.round("low", 7).alias("low"), F.round("high", 7).alias("high"), "replicates")


@query(sql(HITS + """,
tops as (select age, outcome as best from (select *, row_number() over (partition by age order by p desc, outcome) as place from base where outcome <> '__none__') where place = 1 and p > 0),
gr as (select m.age, m.entity, b.outcome as target, b.p, coalesce(m.action = b.outcome and m.label_status = 'ALVO_OBSERVADO', false) as real, coalesce(t.best = b.outcome, false) as first, m.rank_real
       from mt m join base b on b.age = m.age and b.outcome <> '__none__' left join tops t on t.age = m.age where m.label_status <> 'CENSURADO_ANTES_HORIZONTE'),
own as (select age, target, entity, avg((p - real::int) ** 2) as brier, avg(case when real then coalesce(rank_real <= 1, false)::int end) as recall1, avg(case when real then coalesce(rank_real <= 5, false)::int end) as recall5, avg(case when first then real::int end) as precision1, count(*) filter (real) as hits from gr group by all)""",
"select age, target, round(avg(brier), 9) as brier, count(brier) as brier_entities, round(avg(recall1), 9) as recall1, count(recall1) as recall1_entities, round(avg(recall5), 9) as recall5, count(recall5) as recall5_entities, round(avg(precision1), 9) as precision1, count(precision1) as precision1_entities, sum(hits)::bigint as support, count(*) filter (hits > 0) as support_entities from own group by age, target"))
def action_summary(spark, d):
    rows, targets = _evaluated(spark, d)
    found = M.action_summary(rows, targets.withColumnRenamed("action", "target"), ["age"])
    return found.withColumns({name: F.round(name, 9) for name in ("brier", "recall1", "recall5", "precision1")})


LIFT = """
sc as (select o_custkey, round(o_totalprice / 20000) as score, (o_orderstatus = 'F')::int as y from orders),
blk as (select score, count(*)::double as w, sum(y)::double as pos from sc group by score),
cum as (select *, coalesce(sum(w) over (order by score desc rows between unbounded preceding and 1 preceding), 0) as before, sum(w) over () as tw, sum(pos) over () as tp from blk)"""


def _scored_orders(spark, d):
    return Q.orders(spark, d).select(F.col("o_custkey").cast("string").alias("entity"), F.round(F.col("o_totalprice") / 20000).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


@query(sql(LIFT, """select band, round(sum(take), 6) as weight, round(sum(take / w * pos), 6) as positives, round(sum(take / w * pos) / sum(take), 9) as rate, round(sum(take / w * pos) / sum(take) / (any_value(tp) / any_value(tw)), 9) as lift, round(sum(take / w * pos) / any_value(tp), 9) as capture
    from (select *, greatest(0, least(before + w, tw * hi) - greatest(before, tw * lo)) as take from cum, (values ('top10', 0.0::double, 0.1::double), ('top20', 0.0::double, 0.2::double)) b(band, lo, hi)) where take > 0 group by band"""))
def lift_with_ties(spark, d):
    rows = M.weighted_bands(_scored_orders(spark, d), "score", F.lit(1.0), F.col("y"), [("top10", 0, 0.1), ("top20", 0, 0.2)]).drop("mean_score")
    return rows.withColumns({"weight": F.round("weight", 6), "positives": F.round("positives", 6), "rate": F.round("rate", 9), "lift": F.round("lift", 9), "capture": F.round("capture", 9)})


@query(sql(LIFT, """select band, round(sum(take * score) / sum(take), 7) as mean_score, round(sum(take / w * pos) / sum(take), 9) as rate
    from (select *, greatest(0, least(before + w, tw * hi) - greatest(before, tw * lo)) as take from cum, (select printf('%02d', i + 1) as band, i / 5.0 as lo, (i + 1) / 5.0 as hi from range(5) t(i))) where take > 1e-9 group by band"""))
def calibration_curve(spark, d):
    return M.calibration_curve(_scored_orders(spark, d), "score", F.col("y"), 5).select("band", F.round("mean_score", 7).alias("mean_score"), F.round("rate", 9).alias("rate"))


@query(sql(LIFT, """select bin, count(*) as rows, round(avg(score), 9) as mean_score, round(avg(y), 9) as rate from (select *, len(list_filter((select list_distinct(quantile_cont(score, [0.25, 0.5, 0.75])) from sc), lambda e: e < score))::int as bin from sc) group by bin"""))
def calibration_bins(spark, d):
    return M.calibration_bins(_scored_orders(spark, d), "score", F.col("y"), 4).select("bin", "rows", F.round("mean_score", 9).alias("mean_score"), F.round("rate", 9).alias("rate"))


@query(sql(LIFT, """select (select count(*) from sc) as cases, round((select avg((score / 30 - y) ** 2) from sc), 9) as brier, round(sum((w - pos) * (pb + pos / 2)) / (any_value(tp) * (any_value(tw) - any_value(tp))), 9) as roc_auc, round(sum(pos * (pb + pos) / (before + w)) / any_value(tp), 9) as pr_auc
    from (select *, coalesce(sum(pos) over (order by score desc rows between unbounded preceding and 1 preceding), 0) as pb from cum)"""))
def binary_backtest(spark, d):
    rows = _scored_orders(spark, d).withColumn("score", F.col("score") / 30)
    return M.binary_backtest(rows, "score", F.col("y")).select("cases", F.round("brier", 9).alias("brier"), F.round("roc_auc", 9).alias("roc_auc"), F.round("pr_auc", 9).alias("pr_auc"))


DELTA = """
pr as (select o_custkey::varchar as entity, o_orderpriority as context, o_totalprice / 1000 - 150 as delta from orders),
wt as (select *, 1.0::double / count(*) over (partition by entity) as w from pr)"""


def _deltas(spark, d):
    return Q.orders(spark, d).select(F.col("o_custkey").cast("string").alias("entity"), F.col("o_orderpriority").alias("context"), (F.col("o_totalprice") / 1000 - 150).alias("delta"))


@query(sql(DELTA, "select context, count(*) as cases, count(distinct entity) as entities, round(sum(w), 6) as mass, round(sum(delta * w) / (select count(distinct entity) from pr), 7) as contribution from wt group by context"))
def decomposed_difference(spark, d):
    return M.decomposed(_deltas(spark, d), "delta", ["context"]).withColumns({"mass": F.round("mass", 6), "contribution": F.round("contribution", 7)})


@query(sql(DELTA + ", own as (select entity, avg(delta) as d from pr group by entity), rk as (select *, row_number() over (order by d desc, entity) as n from own)", "select count(*) as entities, round(sum(d) filter (n <= 1 and d > 0) / sum(d) filter (d > 0), 8) as worst_1_share, round(sum(d) filter (n <= 10 and d > 0) / sum(d) filter (d > 0), 8) as worst_10_share, round(quantile_cont(d, 0.5), 7) as median from rk"))
def deterioration(spark, d):
    return M.deterioration(_deltas(spark, d), "delta").select("entities", F.round("worst_1_share", 8).alias("worst_1_share"), F.round("worst_10_share", 8).alias("worst_10_share"), F.round("median", 7).alias("median"))


@query(sql(DELTA, "select threshold, count(*) as cases, round(avg(delta), 7) as delta from pr, (select unnest([-100.0, 0.0, 100.0])::double as threshold) where delta <= threshold group by threshold"))
def sensitivity(spark, d):
    return M.lost_mass_sensitivity(_deltas(spark, d), "delta", [-100.0, 0.0, 100.0], ["delta"]).withColumn("delta", F.round("delta", 7))


@query(sql("empty_ as (select 1)", "select ''::varchar as entity, ''::varchar as dest where false"))
def recomputed_probabilities(spark, d):
    dests, groups = S.duration_groups(spark, d)
    cases = _cases(spark, d)
    q = L.conditioned(cases, groups, dests, ["state"], ["entity"]).select("entity", "dest", "q")
    # the same by another way: survival not in logs, normalised over destinations
    s = groups.join(cases, "state").withColumn("m", F.col("pi") * F.exp(-F.pow(F.col("age") / 86400 / F.col("p2"), F.col("p1"))))
    again = s.join(dests.select("state", "dest", "grp", "r"), ["state", "grp"]).withColumn("x", F.col("m") * F.col("r"))
    totals = again.groupBy("entity").agg(F.sum("x").alias("t"))
    again = again.join(totals.filter("t > 1e-280"), "entity").select("entity", "dest", (F.col("x") / F.col("t")).alias("q"))
    return M.recomputed_differences(q.join(again.select("entity").distinct(), "entity", "left_semi"), again, ["entity", "dest"], ["q"], 1e-6).select("entity", "dest")


# ---- diagnostics


@query(sql(STEPS, "select macro, sum(n)::bigint as volume, count(*) as entities, round(sum(n) / (select count(*) from st where macro is not null), 9) as volume_share, round(count(*) / (select count(distinct entity) from st where macro is not null), 9) as penetration, round(sum(own) / (select count(distinct entity) from st where macro is not null), 9) as mean_share from (select entity, macro, count(*) as n, count(*) / sum(count(*)) over (partition by entity) as own from st where macro is not null group by entity, macro) group by macro"))
def presence(spark, d):
    return N.presence(S.steps(spark, d).filter("macro is not null")).withColumns({c: F.round(c, 9) for c in ("volume_share", "penetration", "mean_share")})


@query(sql(STEPS, "select entity, sum(n)::bigint as volume, round(sum(p * p), 9) as hhi, round(sum(-p * log2(p)), 8) as entropy, round(max(p), 9) as dominant, (case when sum(n) >= 100 then 2 when sum(n) >= 10 then 1 else 0 end)::int as volume_band from (select entity, count(*) as n, count(*) / sum(count(*)) over (partition by entity) as p from st where macro is not null group by entity, macro) group by entity"))
def concentration(spark, d):
    return N.concentration(S.steps(spark, d).filter("macro is not null")).select("entity", "volume", F.round("hhi", 9).alias("hhi"), F.round("entropy", 8).alias("entropy"), F.round("dominant", 9).alias("dominant"), "volume_band")


@query(sql(BLOCKS + """,
tr as (select lag(macro) over w as previous, macro as focus, lead(macro) over w as next from bl window w as (partition by entity order by block)),
ok as (select * from tr where previous is not null and next is not null)""", "select previous, focus, next, n, given::bigint as given, round(n / given, 9) as p_given, round(m / fm, 9) as p_all from (select previous, focus, next, count(*) as n, sum(count(*)) over (partition by previous, focus) as given from ok group by previous, focus, next) join (select focus, next, count(*) as m, sum(count(*)) over (partition by focus) as fm from ok group by focus, next) using (focus, next)"))
def context_dependence(spark, d):
    rows = N.context_dependence(J.block_triples(J.funnel_blocks(S.steps(spark, d))))
    return rows.select("previous", "focus", "next", "n", "given", F.round("p_given", 9).alias("p_given"), F.round("p_all", 9).alias("p_all"))


@query(sql(STEPS + """,
dy as (select entity, ts::date as day, max((macro = 'purchase')::int) as a from st where macro is not null group by all)""", "select (dayofweek(day) + 1)::varchar as part, count(*) as active_days, sum(a)::bigint as action_days, round(avg(a), 9) as rate from dy group by 1"))
def weekday_rates(spark, d):
    rows = N.calendar_rates(S.steps(spark, d).filter("macro is not null"), ["purchase"]).filter("calendar = 'weekday'")
    return rows.select("part", "active_days", "action_days", F.round("rate", 9).alias("rate"))


@query(sql(STEPS + """,
dd as (select distinct entity, macro, ts::date as day from st where macro is not null),
gp as (select *, date_diff('day', lag(day) over (partition by entity, macro order by day), day) as gap from dd)""", "select macro, count(gap) as gaps, quantile_cont(gap, 0.25) as q25, quantile_cont(gap, 0.5) as median, quantile_cont(gap, 0.75) as q75, count(distinct entity) as entities, count(distinct (entity, date_trunc('month', day))) as entity_months from gp group by macro"))
def recurrence(spark, d):
    return N.recurrence(S.steps(spark, d).filter("macro is not null"))


@query(sql(RAW, "select kind, combination, count(*) as instants, count(distinct entity) as entities from (select entity, case when count(distinct split_part(state, ':::', 1)) > 1 then 'familias' else 'etapas' end as kind, string_agg(distinct state, '+' order by state) as combination from raw group by entity, ts having count(distinct state) > 1) group by all"))
def collisions(spark, d):
    return N.collisions(S.raw_events(spark, d))


@query(sql(ACTIONS, "select (select count(*) from inst) as instants, (select count(*) from inst where ambiguous) as ambiguous, count(*) as actions, count(*) filter (n_instants > 1) as bursts, sum(n_instants - 1)::bigint as absorbed from act"))
def debounce_effect(spark, d):
    return N.debounce_effect(J.instants_by_depth(S.raw_events(spark, d)), S.actions(spark, d))


@query(sql(STEPS, "select state, count(*) as self_transitions, round(avg((dur_min <= 43200)::int), 9) as within_12h from st where self_transition group by state"))
def self_transitions(spark, d):
    return N.self_transitions(S.steps(spark, d), (43200,)).select("state", "self_transitions", F.round("within_43200s", 9).alias("within_12h"))


@query(sql(STEPS, "select state, count(*) as steps, count(*) filter (censoring = 'exata') as exact, count(*) filter (censoring = 'direita') as right_censored, round(quantile_cont(dur_min, 0.5) filter (censoring = 'exata'), 4) as median, round(quantile_cont(dur_min, 0.9) filter (censoring = 'exata'), 4) as q90 from st where state is not null group by state"))
def censoring_by_state(spark, d):
    return N.censoring_by_state(S.steps(spark, d)).withColumn("median", F.round("median", 4)).withColumn("q90", F.round("q90", 4))


def _lists(spark, d):
    return S.next_state_top5(spark, d).filter("rank is not null").select("entity", "state", "age", "rank", F.col("next_state").alias("action"), F.col("p").alias("score"))


TOP = ORACLE_SQL["next_state_top5"].rsplit("\nselect entity", 1)[0] + ", li as (select entity" + ORACLE_SQL["next_state_top5"].rsplit("\nselect entity", 1)[1] + ")"


@query(TOP + " select (select count(distinct entity) from li where rank is not null) as entities, (select count(*) from (select distinct string_agg(next_state, '|' order by rank) from li where rank is not null group by entity)) as lists, round(avg(m), 7) as mass, round(avg(f - coalesce(s, 0)), 7) as margin from (select entity, sum(p) as m, max(p) filter (rank = 1) as f, max(p) filter (rank = 2) as s from li where rank is not null group by entity)")
def list_concentration(spark, d):
    return N.list_concentration(_lists(spark, d)).select("entities", "lists", F.round("mass", 7).alias("mass"), F.round("margin", 7).alias("margin"))


@query(TOP + " select state as action, count(distinct entity) as entities, count(*) filter (rank = 1) as first, round(avg(p), 7) as mean_score from (select distinct split_part(event_type, '|', 1) || ':::' || b as state from events, (select unnest(['topo', 'navegacao', 'sucesso']) as b) where false union select distinct state from raw) c left join (select entity, rank, p, next_state from li where rank is not null) l on l.next_state = c.state group by c.state")
def target_coverage(spark, d):
    targets = S.states(spark, d).select(F.col("state").alias("action"))
    return N.target_coverage(_lists(spark, d), targets).select("action", "entities", "first", F.round("mean_score", 7).alias("mean_score"))


@query(sql(STEPS, "select case when context is null then 'barreira' when context in ('__BASE__', '__SEM_MEMORIA__') then context else 'memoria' end as context_kind, holdout, count(*) as steps, count(distinct entity) as entities, sum(event_weight)::double as event_weight, round(sum(entity_weight), 6)::double as entity_weight from st group by 1, 2"))
def memory_coverage(spark, d):
    return N.memory_coverage(S.steps(spark, d)).withColumn("entity_weight", F.round("entity_weight", 6))


@query(sql(STEPS, "select t.action, count(macro) as steps, count(distinct entity) as entities, count(*) filter (entry and step > 1) as entries from (select unnest(['error', 'purchase', 'signup']) as action) t left join (select *, not coalesce(lag(macro) over (partition by entity order by step) = macro, false) as entry from st) s on s.macro = t.action and not holdout group by t.action"))
def target_evidence(spark, d):
    targets = A.dimension(spark, [(t,) for t in S.TARGETS], "action string")
    return N.target_evidence(S.steps(spark, d), targets)


@query()
def operational_audit(spark, d):
    return N.operational_audit(S.current(spark, d), _lists(spark, d))


# ---- propensity


@query("""with c as (select distinct ts::date as day from events where ts is not null),
    w as (select date_trunc('week', ts - interval 8 hour)::date + 7 as monday, count(*) as n_events, count(distinct user_id) as n_entities from events where ts is not null group by 1)
    select strftime(day, '%Y%m%d') as cohort, dayofweek(day) = 1 as valid, case when dayofweek(day) = 1 then epoch(day - interval 7 day + interval 8 hour)::bigint end as window_start, case when dayofweek(day) = 1 then epoch(day + interval 8 hour)::bigint end as window_end,
        coalesce(n_events, 0) as n_events, coalesce(n_entities, 0) as n_entities from c left join w on monday = day""")
def weekly_windows(spark, d):
    """Every day of the events as a cohort, with the events and entities of its window."""
    events = spark.read.parquet(f"{d}/events.parquet").filter("ts is not null").select("ts", "user_id")
    days = P.weekly_window(events.select(F.date_format("ts", "yyyyMMdd").alias("cohort")).distinct())
    began = P.current_cohort(events, "ts").withColumn("cohort", F.date_format(F.date_add(F.to_date("cohort", "yyyyMMdd"), 7), "yyyyMMdd"))
    inside = began.groupBy("cohort").agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_entities"))
    rows = days.join(inside, "cohort", "left")
    return rows.select("cohort", "valid", seconds("window_start"), seconds("window_end"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_events", "n_entities")))


@query(sql(BANDED, "select entity, record_id, score, round(percent_rank, 9)::double as percent_rank, band, stratum, test_digit, control_type from assigned"))
def assigned_groups(spark, d):
    return Q.banded(spark, d).withColumn("percent_rank", F.round("percent_rank", 9))


@query("select o_orderkey, (1 + (o_totalprice > 100000)::int + (o_totalprice > 200000)::int + (o_totalprice > 300000)::int)::int as score_group from orders where o_orderstatus = 'O' and o_orderdate >= timestamp '2000-01-01'")
def score_groups(spark, d):
    return Q.anchors(spark, d).select("o_orderkey", P.score_group("o_totalprice", Q.CUTS).alias("score_group"))


@query(sql(BANDED + """,
pp as (select distinct entity, c_mktsegment as channel, control_type from assigned join customer on c_custkey::varchar = entity),
ct as (select channel, count(*) filter (control_type = 'teste') as n_test, count(*) filter (control_type = 'teste' and ok) as approved_test, count(*) filter (control_type = 'controle') as n_control, count(*) filter (control_type = 'controle' and ok) as approved_control
       from (select *, entity in (select o_custkey::varchar from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '2000-01-01') as ok from pp) group by channel)""",
"""select channel, n_test, approved_test, n_control, approved_control, round(100 * t, 2) as rate_test, round(100 * c, 2) as rate_control, round(100 * (t - c), 2) as delta_pp, round(100 * (t / nullif(c, 0) - 1), 2) as lift, round(n_control * (t - c), 2) as projected
    from (select *, approved_test / nullif(n_test, 0) as t, approved_control / nullif(n_control, 0) as c from ct)"""))  # fmt: skip
def uplift(spark, d):
    people = Q.banded(spark, d).join(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("entity"), F.col("c_mktsegment").alias("channel")), "entity")
    approved = Q.orders(spark, d).filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit(Q.SINCE).cast("timestamp"))).select(F.col("o_custkey").cast("string").alias("entity"))
    return P.uplift(people, approved)


@query("select o_orderkey, round(1 / (1 + exp(-(o_totalprice / 100000 * 0.5 - 1))), 9) as score, (1 / (1 + exp(-(o_totalprice / 100000 * 0.5 - 1))) >= 0.5)::int as passes from orders where o_orderstatus = 'O' and o_orderdate >= timestamp '2000-01-01'")
def scored_orders(spark, d):
    rows = Q.anchors(spark, d).select("o_orderkey", (F.col("o_totalprice") / 100000).alias("price"))
    return P.scored(rows, {"price": 0.5}, -1.0).select("o_orderkey", F.round("score", 9).alias("score"), "passes")


@query("""select a.o_orderkey, count(b.o_orderkey) as previous, (max(b.o_orderdate) is null)::int as days_since_last_missing from orders a left join orders b on a.o_custkey = b.o_custkey and b.o_orderdate < a.o_orderdate where a.o_orderstatus = 'O' and a.o_orderdate >= timestamp '2000-01-01' group by a.o_orderkey""")
def feature_rows(spark, d):
    anchors = Q.anchors(spark, d)
    history = P.history_features(anchors, Q.orders(spark, d), "o_custkey", "o_orderdate", "o_orderkey", "o_orderdate", "o_orderkey", {"closed": "F"}, "o_orderstatus")
    rows = P.feature_rows(anchors, "o_orderkey", [history], ["previous", "previous_closed"], ["days_since_last"])
    return rows.select("o_orderkey", "previous", "days_since_last_missing")
