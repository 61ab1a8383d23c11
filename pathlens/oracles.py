"""SQL of the same tables for DuckDB: common table expressions that the oracles share."""

CUT, DEBOUNCE, TIMEOUT = "TIMESTAMP '2024-01-28'", 21600, 21600
TECHNICAL, TARGETS = "('view', 'click')", "('error', 'purchase', 'signup')"

RAW = f"""
raw as (
    select user_id::varchar as entity, date_trunc('hour', ts) as ts,
           event_type || ':::' || case when value < 20 then 'topo' when value < 60 then 'navegacao' else 'sucesso' end as state, value as depth
    from events where date_trunc('hour', ts) < {CUT}
)"""

INSTANTS = f"""{RAW},
one as (select entity, ts, state, coalesce(max(depth), -1) as depth, count(*) as n from raw group by entity, ts, state),
two as (select *, depth = max(depth) over (partition by entity, ts) as deepest from one),
inst as (
    select entity, ts, case when count(*) filter (deepest) = 1 then max(state) filter (deepest) end as state,
           count(*) filter (deepest) <> 1 as ambiguous, sum(n)::bigint as n_events,
           count(*) filter (deepest) = 1 and count(*) > 1 as resolved_by_depth
    from two group by entity, ts
)"""

ACTIONS = f"""{INSTANTS},
marked as (
    select *, coalesce(state = lag(state) over w and not ambiguous and not coalesce(lag(ambiguous) over w, false)
                       and epoch(ts) - epoch(lag(ts) over w) <= {DEBOUNCE}, false) as again
    from inst window w as (partition by entity order by ts)
),
burst as (select *, sum(case when again then 0 else 1 end) over (partition by entity order by ts rows unbounded preceding) as step from marked),
act as (
    select entity, step::bigint as step, max(ts) as ts, min(ts) as first_ts, max(state) as state, bool_or(ambiguous) as ambiguous,
           sum(n_events)::bigint as n_events, count(*) as n_instants
    from burst group by entity, step
)"""

STEPS = f"""{ACTIONS},
led as (
    select *, lead(ts) over w as next_ts, lead(state) over w as next_state, lead(ambiguous) over w as next_ambiguous
    from act window w as (partition by entity order by ts)
),
timed as (
    select *, case when ambiguous then 'origem_ambigua' when next_ts is null or next_ambiguous then 'direita' else 'exata' end as censoring,
           (epoch_us(coalesce(next_ts, {CUT})) - epoch_us(ts)) / 1e6 as dur_min
    from led
),
trans as (
    select entity, step, ts, state, ambiguous, n_events, n_instants, censoring, dur_min,
           case when censoring = 'exata' then next_state end as dest, case when censoring = 'exata' then dur_min end as dur_max,
           not ambiguous and dur_min > 0 as eligible, coalesce(censoring = 'exata' and next_state = state, false) as self_transition,
           ('0x' || substr(md5('holdout|' || entity), 1, 8))::bigint % 5 = 0 as holdout
    from timed
),
cat as (
    select distinct state, split_part(state, ':::', 1) as funnel, split_part(state, ':::', 2) as stage, split_part(state, ':::', 1) as macro,
           split_part(state, ':::', 1) in {TECHNICAL} as technical
    from raw
),
named as (select trans.*, funnel, macro, technical, ambiguous or trans.state is null as barrier from trans left join cat on cat.state = trans.state),
cut_up as (
    select *, lag(step) over w is null or barrier or coalesce(lag(barrier) over w, true) or step - lag(step) over w > 1 as broken
    from named window w as (partition by entity order by step)
),
seg as (select *, sum(broken::int) over (partition by entity order by step rows unbounded preceding) as segment from cut_up),
remembered as (
    select *, last_value(case when not barrier and funnel is not null and not technical then funnel end ignore nulls) over p as memory,
           last_value(case when not barrier and funnel is not null and not technical then step end ignore nulls) over p as evidence_step
    from seg window p as (partition by entity, segment order by step rows between unbounded preceding and current row)
),
st as (
    select *, case when barrier then null when technical then coalesce(memory, '__SEM_MEMORIA__') else '__BASE__' end as context,
           case when eligible and not holdout then 1.0 end as event_weight,
           case when eligible and not holdout then 1.0 / sum((eligible and not holdout)::int) over (partition by entity, state) end as entity_weight
    from remembered
)"""

BLOCKS = f"""{STEPS},
turned as (select *, not coalesce(macro = lag(macro) over (partition by entity order by step), false) as turn from st),
blocked as (select *, sum(turn::int) over (partition by entity order by step rows unbounded preceding) as block from turned),
bl as (
    select entity, block::bigint as block, max(macro) as macro, min(step) as first_step, arg_min(state, step) as entry_state,
           min(ts) as start_ts, max(ts) as last_ts, count(*) as steps
    from blocked group by entity, block
)"""

LABELS = f"""{STEPS},
lk as (
    select *, coalesce(censoring = 'exata' and lead(step) over w = step + 1 and eligible and not coalesce(lead(ambiguous) over w, true)
                       and dest is not distinct from lead(state) over w
                       and abs((epoch_us(lead(ts) over w) - epoch_us(ts)) / 1e6 - dur_min) <= 1e-3, false) as linked
    from st window w as (partition by entity order by step)
),
tj as (
    select *, sum((not coalesce(was, false))::int) over (partition by entity order by step rows unbounded preceding) as trajectory
    from (select *, lag(linked) over (partition by entity order by step) as was from lk)
),
rn as (
    select *, sum(turn::int) over (partition by entity, trajectory order by step rows unbounded preceding) as run
    from (select *, lag(step) over w is null or macro is distinct from lag(macro) over w as turn from tj window w as (partition by entity, trajectory order by step))
),
runs as (select entity, trajectory, run, max(macro) as macro, min(ts) as start_ts from rn group by entity, trajectory, run),
ahead as (
    select *, {", ".join(f"lead(macro, {h}) over w as m{h}, lead(run, {h}) over w as r{h}" for h in (1, 2, 3))}
    from runs window w as (partition by entity, trajectory order by run)
),
judged as (
    select entity, trajectory, run, (r1 is not null)::int + (r2 is not null)::int + (r3 is not null)::int as changes_seen,
           case when m1 in {TARGETS} then m1 when m2 in {TARGETS} then m2 when m3 in {TARGETS} then m3 end as action,
           case when m1 in {TARGETS} then 1 when m2 in {TARGETS} then 2 when m3 in {TARGETS} then 3 end as change
    from ahead
),
lab as (
    select rn.*, action, change, changes_seen,
           case when action is not null then 'ALVO_OBSERVADO' when changes_seen = 3 then 'HORIZONTE_OBSERVADO_SEM_ALVO' else 'CENSURADO_ANTES_HORIZONTE' end as label_status
    from rn join judged using (entity, trajectory, run)
)"""

FREQUENCIES = f"""{STEPS},
pair as (select state, dest, count(*) as n, count(distinct entity) as entities from st where eligible and censoring = 'exata' and not holdout group by state, dest),
orig as (
    select state, count(*) filter (censoring = 'exata') as origin_n, count(distinct entity) filter (censoring = 'exata') as origin_entities, count(*) as origin_steps
    from st where eligible and not holdout group by state
),
freq as (select pair.*, origin_n, origin_entities, origin_steps, n / nullif(origin_n, 0) as p, origin_n / nullif(origin_steps, 0) as coverage from pair join orig using (state))"""

GROUPS = f"""{STEPS},
train as (select * from st where eligible and censoring = 'exata' and not holdout and state is not null),
sup as (select state, dest, count(*) as n, count(distinct entity) as entities from train group by state, dest),
placed as (select *, n >= 20 and entities >= 5 as enough, row_number() over (partition by state order by (n >= 20 and entities >= 5) desc, n desc, entities desc, dest) as place from sup),
grouped as (select state, dest, n, entities, (case when enough and place <= 8 then place else 0 end)::int as grp from placed),
dests as (select *, n / sum(n) over (partition by state, grp) as r, n / sum(n) over (partition by state) as p from grouped),
mom as (
    select state, grp, count(*) as n, avg(ln(dur_min / 86400)) as m, stddev_pop(ln(dur_min / 86400)) as s
    from train join dests using (state, dest) where dur_min > 0 group by state, grp
),
grps as (
    select state, grp, sum(p) as pi, pi() / sqrt(6) / any_value(s) as p1, exp(any_value(m) + 0.5772156649015329 / (pi() / sqrt(6) / any_value(s))) as p2
    from dests join (select state, grp, mom.n as k, m, s from mom) using (state, grp) where k >= 2 and s > 0 group by state, grp
)"""

BANDED = """
anch as (
    select distinct o_orderkey, o_custkey, o_orderdate, o_totalprice from orders
    where o_orderstatus = 'O' and o_orderdate >= timestamp '2000-01-01' and o_orderdate < timestamp '2100-01-01'
),
scored as (select o_custkey::varchar as entity, o_orderkey as record_id, round(o_totalprice, 0) as score from anch),
ranked as (select *, (rank() over (order by score desc) + (count(*) over (partition by score) - 1) / 2.0) / count(*) over () as percent_rank from scored),
bands as (
    select *, case when percent_rank <= .01 then 'Top 1%' when percent_rank <= .05 then 'Top 5%' when percent_rank <= .1 then 'Top 10%' when percent_rank <= .2 then 'Top 20%'
                   when percent_rank <= .3 then 'Top 30%' when percent_rank <= .5 then 'Top 50%' else 'Bottom 50%' end as band
    from ranked
),
strat as (select entity, arg_min(band, (score, record_id)) as stratum from bands group by entity),
hashed as (select *, row_number() over (partition by stratum order by sha256('20240101|' || entity || '|experiment'), entity) as place, count(*) over (partition by stratum) as size from strat),
groups as (
    select entity, stratum, stratum <> 'Bottom 50%' and place <= floor(size * 0.9 + 1e-9) as test from hashed
),
assigned as (
    select bands.*, stratum, case when test then 0 else 1 end as test_digit,
           case when stratum = 'Bottom 50%' then 'controle_score_baixo' when test then 'teste' else 'controle' end as control_type
    from bands join groups using (entity)
)"""


def sql(tables: str, select: str) -> str:
    return f"with {tables.strip()}\n{select.strip()}"
