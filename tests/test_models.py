"""Models, propagation, evaluation and propensity against values worked out by hand."""

import inspect
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pathlens.functions.columns import log_normal_survival, log_survival, normal_survival
from pathlens.operators import evaluation as M
from pathlens.operators import models as K
from pathlens.operators import propensity as P
from pathlens.operators import relational as R
from pathlens.operators import scoring as L

EDGES = "src string, dst string, p double"


def test_normal_survival(spark):
    values = [-6.0, -3.0, -0.5, 0.0, 0.3, 1.0, 2.0, 3.3, 3.4, 4.0, 8.0, 30.0]
    rows = spark.createDataFrame([(z,) for z in values], "z double").select("z", normal_survival(F.col("z")).alias("s"), log_normal_survival(F.col("z")).alias("l")).collect()
    for r in rows:
        exact = 0.5 * math.erfc(r.z / math.sqrt(2))
        assert r.s == pytest.approx(exact, rel=1e-12) and r.l == pytest.approx(math.log(exact), rel=1e-12, abs=1e-14)
    far = spark.range(1).select(log_normal_survival(F.lit(60.0))).first()[0]
    assert far == pytest.approx(-1800 - math.log(60 * math.sqrt(2 * math.pi)), abs=1e-3)


def test_as_of_looks_at_both_times(spark):
    rows = [(1, 1, 5, 1), (2, 1, 4, 8), (3, 1, 6, 10), (4, 1, 9, 10), (5, 1, 10, 2), (6, 1, 3, None), (9, 1, 9, 3), (7, 2, 1, 1)]
    history = spark.createDataFrame(rows, "rid long, e long, known long, entry long")
    anchors = spark.createDataFrame([(4, 1, 10), (9, 1, 10), (1, 1, 5), (8, 3, 5)], "id long, e long, at long")
    got = {r.id: r.previous_id for r in R.as_of(anchors, history, "e", "at", "id", "known", "entry", "rid", []).collect()}
    expected = {}
    for i, e, at in ((4, 1, 10), (9, 1, 10), (1, 1, 5), (8, 3, 5)):
        ok = [(k, n, r) for r, x, k, n in rows if x == e and r != i and n is not None and k < at and (n < at or n == at and r < i)]
        expected[i] = max(ok)[2] if ok else None
    assert got == expected and expected[9] == 4


def test_time_reweights_destinations(spark):
    """p = (.5, .3, .2) with survival (.1, .6, .8) gives (.128, .462, .410)."""
    groups = spark.createDataFrame([("s", g, "exponential", 1.0, -1 / math.log(s), p) for g, (p, s) in enumerate([(0.5, 0.1), (0.3, 0.6), (0.2, 0.8)], 1)], "state string, grp int, family string, p1 double, p2 double, pi double")
    dests = spark.createDataFrame([("s", f"d{g}", g, 1.0, p) for g, p in ((1, 0.5), (2, 0.3), (3, 0.2))], "state string, dest string, grp int, r double, p double")
    cases = spark.createDataFrame([("u", "s", 86400.0), ("v", "s", 0.0)], "entity string, state string, age double")
    q = {(r.entity, r.dest): r.q for r in L.conditioned(cases, groups, dests, ["state"], ["entity"]).collect()}
    assert [round(q["u", f"d{i}"], 3) for i in (1, 2, 3)] == [0.128, 0.462, 0.410]
    assert [q["v", f"d{i}"] for i in (1, 2, 3)] == pytest.approx([0.5, 0.3, 0.2])


def test_competing_lognormal_recovers_parameters_and_raises_the_likelihood(spark):
    import random

    random.seed(3)
    rows = []
    for i in range(3000):
        g = 0 if random.random() < 0.6 else 1
        t = math.exp(random.gauss((-1.0, 1.0)[g], (0.5, 0.8)[g])) * 86400
        c = random.uniform(0, 8) * 86400
        rows.append((str(i), "s", "ab"[g] if t <= c else None, "exata" if t <= c else "direita", min(t, c), True))
    steps = spark.createDataFrame(rows, "entity string, state string, dest string, censoring string, dur_min double, eligible boolean")
    groups = K.pooled_destinations(steps, ["state"], 10, 5)
    few = K.fit_competing_lognormal(steps, groups, ["state"], iterations=1, shrink=0.0)
    params = K.fit_competing_lognormal(steps, groups, ["state"], iterations=15, shrink=0.0)
    out = {r.dest: r for r in params.join(groups, ["state", "grp"]).collect()}
    assert out["a"].pi == pytest.approx(0.6, abs=0.05) and out["a"].mu == pytest.approx(-1.0, abs=0.1) and out["a"].sigma == pytest.approx(0.5, abs=0.08)
    assert out["b"].mu == pytest.approx(1.0, abs=0.15) and out["b"].sigma == pytest.approx(0.8, abs=0.12)
    ll = [K.log_likelihood(steps, groups, p, ["state"]).first().log_likelihood for p in (few, params)]
    assert ll[1] >= ll[0]


def test_competing_lognormal_query_iterates_as_often_as_the_operator(spark, monkeypatch):
    from pathlens import queries

    plain, calls = inspect.signature(K.fit_competing_lognormal), []
    monkeypatch.setattr(K, "fit_competing_lognormal", lambda *a, **k: calls.append(plain.bind(*a, **k)))
    queries.QUERIES["competing_lognormal"](spark, "/root/testdata/sf0.001")
    calls[0].apply_defaults()
    assert calls[0].arguments["iterations"] == 30


def test_pure_timeout_atom(spark):
    steps = spark.createDataFrame([(str(i), "s", 1800.0, "exata", True) for i in range(300)], "entity string, state string, dur_min double, censoring string, eligible boolean")
    row = K.fit_timeout_atom(steps, ["state"], 1800.0).first()
    assert (row.family, row.atom, row.mu) == ("atom", 1.0, None)
    at = spark.range(1).select(K.atom_survival(F.lit(1800.0), F.lit(1800.0), F.lit(0.7), F.lit(0.0), F.lit(1.0)), K.atom_survival(F.lit(88200.0), F.lit(1800.0), F.lit(0.7), F.lit(0.0), F.lit(1.0))).first()
    assert at[0] == 1.0 and at[1] == pytest.approx(0.15)


def test_multistep_masses_close(spark):
    edges = spark.createDataFrame([("a1", "a2", 0.5), ("a1", "b1", 0.3), ("a2", "a1", 0.4), ("a2", "t1", 0.6), ("b1", "b1", 1.0)], EDGES)
    macros = spark.createDataFrame([(n, n[0]) for n in ("a1", "a2", "b1", "t1")], "node string, macro string")
    jumps = {(r.src, r.kind, r.dst): r.p for r in L.macro_jumps(edges, macros).collect()}
    assert jumps["a1", "jump", "t1"] == pytest.approx(0.3 / 0.8) and jumps["a1", "jump", "b1"] == pytest.approx(0.3 / 0.8)
    assert jumps["a1", "lost", None] == pytest.approx(0.2 / 0.8) and jumps["b1", "retained", None] == pytest.approx(1.0)
    out = L.macro_first_passage(L.macro_jumps(edges, macros), macros, ["t"], 2).groupBy("src").agg(F.sum("score").alias("total")).collect()
    assert all(r.total == pytest.approx(1.0, abs=1e-8) for r in out)
    assert [r.node for r in L.closed_nodes(edges.join(macros.select(F.col("node").alias("src"), F.col("macro").alias("m")), "src").join(macros.select(F.col("node").alias("dst"), F.col("macro").alias("n")), "dst"), F.col("m") == F.col("n")).collect()] == ["b1"]


def test_slow_leavers_are_not_retained(spark):
    edges = spark.createDataFrame([("a1", "a1", 0.999), ("a1", "t1", 0.001), ("b1", "b2", 0.99), ("b2", "b1", 0.99), ("b1", "b3", 0.005), ("b1", "t1", 0.005), ("b2", "b3", 0.005), ("b2", "t1", 0.005), ("b3", "b3", 1.0), ("c1", "c2", 0.9), ("c1", "t1", 0.1)], EDGES)
    macros = spark.createDataFrame([(n, n[0]) for n in ("a1", "b1", "b2", "b3", "c1", "c2", "t1")], "node string, macro string")
    jumps = {(r.src, r.kind): r.p for r in L.macro_jumps(edges, macros).collect() if r.p > 1e-8}
    expected = {("a1", "jump"): 1.0, ("b1", "jump"): 0.5, ("b1", "retained"): 0.5, ("b2", "jump"): 0.5, ("b2", "retained"): 0.5, ("b3", "retained"): 1.0, ("c1", "jump"): 0.1, ("c1", "lost"): 0.9}
    assert jumps == pytest.approx(expected, abs=1e-8)
    cut = {(r.src, r.kind): r.p for r in L.macro_jumps(edges, macros, most=1).filter("src = 'a1'").collect()}
    assert cut["a1", "jump"] + cut["a1", "unresolved"] == pytest.approx(1.0) and ("a1", "retained") not in cut


def test_lift_of_a_constant_score_is_one(spark):
    rows = spark.createDataFrame([(str(i), 0.3, int(i < 2)) for i in range(10)], "entity string, score double, y int")
    out = M.weighted_bands(rows, "score", F.lit(1.0), F.col("y"), [("top", 0, 0.1)]).first()
    assert (out.lift, out.capture, out.weight) == (pytest.approx(1.0), pytest.approx(0.1), pytest.approx(1.0))


def test_percent_rank_bands_and_groups(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("b", 2, 0.9), ("c", 3, 0.7), ("d", 4, 0.1)], "entity string, record_id int, score double")
    out = {r.record_id: r for r in P.with_bands(rows).collect()}
    assert [out[i].percent_rank for i in (1, 2, 3, 4)] == [0.375, 0.375, 0.75, 1.0]
    assert [out[i].band for i in (1, 2, 3, 4)] == ["Top 50%", "Top 50%", "Bottom 50%", "Bottom 50%"]
    groups = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.8, 0.9, 1.0)], "score double").select(P.score_group("score", [0.2, 0.8]).alias("g")).collect()
    assert [r.g for r in groups] == [1, 1, 2, 2, 3, 3]


def test_assignment_is_exact_and_ignores_order(spark):
    rows = [(f"e{i}", i, 0.5, "Top 50%") for i in range(100)]
    frame = lambda r: spark.createDataFrame(r, "entity string, record_id int, score double, band string")
    one = {r.entity: r.test_digit for r in P.assigned(frame(rows), "c").collect()}
    two = {r.entity: r.test_digit for r in P.assigned(frame(rows[::-1]), "c").collect()}
    assert one == two and sum(one.values()) == 10
    low = P.assigned(frame([*rows, ("e1", 500, 0.0, P.BOTTOM)]), "c").filter("entity = 'e1'").collect()
    assert {r.control_type for r in low} == {"controle_score_baixo"}


def test_weekly_window(spark):
    rows = spark.createDataFrame([("20240108",), ("20240109",), (None,)], "cohort string")
    out = {r.cohort: r for r in P.weekly_window(rows).collect()}
    assert out["20240108"].window_start == datetime(2024, 1, 1, 8) and out["20240108"].window_end == datetime(2024, 1, 8, 8)
    assert not out["20240109"].valid and out["20240109"].window_start is None
    now = spark.createDataFrame([(datetime(2024, 1, 8, 7, 59),), (datetime(2024, 1, 8, 8, 0),)], "now timestamp")
    assert [r.cohort for r in P.current_cohort(now).orderBy("now").collect()] == ["20240101", "20240108"]


def test_features_are_cleaned(spark):
    rows = spark.createDataFrame([("1", "1.5", "invalid"), ("2", "Infinity", "NaN")], "k string, a string, b string")
    assert [tuple(r) for r in P.cleaned_features(rows, ["k"], ["a", "b"]).orderBy("k").collect()] == [("1", 1.5, None), ("2", None, None)]


def test_as_of_takes_strictly_earlier_records(spark):
    day = lambda d: datetime(2024, 1, d)
    anchors = spark.createDataFrame([(1, "p", day(5)), (2, "q", day(5))], "id long, person string, at timestamp")
    history = spark.createDataFrame([(10, "p", day(1), day(2), 7.0), (11, "p", day(3), day(5), 8.0), (12, "p", day(3), day(4), None)], "rid long, person string, entry timestamp, known timestamp, v double")
    out = {r.id: r for r in R.as_of(anchors, history, "person", "at", "id", "known", "entry", "rid", ["v"]).collect()}
    assert (out[1].previous_id, out[1].previous_v, out[1].no_history) == (12, None, False)
    assert (out[2].previous_id, out[2].no_history) == (None, True)


def test_uplift_without_control_is_null(spark):
    people = spark.createDataFrame([("a", "x", "teste"), ("b", "x", "teste")], "entity string, channel string, control_type string")
    row = P.uplift(people, people.filter("entity = 'a'")).first()
    assert (row.rate_test, row.rate_control, row.delta_pp, row.lift) == (50.0, None, None, None)


def test_log_survival_families(spark):
    s = lambda f, a, b: math.exp(spark.range(1).select(log_survival(f, F.lit(2.0), F.lit(a), F.lit(b))).first()[0])
    assert s("weibull", 2.0, 2.0) == pytest.approx(math.exp(-1)) and s("exponential", 1.0, 2.0) == pytest.approx(math.exp(-1))
    assert s("loglogistic", 2.0, 2.0) == pytest.approx(0.5) and s("lognormal", math.log(2), 1.0) == pytest.approx(0.5)


def test_first_action_knows_the_age(spark):
    edges = spark.createDataFrame([("a", "x", 0.5), ("a", "b", 0.5), ("b", "x", 0.2), ("b", "y", 0.3), ("b", "a", 0.5)], EDGES)
    actions = spark.createDataFrame([("x", "X"), ("y", "Y")], "dst string, action string")
    first = spark.createDataFrame([("u", "x", 0.1), ("u", "b", 0.9), ("v", "a", 1.0), ("w", "y", 0.4), ("z", "lost", 1.0)], "entity string, dest string, q double")
    got = {(r.entity, r.action): r.score for r in L.first_action_by_age(first, edges, actions, 3, ["entity"]).collect()}
    # two steps on from b: X 0.2 + 0.5 * 0.5, Y 0.3; from a: X 0.5 + 0.5 * 0.2, Y 0.5 * 0.3
    assert got == {("u", "X"): pytest.approx(0.1 + 0.9 * 0.45), ("u", "Y"): pytest.approx(0.27), ("v", "X"): pytest.approx(0.6), ("v", "Y"): pytest.approx(0.15), ("w", "Y"): pytest.approx(0.4)}
    one = {(r.entity, r.action): r.score for r in L.first_action_by_age(first, edges, actions, 1, ["entity"]).collect()}
    assert one == {("u", "X"): 0.1, ("w", "Y"): 0.4}


def test_intervals_that_begin_at_zero_count(spark):
    rows = [("s", "exata", 86400.0, 86400.0), ("s", "exata", 4 * 86400.0, 4 * 86400.0), ("s", "intervalo", 0.0, 2 * 86400.0), ("s", "intervalo", 86400.0, 3 * 86400.0), ("s", "direita", 86400.0, None)]
    steps = spark.createDataFrame([(*r, True, False) for r in rows], "state string, censoring string, dur_min double, dur_max double, eligible boolean, holdout boolean")
    out = K.compare_families(steps, K.fit_families(steps, ["state"]).filter("family = 'exponential'"), ["state"]).first()
    mean = 2.5
    s = lambda t: math.exp(-t / mean)
    expected = -2 * math.log(mean) - 5 / mean + math.log(1 - s(2)) + math.log(s(1) - s(3)) - 1 / mean
    assert out.log_likelihood == pytest.approx(expected)


def test_censored_steps_slow_the_curves_of_scores(spark, monkeypatch):
    """Of two groups with the same exact durations, the one that censoring favours grows with the age as brute force says."""
    from pathlens.plans import journeys as S

    rows = [("s", d, "exata", t, True, f"u{i}", False) for i, (d, t) in enumerate([("x", 3600.0 * k) for k in range(1, 31)] + [("y", 36000.0 * k) for k in range(1, 31)])]
    rows += [("s", None, "direita", 400000.0, True, f"c{i}", False) for i in range(20)]
    steps = spark.createDataFrame(rows, "state string, dest string, censoring string, dur_min double, eligible boolean, entity string, holdout boolean")
    monkeypatch.setattr(S, "steps", lambda spark, d: steps)
    dests, groups = S.censored_groups(spark, "")
    cases = spark.createDataFrame([("e", "s", 200000.0)], "entity string, state string, age double")
    got = {r.dest: r.q for r in L.conditioned(cases, groups, dests, ["state"], ["entity"]).collect()}
    m = {r.grp: r.pi * 0.5 * math.erfc((math.log(200000.0 / 86400) - r.p1) / r.p2 / math.sqrt(2)) for r in groups.collect()}
    expected = {r.dest: m[r.grp] / sum(m.values()) * r.r for r in dests.collect()}
    assert got == {k: pytest.approx(v, rel=1e-9) for k, v in expected.items()} and got["y"] > 0.9
