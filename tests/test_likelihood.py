"""Duration models against brute force: intervals, timeout atoms, Newton steps; routes and step coefficients by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathlens.operators import models as K
from pathlens.operators import scoring as L

DAY = 86400.0
STEPS = "state string, dest string, censoring string, dur_min double, dur_max double, eligible boolean, entity string, holdout boolean"


def steps_of(spark, rows):
    return spark.createDataFrame([("s", d, kind, float(low), None if high is None else float(high), True, f"u{i}", False) for i, (d, kind, low, high) in enumerate(rows)], STEPS)


def simulated(n=4000, seed=3):
    """Two groups of log-normal durations, cut off at random times, some only known to lie between two visits."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        own = rng.random() < 0.6
        t = math.exp(rng.normal(-1.0, 0.8) if own else rng.normal(0.7, 0.5)) * DAY
        end = math.exp(rng.normal(1.0, 0.8)) * DAY
        dest = "x" if own else "y"
        if t > end:
            rows.append((None, "direita", round(end, -3) + 1000, None))
        elif rng.random() < 0.5:
            low = math.floor(t / 40000) * 40000
            rows.append((dest if rng.random() < 0.5 else None, "intervalo", low, low + 40000))
        else:
            rows.append((dest, "exata", t, t))
    return rows


def test_intervals_and_right_censoring_recover_the_parameters(spark):
    rows = simulated()
    steps = steps_of(spark, rows).cache()
    groups = spark.createDataFrame([("s", "x", 1, 1.0), ("s", "y", 2, 1.0)], "state string, dest string, grp int, r double")
    likelihoods = []
    for iterations in (1, 3, 30):
        fit = K.fit_competing_lognormal(steps, groups, ["state"], iterations=iterations, alpha=0.0, shrink=0.0).cache()
        likelihoods.append(K.log_likelihood(steps, groups, fit, ["state"]).first().log_likelihood)
    assert all(b >= a - 1e-6 for a, b in zip(likelihoods, likelihoods[1:], strict=False))
    p = {r.grp: r for r in fit.collect()}
    got = [p[1].pi, p[1].mu, p[1].sigma, p[2].pi, p[2].mu, p[2].sigma]
    assert got == pytest.approx([0.6, -1.0, 0.8, 0.4, 0.7, 0.5], abs=4e-2)  # what so many draws tell
    # at the maximum no parameter moved by itself gains
    best = brute_likelihood(rows, got)
    assert likelihoods[-1] == pytest.approx(best, rel=1e-9)
    for i in range(1, 6):
        if i != 3:
            for d in (-1e-2, 1e-2):
                assert brute_likelihood(rows, [*got[:i], got[i] + d, *got[i + 1 :]]) < best


def brute_likelihood(rows, p):
    """From first principles, with pi of the second group what the first leaves."""
    below = lambda t, mu, s: 0.5 * math.erfc(-(math.log(t / DAY) - mu) / s / math.sqrt(2)) if t > 0 else 0.0
    of = {"x": (p[0], p[1], p[2]), "y": (p[3], p[4], p[5])}
    total = 0.0
    for dest, kind, low, high in rows:
        names = [dest] if dest else ["x", "y"]
        if kind == "exata":
            pi, mu, s = of[dest]
            x = math.log(low / DAY)
            total += math.log(pi) - math.log(s * math.sqrt(2 * math.pi)) - math.log(low / DAY) - (x - mu) ** 2 / 2 / s**2
        elif kind == "direita":
            total += math.log(sum(pi * (1 - below(low, mu, s)) for pi, mu, s in of.values()))
        else:
            total += math.log(sum(of[n][0] * (below(high, *of[n][1:]) - below(low, *of[n][1:])) for n in names))
    return total


def test_an_atom_takes_part_in_the_mixture(spark):
    """Silences begin at the timeout, most of them right there; censored steps before it say nothing against them."""
    rng = np.random.default_rng(123)
    rows = []
    for _ in range(4000):
        silent = rng.random() < 0.55
        t = 1800.0 + (0.0 if rng.random() < 0.8 else math.exp(rng.normal(math.log(130.0), 0.8))) if silent else math.exp(rng.normal(math.log(75.0), 1.0))
        end = math.exp(rng.normal(math.log(4000.0), 1.5))
        rows.append(("sem_acao:::classe" if silent else "NAVEGACAO", "exata", t, t) if t < end else (None, "direita", round(end) + 1, None))
    groups = spark.createDataFrame([("s", "sem_acao:::classe", 1, 1.0, 0.55), ("s", "NAVEGACAO", 2, 1.0, 0.45)], "state string, dest string, grp int, r double, p double")
    fit = K.fit_competing_lognormal(steps_of(spark, rows), groups, ["state"], iterations=30, alpha=0.0, shrink=0.0, timeout=1800.0).cache()
    p = {r.grp: r for r in fit.collect()}
    assert p[1].atom == pytest.approx(0.8, abs=0.03) and p[1].shift == 1800.0 and p[2].atom == 0.0 and p[1].pi == pytest.approx(0.55, abs=0.03)
    assert p[1].mu == pytest.approx(math.log(130.0 / DAY), abs=0.15) and p[2].mu == pytest.approx(math.log(75.0 / DAY), abs=0.1)
    # scores: before the timeout all silences are ahead, beyond it only their tail
    curves = fit.select("state", "grp", "family", F.col("mu").alias("p1"), F.col("sigma").alias("p2"), "pi", "shift", "atom")
    cases = spark.createDataFrame([("at", "s", 1800.0), ("after", "s", 1801.0)], "entity string, state string, age double")
    q = {(r.entity, r.dest): r.q for r in L.conditioned(cases, curves, groups, ["state"], ["entity"]).collect()}
    other = p[2].pi * 0.5 * math.erfc((math.log(1801.0 / DAY) - p[2].mu) / p[2].sigma / math.sqrt(2))
    tail = p[1].pi * (1 - p[1].atom) * 0.5 * math.erfc((math.log(1.0 / DAY) - p[1].mu) / p[1].sigma / math.sqrt(2))
    assert q["after", "sem_acao:::classe"] == pytest.approx(tail / (tail + other), rel=1e-9)
    assert q["at", "sem_acao:::classe"] > 0.98


def test_a_pure_atom_needs_no_spread_and_is_gone_after_it(spark):
    groups = spark.createDataFrame([("s", "sem_acao", 1, 1.0, 1.0)], "state string, dest string, grp int, r double, p double")
    rows = [("sem_acao", "exata", 1800.0, 1800.0)] * 300 + [(None, "direita", 900.0, None)] * 20
    fit = K.fit_competing_lognormal(steps_of(spark, rows), groups, ["state"], iterations=5, timeout=1800.0)
    p = fit.first()
    assert p.atom == 1.0 and p.pi == 1.0 and not p.at_bound
    curves = fit.select("state", "grp", "family", F.col("mu").alias("p1"), F.col("sigma").alias("p2"), "pi", "shift", "atom").cache()
    cases = spark.createDataFrame([("at", "s", 1800.0), ("beyond", "s", 1801.0)], "entity string, state string, age double")
    assert [(r.entity, r.q) for r in L.conditioned(cases, curves, groups, ["state"], ["entity"]).collect()] == [("at", 1.0)]
    (within,) = L.horizon(cases.filter("entity = 'at'"), curves, groups, ["state"], ["entity"], 60.0).collect()
    assert (within.within, within.no_exit) == (1.0, 0.0)


def family_likelihood(rows, family, p1, p2):
    def survival(t):
        if t <= 0:
            return 1.0
        return {"weibull": lambda: math.exp(-((t / p2) ** p1)), "exponential": lambda: math.exp(-t / p2), "loglogistic": lambda: 1 / (1 + (t / p2) ** p1), "lognormal": lambda: 0.5 * math.erfc((math.log(t) - p1) / p2 / math.sqrt(2))}[family]()

    def density(t):
        z = (t / p2) ** p1 if family != "lognormal" else 0
        return {"weibull": lambda: p1 / t * z * math.exp(-z), "exponential": lambda: math.exp(-t / p2) / p2, "loglogistic": lambda: p1 / t * z / (1 + z) ** 2, "lognormal": lambda: math.exp(-((math.log(t) - p1) ** 2) / 2 / p2**2) / (t * p2 * math.sqrt(2 * math.pi))}[family]()

    of = {"exata": lambda a, b: density(a), "direita": lambda a, b: survival(a), "intervalo": lambda a, b: survival(a) - survival(b)}
    return sum(math.log(of[kind](low / DAY, (high or 0) / DAY)) for _, kind, low, high in rows)


def test_newton_finds_the_maximum_of_each_family(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(800):
        t, end = rng.weibull(0.7) * 2 * DAY, rng.exponential(5.0) * DAY
        kind = rng.random()
        rows.append((None, "direita", end, None) if t > end else (None, "exata", t, t) if kind < 0.5 else (None, "intervalo", t // 50000 * 50000, t // 50000 * 50000 + 50000))
    fits = {r.family: r for r in K.maximise_families(steps_of(spark, rows), ["state"]).collect()}
    assert set(fits) == set(K.FAMILIES) and all(r.done and r.gradient < 1e-6 for r in fits.values())
    for name, r in fits.items():
        best = family_likelihood(rows, name, r.p1, r.p2)
        assert best == pytest.approx(r.log_likelihood, rel=1e-9)
        for dp in (-1e-3, 1e-3):
            assert family_likelihood(rows, name, r.p1, r.p2 + dp) < best
            if name != "exponential":
                assert family_likelihood(rows, name, r.p1 + dp, r.p2) < best
    assert fits["weibull"].delta_aic == 0.0 and fits["weibull"].p1 == pytest.approx(0.7, abs=0.08)


def test_families_without_two_exact_durations_have_no_rows(spark):
    assert K.maximise_families(steps_of(spark, [(None, "exata", 5.0, 5.0), (None, "direita", 7.0, None)]), ["state"]).count() == 0


# routes and step coefficients

CONFIG = [("p", "pix"), ("b", "boleto"), ("l1", "login"), ("l2", "login"), ("ls", "login"), ("chat", None), ("m", "outra")]
MODELS = {"p": {"l1": 1.0}, "b": {"l1": 1.0}, "l1": {"l2": 1.0}, "l2": {"ls": 1.0}, "ls": {"p": 0.5, "b": 0.5}, "chat": {"l1": 1.0}}
CHILD = {("ls", "pix"): {"p": 0.9, "b": 0.1}, ("ls", "boleto"): {"p": 0.2, "b": 0.8}}


def scenario(models=None, child=None, targets=("pix", "boleto"), k=2, state="l1", memory=None, terminals=()):
    return {"models": MODELS | (models or {}), "child": child or {}, "targets": targets, "k": k, "state": state, "memory": memory, "terminals": terminals}


#: Each is a part of one graph, so that its closure is made once for all.
SCENARIOS = {
    "A": scenario(child=CHILD, state="p", memory="pix"),
    "B": scenario(child=CHILD, state="b", memory="boleto"),
    "C": scenario(child=CHILD, k=1, state="p", memory="pix"),
    "D": scenario(child=CHILD, k=1, memory="boleto"),
    "E": scenario({"l1": {"m": 1.0}}, targets=("pix",), k=1),
    "F": scenario({"l1": {"m": 1.0}}, targets=("pix",)),
    "G": scenario({"l1": {"m": 1.0}}, targets=("outra",)),
    "H": scenario({"l1": {"l2": 1.0}, "l2": {"l1": 1.0}}, targets=("pix",), k=3),
    "I": scenario({"l1": {"l1": 0.8, "p": 0.2}}, targets=("pix",), k=1),
    "J": scenario({"l1": {"m": 0.4, "p": 0.6}}, targets=("boleto",), k=3, terminals=("m",)),
}


@pytest.fixture(scope="module")
def walked(spark):
    """Of each scenario's start the scores and masses, and the arrays of them."""
    from pathlens.operators.journey import BASE, NO_MEMORY

    states = [(n + s, f and n + f, n + (f or s), f == "login") for n in SCENARIOS for s, f in CONFIG]
    dests = [(n + s, BASE, n + d, p) for n, x in SCENARIOS.items() for s, m in x["models"].items() for d, p in m.items()]
    dests += [(n + s, n + c, n + d, p) for n, x in SCENARIOS.items() for (s, c), m in x["child"].items() for d, p in m.items()]
    states = spark.createDataFrame(states, "state string, funnel string, macro string, technical boolean").cache()
    dests = spark.createDataFrame(dests, "state string, context string, dest string, p double").cache()
    edges, macros = (K.checkpointed(df) for df in L.memory_graph(dests, states, spark.createDataFrame([(NO_MEMORY,)], "memory string")))
    targets = [n + t for n, x in SCENARIOS.items() for t in x["targets"]]
    ends = macros.filter(F.col("state").isin([n + t for n, x in SCENARIOS.items() for t in x["terminals"]])).select("node")
    passage = K.checkpointed(L.passage_by_step(L.macro_jumps(edges, macros), macros, targets, 3, ends))
    own = macros.select(F.col("node").alias("src"), F.col("macro").alias("own"))
    out, arrays = {}, {}
    for k in (1, 2, 3):
        starts = {f"{n}{x['state']}|{n + x['memory'] if x['memory'] else NO_MEMORY}": n for n, x in SCENARIOS.items() if x["k"] == k}
        table = edges.filter(F.col("src").isin(list(starts))).join(own, "src").select(F.col("src").alias("node"), F.col("dst").alias("dest"), F.lit(1).alias("grp"), F.col("p").alias("r"), "own")
        rows = L.step_coefficients(passage, table, macros, targets, ["node"], F.col("dest"), k, F.col("own"), ends)
        weights = spark.createDataFrame([(n, node, 1, 1.0) for node, n in starts.items()], "entity string, node string, grp int, weight double")
        scores = K.checkpointed(L.step_scores(weights, rows, ["node"], ["entity"]))
        for r in scores.collect():
            out.setdefault(r.entity, {})[r.kind, r.action and r.action[1:], r.change] = r.score
        for r in L.score_arrays(scores, ["entity"], k).collect():
            arrays[r.entity, r.action and r.action[1:]] = r
    return out, arrays


def test_scores_and_masses_add_up_to_one(walked):
    assert set(walked[0]) == set(SCENARIOS)
    for rows in walked[0].values():
        assert sum(rows.values()) == pytest.approx(1.0, abs=1e-9)


def test_memory_decides_what_follows_a_technical_step(walked):
    out, arrays = walked
    assert out["A"] == {("target", "pix", 2): pytest.approx(0.9), ("target", "boleto", 2): pytest.approx(0.1)} and out["B"]["target", "boleto", 2] == pytest.approx(0.8)
    assert arrays["A", "pix"].by_change == [0.0, pytest.approx(0.9)] and arrays["A", "pix"].best_change == 2 and arrays["A", "pix"].step_limit == 0.0


def test_one_change_reaches_what_is_one_change_away(walked):
    assert walked[0]["C"] == {("step_limit", None, 1): 1.0}
    assert walked[0]["D"] == {("target", "boleto", 1): pytest.approx(0.8), ("target", "pix", 1): pytest.approx(0.2)}


def test_all_mass_has_a_name(walked):
    for name, kind in {"E": "step_limit", "F": "no_model", "G": "target", "H": "retained", "I": "target"}.items():
        assert sum(v for (found, _, _), v in walked[0][name].items() if found == kind) == pytest.approx(1.0, abs=1e-8)


def test_terminal_states_end_the_walk(walked):
    assert walked[0]["J"]["terminal", None, 1] == pytest.approx(0.4) and ("no_model", None, 2) not in walked[0]["J"]


def test_every_route_scores_with_its_model(spark):
    from pathlens.operators.journey import BASE, NO_MEMORY

    cases = [("1", "t", "pix", 0.0), ("2", "nowhere", "pix", 0.0), ("3", "s", BASE, 0.0), ("4", "t", NO_MEMORY, 0.0), ("5", "t", "unseen", 0.0), ("6", "t", "rare", 0.0), ("7", "t", "failed", 0.0)]
    cases = spark.createDataFrame(cases, "entity string, state string, context string, age double")
    supported = spark.createDataFrame([("t", "pix", "candidato"), ("t", "rare", "raro"), ("t", "failed", "candidato"), ("t", NO_MEMORY, "sem_memoria"), ("s", BASE, "origem")], "state string, context string, support_status string")
    dests = spark.createDataFrame([("t", "x", 1, 1.0, 0.3), ("t", "y", 2, 1.0, 0.7), ("s", "x", 1, 1.0, 1.0)], "state string, dest string, grp int, r double, p double")
    groups = spark.createDataFrame([("t", 1, "exponential", 1.0, 1.0, 0.3), ("t", 2, "exponential", 1.0, 1.0, 0.7), ("s", 1, "exponential", 1.0, 1.0, 1.0)], "state string, grp int, family string, p1 double, p2 double, pi double")
    child = spark.createDataFrame([("t", "pix", "x", 5, 0.9), ("t", "pix", "y", 1, 0.1)], "state string, context string, dest string, n int, p double")
    out = L.routed_scores(cases, supported, (dests, groups), K.recombined(child, dests, groups), ["entity"]).collect()
    routes = {r.entity: (r.route, r.model_context) for r in out}
    assert routes == {"1": ("contexto", "pix"), "2": ("sem_modelo_origem", None), "3": ("origem_nao_tecnica", BASE), "4": ("sem_memoria", BASE), "5": ("contexto_nao_visto", BASE), "6": ("contexto_raro", BASE), "7": ("ajuste_filho_falhou", BASE)}
    q = {(r.entity, r.dest): r.q for r in out}
    assert q["1", "x"] == pytest.approx(0.9) and q["5", "x"] == pytest.approx(0.3) and q["2", None] is None and q["3", "x"] == 1.0
