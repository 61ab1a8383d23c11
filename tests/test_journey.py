"""State sequences on small hand-made rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pathlens.operators import journey as J
from pathlens.operators import quality as B

START = datetime(2024, 1, 1)


def events(spark, rows):
    data = [(e, START + timedelta(seconds=s), state, None if depth is None else float(depth)) for e, s, state, depth in rows]
    return spark.createDataFrame(data, "entity string, ts timestamp, state string, depth double")


def steps_of(spark, rows, technical=("login",), cut="2024-01-02"):
    raw = events(spark, rows)
    actions = J.debounced(J.instants_by_depth(raw), 30)
    return J.with_memory(B.with_holdout(J.transitions(actions, cut)), J.catalog(raw, list(technical)))


def test_depth_decides_and_ties_are_ambiguous(spark):
    rows = events(spark, [("u", 0, "a:::topo", 0.2), ("u", 0, "b:::topo", 0.9), ("u", 5, "a:::topo", 0.5), ("u", 5, "b:::topo", 0.5), ("u", 9, "c:::topo", None)])
    out = {r.ts.second: r for r in J.instants_by_depth(rows).collect()}
    assert (out[0].state, out[0].ambiguous, out[0].resolved_by_depth) == ("b:::topo", False, True)
    assert (out[5].state, out[5].ambiguous) == (None, True)
    assert (out[9].state, out[9].ambiguous) == ("c:::topo", False)


def test_debounce_takes_the_last_instant_and_chains(spark):
    rows = events(spark, [("u", s, "a:::topo", 0) for s in (0, 20, 40, 100)])
    out = J.debounced(J.instants(rows), 30).orderBy("step").collect()
    assert [((r.ts - START).seconds, r.n_instants) for r in out] == [(40, 3), (100, 1)]


def test_transitions_are_censored_by_the_end_and_by_barriers(spark):
    rows = [("u", 0, "a:::topo", 0), ("u", 100, "b:::topo", 0), ("u", 200, "a:::topo", 0), ("u", 200, "b:::topo", 0), ("u", 300, "c:::topo", 0)]
    out = J.transitions(J.debounced(J.instants_by_depth(events(spark, rows)), 30), "2024-01-01 00:10:00").orderBy("step").collect()
    assert [r.censoring for r in out] == ["exata", "direita", "origem_ambigua", "direita"]
    assert [r.dur_min for r in out] == [100.0, 100.0, 100.0, 300.0]
    assert [r.dest for r in out] == ["b:::topo", None, None, None]


def test_memory_survives_technical_steps_and_service_channels(spark):
    rows = [("A", 0, "boleto:::topo", 0), ("A", 100, "login:::topo", 0), ("A", 200, "atendimento:::chat", 0), ("A", 300, "login:::sucesso", 0), ("A", 400, "pix:::topo", 0), ("A", 500, "login:::topo", 0)]
    out = steps_of(spark, rows).orderBy("step").collect()
    assert [r.memory for r in out] == ["boleto"] * 4 + ["pix"] * 2
    assert [r.context for r in out] == ["__BASE__", "boleto", "__BASE__", "boleto", "__BASE__", "pix"]


def test_memory_ends_at_a_barrier(spark):
    rows = [("C", 0, "pix:::topo", 0), ("C", 100, "pix:::topo", 1), ("C", 100, "boleto:::topo", 1), ("C", 200, "login:::topo", 0)]
    out = steps_of(spark, rows).orderBy("step").collect()
    assert [r.context for r in out] == ["__BASE__", None, "__SEM_MEMORIA__"]


def test_memory_of_a_prefix_does_not_change(spark):
    rows = [("A", 100 * i, s, 0) for i, s in enumerate(["pix:::topo", "login:::topo", "boleto:::topo", "login:::topo", "login:::sucesso"])]
    whole = {r.step: r.context for r in steps_of(spark, rows).collect()}
    for n in range(1, len(rows)):
        assert all(whole[r.step] == r.context for r in steps_of(spark, rows[:n]).collect())


def test_weights_add_up_to_one_an_origin(spark):
    rows = [("A", 100 * i, s, 0) for i, s in enumerate(["login:::topo", "pix:::topo", "login:::topo", "pix:::sucesso"])]
    out = J.with_weights(steps_of(spark, rows).withColumn("holdout", F.lit(False))).collect()
    assert sorted(r.entity_weight for r in out if r.state == "login:::topo") == [0.5, 0.5]
    held = J.with_weights(steps_of(spark, rows).withColumn("holdout", F.lit(True))).collect()
    assert {r.entity_weight for r in held} == {None}


def test_first_target_labels(spark):
    hit = [("u1", 100 * i, s, 0) for i, s in enumerate(["login:::topo", "home:::topo", "pix:::topo", "home:::topo"])]
    missed = [("u4", 100 * i, s, 0) for i, s in enumerate(["login:::topo", "home:::topo", "login:::topo", "home:::topo"])]
    out = {(r.entity, r.step): r for r in J.first_target_labels(steps_of(spark, hit + missed, technical=("login", "home")), ["pix"], 2).collect()}
    assert (out["u1", 1].label_status, out["u1", 1].change) == (J.HIT, 2)
    assert (out["u1", 2].label_status, out["u1", 2].change) == (J.HIT, 1)
    assert out["u1", 3].label_status == J.CENSORED
    assert out["u4", 1].label_status == J.MISSED
    assert out["u4", 4].label_status == J.CENSORED


def test_silence_starts_at_the_timeout(spark):
    blocks = J.sessions(J.instants(events(spark, [("u", 0, "a:::topo", 0), ("u", 60, "a:::topo", 0), ("u", 5000, "b:::topo", 0)])), 1800)
    out = J.with_silence(blocks, 1800, "2024-01-01 02:00:00").orderBy("step").collect()
    assert [(r.state, (r.ts - START).total_seconds(), (r.end_ts - START).total_seconds()) for r in out] == [("a:::topo", 0, 1860), ("sem_acao", 1860, 5000), ("b:::topo", 5000, 6800), ("sem_acao", 6800, 7200)]


def test_empty_events(spark):
    assert steps_of(spark, []).count() == 0
    assert J.first_target_labels(steps_of(spark, []), ["pix"], 2).count() == 0


def test_gates(spark):
    rows = events(spark, [("", 0, "a:::topo", 0), ("u", 1, None, float("nan")), ("u", 2, "sem_acao", 0)])
    found = B.event_problems(rows).first()
    assert (found.no_entity, found.no_state, found.synthetic_state, found.odd_depth) == (1, 1, 1, 1)
    lists = spark.createDataFrame([("u", 1, "a", 0.5), ("u", 2, "b", 0.6), ("v", 1, "a", 0.5), ("v", 3, "b", 0.1), ("w", 1, "a", 0.5)], "entity string, rank int, action string, score double")
    assert {r.entity for r in B.odd_rankings(lists).collect()} == {"u", "v"}
    masses = spark.createDataFrame([(0.5, 0.5), (0.5, 0.4), (None, 1.0)], "a double, b double")
    assert B.open_masses(masses, ["a", "b"]).count() == 2
