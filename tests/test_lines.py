"""Time lines in slices, exact quantiles, bootstrap arrays, disordered streams and versioned slices."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathlens.operators import evaluation as M
from pathlens.operators import relational as R
from pathlens.sources import tables as A
from pathlens.streaming import journeys as I

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def line(spark):
    """Half of all rows belong to one entity; some rows have no entity, no time or no value."""
    rng = random.Random(6)
    rows = [(i, "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None]), START + timedelta(hours=rng.randint(0, 300)), rng.choice([None, 1, 2, 3, 4]), rng.choice(["x", "y", "z", None])) for i in range(400)]
    rows += [(400, "hot", None, 1, "x"), (401, "lone", START, None, None)]
    return spark.createDataFrame(rows, "id long, e string, t timestamp, v int, s string").repartition(3).cache()


@pytest.mark.parametrize("most", [1_000_000, 30])
def test_slices_change_nothing(spark, line, monkeypatch, most):
    monkeypatch.setattr(R, "SLICE_ROWS", most)
    anchors = line.filter("t is not null and id % 3 = 0").select("id", "e", "t")
    history = line.filter("t is not null").select("e", F.col("t").alias("th"), "v", "s", F.col("id").alias("rid"))
    wanted = {"n": ("count", F.col("v")), "total": ("sum", F.col("v")), "least": ("min", F.col("v")), "most": ("max", F.col("v")), "mean": ("avg", F.col("v"))}
    rows = line.filter("t is not null").collect()
    brute = {}
    for a in rows:
        if a.id % 3 == 0:
            past = [b for b in rows if b.e == a.e and b.t < a.t]
            values = [b.v for b in past if b.v is not None]
            brute[a.id] = (len(values), sum(values) if values else None, min(values, default=None), max(values, default=None), sum(values) / len(values) if values else None, len({b.s for b in past} - {None}))
    for slices in (1, 2, 32) if most > 30 else (None,):
        got = R.history_before(anchors, history, "e", "t", "id", "th", wanted, slices).join(R.distinct_before(anchors, history, "e", "t", "id", "th", ["s"], slices), "id").collect()
        assert {r.id: (r.n, r.total, r.least, r.most, pytest.approx(r.mean) if r.mean is not None else None, r.distinct_s) for r in got if True} == {k: v for k, v in brute.items()}
    found = [sorted((r.id, r.previous_id, r.previous_v) for r in R.as_of(anchors, history, "e", "t", "id", "th", "th", "rid", ["v"], slices).collect()) for slices in (1, 5, None)]
    assert found[0] == found[1] == found[2] and len(found[0]) == anchors.count()


def test_a_hot_entity_is_spread_over_tasks(line):
    cut = R.in_slices(line.filter("t is not null"), ["e"], "t", 16)
    most, rows = cut.groupBy("_entity", "_slice").count().agg(F.max("count"), F.sum("count")).first()
    assert most < 0.1 * rows


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_hot_entities_alone_are_cut(line, monkeypatch, few):
    monkeypatch.setattr(R, "SLICE_ROWS", 80)
    monkeypatch.setattr(R, "FEW_CUTS", few)
    rows = line.filter("t is not null")
    sizes = {(r._entity.e, r._slice): r["count"] for r in R.in_slices(rows, ["e"], "t").groupBy("_entity", "_slice").count().collect()}
    assert max(sizes.values()) < 120 and sum(sizes.values()) == rows.count()
    assert {entity for entity, at in sizes if at > 0} == {"hot"}
    monkeypatch.setattr(R, "SLICE_ROWS", 1000)
    assert "_slice" not in R.in_slices(rows, ["e"], "t").columns


def test_next_event_is_the_first_at_or_after_the_start(line):
    cases = line.select("id", "e", F.col("t").alias("start"), (F.col("t") + F.expr("interval 20 hours")).alias("end"), F.lit("x").alias("name"))
    events = line.filter("v = 1").select("e", F.col("t").alias("ts"))
    rows, times = cases.collect(), [(r.e, r.ts) for r in events.collect()]
    got = {r.id: (r.outcome, r.name) for r in R.any_event_between(cases, events, "e", "start", "end", "ts").collect()}
    assert got == {c.id: (int(any(e is not None and e == c.e and t is not None and c.start is not None and c.start <= t < c.end for e, t in times)), "x") for c in rows}


def test_quantiles_equal_percentile_though_one_group_has_most_rows(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 10 else "cold", float(v), int(v)) for i, v in enumerate(rng.integers(0, 500, 3000))] + [("one", 7.5, 7), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, v double, n int").cache()
    marks = [0.0, 0.01, 0.25, 0.5, 0.777, 1.0]
    text = ", ".join(map(str, marks))
    for c in ("v", "n"):
        wanted = {r.g: r.q for r in df.groupBy("g").agg(F.expr(f"percentile({c}, array({text}))").alias("q")).collect() if r.q}
        assert {r.g: r.q for r in R.exact_quantiles(df, c, marks, ("g",)).collect()} == {g: pytest.approx(q, abs=1e-12) for g, q in wanted.items()}
    assert R.exact_quantiles(df, "v", [0.5]).first().q == pytest.approx([df.agg(F.expr("percentile(v, 0.5)")).first()[0]])
    assert R.exact_quantiles(df.limit(0), "v", [0.5]).first().q is None and R.exact_quantiles(df.limit(0), "v", [0.5], ("g",)).count() == 0


def test_bootstrap_keeps_entities_as_rows(spark):
    rng = random.Random(4)
    rows = [(f"u{i}", "even" if i % 2 else None, rng.random(), rng.random() * 0.9) for i in range(300)]
    df = spark.createDataFrame(rows, "entity string, k string, a double, b double")
    out = M.bootstrap(df, "a", "b", replicates=200)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence" not in plan
    got = out.first()
    gain = np.array([r[2] - r[3] for r in rows])
    means = []
    for r in range(1, 201):
        c3, c2, c1, c0 = M._uniform_numbers(*(f"bootstrap|{r}|{c}" for c in ("c3", "c2", "c1", "c0")))
        u = np.array([(((c3 * x + c2) % M.PRIME * x + c1) % M.PRIME * x + c0) % M.PRIME / M.PRIME for x in M._uniform_numbers(*(f"bootstrap|{row[0]}" for row in rows))])
        w = sum((u > p).astype(int) for p in M.POISSON)
        means.append((w * gain).sum() / w.sum())
    assert [got.low, got.high] == pytest.approx(np.percentile(means, [2.5, 97.5]).tolist(), rel=1e-9)
    by = {r.k: r.entities for r in M.bootstrap(df.filter("k is not null"), "a", "b", replicates=50, keys=("k",)).collect()}
    assert by == {"even": 150}


def test_arrival_order_does_not_matter_within_the_watermark(spark, tmp_path):
    """Batches in any order that the watermark admits give the state that the ordered events give."""
    rng = random.Random(1)
    names = ["pix:::topo", "login:::topo", "login:::fim", "boleto:::topo", "atendimento:::chat"]
    rows = sorted({(f"u{rng.randint(1, 5)}", START + timedelta(hours=rng.randint(0, 200)), rng.choice(names), rng.choice([0.1, 0.5])) for _ in range(150)}, key=lambda r: r[1])
    results = []
    for k, late in enumerate((0, 60, 60)):
        order = sorted(rows, key=lambda r: r[1] + timedelta(hours=rng.randint(0, late)))
        folder = str(tmp_path / f"in{k}")
        for i in range(0, len(order), 40):
            spark.createDataFrame(order[i : i + 40], "entity string, ts timestamp, state string, depth double").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("entity string, ts timestamp, state string, depth double").option("maxFilesPerTrigger", 1).parquet(folder)
        query = I.current_states(stream, ["login"]).writeStream.format("memory").queryName(f"now{k}").outputMode("update").option("checkpointLocation", str(tmp_path / f"log{k}")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        seen = {}
        for r in spark.table(f"now{k}").collect():  # later batches see more events
            if r.events >= seen.get(r.entity, r).events:
                seen[r.entity] = r
        results.append({e: (r.ts, r.state, r.memory, r.ambiguous, r.events) for e, r in seen.items()})
    assert results[0] == results[1] == results[2] and sum(r[4] for r in results[0].values()) == len(rows)


def test_a_failed_publication_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda day, n: spark.createDataFrame([(day, f"s{i}", n) for i in range(3)], "day int, state string, n int")
    assert A.publish_slice(rows(1, 10), path, {"day": 1}) == 1
    assert A.publish_slice(rows(2, 20), path, {"day": 2}) == 2
    before = sorted(map(tuple, A.read_version(spark, path).collect()))
    with pytest.raises(ValueError):
        A.publish_slice(rows(2, 20), path, {"day": 1})  # rows of another slice
    with pytest.raises(ValueError):
        A.publish_slice(rows(1, 1).limit(0), path, {"day": 1})
    with pytest.raises(ValueError):
        A.publish_slice(rows(1, 1).withColumn("more", F.lit(1)), path, {"day": 1})
    broken = rows(1, 1).withColumn("n", F.when(F.col("state") == "s2", F.raise_error(F.lit("stop"))).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        A.publish_slice(broken, path, {"day": 1})
    assert sorted(map(tuple, A.read_version(spark, path).collect())) == before
    reader = A.read_version(spark, path, 2)  # begun before the next version comes
    assert A.publish_slice(rows(1, 11), path, {"day": 1}) == 3
    assert sorted(map(tuple, reader.collect())) == before
    assert {(r.day, r.n) for r in A.read_version(spark, path).collect()} == {(1, 11), (2, 20)}
    assert {(r.day, r.n) for r in A.read_version(spark, path, 1).collect()} == {(1, 10)}
    with pytest.raises(ValueError):
        A.read_version(spark, path, 9)
