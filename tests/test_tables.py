"""Sinks, manifests, signatures, streams and the SQL oracles."""

import glob
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pathlens.sources import tables as A
from pathlens.streaming import journeys as I

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, "d string, v string, x long")


def test_slice_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    A.overwrite_slice(frame(spark, [("1", "a", 1)]), path, {"d": "1", "v": "a"})
    A.overwrite_slice(frame(spark, [("2", "a", 2)]), path, {"d": "2", "v": "a"})
    A.overwrite_slice(frame(spark, [("2", "a", 3)]), path, {"d": "2", "v": "a"})
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 3]
    for bad in (frame(spark, []), frame(spark, [("3", "a", 1)])):
        with pytest.raises(ValueError):
            A.overwrite_slice(bad, path, {"d": "2", "v": "a"})
    with pytest.raises(ValueError):
        A.overwrite_slice(frame(spark, [("2", "a", 1)]).withColumn("y", F.lit(1)), path, {"d": "2", "v": "a"})


def test_runs_and_manifests(spark, tmp_path):
    data, notes = str(tmp_path / "d"), str(tmp_path / "m")
    now = datetime(2024, 1, 1)
    df = spark.range(3).toDF("x")
    A.write_run(df, data, notes, "r1", "full", "m", now, now, {"a": 1})
    A.write_run(df, data, notes, "r2", "full", "m", now, datetime(2024, 1, 2), {"a": 1})
    with pytest.raises(ValueError):
        A.write_run(df, data, notes, "r1", "full", "m", now, now, {})
    manifests = spark.read.parquet(notes)
    assert manifests.filter("status = 'FALHOU'").count() == 1
    assert A.latest_run(manifests).first().run_id == "r2"
    assert A.choose_run(manifests, "m", "r1").first().run_id == "r1"
    assert A.completed_only(spark.read.parquet(data), manifests).count() == 6
    assert A.single_run(spark.read.parquet(data), "r1").count() == 3
    with pytest.raises(ValueError):
        A.single_run(spark.read.parquet(data))


def test_signature_and_package(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x long, y string")
    assert A.signature(df).first() == A.signature(df.orderBy(F.desc("x"))).first()
    assert A.signature(df).first() != A.signature(df.withColumn("x", F.col("x") + 1)).first()
    A.write_package({"t": df}, str(tmp_path), "p")
    assert A.read_package(spark, str(tmp_path), "p")["t"].count() == 2
    assert A.report_rows({"a": df, "b": spark.range(1)}).count() == 3
    assert {tuple(r) for r in A.changed_parameters(df, df.withColumn("y", F.lit("a")), ["x"]).collect()} == {(2, "changed")}


def test_streams(spark, tmp_path):
    rows = [("u", datetime(2024, 1, 1, 0, 0), "pix:::topo", 0.1), ("u", datetime(2024, 1, 1, 0, 10), "login:::topo", 0.2), ("u", datetime(2024, 1, 1, 5, 0), "login:::topo", 0.2)]
    spark.createDataFrame(rows, "entity string, ts timestamp, state string, depth double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity string, ts timestamp, state string, depth double").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.statefulOperator.allowMultiple", "true")
    query = I.current_states(stream, ["login"]).writeStream.format("memory").queryName("now").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = spark.table("now").orderBy(F.desc("ts")).first()
    assert (last.state, last.memory, last.events) == ("login:::topo", "pix", 3)


COMPARED = ["next_state_top5", "instants_by_depth", "debounced_actions", "transitions", "memory_and_weights", "first_target_labels", "frequency_baseline", "hit_metrics", "lift_with_ties", "assigned_groups", "latest_prior_order", "contract_features", "age_conditioned"]


@pytest.mark.parametrize("name", COMPARED)
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {path.rsplit('/', 1)[1][:-8]} as select * from '{path}'")
    ours, theirs = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def rows_of(df: pd.DataFrame):
    show = lambda v: "-" if pd.isna(v) else str(v) if isinstance(v, (bool, str)) else f"{float(v):.6f}"
    return sorted(tuple(show(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
