"""Streams whose cost follows the input: state by bucket, batches of many files."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pathlens import scores
from pathlens.plans import journeys as S
from pathlens.streaming import journeys as I

SF = "/root/testdata/sf0.001"
EVENT = "entity string, ts timestamp, state string, depth double"


def test_state_is_held_by_bucket(spark, tmp_path):
    """300 entities in 4 keys: each has its own state, with ties, null states and null depths; entities come back in later batches."""
    start = datetime(2024, 1, 1)
    first = [(f"u{i}", start + timedelta(hours=h), s, d) for i in range(300) for h, s, d in ((0, "pix:::a", 1.0), (5, "login:::a", None), (5, "login:::b", -1.0 if i % 2 else -2.0), (90, "login:::c", 0.5))]
    later = [(f"u{i}", start + timedelta(hours=h), s, 1.0) for i in range(0, 300, 3) for h, s in ((200, None), (201, "login:::d"))]
    found = {}
    for rows in (first, later):
        spark.createDataFrame(rows, EVENT).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
        sink = lambda df, i: found.update({r.entity: (r.ts, r.state, r.memory, r.ambiguous, r.events) for r in df.collect()})
        query = I.current_states(stream, ["login"], buckets=4).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    for i in range(300):
        # a null depth counts as -1: a tie with login:::b for odd i, which ends the memory of pix
        memory = None if i % 2 else "pix"
        assert found[f"u{i}"] == ((start + timedelta(hours=201), "login:::d", None, False, 6) if i % 3 == 0 else (start + timedelta(hours=90), "login:::c", memory, False, 4))
    assert len(found) == 300


def test_batches_are_not_one_task(spark, tmp_path, monkeypatch):
    """Every batch of the disordered stream is as many files as there are tasks, and all events are in one of them."""
    raw = S.raw_events(spark, SF).repartition(4)
    monkeypatch.setattr(S, "raw_events", lambda *_: raw)
    counts = []

    class Done:
        def awaitTermination(self):
            counts.append(len(list((tmp_path / "in").glob("*.parquet"))))

    scores._batches(spark, SF, str(tmp_path), lambda stream: Done())
    assert counts == [4 * (i + 1) for i in range(len(counts))] and len(counts) >= 4
    assert spark.read.parquet(str(tmp_path / "in")).filter(F.col("ts").isNotNull()).count() == raw.count()
