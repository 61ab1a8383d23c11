"""Histories with counts of different values: right, and worked out once."""

import random
from datetime import datetime, timedelta

from pathlens.operators import propensity as P


def test_history_with_distinct_values_is_read_once(spark):
    """Against plain loops, with nulls and equal times; the rows behind `history` are made at most twice, not for every line and count."""
    rng, start = random.Random(3), datetime(2024, 1, 1)
    day = lambda: start + timedelta(days=rng.randint(0, 12))
    records = [(rng.choice(["a", "b", None]), day(), i, rng.choice(["F", "O"])) for i in range(40)]
    history = [(*r, rng.choice([1, 2, 3, None]), rng.choice(["x", "y", None])) for r in records for _ in range(rng.randint(1, 4))]
    anchors = [(i, rng.choice(["a", "b", "c"]), day()) for i in range(25)]
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    kind = "e string, t timestamp, r long, status string, s long, p string"
    df = spark.createDataFrame(history, kind).mapInArrow(counted, kind)
    asked = spark.createDataFrame(anchors, "id long, e string, at timestamp")
    got = P.history_features(asked, df, "e", "at", "id", "t", "r", {"closed": "F"}, "status", ["s", "p"]).collect()
    assert made.value <= 2 * len(history)
    want = {}
    for i, e, at in anchors:
        own = [h for h in history if h[0] == e and h[1] < at]
        want[i] = (len({h[2] for h in own}), len({h[2] for h in own if h[3] == "F"}), len({h[4] for h in own} - {None}), len({h[5] for h in own} - {None}), (at - max(h[1] for h in own)).days if own else None)
    assert {r.id: (r.previous, r.previous_closed, r.distinct_s, r.distinct_p, r.days_since_last) for r in got} == want
    assert len(got) == len(anchors)
