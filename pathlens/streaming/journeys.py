"""Streaming forms of the cut, the sessions and the current state.

They take the same events as the batch operators (entity, ts, state, depth) from any
streaming source.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CURRENT = "entity string, ts long, state string, memory string, ambiguous boolean, events long"
#: What is held of each entity of a bucket, and the events that wait. Times are microseconds, so that nothing depends on the session's time zone.
STATE = "entity array<string>, ts array<long>, state array<string>, memory array<string>, ambiguous array<boolean>, events array<long>, waiting_entity array<string>, waiting_ts array<long>, waiting_state array<string>, waiting_depth array<double>"
#: Keys of the streamed state; a call to Python takes some 8 ms however little its key holds, an entity of a bucket some microseconds.
BUCKETS = 4096


def with_cut(events: DataFrame, lag: str = "72 hours") -> DataFrame:
    """Events with the watermark that closes windows and drops what comes later still."""
    return events.withWatermark("ts", lag)


def sessions(events: DataFrame, timeout: str = "30 minutes", lag: str = "72 hours") -> DataFrame:
    """Sessions of an entity and state that end after so long without an event."""
    rows = with_cut(events, lag).groupBy(F.session_window("ts", timeout), "entity", "state").agg(F.count("*").alias("n_events"), F.max("depth").alias("depth"))
    return rows.select("entity", "state", F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n_events", "depth")


def current_states(events: DataFrame, technical: list[str], service: str = "atendimento", lag: str = "72 hours", buckets: int = BUCKETS) -> DataFrame:
    """Each entity's last state with its memory, updated with every batch, whatever order the events come in.

    Events wait in the state, with a timer, until the watermark has passed them, so that none
    can come before them any more; then they are applied in the order of their time. What is
    shown after each batch is that state with the waiting events applied to it, so it is what
    the events seen so far say. Events behind the watermark are dropped. Of several states at
    one time the deepest counts, a tie is ambiguous; a tie or a null state is a barrier: memory
    starts anew after it. Events without time don't count.

    Entities are dealt to `buckets` keys by a hash, and their rows are plain lists, which are
    sorted and walked once: a call to Python and pandas operations for every single entity cost
    far more than its few rows. A call holds the entities of one bucket, so `buckets` should grow
    with them once there are millions; a running query keeps the number that it was started with.
    """
    silent = {service, *technical}

    def applied(ts, last, memory, ambiguous, seen, rows, watermark):
        """What stands after the rows behind the watermark, what after all, and the rows that go on waiting."""
        rows.sort(key=itemgetter(0))
        passed = bisect_right(rows, watermark, key=itemgetter(0))
        kept = (ts, last, memory, ambiguous, seen + passed)
        for at, tied in groupby(rows, key=itemgetter(0)):
            tied = list(tied)
            depth = max(d for _, _, d in tied)
            states = {s for _, s, d in tied if d == depth}
            was, ts, ambiguous = last, at, len(states) > 1
            last = None if ambiguous else states.pop()
            memory = None if was is None or last is None else memory
            family = None if last is None else last.split(":::")[0]
            if family is not None and family not in silent:
                memory = family
            if at <= watermark:
                kept = (ts, last, memory, ambiguous, seen + passed)
        return kept, (ts, last, memory, ambiguous, seen + len(rows)), rows[passed:]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else [[]] * 10
        known = {entity: row for entity, *row in zip(*held[:6], strict=True)}
        rows, new = defaultdict(list), set()
        for entity, *row in zip(*held[6:], strict=True):
            rows[entity].append(tuple(row))
        for frame in frames:
            entities = frame["entity"].tolist()
            new.update(entities)
            for entity, row in zip(entities, zip(*(frame[c].tolist() for c in ("at", "state", "depth")), strict=True), strict=True):
                rows[entity].append(row)
        watermark = state.getCurrentWatermarkMs() * 1000
        shown, waiting = [], []
        for entity, own in rows.items():
            known[entity], now, left = applied(*known.get(entity, (None, None, None, False, 0)), own, watermark)
            waiting += ((entity, *row) for row in left)
            if entity in new:
                shown.append((entity, *now))
        columns = lambda table, n: map(list, zip(*table, strict=True)) if table else [[]] * n
        state.update((*columns([(entity, *row) for entity, row in known.items()], 6), *columns(waiting, 4)))
        if waiting:
            state.setTimeoutTimestamp(min(at for _, at, *_ in waiting) // 1000 + 1)
        if shown:
            yield pd.DataFrame(shown, columns=["entity", "ts", "state", "memory", "ambiguous", "events"])

    depth = F.nanvl(F.coalesce(F.col("depth").cast("double"), F.lit(-1.0)), F.lit(-1.0)).alias("depth")
    bucket = F.pmod(F.xxhash64("entity"), F.lit(buckets)).alias("bucket")
    rows = with_cut(events, lag).filter(F.col("ts").isNotNull()).select(bucket, "entity", "ts", F.unix_micros("ts").alias("at"), "state", depth)
    found = rows.groupBy("bucket").applyInPandasWithState(update, CURRENT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("ts", F.timestamp_micros("ts"))


def future_events(events: DataFrame, now: str) -> DataFrame:
    """Events beyond the present by day: counted, never given another date."""
    return events.filter(F.col("ts") > F.lit(now).cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("day")).count()
