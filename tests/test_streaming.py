"""Sessions of streams against cutting all plays at once."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from sittings.operators.sessions import session_table
from sittings.streaming.sessions import SessionStream, numbered

T0 = datetime(2024, 1, 1)
SCHEMA = "user_id string, timestamp timestamp, track_name string"


def log(spark, plays):
    rows = [(user, None if s is None else T0 + timedelta(seconds=s), "t") for user, s in plays]
    return spark.createDataFrame(rows, SCHEMA)


def stream(spark, tmp_path, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    return SessionStream(str(tmp_path / "in"), str(tmp_path / "out"), schema, **options)


def arrive(spark, plays, to):
    log(spark, plays).coalesce(1).write.mode("append").parquet(to.source)
    return to.run(spark)


def rows(table):
    return sorted(tuple(r) for r in table.collect())


def whole(spark, plays, gap=1200):
    table = session_table(log(spark, [p for p in plays if None not in p]), gap)
    return rows(table.select("user_id", "session_num", "track_count", "start_ts", "end_ts"))


@pytest.mark.parametrize("gap", [5, 1200])
def test_random_logs_in_time_order(spark, tmp_path, gap):
    """Gaps of exactly the limit and a second over it, with fractions of seconds on both ends."""
    rng = random.Random(gap)
    plays = []
    for user in "abc":
        at = 0.0
        for _ in range(60):
            at += rng.choice([0, 1, gap, gap + 1, gap / 2]) + rng.choice([0, 0.25, 0.999])
            plays.append((user, at))
    plays.sort(key=lambda p: p[1])
    s = stream(spark, tmp_path, gap=gap, delay=1)
    for part in range(3):
        arrive(spark, [*plays[part * 60 : part * 60 + 60], (None, 1), ("a", None)], s)
    s.close(spark)
    assert rows(numbered(s.sessions(spark))) == whole(spark, plays, gap)


def test_late_plays(spark, tmp_path):
    """A play behind the watermark is dropped and counted; one before that links two sessions."""
    s = stream(spark, tmp_path, delay=4000)
    arrive(spark, [("a", 0), ("a", 2400), ("b", 9000)], s)  # the watermark is at 5000
    in_time = [("c", 7000)]
    arrive(spark, in_time, s)
    progress = arrive(spark, [("b", 9500), ("a", 100), ("b", 5200), ("b", 8000)], s)
    dropped = sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])
    s.close(spark)
    assert dropped == 1
    kept = [("a", 0), ("a", 2400), ("b", 9000), ("c", 7000), ("b", 9500), ("b", 5200), ("b", 8000)]
    assert rows(numbered(s.sessions(spark))) == whole(spark, kept)


def test_open_sessions_wait_and_runs_take_up_where_they_were(spark, tmp_path):
    s = stream(spark, tmp_path, delay=0)
    arrive(spark, [("a", 0), ("a", 10), ("b", 5000)], s)
    assert [(r.user_id, r.track_count) for r in s.sessions(spark).collect()] == [("a", 2)]
    assert s.run(spark) == [] or s.sessions(spark).count() == 1
    arrive(spark, [("b", 5100)], s)
    s.close(spark)
    assert sorted((r.user_id, r.track_count) for r in s.sessions(spark).collect()) == [("a", 2), ("b", 2)]


def test_nothing_arrived(spark, tmp_path):
    s = stream(spark, tmp_path)
    log(spark, []).write.parquet(s.source)
    assert s.close(spark) == []
