"""Session tables that grow by logs, against cutting all plays at once."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from sittings.operators.incremental import SessionStore
from sittings.operators.sessions import session_table

T0 = datetime(2024, 1, 1)
SCHEMA = "user_id string, timestamp timestamp, artist_name string, track_name string"
COLUMNS = ["user_id", "session_num", "track_count", "start_ts", "end_ts"]


def log(spark, plays):
    rows = [(user, T0 + timedelta(seconds=s), "a", "t") for user, s in plays]
    return spark.createDataFrame(rows, SCHEMA)


def rows(table):
    return sorted(tuple(r) for r in table.select(COLUMNS).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_logs_in_any_order(spark, tmp_path, seed):
    """Random plays dealt at random: every later log joins and renumbers older sessions."""
    rng = random.Random(seed)
    plays = [(f"u{rng.randrange(9)}", rng.choice([rng.randrange(90_000), 300 * rng.randrange(60)])) for _ in range(500)]
    logs = [[], [], [], []]
    for play in plays:
        logs[rng.randrange(4)].append(play)
    store = SessionStore(str(tmp_path / "store"), parts=4)
    seen = []
    for n, some in enumerate(logs):
        assert store.add(log(spark, some), f"day {n}")
        seen += some
        assert rows(store.sessions(spark)) == rows(session_table(log(spark, seen)))
    again = store.rewritten(spark, str(tmp_path / "again"))
    assert rows(again.sessions(spark)) == rows(session_table(log(spark, seen)))
    assert again.labels(spark) == [f"day {n}" for n in range(4)]
    more = [("u1", 10), ("new", 5)]
    assert again.add(log(spark, more), "day 4") and not again.add(log(spark, more), "day 2")
    assert rows(again.sessions(spark)) == rows(session_table(log(spark, seen + more)))


@pytest.mark.parametrize("gap", [1, 1200, 7200])
def test_a_late_play_joins_two_sessions(spark, tmp_path, gap):
    store = SessionStore(str(tmp_path / "store"), gap, parts=2)
    first = [("a", 0), ("a", 2 * gap), ("a", 9 * gap), ("b", 7)]
    store.add(log(spark, first), "first")
    assert [r[1] for r in rows(store.sessions(spark))] == [1, 2, 3, 1]
    late = [("a", gap)]
    store.add(log(spark, late), "late")
    assert rows(store.sessions(spark)) == rows(session_table(log(spark, first + late), gap))
    assert [(r[0], r[1], r[2]) for r in rows(store.sessions(spark))] == [("a", 1, 3), ("a", 2, 1), ("b", 1, 1)]


def test_only_what_can_change_is_written_again(spark, tmp_path):
    store = SessionStore(str(tmp_path / "store"), parts=8)
    store.add(log(spark, [(f"u{i}", 10_000 * d) for i in range(20) for d in range(30)]), "month")
    store.add(log(spark, [("u3", 290_100), ("u4", 400_000)]), "day")
    written = spark.read.parquet(str(tmp_path / "store" / "sessions" / "batch=1"))
    # The last session of each of the two users, and the new one of one of them.
    assert sorted((r.user_id, r.session_num, r.replaces) for r in written.collect()) == [
        ("u3", 30, 30), ("u4", 30, 30), ("u4", 31, 30),
    ]


def test_old_cells_are_read_by_the_parts_of_the_users_touched(spark, tmp_path, capsys):
    store = SessionStore(str(tmp_path / "store"), parts=8)
    store.add(log(spark, [(f"u{i}", 10_000 * d) for i in range(40) for d in range(3)]), "month")
    new = store._write(
        spark.createDataFrame([(3, "u9", 7, 1, T0, T0)], "part int, user_id string, cell long, plays long, "
                              "first_ts timestamp, last_ts timestamp"), "cells", 1)  # fmt: skip
    store._rechained(new, [0]).explain("formatted")
    plan = capsys.readouterr().out
    stored = [line for line in plan.splitlines() if line.startswith("PartitionFilters") and "batch#" in line]
    assert len(stored) >= 2 and all("part#" in line and "= 3" in line for line in stored), stored


def test_cut_short_and_repeated_and_empty(spark, tmp_path):
    store = SessionStore(str(tmp_path / "store"), parts=2)
    assert not store.add(log(spark, []), "nothing")
    with pytest.raises(ValueError):
        store.sessions(spark)
    first, second = [("a", 0), ("b", 50)], [("a", 100)]
    assert store.add(log(spark, first), "first") and not store.add(log(spark, first), "first")
    # Files of an attempt that never came to its commit.
    store._write(spark.read.parquet(f"{store.path}/cells/batch=0"), "cells", 1)
    store._write(spark.read.parquet(f"{store.path}/sessions/batch=0"), "sessions", 1)
    assert rows(store.sessions(spark)) == rows(session_table(log(spark, first)))
    assert store.add(log(spark, second), "second")
    assert rows(store.sessions(spark)) == rows(session_table(log(spark, first + second)))
    with pytest.raises(ValueError):
        SessionStore(store.path, 60, 2).sessions(spark)
