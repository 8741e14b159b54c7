"""Sessions and rankings on edge rows, skewed logs and random ones."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from sittings.operators import ranking
from sittings.operators.sessions import COPIES_PER_CHUNK, session_table, sessionize
from sittings.sources.plays import clean_plays, read_plays_parquet

T0 = datetime(2024, 1, 1)
SCHEMA = (
    "event_id bigint, user_id string, timestamp timestamp, artist_name string, track_name string"
)


def log(spark, plays):
    """plays: (user, seconds from T0[, song])."""
    rows = [
        (i, p[0], T0 + timedelta(seconds=p[1]), "a", p[2] if len(p) > 2 else "t")
        for i, p in enumerate(plays)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def floored(ts: datetime) -> int:
    return int((ts - T0 + timedelta(days=1000)).total_seconds() // 1)


def by_hand(rows, gap=1200):
    """(event_id -> prev, gap, flag, number), walking each user's plays in order."""
    per_user = defaultdict(list)
    for event_id, user, ts, *_ in rows:
        per_user[user].append((ts, event_id))
    out = {}
    for user, plays in per_user.items():
        number, prev = 0, None
        for ts, event_id in sorted(plays):
            between = None if prev is None else floored(ts) - floored(prev)
            opens = int(between is None or between > gap)
            number += opens
            out[event_id] = (prev, between, opens, number)
            prev = ts
    return out


def marks(df):
    return {
        r.event_id: (r.prev_ts, r.gap, r.new_session, r.session_num) for r in df.collect()
    }


@pytest.mark.parametrize(
    ("seconds", "numbers"),
    [
        ([0], [1]),
        ([0, 1200], [1, 1]),
        ([0, 1201], [1, 2]),
        ([2401, 3601.9], [1, 1]),
        ([2401, 3602], [1, 2]),
        ([5, 5, 5], [1, 1, 1]),
        ([0, 1000, 2000, 3201, 3202], [1, 1, 1, 2, 2]),
        ([-5000, -3800, -2599], [1, 1, 2]),
    ],
)
def test_gap_edges(spark, seconds, numbers):
    plays = log(spark, [("u", s) for s in seconds])
    got = marks(sessionize(plays, tie_break="event_id"))
    assert got == by_hand(plays.collect())
    assert [got[i][3] for i in range(len(seconds))] == numbers


def random_log(spark, seed, n=600):
    rng = random.Random(seed)
    users = ["hot"] * n + [f"u{i}" for i in range(5)] * (n // 5)
    plays = []
    for user in users:
        second = rng.choice([rng.randrange(0, 200_000), rng.randrange(0, 40) * 1200])
        plays.append((user, second + rng.choice([0, 0, 0.5]), f"t{rng.randrange(8)}"))
    # One instant holds a third of all rows.
    plays += [("hot", 77_777, f"t{i % 3}") for i in range(n)]
    rng.shuffle(plays)
    return log(spark, plays)


@pytest.mark.parametrize("gap", [1, 1200, 21600])
def test_hot_instants_match_walk(spark, gap):
    plays = random_log(spark, gap, 300)
    want = by_hand(plays.collect(), gap)
    assert marks(sessionize(plays, gap, "event_id")) == want
    without_id = sessionize(plays.drop("event_id"), gap).collect()
    got = Counter((r.user_id, r.timestamp, r.prev_ts, r.gap, r.new_session) for r in without_id)
    rows = {r.event_id: r for r in plays.collect()}
    assert got == Counter(
        (rows[i].user_id, rows[i].timestamp, prev, gap_, flag)
        for i, (prev, gap_, flag, _) in want.items()
    )


@pytest.mark.parametrize("gap", [0, 1, 600, 1200, 21600])
def test_random_log_matches_walk(spark, gap):
    plays = random_log(spark, gap)
    rows = plays.collect()
    want = by_hand(rows, gap)
    assert marks(sessionize(plays, gap, "event_id")) == want

    sizes, starts = Counter(), {}
    for r in rows:
        key = (r.user_id, want[r.event_id][3])
        sizes[key] += 1
        starts[key] = min(starts.get(key, r.timestamp), r.timestamp)
    table = session_table(plays, gap).collect()
    assert {(r.user_id, r.session_num): r.track_count for r in table} == sizes
    assert {(r.user_id, r.session_num): r.start_ts for r in table} == starts
    assert sum(r.track_count for r in table) == len(rows)

    per_user = Counter(user for user, _ in sizes)
    counts = ranking.user_session_counts(plays, gap).collect()
    assert {r.user_id: r.session_count for r in counts} == per_user

    top = sorted(sizes, key=lambda k: (-sizes[k], k))[:4]
    songs = Counter(
        r.track_name for r in rows if (r.user_id, want[r.event_id][3]) in set(top)
    )
    ranked = sorted(songs.items(), key=lambda s: (-s[1], s[0]))[:3]
    got = ranking.top_songs(plays, gap, sessions=4, songs=3).orderBy("rank").collect()
    assert [(r.track_name, r.play_count) for r in got] == ranked
    assert [r["rank"] for r in got] == list(range(1, len(ranked) + 1))


def test_larger_gap_never_splits_more(spark):
    plays = random_log(spark, 9)
    counts = [session_table(plays, gap).count() for gap in (60, 600, 1200, 7200)]
    assert counts == sorted(counts, reverse=True)


def test_without_row_id_copies_are_kept(spark):
    rows = [("u", 0, "a")] * 3 + [("u", 0, "b")] * 2 + [("u", 1201, "a")] * 2
    plays = log(spark, rows).drop("event_id")
    got = sessionize(plays)
    assert got.count() == len(rows)
    assert got.filter("new_session = 1").count() == 2
    gaps = Counter(r.gap for r in got.collect())
    assert gaps == {None: 1, 0: 5, 1201: 1}
    assert Counter(r.session_num for r in got.collect()) == {1: 5, 2: 2}


def null_first(value):
    return (value is not None, value if value is not None else 0)


def test_order_of_ties(spark):
    """NULL before values, then the other columns; equal rows and both zeros are kept."""
    rng = random.Random(11)
    rows = [
        ("u", T0 + timedelta(seconds=rng.choice([0, 600, 5000])), rng.choice([None, 1, 2]),
         rng.choice([0.0, -0.0, 1.5, None]), rng.choice(["a", "b", None]))
        for _ in range(200)
    ]
    schema = "user_id string, timestamp timestamp, tie int, x double, y string"
    got = sessionize(spark.createDataFrame(rows, schema), tie_break="tie").collect()
    want, prev, number = Counter(), None, 0
    in_order = sorted(rows, key=lambda r: [str(null_first(x)) for x in (*r[1:], str(r[3]))])
    for r in in_order:
        opens = int(prev is None or floored(r[1]) - floored(prev) > 1200)
        number += opens
        want[(*map(str, r), str(prev), opens, number)] += 1
        prev = r[1]
    assert want == Counter(
        (*map(str, (r.user_id, r.timestamp, r.tie, r.x, r.y)), str(r.prev_ts), r.new_session, r.session_num)
        for r in got
    )


def test_more_copies_than_a_chunk(spark):
    n = 2 * COPIES_PER_CHUNK + 7
    plays = spark.range(n).selectExpr(
        "'u' AS user_id", "timestamp'2024-01-01' AS timestamp", "'a' AS artist_name",
        "'t' AS track_name",
    )
    got = sessionize(plays).selectExpr("count(*) n", "sum(new_session) s", "sum(gap) g").first()
    assert (got.n, got.s, got.g) == (n, 1, 0)


def test_dropped_plays_are_spanned(spark):
    rows = [
        (0, "u", T0, "a", "t"),
        (1, "u", T0 + timedelta(seconds=1000), None, "t"),
        (2, "u", T0 + timedelta(seconds=1500), "a", "t"),
        (3, None, T0, "a", "t"),
        (4, "u", None, "a", "t"),
        (5, "u", T0, "a", None),
    ]
    got = marks(sessionize(clean_plays(spark.createDataFrame(rows, SCHEMA)), tie_break="event_id"))
    assert got == {0: (None, None, 1, 1), 2: (T0, 1500, 1, 2)}


def test_hot_instant_is_split_by_adaptive_execution(spark):
    """A user's instant with a third of the rows does not end in one join task."""
    plays = spark.range(300_000).selectExpr(
        "id AS event_id",
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE string(id % 500) END AS user_id",
        "timestamp_seconds(CASE WHEN id % 3 = 0 THEN 0 ELSE pmod(xxhash64(id), 900000) END)"
        " AS timestamp",
        "'a' AS artist_name",
        "'t' AS track_name",
    )
    settings = {
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = sessionize(plays, tie_break="event_id")
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_no_hot_cells_cost_no_extra_scan(spark, tmp_path):
    random_log(spark, 3).write.parquet(str(tmp_path / "log"))
    df = sessionize(spark.read.parquet(str(tmp_path / "log")), tie_break="event_id")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 2


def test_user_filter_reaches_the_scan(spark, tmp_path):
    random_log(spark, 3).write.parquet(str(tmp_path / "log"))
    log = read_plays_parquet(spark, str(tmp_path / "log"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    df = session_table(log).filter("user_id = 'u1'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(user_id,u1)" in plan and "IsNotNull(track_name)" in plan
    assert "event_id" not in plan


def test_windows_see_cells_not_plays(spark):
    plan = session_table(random_log(spark, 3))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan[plan.rindex("HashAggregate") :]
    assert plan.count("Exchange hashpartitioning") == 2
