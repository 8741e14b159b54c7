"""Longest sessions, the songs in them, and the most active user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sittings.functions.clock import cell_start
from sittings.operators.sessions import (
    GAP_SECONDS,
    cell_width,
    numbered_cells,
    session_table,
)

TOP_SESSIONS = 50
TOP_SONGS = 10


def top_sessions(sessions: DataFrame, n: int = TOP_SESSIONS) -> DataFrame:
    """The n sessions with the most plays; ties go by user and session number."""
    return sessions.orderBy(F.desc("track_count"), "user_id", "session_num").limit(n)


def plays_in(plays: DataFrame, chosen: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Plays that belong to one of the `chosen` sessions.

    Plays of one cell share a session and the sessions of a user never overlap, so a play
    belongs to the chosen session that covers its cell and needs no session number of its own.
    Adaptive execution broadcasts the cells if they are few.
    """
    width = cell_width(gap)
    first, last = cell_start(F.col("start_ts"), width), cell_start(F.col("end_ts"), width)
    cells = chosen.select(
        "user_id", F.explode(F.sequence(first, last, F.lit(width).cast("bigint"))).alias("cell")
    )
    return plays.withColumn("cell", cell_start(F.col("timestamp"), width)).join(
        cells, ["user_id", "cell"], "left_semi"
    ).drop("cell")


def rank_songs(plays: DataFrame, n: int = TOP_SONGS) -> DataFrame:
    """rank, artist_name, track_name, play_count of the n most played songs."""
    order = [F.desc("play_count"), "artist_name", "track_name"]
    return (
        plays.groupBy("artist_name", "track_name")
        .agg(F.count("*").alias("play_count"))
        .orderBy(*order)
        .limit(n)
        .select(
            F.row_number().over(Window.orderBy(*order)).alias("rank"),
            "artist_name",
            "track_name",
            "play_count",
        )
    )


def top_songs(
    plays: DataFrame, gap: int = GAP_SECONDS, sessions: int = TOP_SESSIONS, songs: int = TOP_SONGS
) -> DataFrame:
    chosen = top_sessions(session_table(plays, gap), sessions)
    return rank_songs(plays_in(plays, chosen, gap), songs)


def user_session_counts(plays: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Sessions per user: their numbers run 1..n, so the highest is the count."""
    return (
        numbered_cells(plays, gap)
        .groupBy("user_id")
        .agg(F.max("session_num").alias("session_count"))
    )


def top_user(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("session_count"), "user_id").limit(1)
