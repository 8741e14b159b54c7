"""Daily series: one (series_key, ds, y) row per day, for every key at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sittings.functions.clock import weekday


def daily_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions per user and day, a session counting on the day it starts."""
    return (
        sessions.select(F.col("user_id").alias("series_key"), F.to_date("start_ts").alias("ds"))
        .groupBy("series_key", "ds")
        .agg(F.count("*").alias("y"))
    )


def fill_calendar(daily: DataFrame) -> DataFrame:
    """Add the missing days between a series' first and last day, with y = 0.

    Each day stretches to the eve of the next one present, so no calendar table,
    join or second shuffle is needed.
    """
    along = Window.partitionBy("series_key").orderBy("ds")
    eve = F.date_sub(F.lead("ds").over(along), 1)
    stretched = daily.select("series_key", "ds", "y", F.coalesce(eve, F.col("ds")).alias("upto"))
    return stretched.select(
        "series_key",
        F.col("ds").alias("seen"),
        "y",
        F.explode(F.sequence("ds", "upto")).alias("ds"),
    ).select(
        "series_key",
        "ds",
        F.when(F.col("ds") == F.col("seen"), F.col("y")).otherwise(0).cast("bigint").alias("y"),
    )


def busiest_series(daily: DataFrame) -> DataFrame:
    """The series with the largest total, ties by key, as (series_key, ds, y).

    Every series is packed into one row (at most one entry per calendar day), so
    the winner and its days come out of a single pass.
    """
    packed = daily.groupBy("series_key").agg(
        F.sum("y").alias("total"), F.collect_list(F.struct("ds", "y")).alias("days")
    )
    return (
        packed.orderBy(F.desc("total"), "series_key")
        .limit(1)
        .select("series_key", F.inline("days"))
    )


def series_bounds(daily: DataFrame) -> DataFrame:
    return daily.groupBy("series_key").agg(
        F.min("ds").alias("first_ds"),
        F.max("ds").alias("last_ds"),
        F.count("*").alias("days"),
        F.sum("y").alias("total"),
        F.avg("y").alias("mean_y"),
    )


def weekday_profile(daily: DataFrame) -> DataFrame:
    return daily.groupBy("series_key", weekday(F.col("ds")).alias("dow")).agg(
        F.count("*").alias("days"), F.avg("y").alias("mean_y")
    )


def future_days(daily: DataFrame, horizon: int) -> DataFrame:
    """The `horizon` days after each series' last one."""
    last = daily.groupBy("series_key").agg(F.max("ds").alias("last_ds"))
    days = F.sequence(F.date_add("last_ds", 1), F.date_add("last_ds", horizon))
    return last.select("series_key", F.explode(days).alias("ds"))


def history_and_future(daily: DataFrame, horizon: int) -> DataFrame:
    history = daily.select("series_key", "ds", F.lit(False).alias("is_future"))
    return history.unionByName(
        future_days(daily, horizon).withColumn("is_future", F.lit(True))
    )
