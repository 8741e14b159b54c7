"""The given tables in the roles of the plays log and of long daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sittings.sources.plays import clean_plays


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as plays: the event type is the artist, the properties the track."""
    return clean_plays(
        table(spark, sf_dir, "events").select(
            "event_id",
            "user_id",
            F.col("ts").alias("timestamp"),
            F.col("event_type").alias("artist_name"),
            F.col("props").alias("track_name"),
        )
    )


def order_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as plays of their customer; many share an instant."""
    return clean_plays(
        table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("event_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("timestamp"),
            F.col("o_orderstatus").alias("artist_name"),
            F.col("o_orderpriority").alias("track_name"),
        )
    )


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with missing values: NULL for small amounts, one type and one property."""

    def unless(missing: Column, name: str) -> Column:
        return F.when(~missing, F.col(name))

    return table(spark, sf_dir, "events").select(
        "event_id",
        unless(F.col("value") < 0.5, "user_id").alias("user_id"),
        unless(F.col("value").between(0.5, 1.0), "ts").alias("timestamp"),
        unless(F.col("event_type") == "view", "props").alias("artist_id"),
        unless(F.col("event_type") == "error", "event_type").alias("artist_name"),
        F.lit(None).cast("string").alias("track_id"),
        unless(F.col("props") == '{"k": 0}', "props").alias("track_name"),
    )


def event_text(spark: SparkSession, sf_dir: str, damaged: bool = False) -> DataFrame:
    """Events as a raw text log; if damaged, the time of every error is unreadable."""
    shown = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    unreadable = F.lit(damaged) & (F.col("event_type") == "error")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("user_id"),
        F.when(unreadable, F.concat(F.lit("bad "), shown))
        .otherwise(shown)
        .alias("timestamp"),
        F.lit(None).cast("string").alias("artist_id"),
        F.col("event_type").alias("artist_name"),
        F.lit(None).cast("string").alias("track_id"),
        F.col("props").alias("track_name"),
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a raw log, many of them damaged.

    Errors have an unreadable time, small amounts no user, one property no track, and views of
    amounts up to 1 end after the third field.
    """
    value = table(spark, sf_dir, "events").select("event_id", "value", "event_type", "props")
    text = event_text(spark, sf_dir, damaged=True).join(value, "event_id")
    user = F.when(text.value < 0.5, "").otherwise(F.col("user_id"))
    track = F.when(F.col("props") == '{"k": 0}', "").otherwise(F.col("track_name"))
    short = (F.col("event_type") == "view") & text.value.between(0.5, 1.0)
    head = F.concat_ws("\t", user, "timestamp", F.lit(""))
    whole = F.concat_ws("\t", head, "artist_name", F.lit(""), track)
    return text.select(F.when(short, head).otherwise(whole).alias("value"))


def segment_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per market segment and day, without the missing days.

    Orders are counted per customer and day before the join, so a customer with a
    large share of them sends at most one row per day.
    """
    per_customer = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.to_date("o_orderdate").alias("ds"))
        .agg(F.count("*").alias("n"))
    )
    segments = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        per_customer.join(segments, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("series_key"), "ds")
        .agg(F.sum("n").alias("y"))
    )
