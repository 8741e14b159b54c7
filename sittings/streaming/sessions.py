"""Sessions of a log that arrives as files, by Structured Streaming.

Sessions are windows of a user that grow with each play. A play belongs to the session before it
if it starts at most `gap` seconds later, both floored to seconds; a session window takes
instants strictly before its end, and between floored seconds any bound from `gap` to
`gap + 1` decides alike, so the window's gap is `gap` seconds and 900 milliseconds.

A session is written once the watermark, the latest instant seen less `delay`, passes its end, so state
holds open sessions only. A play behind the watermark is dropped by Spark and counted in the query's progress
(`numRowsDroppedByWatermark`); one that is late but ahead of it joins or links sessions as if it
had come in time. What is still open when a log ends is written by `close`, which moves the watermark on by
a play of nobody, far ahead; its own window never ends.

Written sessions have no number: numbers follow from the order of all of a user's sessions,
and a session is final only as far as its own plays go. `numbered` adds them to what is written.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sittings.operators.sessions import GAP_SECONDS

DELAY_SECONDS = 3600
NOBODY = "\0 nobody"


def windows(plays: DataFrame, gap: int = GAP_SECONDS, delay: int = DELAY_SECONDS) -> DataFrame:
    """Sessions of a stream (or table) of plays: user_id (as text), track_count, start_ts, end_ts."""
    second = F.date_trunc("second", "timestamp")
    timed = plays.select(F.col("user_id").cast("string").alias("user_id"), "timestamp", second.alias("second"))
    session = F.session_window("second", f"{gap} seconds 900 milliseconds")
    return (
        timed.withWatermark("second", f"{delay} seconds")
        .groupBy("user_id", session)
        .agg(
            F.count("*").alias("track_count"),
            F.min("timestamp").alias("start_ts"),
            F.max("timestamp").alias("end_ts"),
        )
        .drop("session_window")
    )


def numbered(written: DataFrame) -> DataFrame:
    """Written sessions with session_num, as `operators.sessions.session_table` numbers them."""
    along = Window.partitionBy("user_id").orderBy("start_ts")
    number = F.row_number().over(along).cast("long")
    return written.select("user_id", number.alias("session_num"), "track_count", "start_ts", "end_ts")


@dataclass(frozen=True)
class SessionStream:
    """Parquet files of plays that land in `source`, cut into sessions below `target`.

    `schema` is that of the files, with user_id and timestamp at least; rows without either are dropped.
    """

    source: str
    target: str
    schema: StructType
    gap: int = GAP_SECONDS
    delay: int = DELAY_SECONDS

    def run(self, spark: SparkSession) -> list[dict]:
        """Take in the files that arrived since the last run, and end. Returns the progress reports.

        The checkpoint lies beside the sessions, so a run that was cut short is taken up where it was.
        """
        plays = spark.readStream.schema(self.schema).parquet(self.source)
        plays = plays.filter("user_id IS NOT NULL AND timestamp IS NOT NULL")
        query = (
            windows(plays, self.gap, self.delay)
            .writeStream.outputMode("append")
            .format("parquet")
            .option("path", f"{self.target}/sessions")
            .option("checkpointLocation", f"{self.target}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return [p if isinstance(p, dict) else p.jsonValue for p in query.recentProgress]

    def close(self, spark: SparkSession) -> list[dict]:
        """Write the sessions still open, once no more plays are to come for them."""
        latest = spark.read.schema(self.schema).parquet(self.source)
        latest = latest.filter(F.col("user_id").cast("string") != NOBODY).agg(F.max("timestamp")).first()[0]
        if latest is None:
            return []
        ahead = latest + timedelta(seconds=self.gap + self.delay + 2)
        names = [f.name for f in self.schema]
        if dict((f.name, f.dataType.typeName()) for f in self.schema)["user_id"] != "string":
            raise ValueError("user_id must be text for a play of nobody")
        row = spark.createDataFrame([(NOBODY, ahead)], "user_id string, timestamp timestamp")
        missing = {f.name: F.lit(None).cast(f.dataType) for f in self.schema if f.name not in row.columns}
        row.withColumns(missing).select(names).coalesce(1).write.mode("append").parquet(self.source)
        return self.run(spark)

    def sessions(self, spark: SparkSession) -> DataFrame:
        """What is written so far."""
        return spark.read.parquet(f"{self.target}/sessions").filter(F.col("user_id") != NOBODY)
