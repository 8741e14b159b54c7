"""The log laid out for sessions: in buckets of users, each sorted by user and time.

Sessions are cut user by user, so a log that already lies by user needs no shuffle for them: neither
for the aggregate into cells nor for the window over a user's cells nor for anything grouped by user
behind it. It pays for a log that is read more than once; the layout costs one shuffle of the plays.
A user's plays lie in one bucket, so a user with a large share of the log makes one large bucket; such a log is
better read as it is, where the plays of a cell combine before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(plays: DataFrame, name: str, path: str, buckets: int) -> None:
    """Register `plays` as table `name`, its files below `path`, one to a bucket."""
    laid = plays.repartition(buckets, "user_id").write.mode("overwrite").format("parquet")
    laid.bucketBy(buckets, "user_id").sortBy("user_id", "timestamp").option("path", path).saveAsTable(name)


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
