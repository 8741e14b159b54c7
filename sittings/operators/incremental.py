"""A session table that grows by one log after another without reading the old logs again.

A store keeps two tables, and both are only ever added to. `cells` holds the cells of every log
(`sessions.cells`): counts, first and last instants, which merge by sum, least and greatest, so
that plays of one cell may come in any number of logs, late ones too. `sessions` holds, for each log, the
sessions of the users it touched from the first one that the log could change: the last session
that begins no later than the user's first new play. Sessions before that one ended more than a
gap earlier, so they keep their numbers; those from it on are chained anew from the user's cells, and
replace what earlier logs left there.

Both are partitioned by a hash of the user. A log is added by reading the partitions it has
users in, and of these the rows of its users. A log counts once its commit is written, as the
last thing: one that was cut short leaves files which nobody reads and the next attempt
overwrites, and one that is added twice under one label is added once.

Plays without a required column are expected to be gone (`plays.clean_plays`). An empty log adds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sittings.operators.sessions import GAP_SECONDS, cells, chained

PARTS = 64
CELL = ["part", "user_id", "cell"]


@dataclass(frozen=True)
class SessionStore:
    """Sessions at `path`, cut by `gap`, in `parts` partitions of users."""

    path: str
    gap: int = GAP_SECONDS
    parts: int = PARTS

    def _commits(self, spark: SparkSession) -> list[tuple[int, str]]:
        """Batches and labels, one of each log."""
        schema = "label string, gap int, parts int, batch int"
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return []
        rows = spark.read.schema(schema).parquet(f"{self.path}/commits").collect()
        for r in rows:
            if (r.gap, r.parts) != (self.gap, self.parts):
                raise ValueError(f"{self.path} was made with a gap of {r.gap} and {r.parts} parts")
        return sorted((r.batch, r.label) for r in rows)

    def labels(self, spark: SparkSession) -> list[str]:
        """The logs added so far, in order."""
        return [label for _, label in self._commits(spark)]

    def _commit(self, spark: SparkSession, batch: int, labels: list[str]) -> None:
        rows = [(label, self.gap, self.parts) for label in labels]
        rows = spark.createDataFrame(rows, "label string, gap int, parts int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")

    def _write(self, rows: DataFrame, table: str, batch: int) -> DataFrame:
        path = f"{self.path}/{table}/batch={batch}"
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
        return rows.sparkSession.read.parquet(path)

    def _read(self, spark: SparkSession, table: str, batches: list[int]) -> DataFrame:
        whole = spark.read.parquet(f"{self.path}/{table}")
        return whole.filter(F.col("batch").isin(batches))

    def add(self, plays: DataFrame, label: str) -> bool:
        """Add a log under a label; False if a log of that label is there already or it has no plays."""
        spark = plays.sparkSession
        commits = self._commits(spark)
        if label in [known for _, known in commits]:
            return False
        batches = sorted({b for b, _ in commits})
        batch = max(batches, default=-1) + 1
        part = F.pmod(F.xxhash64("user_id"), F.lit(self.parts)).cast("int").alias("part")
        if plays.isEmpty():
            return False
        new = self._write(cells(plays, self.gap).select(part, "*"), "cells", batch)
        self._write(self._rechained(new, batches), "sessions", batch)
        self._commit(spark, batch, [label])
        return True

    def _rechained(self, new: DataFrame, batches: list[int]) -> DataFrame:
        """Sessions of the users in `new` cells, from the first that can change on (`replaces`)."""
        if not batches:
            return _sessions(chained(new, self.gap).withColumn("replaces", F.lit(1).cast("long")))
        spark = new.sparkSession
        # At most `parts` numbers, which prune what is read of the store.
        parts = [r.part for r in new.select("part").distinct().collect()]
        touched = new.groupBy("part", "user_id").agg(F.min("first_ts").alias("since"))
        known = _current(self._read(spark, "sessions", batches).filter(F.col("part").isin(parts)), touched)
        before = F.col("start_ts") <= F.col("since")
        starts = touched.join(known, ["part", "user_id"], "left").groupBy("part", "user_id")
        starts = starts.agg(
            F.coalesce(F.max(F.when(before, F.col("session_num"))), F.lit(1)).alias("replaces"),
            F.max(F.when(before, F.col("start_ts"))).alias("begin"),
        )
        old = self._read(spark, "cells", batches).filter(F.col("part").isin(parts)).drop("batch")
        later = F.col("begin").isNull() | (F.col("first_ts") >= F.col("begin"))
        old = old.join(starts, ["part", "user_id"]).filter(later).select(*new.columns)
        whole = new.unionByName(old).groupBy(*CELL).agg(
            F.sum("plays").alias("plays"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
        )
        numbered = chained(whole, self.gap).join(starts.drop("begin"), ["part", "user_id"])
        numbered = numbered.withColumn("session_num", F.col("session_num") + F.col("replaces") - 1)
        return _sessions(numbered)

    def sessions(self, spark: SparkSession) -> DataFrame:
        """The table of all logs added, as `sessions.session_table` of their plays would be."""
        batches = sorted({b for b, _ in self._commits(spark)})
        if not batches:
            raise ValueError(f"no log was added to {self.path}")
        return _current(self._read(spark, "sessions", batches)).drop("part")

    def rewritten(self, spark: SparkSession, path: str) -> SessionStore:
        """The store at another path as if all its logs had come as one; their labels stay known."""
        to = SessionStore(path, self.gap, self.parts)
        commits = self._commits(spark)
        batches = sorted({b for b, _ in commits})
        whole = self._read(spark, "cells", batches).groupBy(*CELL).agg(
            F.sum("plays").alias("plays"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
        )
        to._write(whole, "cells", 0)
        current = _current(self._read(spark, "sessions", batches))
        to._write(current.withColumn("replaces", F.lit(1).cast("long")), "sessions", 0)
        to._commit(spark, 0, [label for _, label in commits])
        return to


def _sessions(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("part", "user_id", "session_num").agg(
        F.sum("plays").alias("track_count"),
        F.min("first_ts").alias("start_ts"),
        F.max("last_ts").alias("end_ts"),
        F.first("replaces").alias("replaces"),
    )


def _current(written: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Of all sessions written, those that no later log replaced."""
    if users is not None:
        written = written.join(users.select("part", "user_id"), ["part", "user_id"], "left_semi")
    later = Window.partitionBy("part", "user_id").orderBy("batch").rangeBetween(1, Window.unboundedFollowing)
    replaced = F.min("replaces").over(later)
    kept = written.withColumn("replaced", replaced).filter("replaced IS NULL OR session_num < replaced")
    return kept.select("part", "user_id", "session_num", "track_count", "start_ts", "end_ts")
