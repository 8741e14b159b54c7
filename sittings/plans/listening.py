"""Queries over the plays log: cleaning, sessions, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sittings.operators import ranking, sessions
from sittings.operators.incremental import SessionStore
from sittings.runtime import scratch_path
from sittings.sources import fixtures, plays, sinks
from sittings.streaming.sessions import SessionStream, numbered

LONG_GAP = 6 * 3600


def clean_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plays.clean_plays(fixtures.gappy_events(spark, sf_dir))


def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.event_text(spark, sf_dir, damaged=True)
    # Text without a zone is read in the session's zone; show the same wall time.
    parsed = plays.with_parsed_timestamp(raw).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz")
    )
    return parsed.select("event_id", "user_id", "timestamp")


def _through_text(events: DataFrame, quote: str = "") -> DataFrame:
    """A raw log written as text and read back."""
    path = scratch_path(events.sparkSession, "plays-tsv")
    sinks.write_tsv(events.select(plays.PLAYS_SCHEMA.fieldNames()), path, header=False)
    return plays.read_plays_tsv(events.sparkSession, path, quote)


def text_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_text(fixtures.event_text(spark, sf_dir))


def tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _through_text(fixtures.event_text(spark, sf_dir, damaged=True))
    return back.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def tsv_quoted_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read with the usual quoting, which strips the quotes around an artist."""
    quoted = F.concat(F.lit('"'), F.col("artist_name"), F.lit('"'))
    events = fixtures.event_text(spark, sf_dir).withColumn("artist_name", quoted)
    back = _through_text(events, quote='"')
    return back.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def tsv_top_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_songs(text_plays(spark, sf_dir))


def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessionize(fixtures.event_plays(spark, sf_dir), tie_break="event_id")


def sessionize_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessionize(fixtures.event_plays(spark, sf_dir), LONG_GAP, "event_id")


def sessionize_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessionize(fixtures.order_plays(spark, sf_dir), tie_break="event_id")


def sessionize_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without their key: ties and exact copies have no row id to go by."""
    return sessions.sessionize(fixtures.order_plays(spark, sf_dir).drop("event_id"))


def sessionize_null_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column that orders ties is NULL on some plays and alike on others."""
    tie = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 2).alias("tie")
    plays = fixtures.order_plays(spark, sf_dir)
    return sessions.sessionize(plays.select("*", tie), tie_break="tie")


def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sessions.session_table(fixtures.event_plays(spark, sf_dir))
    return table.withColumn("session_id", sessions.session_id())


def _three_logs(plays: DataFrame, late: bool = True) -> list[DataFrame]:
    """Thirds of the time the plays cover, one after the other; if `late`, all errors come last."""
    behind = F.lit(late) & (F.col("artist_name") == "error")
    span = plays.agg(F.min("timestamp").alias("low"), F.max("timestamp").alias("high")).first()
    third = (span.high - span.low) / 3
    bounds = [span.low + third, span.low + 2 * third]
    place = sum((F.col("timestamp") >= F.lit(b)).cast("int") for b in bounds)
    placed = plays.withColumn("log", F.when(behind, 2).otherwise(place))
    return [placed.filter(F.col("log") == n).drop("log") for n in range(3)]


def _stored_sessions(spark: SparkSession, sf_dir: str) -> SessionStore:
    store = SessionStore(scratch_path(spark, "session-store"))
    for n, log in enumerate(_three_logs(fixtures.event_plays(spark, sf_dir))):
        store.add(log, f"log {n}")
    return store


def sessions_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session table from three logs that were added one by one, late plays with the last."""
    return _stored_sessions(spark, sf_dir).sessions(spark)


def sessions_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table once the store's logs were brought together."""
    store = _stored_sessions(spark, sf_dir)
    return store.rewritten(spark, scratch_path(spark, "session-store")).sessions(spark)


def sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session table from a stream of three files of plays, each taken in by a run of its own."""
    source = scratch_path(spark, "stream-source")
    kept = ["user_id", "timestamp", "artist_name", "track_name"]
    log = fixtures.event_plays(spark, sf_dir).select(kept)
    users = log.schema["user_id"].dataType
    log = log.withColumns({"user_id": F.col("user_id").cast("string"), "timestamp": F.col("timestamp").cast("timestamp")})
    stream = SessionStream(source, scratch_path(spark, "stream-sessions"), log.schema, delay=60)
    for part in _three_logs(log, late=False):
        part.write.mode("append").parquet(source)
        stream.run(spark)
    stream.close(spark)
    found = numbered(stream.sessions(spark))
    instants = {c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")}
    return found.withColumn("user_id", F.col("user_id").cast(users)).withColumns(instants)


def sessions_of_gappy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped plays leave their neighbours' gap spanning them."""
    return sessions.session_table(clean_plays(spark, sf_dir), LONG_GAP)


def top_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sessions.session_table(fixtures.event_plays(spark, sf_dir))
    return ranking.top_sessions(table).select(
        sessions.session_id().alias("session_id"), "user_id", "session_num", "track_count"
    )


def top_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_songs(fixtures.event_plays(spark, sf_dir))


def top_songs_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_songs(fixtures.event_plays(spark, sf_dir), LONG_GAP)


def user_session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.user_session_counts(fixtures.event_plays(spark, sf_dir))


def top_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_user(user_session_counts(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        clean_plays,
        parse_timestamps,
        tsv_roundtrip,
        tsv_quoted_roundtrip,
        tsv_top_songs,
        sessionize,
        sessionize_6h,
        sessionize_ties,
        sessionize_copies,
        sessionize_null_ties,
        session_table,
        sessions_incremental,
        sessions_rewritten,
        sessions_stream,
        sessions_of_gappy_log,
        top_sessions,
        top_songs,
        top_songs_6h,
        user_session_counts,
        top_user,
    )
}
