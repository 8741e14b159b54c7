"""Queries that publish a result as text files and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sittings.operators import models
from sittings.operators.sessions import session_table
from sittings.plans import forecasting, listening
from sittings.runtime import scratch_path
from sittings.sources import bucketed, fixtures, plays, sinks

SEGMENTS = forecasting.SEGMENTS


def _one_file(df: DataFrame, order_by: list[str], sep: str = "\t") -> DataFrame:
    path = scratch_path(df.sparkSession, "report")
    sinks.write_report(df, path, order_by, sep)
    return sinks.read_back(df.sparkSession, path, df.schema, sep)


def _by_model(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "by-model")
    sinks.write_tsv(df, path, partition_by=["model"])
    return sinks.read_tsv(df.sparkSession, path, df.schema, partition_by=["model"])


def top_songs_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_file(listening.top_songs(spark, sf_dir), ["rank"])


def _checked_log(spark: SparkSession, sf_dir: str) -> str:
    """A damaged log, read with its rejects and written as two tables."""
    log, path = scratch_path(spark, "log-lines"), scratch_path(spark, "checked-log")
    fixtures.event_lines(spark, sf_dir).write.text(log)
    plays.write_checked(plays.read_checked_tsv(spark, log), path)
    return path


def tsv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a damaged log that are no plays, with all that is wrong with them."""
    return plays.read_checked(spark, _checked_log(spark, sf_dir))[1]


def tsv_rejects_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of the lines that are plays."""
    kept, _ = plays.read_checked(spark, _checked_log(spark, sf_dir))
    table = session_table(kept)
    instants = {c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")}
    return table.withColumns(instants)


def tsv_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines are plays, and how many are not for each set of reasons."""
    kept, rejects = plays.read_checked(spark, _checked_log(spark, sf_dir))
    reasons = rejects.select("reasons").unionAll(kept.select(F.lit("play").alias("reasons")))
    return reasons.groupBy("reasons").agg(F.count("*").alias("n_lines"))


def session_table_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session table of a log that lies by user, without a shuffle."""
    path = scratch_path(spark, "bucketed-plays")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    bucketed.write_bucketed(fixtures.event_plays(spark, sf_dir), name, path, buckets=8)
    return session_table(bucketed.read_bucketed(spark, name))


def forecast_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_model(
        forecasting.stack(
            [
                forecasting.forecast_report(model, SEGMENTS, spark, sf_dir)
                for model in (models.seasonal_trend, models.seasonal_ar1)
            ]
        )
    )


def holdout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_model(forecasting.holdout_report(models.seasonal_ar1, SEGMENTS, spark, sf_dir))


def validation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated, the baseline's missing RMSE an empty field; written in parallel."""
    results = forecasting.validation_results(SEGMENTS, spark, sf_dir)
    results = results.select("series_key", "Model", "MAE", "RMSE")
    path = scratch_path(spark, "validation")
    sinks.write_csv(results, path)
    return sinks.read_back(spark, path, results.schema, sep=",")


def text_edge_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with tabs, line ends, quotes, backslashes and padding, through both sinks."""
    text = F.concat(F.lit('  "\\t\t'), F.col("text"), F.lit("\r\\\r\n \\"))
    text = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 11 != 0, text)
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    path = scratch_path(spark, "texts")
    sinks.write_tsv(docs, f"{path}/tsv")
    sinks.write_csv(sinks.read_tsv(spark, f"{path}/tsv", docs.schema), f"{path}/csv")
    return sinks.read_back(spark, f"{path}/csv", docs.schema, sep=",")


QUERIES = {
    f.__name__: f for f in (
        tsv_rejects, tsv_rejects_kept, tsv_reject_reasons, session_table_bucketed,
        top_songs_file, forecast_files, holdout_files, validation_file, text_edge_roundtrip,
    )
}
