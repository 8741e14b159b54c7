"""The plays log: schema, TSV and parquet scans, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sittings.functions.clock import parse_timestamp

PLAYS_SCHEMA = StructType(
    [
        StructField(name, StringType(), True)
        for name in ("user_id", "timestamp", "artist_id", "artist_name", "track_id", "track_name")
    ]
)

# A play without one of these is dropped; the two id columns may be NULL.
REQUIRED = ["user_id", "timestamp", "artist_name", "track_name"]


def read_raw_tsv(spark: SparkSession, path: str, quote: str = "") -> DataFrame:
    """Headerless tab-separated log, every column text.

    `quote=""` takes quotes literally. Pass `'"'` for the usual CSV quoting, which
    strips the quotes of a track named "Heroes" and lets an unclosed one swallow
    the tabs after it.
    """
    return (
        spark.read.schema(PLAYS_SCHEMA)
        .option("sep", "\t")
        .option("header", "false")
        .option("quote", quote)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def read_plays_tsv(spark: SparkSession, path: str, quote: str = "") -> DataFrame:
    return clean_plays(with_parsed_timestamp(read_raw_tsv(spark, path, quote)))


def read_plays_parquet(spark: SparkSession, path: str) -> DataFrame:
    return clean_plays(spark.read.parquet(path))


def with_parsed_timestamp(raw: DataFrame) -> DataFrame:
    return raw.withColumn("timestamp", parse_timestamp(F.col("timestamp")))


def clean_plays(plays: DataFrame) -> DataFrame:
    """Drop plays that lack a required column. Done before any session is cut.

    Spelt as one condition per column, which reaches the scan; `dropna` would not.
    """
    return plays.filter(" AND ".join(f"{name} IS NOT NULL" for name in REQUIRED))


def read_checked_tsv(spark: SparkSession, path: str, quote: str = "") -> DataFrame:
    """Every line of the log, with its columns as in PLAYS_SCHEMA, and why it is no play.

    `reasons` is NULL for a play, else all that is wrong, joined by "; "; `line` is the line as it stands.
    Plays are those of `read_plays_tsv`: fields beyond the last column are ignored, empty lines are none.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    fields = ", ".join(f"{f.name} string" for f in PLAYS_SCHEMA)
    options = {"sep": "\t", "quote": quote, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    parsed = F.from_csv("line", f"{fields}, broken string", options)
    rows = lines.select("line", parsed.alias("fields")).select("line", "fields.*")
    # The log's reader skips these, and the column parser would make a row of them.
    blank = F.col("line").rlike(r"^[\x00-\x20]*$")
    rows = rows.withColumns(
        {
            "written": F.col("timestamp"),
            "timestamp": F.when(~blank, parse_timestamp(F.col("timestamp"))),
        }
    )
    missing = [F.when(F.col(c).isNull(), f"no {c}") for c in REQUIRED if c != "timestamp"]
    when = F.when(F.col("written").isNull(), "no timestamp").when(
        F.col("timestamp").isNull(), "unreadable timestamp"
    )
    found = F.concat_ws("; ", when, *missing)
    count = F.when(F.col("broken").isNotNull(), "wrong number of fields")
    reasons = F.when(blank, "empty line").when(found != "", F.concat_ws("; ", count, found))
    kept = [F.when(~blank, F.col(f.name)).alias(f.name) for f in PLAYS_SCHEMA]
    return rows.select(*kept, reasons.alias("reasons"), "line")


def write_checked(checked: DataFrame, path: str) -> None:
    """Plays and rejected lines as two tables below `path`, in one scan of the log."""
    rejected = F.col("reasons").isNotNull().alias("rejected")
    checked.select("*", rejected).write.mode("overwrite").partitionBy("rejected").parquet(path)


def read_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The plays, and the rejected lines with their reasons, of `write_checked`."""
    columns = [f"{f.name} {'timestamp' if f.name == 'timestamp' else 'string'}" for f in PLAYS_SCHEMA]
    both = spark.read.schema(", ".join([*columns, "reasons string", "line string", "rejected boolean"])).parquet(path)
    plays = both.filter("NOT rejected").drop("reasons", "line", "rejected")
    return plays, both.filter("rejected").select("line", "reasons")
