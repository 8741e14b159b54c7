"""Delimited text sinks, and their way back into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REPORT_ROWS = 1000

# What stands for the characters a line of fields cannot hold.
ESCAPES = {"\t": "\\t", "\n": "\\n", "\r": "\\r", "\0": "\\0"}
EMPTY = "\\e"

# A value no field has, so that an empty field is NULL and a quoted empty one is not.
NO_FIELD = "\0"


def _escaped(value: Column) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for character, shown in ESCAPES.items():
        out = F.replace(out, F.lit(character), F.lit(shown))
    return F.when(value == "", EMPTY).otherwise(out)


def _unescaped(value: Column) -> Column:
    def piece(text: Column) -> Column:
        for character, shown in ESCAPES.items():
            text = F.replace(text, F.lit(shown), F.lit(character))
        return text

    # Between two backslashes that stand for one there are only escapes.
    pieces = F.transform(F.split(value, r"\\\\", -1), piece)
    return F.when(value == EMPTY, "").otherwise(F.array_join(pieces, "\\"))


def write_tsv(
    df: DataFrame, path: str, header: bool = True, partition_by: list[str] | None = None
) -> None:
    """Tab-separated directory, written in parallel and without quoting.

    Values are literal but for backslashes and the characters of ESCAPES, which are escaped;
    NULL is an empty field, an empty text is EMPTY. Values with none of these read back alike
    with `read_raw_tsv`, all of them with `read_tsv`.
    """
    partition_by = partition_by or []
    fields = {
        c: _escaped(F.col(c).cast("string")) for c in df.columns if c not in partition_by
    }
    writer = df.withColumns(fields).write.mode("overwrite")
    writer = writer.option("sep", "\t").option("header", header).option("quote", "")
    writer = writer.option("nullValue", "").option("emptyValue", "")
    writer = _untrimmed(writer)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def _untrimmed(options):
    return options.option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    )


def read_tsv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    header: bool = True,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """What `write_tsv` wrote."""
    partition_by = partition_by or []
    texts = ", ".join(f"`{f.name}` string" for f in schema if f.name not in partition_by)
    parts = "".join(
        f", `{f.name}` {f.dataType.simpleString()}" for f in schema if f.name in partition_by
    )
    reader = spark.read.schema(texts + parts).option("sep", "\t").option("header", header)
    raw = _untrimmed(reader.option("quote", "").option("nullValue", "")).csv(path)
    return raw.select(
        *[
            F.col(f.name)
            if f.name in partition_by
            else _unescaped(F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Files with a header, written in parallel.

    Texts that hold a separator, quote or line end are quoted, with quotes doubled; an empty
    text is a quoted nothing, NULL an empty field.
    """
    writer = df.write.mode("overwrite").option("sep", sep).option("header", True)
    writer = writer.option("quote", '"').option("escape", '"').option("nullValue", "")
    _untrimmed(writer.option("emptyValue", '""')).csv(path)


def write_report(
    df: DataFrame,
    path: str,
    order_by: list[str | Column],
    sep: str = "\t",
    max_rows: int = REPORT_ROWS,
) -> None:
    """One ordered file like those of `write_csv`, for results of at most `max_rows`.

    Fails on an empty result and on a larger one, before anything is gathered. The shuffle to
    one partition keeps the work before it parallel, which a plain coalesce would not.
    """
    rows = df.limit(max_rows + 1).count()
    if not rows:
        raise RuntimeError(f"no rows to write to {path}")
    if rows > max_rows:
        raise ValueError(f"more than {max_rows} rows for one file: {path}")
    write_csv(df.repartition(1).sortWithinPartitions(*order_by), path, sep)


def read_back(spark: SparkSession, path: str, schema: StructType, sep: str = "\t") -> DataFrame:
    """The files of `write_csv` or `write_report` as a table again."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", True)
    reader = reader.option("quote", '"').option("escape", '"').option("multiLine", True)
    return _untrimmed(reader.option("nullValue", NO_FIELD).option("emptyValue", "")).csv(path)
