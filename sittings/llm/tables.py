"""Small helpers for the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sittings.runtime import settle

BROADCAST_ROWS = 200_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered_words(text: Column) -> Column:
    """A-Z lower-cased runs of ASCII letters, digits and non-ASCII characters; NULL has none."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lower, NO_WORD), "")


def compact(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Settle a table of narrow rows; broadcast it if it is counted to have few, else leave the
    join to Spark."""
    table = settle(df, name)
    return F.broadcast(table) if table.count() <= rows else table


# Keys of eight bytes that are broadcast to keep texts out of a shuffle: at most some tens of megabytes.
BROADCAST_KEYS = 1_000_000


def _keys(marks: DataFrame) -> DataFrame | None:
    return F.broadcast(marks.select("key")) if marks.count() <= BROADCAST_KEYS else None


def marked_only(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of `texts` with a row of `marks` (settled, one a key), and its columns.

    As long as the marked keys are few, texts without any are not shuffled.
    """
    keys = _keys(marks)
    if keys is not None:
        texts = texts.join(keys, "key", "left_semi")
    return texts.join(marks, "key")


def with_marks(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """All rows of `texts`, with the columns of `marks` or NULL; shuffled like `marked_only`."""
    keys = _keys(marks)
    if keys is None:
        return texts.join(marks, "key", "left")
    none = {f.name: F.lit(None).cast(f.dataType) for f in marks.schema if f.name != "key"}
    rest = texts.join(keys, "key", "left_anti").withColumns(none)
    return texts.join(keys, "key", "left_semi").join(marks, "key").unionByName(rest)


COPIES_PER_CHUNK = 100_000


def copies(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each row `copies` times, numbered by `copy` from 0; many copies are spread over tasks."""
    last, start = F.col("copies") - 1, F.col("chunk") * COPIES_PER_CHUNK
    chunks = F.sequence(F.lit(0).cast("long"), F.floor(last / COPIES_PER_CHUNK))
    spread = rows.withColumn("chunk", F.explode(chunks)).repartition(*key, "chunk")
    copy = F.sequence(start, F.least(last, start + (COPIES_PER_CHUNK - 1)))
    return spread.withColumn("copy", F.explode(copy)).drop("chunk", "copies")
