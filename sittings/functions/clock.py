"""Time expressions shared by the operators. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(text: Column) -> Column:
    """Text to TIMESTAMP; unparseable text becomes NULL instead of an ANSI error."""
    return text.try_cast("timestamp")


def gap_seconds(later: Column, earlier: Column) -> Column:
    """Whole seconds between two instants, each floored to its second first."""
    return F.unix_timestamp(later) - F.unix_timestamp(earlier)


def cell_start(ts: Column, width: int) -> Column:
    """Second at which the fixed-width time cell holding `ts` begins."""
    second = F.unix_timestamp(ts)
    return second - F.pmod(second, F.lit(width))


def weekday(ds: Column) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(ds)


def day_text(ds: Column) -> Column:
    return F.date_format(ds, "yyyy-MM-dd")
