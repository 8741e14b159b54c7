"""Cutting each user's plays into sessions by an inactivity gap.

A session is a run of plays of one user in which each play starts at most
`gap_seconds` after the one before, both floored to whole seconds.

The plain form, a window over all plays of a user, sorts a user's whole history
in one task, so one user with a third of the log stalls the job. Here plays are
first combined into *cells*: fixed time slices no wider than `gap_seconds + 1`.
Two plays in one cell are at most `gap_seconds` apart, so a cell never straddles
a session boundary and can be reduced to its count, first and last instant with
an ordinary map-side combined aggregate. Only cells are then windowed by user,
and a user has at most one per cell width of the time the log covers (about
26,000 a year at 20 minutes), however many plays they have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sittings.functions.clock import cell_start, gap_seconds as seconds_between

GAP_SECONDS = 20 * 60
MAX_CELL_SECONDS = 3600

# Rows a task makes at a time when copies of a row are written out again.
COPIES_PER_CHUNK = 100_000

# Parts in which the plays of one instant are ordered before their firsts are compared.
PARTS = 256


def cell_width(gap: int) -> int:
    return min(gap + 1, MAX_CELL_SECONDS)


def _cell(gap: int) -> Column:
    return cell_start(F.col("timestamp"), cell_width(gap))


def cells(plays: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """One row per (user, cell): plays, first and last instant."""
    return plays.groupBy("user_id", _cell(gap).alias("cell")).agg(
        F.count("*").alias("plays"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def numbered_cells(plays: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """`cells` with session numbers."""
    return chained(cells(plays, gap), gap)


def chained(cells: DataFrame, gap: int) -> DataFrame:
    """Cells (with first_ts and last_ts) with the last instant before them and session numbers."""
    by_user = Window.partitionBy("user_id").orderBy("cell")
    since = seconds_between(F.col("first_ts"), F.col("prev_cell_ts"))
    return (
        cells.withColumn("prev_cell_ts", F.lag("last_ts").over(by_user))
        .withColumn("opens", F.when(since.isNull() | (since > gap), 1).otherwise(0))
        .withColumn(
            "session_num",
            F.sum("opens").over(by_user.rowsBetween(Window.unboundedPreceding, 0)),
        )
    )


def session_id() -> Column:
    return F.concat_ws("_", F.col("user_id").cast("string"), F.col("session_num").cast("string"))


def session_table(plays: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """One row per session: user_id, session_num, track_count, start_ts, end_ts.

    The aggregate runs in the partitioning the user window left behind. The session
    id text is made on output only: Spark cannot see that it determines the user,
    so grouping by it would shuffle again.
    """
    return (
        numbered_cells(plays, gap)
        .groupBy("user_id", "session_num")
        .agg(
            F.sum("plays").alias("track_count"),
            F.min("first_ts").alias("start_ts"),
            F.max("last_ts").alias("end_ts"),
        )
    )


def sessionize(
    plays: DataFrame, gap: int = GAP_SECONDS, tie_break: str | None = None
) -> DataFrame:
    """Every (clean) play with prev_ts, gap, new_session, session_num and session_id.

    Plays at the same instant are ordered by `tie_break`, then by their other columns, NULL
    first; exact copies are interchangeable.

    All but the first play of an instant follow it at gap 0. So the instants are marked, each
    with its predecessor in its cell or in the chain of cells, and the plays take their
    instant's marks by a join on (user, instant), between shuffles that Spark adds itself,
    which adaptive execution splits where one instant is hot. Only instants of several
    plays need an order; where there are none, adaptive execution drops that branch.
    """
    columns = plays.columns
    marks = _marked_instants(plays, gap)
    joined = plays.join(marks, ["user_id", "timestamp"])
    # An instant has no more plays than its cell. That both counts are used keeps the aggregate
    # below alike for instants and cells, so that one scan and shuffle serves them.
    at_instant = F.least("plays_at", "plays")
    single = joined.filter(at_instant == 1).select(
        *columns,
        F.col("before_ts").alias("prev_ts"),
        F.col("opens").alias("new_session"),
        "session_num",
    )
    tied = _order_ties(joined.filter(at_instant > 1), columns, tie_break)
    return single.unionByName(tied).select(
        *columns,
        "prev_ts",
        seconds_between(F.col("timestamp"), F.col("prev_ts")).alias("gap"),
        "new_session",
        "session_num",
        session_id().alias("session_id"),
    )


def _marked_instants(plays: DataFrame, gap: int) -> DataFrame:
    """Every instant's plays, its predecessor, whether it opens a session, and its number."""
    instants = (
        plays.groupBy("user_id", _cell(gap).alias("cell"), "timestamp")
        .agg(F.count("*").alias("plays_at"))
        .filter("user_id IS NOT NULL AND cell IS NOT NULL")
    )
    in_cell = Window.partitionBy("user_id", "cell").orderBy("timestamp")
    lagged = instants.withColumn("lag_ts", F.lag("timestamp").over(in_cell))
    chain = chained(
        lagged.groupBy("user_id", "cell").agg(
            F.sum("plays_at").alias("plays"),
            F.min("timestamp").alias("first_ts"),
            F.max("timestamp").alias("last_ts"),
        ),
        gap,
    ).select("user_id", "cell", "plays", "prev_cell_ts", "opens", "session_num")
    return lagged.join(chain, ["user_id", "cell"]).select(
        "user_id",
        "timestamp",
        "plays_at",
        "plays",
        F.coalesce("lag_ts", "prev_cell_ts").alias("before_ts"),
        F.when(F.col("lag_ts").isNull(), F.col("opens")).otherwise(0).alias("opens"),
        "session_num",
    )


def _order_ties(tied: DataFrame, columns: list[str], tie_break: str | None) -> DataFrame:
    """Plays of instants that hold several: the first takes the instant's marks.

    Copies travel as one row and are told apart again at the end. Fractions are compared by
    their text too, as 0.0 and -0.0 are equal to Spark but not the same.
    """
    kinds = dict(tied.select(columns).dtypes)
    inexact = [c for c in columns if kinds[c] in ("double", "float")]
    keyed = tied.withColumns({c: F.col(c).cast("string") for c in inexact})
    rows = keyed.groupBy(*tied.columns).agg(F.count("*").alias("copies"))
    rest = [c for c in columns if c not in ("user_id", "timestamp", tie_break)]
    order = []
    for c in [*([tie_break] if tie_break else []), *rest]:
        order += [F.col(c).cast(kinds[c]), F.col(c)] if c in inexact else [F.col(c)]
    # The first of each part, then the first of those; the others are spread by their part.
    part = F.pmod(F.xxhash64(*columns), F.lit(PARTS))
    in_part = Window.partitionBy("user_id", "timestamp", "part").orderBy(*order, F.lit(0))
    rows = rows.withColumn("part", part).withColumn("in_part", F.row_number().over(in_part))
    rows = rows.withColumn("part", F.when(F.col("in_part") == 1, -1).otherwise(F.col("part")))
    rows = rows.withColumn("place", F.row_number().over(in_part))
    spread = _expand_copies(rows, tied.columns)
    is_first = (F.col("part") == -1) & (F.col("place") == 1) & (F.col("copy") == 0)
    return spread.select(
        *[F.col(c).cast(kinds[c]).alias(c) if c in inexact else c for c in columns],
        F.when(is_first, F.col("before_ts")).otherwise(F.col("timestamp")).alias("prev_ts"),
        F.when(is_first, F.col("opens")).otherwise(0).alias("new_session"),
        "session_num",
    )


def _expand_copies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Undo `copies`, spreading a very large group over tasks in chunks."""
    last = F.col("copies") - 1
    start = F.col("chunk") * COPIES_PER_CHUNK
    end = F.least(last, start + (COPIES_PER_CHUNK - 1))
    chunks = F.sequence(F.lit(0), F.floor(last / COPIES_PER_CHUNK))
    return (
        rows.withColumn("chunk", F.explode(chunks))
        .repartition(*columns, "chunk")
        .withColumn("copy", F.explode(F.sequence(start, end)))
    )
