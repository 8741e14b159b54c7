"""Forecast origins, and what each of them may learn from.

An origin is the last day (`cutoff`) a model may look at. One origin at the end of
a series makes a forecast, one `n` days earlier a holdout test, and a whole row of
them a rolling-origin cross-validation, so every model is written once against
(series_key, cutoff).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Origins:
    """Cutoffs at `holdback` days before the last one, then every `step` days back.

    Without `step` there is one. With it they go back as long as `initial` days of
    history remain before the cutoff; `with_latest` keeps the latest even if fewer do.
    A series too short for any has none.

    The methods give SQL over a series' `first_ds` and `last_ds`.
    """

    holdback: int = 0
    step: int | None = None
    initial: int = 0  # only with `step`
    with_latest: bool = False

    def count(self) -> str:
        spare = f"(datediff(last_ds, first_ds) - {self.holdback + self.initial})"
        one = f"CASE WHEN datediff(last_ds, first_ds) >= {self.holdback} THEN 1 ELSE 0 END"
        if self.step is None:
            return one
        least = one if self.with_latest else "0"
        return f"greatest({least}, int(floor({spare} / {self.step})) + 1)"

    def cutoff(self, k: str = "0") -> str:
        return f"date_sub(last_ds, {self.holdback} + {self.step or 1} * {k})"

    def cutoffs(self) -> str:
        """Array of all cutoffs, newest first."""
        n = self.count()
        steps = f"CASE WHEN {n} > 0 THEN sequence(0, {n} - 1) ELSE CAST(array() AS ARRAY<INT>) END"
        return f"transform({steps}, k -> {self.cutoff('k')})"


END = Origins()


def holdout(days: int) -> Origins:
    return Origins(holdback=days)


def rolling(initial: int, period: int, horizon: int) -> Origins:
    return Origins(holdback=horizon, step=period, initial=initial)


def bounds(daily: DataFrame) -> DataFrame:
    return daily.groupBy("series_key").agg(
        F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds")
    )


def cutoffs(daily: DataFrame, origins: Origins) -> DataFrame:
    """(series_key, cutoff) for every origin."""
    return bounds(daily).selectExpr("series_key", f"explode({origins.cutoffs()}) AS cutoff")


def with_calendar(daily: DataFrame) -> DataFrame:
    """Dense series with its bounds and the fields models use: day number t, value v.

    Values are taken from the series' mean `base`, which changes no estimate but keeps sums of
    squares from cancelling where the level is large.
    """
    return daily.selectExpr(
        "series_key",
        "ds",
        "min(ds) OVER (PARTITION BY series_key) AS first_ds",
        "max(ds) OVER (PARTITION BY series_key) AS last_ds",
        "weekday(ds) AS dow",
        "month(ds) AS month",
        "avg(double(y)) OVER (PARTITION BY series_key) AS base",
        "double(y) AS y",
    ).selectExpr("*", "y - base AS v").drop("y").withColumn("t", F.expr("double(datediff(ds, first_ds))"))


def learn(days: DataFrame, origins: Origins, cell: list[str], sums: dict[str, str]) -> DataFrame:
    """For each (series, cutoff, cell), `sums` over that cell's days up to the cutoff.

    `sums` are SQL aggregates over days as `with_calendar` gives them. For rolling
    origins they are taken once as running totals along each cell; a day's totals
    then hold for exactly the cutoffs before the cell's next day. The work is linear
    in days plus output: no history is repeated per fold, and everything runs in
    the partitioning by series.
    """
    key = ["series_key", "first_ds", "last_ds", "base"]
    n, latest = origins.count(), origins.cutoff()
    if origins.step is None:
        return (
            days.where(f"{n} > 0 AND ds <= {latest}")
            .groupBy(*key, F.expr(f"{latest} AS cutoff"), *cell)
            .agg(*[F.expr(f"{agg} AS {name}") for name, agg in sums.items()])
        )
    along = f"(PARTITION BY {', '.join(['series_key', *cell])} ORDER BY ds"
    running = f"{along} ROWS UNBOUNDED PRECEDING)"

    def reached(ds: str) -> str:
        return f"int(floor(datediff({latest}, {ds}) / {origins.step}))"

    return (
        days.selectExpr(
            *key,
            *cell,
            "ds",
            f"lead(ds) OVER {along}) AS next_ds",
            *[f"{agg} OVER {running} AS {name}" for name, agg in sums.items()],
        )
        .selectExpr(
            "*",
            f"greatest(0, coalesce({reached('next_ds')} + 1, 0)) AS from_k",
            f"least({n} - 1, {reached('ds')}) AS to_k",
        )
        .where("from_k <= to_k")
        .withColumn("k", F.expr("explode(sequence(from_k, to_k))"))
        .selectExpr(*key, f"{origins.cutoff('k')} AS cutoff", *cell, *sums)
    )
