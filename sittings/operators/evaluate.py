"""Scoring forecasts against what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sittings.operators.origins import Origins, bounds

RUN = ["series_key", "model"]
HOLDOUT, CROSS_VALIDATION = "holdout", "cross_validation"


def score(forecast: DataFrame, daily: DataFrame) -> DataFrame:
    """Forecast days that have an actual value, with it as `y`."""
    return forecast.join(daily, ["series_key", "ds"])


def by_series(daily: DataFrame) -> DataFrame:
    """One row per (dense) series: its bounds and its values in order."""
    days = F.array_sort(F.collect_list(F.struct("ds", "y")))
    return daily.groupBy("series_key").agg(
        F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"), days["y"].alias("ys")
    )


def score_in_series(
    forecast: DataFrame, series: DataFrame, test: Origins | None = None, folds: Origins | None = None
) -> DataFrame:
    """Like `score`, from a table by `by_series`; with origins, a row per protocol of its own.

    Forecasts of one model are partitioned by series, and so they stay: nothing is shuffled
    by day or by origin.
    """
    joined = forecast.join(series, "series_key")
    scored = joined.withColumn("y", F.expr("get(ys, datediff(ds, first_ds))")).filter("y IS NOT NULL")
    if test and folds:
        roles = [
            f"IF(array_contains({o.cutoffs()}, cutoff), '{protocol}', NULL)"
            for o, protocol in ((test, HOLDOUT), (folds, CROSS_VALIDATION))
        ]
        scored = scored.withColumn("protocol", F.expr(f"explode(array({', '.join(roles)}))"))
        scored = scored.filter("protocol IS NOT NULL")
    return scored.drop("first_ds", "last_ds", "ys")


def protocols(daily: DataFrame, test: Origins, folds: Origins) -> DataFrame:
    """(series_key, cutoff, protocol): which test each origin takes part in.

    The holdout's origin is usually the latest fold too, so models are fitted once
    per origin and their scores counted under each protocol.
    """
    roles = [
        f"transform({origins.cutoffs()}, c -> named_struct('cutoff', c, 'protocol', '{protocol}'))"
        for origins, protocol in ((test, HOLDOUT), (folds, CROSS_VALIDATION))
    ]
    return bounds(daily).selectExpr("series_key", f"inline(concat({', '.join(roles)}))")


def for_every_series(
    results: DataFrame, daily: DataFrame, models: list[str], protocols: list[str] | None = None
) -> DataFrame:
    """Add a row of NULLs where a series is too short for a model's test."""
    expected = bounds(daily).select(
        "series_key", F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    )
    if protocols:
        each = F.explode(F.array(*[F.lit(p) for p in protocols])).alias("protocol")
        expected = expected.select("*", each)
    return expected.join(results, expected.columns, "left").select(*results.columns)


def _errors() -> tuple[Column, Column]:
    error = F.col("y") - F.col("yhat")
    return F.abs(error), error * error


def accuracy(scored: DataFrame) -> DataFrame:
    """MAE and RMSE per series and model over all scored days (holdout protocol)."""
    absolute, squared = _errors()
    return scored.groupBy(*RUN).agg(
        F.avg(absolute).alias("mae"), F.sqrt(F.avg(squared)).alias("rmse")
    )


def horizon_errors(scored: DataFrame, *by: str) -> DataFrame:
    """Rows, mean absolute and mean squared error per run and days ahead."""
    absolute, squared = _errors()
    return scored.groupBy(*by, *RUN, F.datediff("ds", "cutoff").alias("horizon")).agg(
        F.count("yhat").alias("n"), F.avg(absolute).alias("abs"), F.avg(squared).alias("sq")
    )


def smooth(errors: DataFrame, rolling_window: float, *by: str) -> DataFrame:
    """Add MAE and RMSE per horizon, smoothed over a trailing share of the rows.

    With `rolling_window` w, a horizon's metrics cover the last w of all its run's
    rows up to that horizon, a horizon that fits only in part counting by that part;
    they are NULL for horizons with fewer rows behind them. A run has one entry per day ahead.
    """
    day = F.struct("horizon", "n", "abs", "sq")
    runs = errors.groupBy(*by, *RUN).agg(
        F.array_sort(F.collect_list(day)).alias("days"), F.sum("n").alias("rows")
    )
    wanted = F.greatest(F.floor(F.col("rows") * rolling_window + 1e-9), F.lit(1))

    def trailing(day: Column, at: Column) -> Column:
        """Of the rows up to a day, from the last back, as many as wanted."""

        def take(seen: Column, day: Column) -> Column:
            n = F.least(seen["left"], day["n"])
            return F.struct(
                (seen["left"] - n).alias("left"),
                (seen["abs"] + n * F.coalesce(day["abs"], F.lit(0.0))).alias("abs"),
                (seen["sq"] + n * F.coalesce(day["sq"], F.lit(0.0))).alias("sq"),
            )

        start = F.struct(
            wanted.cast("long").alias("left"), F.lit(0.0).alias("abs"), F.lit(0.0).alias("sq")
        )
        back = F.reverse(F.slice("days", F.lit(1), at + 1))
        found = F.aggregate(back, start, take)
        whole = found["left"] == 0
        return F.struct(
            *[day[c].alias(c) for c in ("horizon", "n", "abs", "sq")],
            F.when(whole, found["abs"] / wanted).alias("mae"),
            F.when(whole, F.sqrt(found["sq"] / wanted)).alias("rmse"),
        )

    return runs.select(*by, *RUN, F.inline(F.transform("days", trailing)))


def accuracy_by_horizon(scored: DataFrame, rolling_window: float = 0.0) -> DataFrame:
    """MAE and RMSE per days ahead, without the horizons that smoothing leaves out."""
    return (
        smooth(horizon_errors(scored), rolling_window)
        .filter(F.col("mae").isNotNull())
        .select(*RUN, "horizon", "n", "mae", "rmse")
    )


def headline(by_horizon: DataFrame) -> DataFrame:
    """Plain mean of the per-horizon metrics (cross-validation protocol)."""
    return by_horizon.groupBy(*RUN).agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"))


def compare(
    scored: DataFrame, rolling_window: float = 0.0, baseline: str = "weekday_mean"
) -> DataFrame:
    """`compare_errors` of scored rows that carry a `protocol`."""
    return compare_errors(horizon_errors(scored, "protocol"), rolling_window, baseline)


def compare_errors(
    errors: DataFrame, rolling_window: float = 0.0, baseline: str = "weekday_mean"
) -> DataFrame:
    """MAE and RMSE of every run, and its MAE gain over the baseline in percent.

    `errors` are those of `horizon_errors` by protocol: a holdout averages over its days, a
    cross-validation over its horizons. A negative gain means worse.
    """
    held = F.col("protocol") == HOLDOUT
    days = F.sum("n")
    metrics = (
        smooth(errors, rolling_window, "protocol")
        .groupBy("protocol", *RUN)
        .agg(
            F.when(held, F.sum(F.col("n") * F.col("abs")) / days)
            .otherwise(F.avg("mae"))
            .alias("mae"),
            F.when(held, F.sqrt(F.sum(F.col("n") * F.col("sq")) / days))
            .otherwise(F.avg("rmse"))
            .alias("rmse"),
        )
    )
    run = Window.partitionBy("protocol", "series_key")
    base = F.max(F.when(F.col("model") == baseline, F.col("mae"))).over(run)
    gain = F.when(base > 0, (base - F.col("mae")) / base * 100)
    return metrics.withColumn("improvement_pct", gain)
