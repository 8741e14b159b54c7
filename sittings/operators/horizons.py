"""What rolling-origin errors tell by days ahead: all metrics, and intervals made of the errors themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sittings.operators import origins
from sittings.operators.evaluate import RUN, score
from sittings.operators.models import with_interval

SHARES = (0.1, 0.9)  # an 80 % interval

# Days ahead with fewer errors than this get no interval of their own.
LEAST_ERRORS = 10

SUMS = ("mse", "mae", "mape", "smape", "coverage")


def _rows(scored: DataFrame) -> DataFrame:
    """Errors of scored forecasts with bounds, numbered by days ahead, then cutoff, within their run.

    A relative error of a day with nothing on it has no value; the symmetric one is 0 if nothing was forecast either.
    """
    error = F.abs(F.col("y") - F.col("yhat"))
    size = F.abs("y") + F.abs("yhat")
    order = Window.partitionBy(*RUN).orderBy("horizon", "cutoff")
    bounded = with_interval(scored.filter("yhat IS NOT NULL"))
    # So that a forecast of nothing is one, whatever its sums left in the last digits.
    bounded = bounded.withColumns({c: F.round(c, 9) for c in ("yhat", "yhat_lower", "yhat_upper")})
    return (
        bounded.select(
            *RUN,
            "cutoff",
            F.datediff("ds", "cutoff").alias("horizon"),
            (error * error).alias("mse"),
            error.alias("mae"),
            F.when(F.col("y") != 0, error / F.abs("y")).alias("mape"),
            F.when(size > 0, 2 * error / size).otherwise(0.0).alias("smape"),
            F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")).cast("double").alias("coverage"),
        )
        .withColumn("place", F.row_number().over(order))
    )


def full_metrics(scored: DataFrame, rolling_window: float = 0.0) -> DataFrame:
    """mse, rmse, mae, mape, mdape, smape and coverage of each run by days ahead.

    `scored` are forecasts with `sd` beside actual values. With `rolling_window` w a horizon's means cover the
    last w of its run's rows up to it, a horizon that fits only in part counting by that part; its median
    covers all its own rows, and before them, by cutoff from the last back, as many as w asks for. Horizons with fewer rows
    behind them are left out. Days with nothing on them have no relative error and are
    left out of `mape` and `mdape`, which are NULL if no others are there.
    """
    rows = _rows(scored)
    by_day = rows.groupBy(*RUN, "horizon").agg(
        F.count("*").alias("n"),
        F.max("place").alias("upto"),
        *[F.sum(c).alias(c) for c in SUMS],
        *[F.count(c).alias(f"n_{c}") for c in SUMS],
    )
    run = Window.partitionBy(*RUN)
    wanted = F.greatest(F.floor(F.max("upto").over(run) * rolling_window + 1e-9), F.lit(1))
    by_day = by_day.withColumn("wanted", wanted)
    last = by_day.filter("upto >= wanted").select(
        *RUN, F.col("horizon").alias("to"), F.col("n").alias("own"), F.col("upto").alias("end"), "wanted"
    )
    behind = last.join(by_day.drop("wanted"), RUN).filter("horizon <= to")
    # Of a horizon's rows, as many as are still wanted behind those after it.
    take = F.greatest(F.lit(0), F.least(F.col("n"), F.col("wanted") - (F.col("end") - F.col("upto"))))
    share = take / F.col("n")
    means = behind.withColumn("share", share).groupBy(*RUN, "to").agg(
        F.max("own").alias("n"),
        *[
            F.when(F.sum(F.col(f"n_{c}") * F.col("share")) > 0,
                   F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("share")) / F.sum(F.col(f"n_{c}") * F.col("share"))).alias(c)
            for c in SUMS
        ],
    )
    first = F.least(F.col("end") - F.col("own"), F.col("end") - F.col("wanted"))
    inside = last.withColumn("first", first).join(rows.select(*RUN, "place", "mape"), RUN)
    inside = inside.filter("place > first AND place <= end")
    medians = inside.groupBy(*RUN, "to").agg(F.expr("percentile(mape, 0.5)").alias("mdape"))
    return means.join(medians, [*RUN, "to"]).select(
        *RUN, F.col("to").alias("horizon"), "n", "mse", F.sqrt("mse").alias("rmse"), "mae", "mape", "mdape",
        "smape", "coverage",
    )


def _errors(model: Callable, daily: DataFrame, folds: origins.Origins, horizon: int) -> DataFrame:
    scored = score(model(daily, folds, horizon), daily).filter("yhat IS NOT NULL")
    return scored.select(*RUN, "cutoff", F.datediff("ds", "cutoff").alias("horizon"), (F.col("y") - F.col("yhat")).alias("error"))


def empirical_interval(
    model: Callable, daily: DataFrame, folds: origins.Origins, horizon: int
) -> DataFrame:
    """Forecasts from the end of each series, with bounds from what the model's folds were off by.

    A day's bounds are its forecast plus the 10 % and 90 % points of the folds' errors as many days ahead,
    by exact order statistics, which Spark combines before the shuffle. With fewer than LEAST_ERRORS errors there are none.
    """
    shares = f"array({', '.join(map(str, SHARES))})"
    points = _errors(model, daily, folds, horizon).groupBy(*RUN, "horizon").agg(
        F.count("*").alias("n_errors"), F.expr(f"percentile(error, {shares})").alias("points")
    )
    ahead = model(daily, origins.END, horizon).withColumn("horizon", F.datediff("ds", "cutoff"))
    enough = F.col("n_errors") >= LEAST_ERRORS
    bound = [F.when(enough, F.col("yhat") + F.col("points")[i]) for i in range(2)]
    return ahead.join(points, [*RUN, "horizon"], "left").select(
        *RUN, "cutoff", "ds", "yhat", bound[0].alias("yhat_lower"), bound[1].alias("yhat_upper"),
        F.coalesce("n_errors", F.lit(0)).alias("n_errors"),
    )


def empirical_coverage(
    model: Callable, daily: DataFrame, folds: origins.Origins, horizon: int
) -> DataFrame:
    """Per run: days tested, and the share of them within bounds from the errors of earlier folds alone.

    A fold's errors are known once its days have passed, so those that end by a cutoff may be used there.
    """
    errors = _errors(model, daily, folds, horizon)
    # Errors as many days ahead of cutoffs at least that many days before.
    day = F.datediff("cutoff", F.lit("1970-01-01").cast("date"))
    known = Window.partitionBy(*RUN, "horizon").orderBy("at").rangeBetween(Window.unboundedPreceding, -horizon)
    shares = f"array({', '.join(map(str, SHARES))})"
    told = errors.withColumn("at", day).select(
        "*", F.count("*").over(known).alias("n"), F.expr(f"percentile(error, {shares})").over(known).alias("points")
    )
    inside = F.col("error").between(F.col("points")[0], F.col("points")[1]).cast("double")
    return told.filter(F.col("n") >= LEAST_ERRORS).groupBy(*RUN).agg(
        F.count("*").alias("days"), F.avg(inside).alias("coverage")
    )
