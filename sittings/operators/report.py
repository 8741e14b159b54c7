"""Published forms of forecasts and evaluations, and the data behind the plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sittings.functions.clock import day_text
from sittings.functions.publish import not_negative, round_forecast, round_metric
from sittings.operators.evaluate import CROSS_VALIDATION, HOLDOUT
from sittings.operators.series import series_bounds


def published_forecast(forecast: DataFrame) -> DataFrame:
    """Days after the cutoff, clipped at 0 (but for the upper bound), one decimal."""
    return forecast.filter(F.col("ds") > F.col("cutoff")).select(
        "series_key",
        "model",
        day_text(F.col("ds")).alias("date"),
        round_forecast(not_negative(F.col("yhat"))).alias("predicted_sessions"),
        round_forecast(not_negative(F.col("yhat_lower"))).alias("lower_bound"),
        round_forecast(F.col("yhat_upper")).alias("upper_bound"),
    )


def published_holdout(scored: DataFrame) -> DataFrame:
    """date, actual, predicted; predictions are rounded but not clipped."""
    return scored.select(
        "series_key",
        "model",
        day_text(F.col("ds")).alias("date"),
        F.col("y").alias("actual"),
        round_forecast(F.col("yhat")).alias("predicted"),
    )


def validation_table(metrics: DataFrame, model: str, baseline: str) -> DataFrame:
    """Model, MAE, RMSE as published: a cross-validated model and a held-out baseline, whose RMSE stays empty.

    `metrics` are those of both protocols. `gain_over_holdout_pct` sets the one against the other by
    the rounded MAEs: the two come from different tests.
    """
    crossed = (F.col("model") == model) & (F.col("protocol") == CROSS_VALIDATION)
    held = (F.col("model") == baseline) & (F.col("protocol") == HOLDOUT)
    mae = round_metric(F.col("mae"))
    base = F.max(F.when(held, mae)).over(Window.partitionBy("series_key"))
    gain = F.when(crossed & (F.col("base") > 0), (F.col("base") - mae) / F.col("base") * 100)
    return metrics.withColumn("base", base).filter(crossed | held).select(
        "series_key",
        F.col("model").alias("Model"),
        mae.alias("MAE"),
        F.when(crossed, round_metric(F.col("rmse"))).alias("RMSE"),
        F.round(gain, 6).alias("gain_over_holdout_pct"),
    )


def forecast_feed(daily: DataFrame, fitted: DataFrame) -> DataFrame:
    """Points, line, band and start marker of a forecast plot, told apart by `segment`.

    The marker rides on the last history day, so it costs no pass of its own.
    """
    empty = F.lit(None).cast("double")
    last = F.max("ds").over(Window.partitionBy("series_key"))
    history = (
        daily.withColumn("last_ds", last)
        .withColumn(
            "segment",
            F.explode(
                F.when(
                    F.col("ds") == F.col("last_ds"),
                    F.array(F.lit("history"), F.lit("forecast_start")),
                ).otherwise(F.array(F.lit("history")))
            ),
        )
        .select(
            "series_key",
            "segment",
            "ds",
            F.when(F.col("segment") == "history", F.col("y").cast("double")).alias("value"),
            empty.alias("lower"),
            empty.alias("upper"),
        )
    )
    line = fitted.select(
        "series_key",
        F.lit("forecast").alias("segment"),
        "ds",
        F.col("yhat").alias("value"),
        F.col("yhat_lower").alias("lower"),
        F.col("yhat_upper").alias("upper"),
    )
    return history.unionByName(line)


def cv_feed(scored: DataFrame, daily: DataFrame) -> DataFrame:
    """Actual, predicted and overall mean per cross-validated day."""
    means = series_bounds(daily).select("series_key", F.col("mean_y").alias("overall_mean"))
    return scored.join(means, "series_key").select(
        "series_key", "model", "cutoff", "ds", F.col("y").alias("actual"), "yhat", "overall_mean"
    )


def preview(published: DataFrame, n: int = 10) -> DataFrame:
    """The first n days of each published forecast."""
    order = Window.partitionBy("series_key", "model").orderBy("date")
    return (
        published.withColumn("row", F.row_number().over(order))
        .filter(F.col("row") <= n)
        .drop("row")
    )
