"""Queries over daily series: calendars, forecasts, evaluation."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import partial, reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sittings.functions.publish import not_negative
from sittings.operators import (
    arma,
    autoregression,
    changepoints,
    differencing,
    evaluate,
    harmonics,
    horizons,
    levinson,
    models,
    origins,
    report,
    series,
)
from sittings.operators.sessions import session_table
from sittings.plans import listening
from sittings.sources import fixtures

SMOOTHING = 0.1
CLOSED_FORM = (models.weekday_mean, models.seasonal_trend, models.seasonal_ar1)


def user_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.daily_sessions(session_table(fixtures.event_plays(spark, sf_dir)))


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.fill_calendar(user_daily(spark, sf_dir))


def segment_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.fill_calendar(fixtures.segment_daily(spark, sf_dir))


def mixed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of which two have only their last twenty days."""
    sparse = fixtures.segment_daily(spark, sf_dir)
    last = F.max("ds").over(Window.partitionBy("series_key"))
    recent = sparse.withColumn("last_ds", last).filter(
        "series_key >= 'F' OR ds > date_sub(last_ds, 20)"
    )
    return series.fill_calendar(recent.drop("last_ds"))


def tsv_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series of the log once it went through text."""
    return series.daily_sessions(session_table(listening.text_plays(spark, sf_dir)))


def tsv_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.fill_calendar(tsv_daily(spark, sf_dir))


def tsv_top_user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.fill_calendar(series.busiest_series(tsv_daily(spark, sf_dir)))


def top_user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.fill_calendar(series.busiest_series(user_daily(spark, sf_dir)))


@dataclass(frozen=True)
class Setting:
    """A daily series and how far it is forecast and tested."""

    daily: Callable[[SparkSession, str], DataFrame]
    horizon: int
    test_days: int
    initial: int
    period: int

    @property
    def test(self) -> origins.Origins:
        return origins.holdout(self.test_days)

    @property
    def folds(self) -> origins.Origins:
        return origins.rolling(self.initial, self.period, self.test_days)


SEGMENTS = Setting(segment_series, horizon=90, test_days=30, initial=180, period=30)
USERS = Setting(user_series, horizon=7, test_days=7, initial=14, period=7)
TOP_USER = Setting(top_user_series, horizon=7, test_days=7, initial=14, period=7)
TSV_TOP_USER = replace(TOP_USER, daily=tsv_top_user_series)
MIXED = replace(SEGMENTS, daily=mixed_series)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, where sums taken in another order still agree.

    Ten places first, so that a mean that ends in a half is not tipped over by its last bit.
    """
    doubles = {c: F.round(F.round(c, 10), 6) for c, t in df.dtypes if t == "double"}
    return df.withColumns(doubles)


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def bounds(setting, spark, sf_dir):
    return rounded(series.series_bounds(setting.daily(spark, sf_dir)))


def profile(setting, spark, sf_dir):
    return rounded(series.weekday_profile(setting.daily(spark, sf_dir)))


def calendar(setting, spark, sf_dir):
    return series.history_and_future(setting.daily(spark, sf_dir), setting.horizon)


def cutoffs(setting, spark, sf_dir):
    return origins.cutoffs(setting.daily(spark, sf_dir), setting.folds)


def forecast(model, setting, spark, sf_dir, **options):
    daily = setting.daily(spark, sf_dir)
    return rounded(models.with_interval(model(daily, origins.END, setting.horizon, **options)))


def tested(model, setting, which, spark, sf_dir):
    """Predictions beside actual values for the holdout or the folds."""
    daily = setting.daily(spark, sf_dir)
    return evaluate.score(model(daily, which, setting.test_days), daily).drop("sd")


def holdout(model, setting, spark, sf_dir):
    return rounded(tested(model, setting, setting.test, spark, sf_dir))


def cross_validation(model, setting, spark, sf_dir):
    return rounded(tested(model, setting, setting.folds, spark, sf_dir))


def by_horizon(model, setting, smoothing, spark, sf_dir):
    scored = tested(model, setting, setting.folds, spark, sf_dir)
    return rounded(evaluate.accuracy_by_horizon(scored, smoothing))


def names(chosen):
    return [m.__name__ for m in chosen]


def run_each(chosen, which, days, daily, *tests):
    """Several models on one series table, each scored in its partitioning by series.

    Those in closed form share one pass.
    """
    in_series = evaluate.by_series(daily)
    if set(chosen) <= set(CLOSED_FORM):
        run = models.closed_forms(daily, which, days, tuple(names(chosen)))
        return [evaluate.score_in_series(run, in_series, *tests).drop("sd")]
    return [
        evaluate.score_in_series(model(daily, which, days), in_series, *tests).drop("sd")
        for model in chosen
    ]


def holdout_accuracy(chosen, setting, daily):
    runs = run_each(chosen, setting.test, setting.test_days, daily)
    return stack([evaluate.accuracy(scored) for scored in runs])


def cv_accuracy(chosen, setting, daily):
    runs = run_each(chosen, setting.folds, setting.test_days, daily)
    return stack(
        [evaluate.headline(evaluate.accuracy_by_horizon(scored, SMOOTHING)) for scored in runs]
    )


def holdout_all(chosen, setting, spark, sf_dir):
    daily = setting.daily(spark, sf_dir)
    runs = run_each(chosen, setting.test, setting.test_days, daily)
    return rounded(evaluate.for_every_series(stack(runs), daily, names(chosen)))


def cv_all(chosen, setting, spark, sf_dir):
    daily = setting.daily(spark, sf_dir)
    metrics = cv_accuracy(chosen, setting, daily)
    return rounded(evaluate.for_every_series(metrics, daily, names(chosen)))


def ar_orders(which, setting, spark, sf_dir):
    """Which candidate won for each series and fold."""
    return rounded(autoregression.orders(setting.daily(spark, sf_dir), which))


def levinson_orders(which, setting, spark, sf_dir):
    """The order that was chosen for each series and fold."""
    return rounded(levinson.orders(setting.daily(spark, sf_dir), which))


def arma_terms(which, setting, spark, sf_dir):
    """The moving-average and autoregressive terms that were chosen for each series."""
    return rounded(arma.orders(setting.daily(spark, sf_dir), which))


def difference_orders(which, setting, spark, sf_dir):
    """How often each series is differenced, by season and by day, at each origin."""
    return rounded(differencing.orders(setting.daily(spark, sf_dir), which))


def turning_trends(which, setting, spark, sf_dir):
    """How often each series' trend was found to turn, and its slopes, at each origin."""
    return rounded(changepoints.trends(setting.daily(spark, sf_dir), which))


def full_metrics(model, setting, smoothing, spark, sf_dir):
    """All metrics of the cross-validation by days ahead."""
    daily = setting.daily(spark, sf_dir)
    scored = evaluate.score(model(daily, setting.folds, setting.test_days), daily)
    return rounded(horizons.full_metrics(scored, smoothing))


def empirical(which, model, setting, spark, sf_dir):
    """Intervals, or their coverage, from the errors of folds as long as the forecast."""
    folds = origins.rolling(setting.initial, setting.period, setting.horizon)
    return rounded(which(model, setting.daily(spark, sf_dir), folds, setting.horizon))


def tested_metrics(chosen, setting, daily):
    """Metrics of every model under both protocols, from one run of each."""
    either = replace(setting.folds, with_latest=True)
    tests = (setting.test, setting.folds)
    runs = run_each(chosen, either, setting.test_days, daily, *tests)
    # A model's errors are summed where they are; only these sums meet the other models'.
    errors = stack([evaluate.horizon_errors(scored, "protocol") for scored in runs])
    metrics = evaluate.compare_errors(errors, SMOOTHING)
    return evaluate.for_every_series(
        metrics, daily, names(chosen), [evaluate.HOLDOUT, evaluate.CROSS_VALIDATION]
    )


def comparison(chosen, setting, spark, sf_dir):
    """Every model under both protocols, against the weekday mean under the same."""
    return rounded(tested_metrics(chosen, setting, setting.daily(spark, sf_dir)))


def validation_results(setting, spark, sf_dir):
    """The published table: cross-validated trend model, held-out weekday mean."""
    chosen = [models.seasonal_trend, models.weekday_mean]
    return report.validation_table(tested_metrics(chosen, setting, setting.daily(spark, sf_dir)), *names(chosen))


def forecast_report(model, setting, spark, sf_dir):
    daily = setting.daily(spark, sf_dir)
    return report.published_forecast(
        models.with_interval(model(daily, origins.END, setting.horizon))
    )


def holdout_report(model, setting, spark, sf_dir):
    return report.published_holdout(tested(model, setting, setting.test, spark, sf_dir))


def forecast_preview(model, setting, spark, sf_dir):
    return report.preview(forecast_report(model, setting, spark, sf_dir))


def forecast_feed(model, setting, spark, sf_dir):
    """History, fitted line over all days and band."""
    daily = setting.daily(spark, sf_dir)
    line = models.with_interval(model(daily, origins.END, setting.horizon, history=True))
    return rounded(report.forecast_feed(daily, line))


def future_feed(model, setting, spark, sf_dir):
    """History and the clipped forecast only, for models without a fitted line."""
    daily = setting.daily(spark, sf_dir)
    line = models.with_interval(model(daily, origins.END, setting.horizon))
    clipped = line.withColumn("yhat", not_negative(F.col("yhat")))
    return rounded(report.forecast_feed(daily, clipped))


def cv_feed(model, setting, spark, sf_dir):
    daily = setting.daily(spark, sf_dir)
    return rounded(report.cv_feed(tested(model, setting, setting.folds, spark, sf_dir), daily))


QUERIES = {
    "daily_sessions": user_daily,
    "daily_sessions_filled": user_series,
    "top_user_daily": top_user_series,
    "order_daily_filled": segment_series,
    "series_bounds": partial(bounds, SEGMENTS),
    "series_bounds_users": partial(bounds, USERS),
    "weekday_profile": partial(profile, SEGMENTS),
    "weekday_profile_users": partial(profile, USERS),
    "forecast_calendar": partial(calendar, SEGMENTS),
    "naive_forecast": partial(forecast, models.weekday_mean, SEGMENTS),
    "naive_forecast_users": partial(forecast, models.weekday_mean, USERS),
    "naive_holdout": partial(holdout, models.weekday_mean, SEGMENTS),
    "naive_holdout_users": partial(holdout, models.weekday_mean, USERS),
    "cv_cutoffs": partial(cutoffs, SEGMENTS),
    "cv_cutoffs_users": partial(cutoffs, USERS),
    "naive_cv": partial(cross_validation, models.weekday_mean, SEGMENTS),
    "naive_cv_users": partial(cross_validation, models.weekday_mean, USERS),
    "naive_cv_by_horizon": partial(by_horizon, models.weekday_mean, SEGMENTS, 0.0),
    "naive_cv_by_horizon_smoothed": partial(
        by_horizon, models.weekday_mean, SEGMENTS, SMOOTHING
    ),
    "seasonal_trend_forecast": partial(forecast, models.seasonal_trend, SEGMENTS),
    "seasonal_trend_forecast_users": partial(forecast, models.seasonal_trend, USERS),
    "seasonal_trend_fitted": partial(forecast, models.seasonal_trend, SEGMENTS, history=True),
    "seasonal_trend_cv": partial(cross_validation, models.seasonal_trend, SEGMENTS),
    "seasonal_ar1_forecast": partial(forecast, models.seasonal_ar1, SEGMENTS),
    "seasonal_ar1_forecast_users": partial(forecast, models.seasonal_ar1, USERS),
    "seasonal_ar1_cv": partial(cross_validation, models.seasonal_ar1, SEGMENTS),
    "holdout_all_models": partial(holdout_all, CLOSED_FORM, SEGMENTS),
    "cv_all_models": partial(cv_all, CLOSED_FORM, SEGMENTS),
    "model_comparison": partial(comparison, CLOSED_FORM, SEGMENTS),
    "model_comparison_users": partial(comparison, CLOSED_FORM, USERS),
    "validation_results": partial(validation_results, SEGMENTS),
    "forecast_report": partial(forecast_report, models.seasonal_trend, SEGMENTS),
    "top_user_forecast_report": partial(forecast_report, models.seasonal_trend, TOP_USER),
    "holdout_report": partial(holdout_report, models.seasonal_ar1, SEGMENTS),
    "forecast_preview": partial(forecast_preview, models.seasonal_trend, SEGMENTS),
    "forecast_feed": partial(forecast_feed, models.seasonal_trend, SEGMENTS),
    "seasonal_ar1_feed": partial(future_feed, models.seasonal_ar1, SEGMENTS),
    "cv_feed": partial(cv_feed, models.seasonal_trend, SEGMENTS),
    "top_user_validation_results": partial(validation_results, TOP_USER),
    "top_user_model_comparison": partial(comparison, CLOSED_FORM, TOP_USER),
    "top_user_holdout_report": partial(holdout_report, models.seasonal_ar1, TOP_USER),
    "top_user_ar_forecast_report": partial(forecast_report, models.seasonal_ar1, TOP_USER),
    "top_user_forecast_feed": partial(forecast_feed, models.seasonal_trend, TOP_USER),
    "top_user_cv_feed": partial(cv_feed, models.seasonal_trend, TOP_USER),
    "ar_orders": partial(ar_orders, origins.END, SEGMENTS),
    "ar_orders_users": partial(ar_orders, origins.END, USERS),
    "ar_orders_cv": partial(ar_orders, SEGMENTS.folds, SEGMENTS),
    "ar_select_forecast": partial(forecast, autoregression.ar_select, SEGMENTS),
    "ar_select_forecast_users": partial(forecast, autoregression.ar_select, USERS),
    "ar_select_cv": partial(cross_validation, autoregression.ar_select, SEGMENTS),
    "ar_select_cv_users": partial(cross_validation, autoregression.ar_select, USERS),
    "ar_select_holdout": partial(holdout, autoregression.ar_select, SEGMENTS),
    "ar_select_holdout_users": partial(holdout, autoregression.ar_select, USERS),
    "top_user_ar_select_report": partial(forecast_report, autoregression.ar_select, TOP_USER),
    "top_user_ar_select_holdout": partial(holdout_report, autoregression.ar_select, TOP_USER),
    "ar_levinson_orders": partial(levinson_orders, origins.END, SEGMENTS),
    "ar_levinson_orders_users": partial(levinson_orders, origins.END, USERS),
    "ar_levinson_orders_cv": partial(levinson_orders, SEGMENTS.folds, SEGMENTS),
    "ar_levinson_forecast": partial(forecast, levinson.ar_levinson, SEGMENTS),
    "ar_levinson_forecast_users": partial(forecast, levinson.ar_levinson, USERS),
    "ar_levinson_cv": partial(cross_validation, levinson.ar_levinson, SEGMENTS),
    "ar_levinson_cv_users": partial(cross_validation, levinson.ar_levinson, USERS),
    "arma_orders": partial(arma_terms, origins.END, SEGMENTS),
    "arma_orders_users": partial(arma_terms, origins.END, USERS),
    "arma_forecast": partial(forecast, arma.arma, SEGMENTS),
    "arma_forecast_users": partial(forecast, arma.arma, USERS),
    "arma_holdout": partial(holdout, arma.arma, SEGMENTS),
    "arma_holdout_users": partial(holdout, arma.arma, USERS),
    "difference_orders": partial(difference_orders, origins.END, SEGMENTS),
    "difference_orders_users": partial(difference_orders, origins.END, USERS),
    "difference_orders_cv": partial(difference_orders, SEGMENTS.folds, SEGMENTS),
    "difference_orders_cv_users": partial(difference_orders, USERS.folds, USERS),
    "cv_metrics_full": partial(full_metrics, models.seasonal_trend, SEGMENTS, SMOOTHING),
    "cv_metrics_full_users": partial(full_metrics, models.weekday_mean, USERS, SMOOTHING),
    "cv_metrics_full_unsmoothed": partial(full_metrics, levinson.ar_levinson, SEGMENTS, 0.0),
    "empirical_interval_forecast": partial(
        empirical, horizons.empirical_interval, models.seasonal_trend, SEGMENTS
    ),
    "empirical_interval_forecast_users": partial(
        empirical, horizons.empirical_interval, models.weekday_mean, USERS
    ),
    "empirical_coverage": partial(empirical, horizons.empirical_coverage, models.seasonal_trend, SEGMENTS),
    "changepoint_trends": partial(turning_trends, SEGMENTS.folds, SEGMENTS),
    "changepoint_trends_users": partial(turning_trends, origins.END, USERS),
    "changepoint_forecast": partial(forecast, changepoints.changepoint, SEGMENTS),
    "changepoint_forecast_users": partial(forecast, changepoints.changepoint, USERS),
    "changepoint_fitted": partial(forecast, changepoints.changepoint, SEGMENTS, history=True),
    "changepoint_cv": partial(cross_validation, changepoints.changepoint, SEGMENTS),
    "harmonic_forecast": partial(forecast, harmonics.harmonic, SEGMENTS),
    "harmonic_forecast_users": partial(forecast, harmonics.harmonic, USERS),
    "harmonic_cv": partial(cross_validation, harmonics.harmonic, SEGMENTS),
    "holdout_mixed_lengths": partial(holdout_all, CLOSED_FORM, MIXED),
    "cv_mixed_lengths": partial(cv_all, CLOSED_FORM, MIXED),
    "validation_mixed_lengths": partial(validation_results, MIXED),
    "tsv_daily_filled": tsv_series,
    "tsv_top_user_forecast": partial(forecast_report, models.seasonal_trend, TSV_TOP_USER),
}
