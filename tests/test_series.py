"""Daily series, origins, models and their evaluation."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from sittings.operators import autoregression, evaluate, levinson, models, origins, report, series
from sittings.operators.sessions import session_table

D0 = date(2023, 1, 2)  # a Monday
CLOSED = [models.weekday_mean, models.seasonal_trend, models.seasonal_ar1]
ALL = [*CLOSED, autoregression.ar_select, levinson.ar_levinson]


def daily(spark, **values):
    rows = [
        (key, D0 + timedelta(days=i), int(y))
        for key, ys in values.items()
        for i, y in enumerate(ys)
    ]
    return spark.createDataFrame(rows, "series_key string, ds date, y bigint")


def by_day(df):
    return {(r.series_key, r.ds): r.y for r in df.collect()}


def test_session_counts_on_its_first_day(spark):
    at = datetime(2023, 1, 2, 23, 50)
    rows = [("u", at + timedelta(minutes=m)) for m in (0, 15, 30, 45, 90)]
    plays = spark.createDataFrame(rows, "user_id string, timestamp timestamp_ntz")
    got = by_day(series.daily_sessions(session_table(plays)))
    assert got == {("u", D0): 1, ("u", D0 + timedelta(days=1)): 1}


def test_calendar_fill(spark):
    rows = [("a", D0, 3), ("a", D0 + timedelta(days=4), 2), ("one", D0, 7)]
    sparse = spark.createDataFrame(rows, "series_key string, ds date, y bigint")
    dense = by_day(series.fill_calendar(sparse))
    assert dense == {
        **{("a", D0 + timedelta(days=i)): y for i, y in enumerate([3, 0, 0, 0, 2])},
        ("one", D0): 7,
    }


def test_busiest_series_breaks_ties_by_key(spark):
    df = daily(spark, b=[1, 2], a=[3], c=[1, 1])
    assert by_day(series.busiest_series(df)) == {("a", D0): 3}


def test_future_days(spark):
    got = series.future_days(daily(spark, a=[1, 1]), 3).orderBy("ds").collect()
    assert [r.ds for r in got] == [D0 + timedelta(days=i) for i in (2, 3, 4)]


@pytest.mark.parametrize(
    ("days", "count"), [(209, 0), (210, 0), (211, 1), (240, 1), (241, 2), (301, 4), (5, 0)]
)
def test_rolling_cutoffs(spark, days, count):
    df = daily(spark, a=[1] * days)
    got = sorted(r.cutoff for r in origins.cutoffs(df, origins.rolling(180, 30, 30)).collect())
    last = D0 + timedelta(days=days - 1)
    assert got == [last - timedelta(days=30 + 30 * k) for k in reversed(range(count))]
    assert all(c >= D0 + timedelta(days=180) for c in got)


WEEKLY = [1, 2, 3, 4, 5, 6, 7]


@pytest.mark.parametrize("model", ALL, ids=lambda m: m.__name__)
def test_weekly_series_is_forecast(spark, model):
    df = daily(spark, a=WEEKLY * 20)
    got = model(df, origins.END, 14).orderBy("ds").collect()
    assert [r.ds for r in got] == [D0 + timedelta(days=140 + i) for i in range(14)]
    tolerance = {"seasonal_trend": 0.5, "fourier_trend": 0.5}.get(model.__name__, 1e-6)
    assert np.allclose([r.yhat for r in got], WEEKLY * 2, atol=tolerance)


@pytest.mark.parametrize("model", ALL, ids=lambda m: m.__name__)
def test_folds_learn_only_from_the_past(spark, model):
    """A fold's forecast does not change when the days after its cutoff do."""
    rng = random.Random(3)
    past = [rng.randrange(9) for _ in range(60)]
    folds = origins.rolling(40, 10, 20)
    one, two = (
        {
            (r.cutoff, r.ds): r.yhat
            for r in model(daily(spark, a=past + tail), folds, 20).collect()
            if r.cutoff < D0 + timedelta(days=60)
        }
        for tail in ([1] * 40, [50, 0] * 20)
    )
    assert one.keys() == two.keys() and len({c for c, _ in one}) == 2
    assert all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)


@pytest.mark.parametrize("model", ALL, ids=lambda m: m.__name__)
def test_fold_equals_forecast_of_the_cut_series(spark, model):
    rng = random.Random(4)
    ys = [rng.randrange(9) + i % 7 for i in range(90)]
    folds = origins.rolling(50, 10, 10)
    cut = model(daily(spark, a=ys[:61]), origins.END, 10).collect()
    want = {r.ds: (r.yhat, r.sd) for r in cut}
    fold = [
        r
        for r in model(daily(spark, a=ys[:71]), folds, 10).collect()
        if r.cutoff == D0 + timedelta(days=60)
    ]
    assert {r.ds for r in fold} == set(want)
    for r in fold:
        assert (r.yhat, r.sd) == pytest.approx(want[r.ds], abs=1e-6)


@pytest.mark.parametrize("model", ALL, ids=lambda m: m.__name__)
def test_short_series(spark, model):
    df = daily(spark, one=[4], few=[1, 2, 3, 4, 5])
    forecast = model(df, origins.END, 7)
    assert forecast.count() == 14
    assert model(df, origins.holdout(30), 30).count() == 0
    assert model(df, origins.rolling(180, 30, 30), 30).count() == 0


def test_unseen_weekday_is_null_and_ignored(spark):
    df = daily(spark, a=[1, 2, 3, 4, 5, 6, 7, 8])
    scored = evaluate.score(models.weekday_mean(df, origins.holdout(5), 5), df)
    got = {r.ds: r.yhat for r in scored.collect()}
    assert got[D0 + timedelta(days=3)] is None
    assert got[D0 + timedelta(days=7)] == 1
    assert evaluate.accuracy(scored).first().mae == 7


def test_trend_and_season_are_recovered(spark):
    t = np.arange(900)
    truth = (20 + 0.05 * np.arange(960)) * np.tile([0.7, 0.9, 1, 1.1, 1.3, 1, 1], 140)[:960]
    noise = np.random.default_rng(1).normal(0, 1, 900)
    df = daily(spark, a=np.round(truth[t] + noise))
    for yearly in (False, True):
        got = models.seasonal_trend(df, origins.END, 60, yearly=yearly).orderBy("ds").collect()
        error = np.abs(np.array([r.yhat for r in got]) - truth[900:])
        assert error.mean() < 1.5, yearly
        assert got[0].sd == pytest.approx(1.04, abs=0.2)


def test_a_day_more_makes_no_other_model(spark):
    """A yearly wave of just under and just over two years is forecast alike."""
    wave = np.round(1000 + 400 * np.sin(2 * np.pi * np.arange(1100) / 365.25))
    df = daily(spark, short=wave[:729], long=wave[:731])
    got = models.seasonal_trend(df, origins.END, 90)
    by = {r.series_key: r for r in got.groupBy("series_key").agg({"sd": "max", "yhat": "avg"}).collect()}
    assert by["short"]["max(sd)"] == pytest.approx(by["long"]["max(sd)"], rel=0.02)
    assert by["short"]["avg(yhat)"] == pytest.approx(by["long"]["avg(yhat)"], rel=0.02)


@pytest.mark.parametrize("model", [models.weekday_mean, models.seasonal_ar1, models.seasonal_trend])
def test_level_does_not_change_the_fit(spark, model):
    rng = np.random.default_rng(3)
    x = np.zeros(400)
    for i in range(1, len(x)):
        x[i] = 0.8 * x[i - 1] + rng.normal(0, 20)
    x = np.round(x)
    levels = {"a": 1e3, "b": 1e9, "c": 1e12}
    df = daily(spark, **{k: x + v for k, v in levels.items()})
    got = model(df, origins.END, 3).collect()
    rows = {(r.series_key, r.ds): (r.yhat - levels[r.series_key], r.sd) for r in got}
    # The trend's indices are ratios to the level, so only the others shift with it exactly.
    close = 2.0 if model is models.seasonal_trend else 0.05
    for (key, ds), found in rows.items():
        if model is models.seasonal_trend and key == "a":
            continue
        want = rows["b" if model is models.seasonal_trend else "a", ds]
        assert found == pytest.approx(want, abs=close), key


def test_autoregression_is_recovered(spark):
    rng = np.random.default_rng(2)
    x = np.zeros(3000)
    for i in range(1, len(x)):
        x[i] = 0.7 * x[i - 1] + rng.normal(0, 30)
    df = daily(spark, a=np.round(1000 + x))
    ar = models.seasonal_ar1(df, origins.END, 2).orderBy("ds").collect()
    last = round(1000 + x[-1])
    assert (ar[0].yhat - 1000) / (last - 1000) == pytest.approx(0.7, abs=0.15)
    assert ar[0].sd == pytest.approx(30, rel=0.05)


def test_interval_and_publication(spark):
    df = daily(spark, a=[0, 3, 0, 1, 0, 0, 2] * 6)
    raw = models.with_interval(models.seasonal_ar1(df, origins.END, 30))
    assert raw.filter("NOT (yhat_lower <= yhat AND yhat <= yhat_upper)").isEmpty()
    shown = report.published_forecast(raw)
    assert shown.columns == [
        "series_key", "model", "date", "predicted_sessions", "lower_bound", "upper_bound",
    ]
    assert shown.count() == 30
    assert shown.filter("predicted_sessions < 0 OR lower_bound < 0").isEmpty()
    assert shown.filter("predicted_sessions <> bround(predicted_sessions, 1)").isEmpty()
    assert report.preview(shown, 10).count() == 10


def test_upper_bound_is_not_clipped(spark):
    df = spark.sql(
        "SELECT 'a' AS series_key, 'm' AS model, date'2023-01-01' AS cutoff,"
        " date'2023-01-02' AS ds, -3D AS yhat, -5D AS yhat_lower, -1.25D AS yhat_upper"
    )
    row = report.published_forecast(df).first()
    assert (row.predicted_sessions, row.lower_bound, row.upper_bound) == (0.0, 0.0, -1.2)


def trailing_means(errors, folds, horizon, share):
    """Smoothing spelt out on rows: the last w of them up to each horizon."""
    w = max(1, int(share * horizon * folds + 1e-9))
    out = {}
    for h in range(1, horizon + 1):
        left, total = w, 0.0
        for back in range(h, 0, -1):
            take = min(left, folds)
            total += take * np.mean(errors[back])
            left -= take
            if not left:
                out[h] = total / w
                break
    return out


@pytest.mark.parametrize(
    ("folds", "horizon", "share"),
    [(3, 10, 0.1), (4, 10, 0.25), (5, 7, 0.1), (3, 7, 0.5), (2, 5, 1.0), (3, 4, 0.0)],
)
def test_smoothing(spark, folds, horizon, share):
    rng = random.Random(7)
    rows, absolute, squared = [], {}, {}
    for f in range(folds):
        cutoff = D0 + timedelta(days=f * horizon)
        for h in range(1, horizon + 1):
            y, yhat = rng.randrange(9), rng.random() * 9
            rows.append(("a", "m", cutoff, cutoff + timedelta(days=h), yhat, y))
            absolute.setdefault(h, []).append(abs(y - yhat))
            squared.setdefault(h, []).append((y - yhat) ** 2)
    scored = spark.createDataFrame(
        rows, "series_key string, model string, cutoff date, ds date, yhat double, y bigint"
    )
    got = evaluate.accuracy_by_horizon(scored, share).collect()
    mae = trailing_means(absolute, folds, horizon, share)
    mse = trailing_means(squared, folds, horizon, share)
    assert {r.horizon: r.mae for r in got} == pytest.approx(mae)
    assert {r.horizon: r.rmse**2 for r in got} == pytest.approx(mse)
    top = evaluate.headline(evaluate.accuracy_by_horizon(scored, share)).first()
    assert top.mae == pytest.approx(np.mean(list(mae.values())))


def test_smoothing_goes_by_rows(spark):
    """A horizon without predictions in some folds has fewer rows than the others."""
    rng = random.Random(8)
    by_horizon, rows = {}, []
    for f in range(6):
        cutoff = D0 + timedelta(days=20 * f)
        for h in range(1, 11):
            y, yhat = rng.randrange(9), None if rng.random() < 0.3 else rng.random() * 9
            rows.append(("a", "m", cutoff, cutoff + timedelta(days=h), yhat, y))
            if yhat is not None:
                by_horizon.setdefault(h, []).append(abs(y - yhat))
    scored = spark.createDataFrame(
        rows, "series_key string, model string, cutoff date, ds date, yhat double, y bigint"
    )
    wanted = int(0.3 * sum(map(len, by_horizon.values())) + 1e-9)
    want, behind = {}, []
    for h in range(1, 11):
        behind.append(by_horizon.get(h, []))
        if sum(map(len, behind)) >= wanted:
            left, total = wanted, 0.0
            for errors in reversed(behind):
                take = min(left, len(errors))
                total += take * np.mean(errors) if take else 0
                left -= take
            want[h] = total / wanted
    got = evaluate.accuracy_by_horizon(scored, 0.3).collect()
    assert {r.horizon: r.mae for r in got} == pytest.approx(want)


def test_improvement_sign(spark):
    rows = [
        ("a", model, "holdout", D0, D0 + timedelta(days=1), yhat, 10)
        for model, yhat in (("weekday_mean", 6.0), ("better", 9.0), ("worse", 2.0))
    ]
    scored = spark.createDataFrame(
        rows,
        "series_key string, model string, protocol string, cutoff date, ds date, yhat double,"
        " y bigint",
    )
    got = {r.model: r.improvement_pct for r in evaluate.compare(scored).collect()}
    assert got == {"weekday_mean": 0, "better": 75, "worse": -100}


def test_too_short_series_has_null_metrics(spark):
    df = daily(spark, short=[1] * 5, long=[1, 2] * 30)
    test, folds = origins.holdout(10), origins.rolling(20, 10, 10)
    scored = evaluate.score(models.weekday_mean(df, folds, 10), df).join(
        evaluate.protocols(df, test, folds), ["series_key", "cutoff"]
    )
    got = evaluate.for_every_series(
        evaluate.compare(scored), df, ["weekday_mean"], [evaluate.HOLDOUT, evaluate.CROSS_VALIDATION]
    ).collect()
    assert len(got) == 4
    assert {r.series_key for r in got if r.mae is None} == {"short"}


def test_protocols(spark):
    df = daily(spark, mid=[1] * 35, long=[1] * 45, short=[1] * 5)
    got = evaluate.protocols(df, origins.holdout(10), origins.rolling(30, 10, 10)).collect()
    latest = D0 + timedelta(days=34)
    assert sorted((r.series_key, r.cutoff, r.protocol) for r in got) == [
        ("long", latest, "cross_validation"),
        ("long", latest, "holdout"),
        ("mid", D0 + timedelta(days=24), "holdout"),
    ]


def test_order_is_recovered(spark):
    """Series made by each kind of candidate are told apart, and forecast by it."""
    rng = np.random.default_rng(12)
    n = 600
    noise = rng.normal(0, 20, (4, n))
    flat, one, seven, walk = np.zeros((4, n))
    for i in range(n):
        flat[i] = noise[0, i]
        one[i] = 0.7 * one[i - 1] + noise[1, i] if i else 0
        seven[i] = 0.6 * seven[i - 7] + noise[2, i] if i > 6 else 0
        walk[i] = walk[i - 7] + noise[3, i] if i > 6 else 100 * i
    df = daily(spark, **{k: np.round(1000 + v) for k, v in dict(a=flat, b=one, c=seven, d=walk).items()})
    got = {r.series_key: r for r in autoregression.orders(df, origins.END).collect()}
    assert (got["a"].differenced, got["b"].differenced, got["d"].differenced) == (False, False, True)
    assert got["b"].lag1 and got["b"].phi1 == pytest.approx(0.7, abs=0.1)
    assert got["c"].lag7 and got["c"].phi7 == pytest.approx(0.6, abs=0.1)
    ahead = autoregression.ar_select(df, origins.END, 14).collect()
    last_week = {r.series_key: [] for r in ahead}
    for r in sorted(ahead, key=lambda r: r.ds):
        last_week[r.series_key].append(r)
    assert [r.yhat for r in last_week["d"][:7]] == pytest.approx(list(np.round(1000 + walk[-7:])), rel=0.02)
    assert last_week["b"][0].sd == pytest.approx(20, rel=0.1)
    assert last_week["d"][13].sd == pytest.approx(20 * 2**0.5, rel=0.1)


def test_orders_need_no_python_worker(spark):
    plan = autoregression.orders(daily(spark, a=[1, 2, 3] * 20), origins.END)
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_scored_rows_are_not_shuffled(spark):
    """Forecasts of all folds are scored and summed in the partitioning by series."""
    df = daily(spark, a=[1, 2, 3] * 30, b=[4, 5] * 40)
    in_series = evaluate.by_series(df)
    test, folds = origins.holdout(10), origins.rolling(20, 10, 10)
    for model in ALL:
        scored = evaluate.score_in_series(model(df, folds, 10), in_series, test, folds)
        errors = evaluate.horizon_errors(scored, "protocol")
        plan = errors._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
        assert exchanges and all("(series_key" in x for x in exchanges)
        assert not any("ds#" in x.split("ENSURE")[0] or "cutoff#" in x for x in exchanges)
        # The same rows as by joins on day and origin.
        roles = evaluate.protocols(df, test, folds)
        want = evaluate.score(model(df, folds, 10), df).join(roles, ["series_key", "cutoff"])
        columns = ["series_key", "cutoff", "ds", "protocol", "y"]
        assert sorted(scored.select(columns).collect()) == sorted(want.select(columns).collect())


def test_closed_forms_are_the_models_in_one_pass(spark):
    rng = np.random.default_rng(21)
    df = daily(spark, a=rng.poisson(20, 500), b=rng.poisson(3, 40), c=[5], d=[2] * 30)
    for which in (origins.END, origins.rolling(14, 9, 5), origins.holdout(7)):
        found = {tuple(r)[:4]: (r.yhat, r.sd) for r in models.closed_forms(df, which, 5).collect()}
        want = {}
        for model in CLOSED:
            want |= {tuple(r)[:4]: (r.yhat, r.sd) for r in model(df, which, 5).collect()}
        assert found.keys() == want.keys() and len(want) > 15
        for k, (yhat, sd) in want.items():
            near = [x if x is None else pytest.approx(x, rel=1e-9, abs=1e-6) for x in (yhat, sd)]
            assert list(found[k]) == near, k


def windows(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in x]


def test_comparison_goes_over_the_days_once(spark):
    from sittings.plans import forecasting

    df = daily(spark, a=[1, 2, 3] * 30, b=[4, 5] * 40)
    assert len(windows(models.closed_forms(df, origins.rolling(14, 7, 7), 7))) <= 8
    # The rest are those of the daily series itself.
    query = forecasting.comparison(forecasting.CLOSED_FORM, forecasting.USERS, spark, "/root/testdata/sf0.001")
    assert len(windows(query)) <= 8 + 3 * len(windows(forecasting.user_series(spark, "/root/testdata/sf0.001")))
