"""Turning trends and smooth years, recovered and against least squares on the days themselves."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest

from sittings.operators import changepoints, harmonics, origins

D0 = date(2020, 1, 6)  # a Monday
WEEK = np.array([0, 9, 4, 12, 3, 8, 5])


def daily(spark, **values):
    rows = [(key, D0 + timedelta(days=i), float(y)) for key, ys in values.items() for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "series_key string, ds date, y double")


def forward(ys):
    """Hinges added one by one, each time by least squares on all days."""
    ys = np.asarray(ys, float)
    n, t = len(ys), np.arange(len(ys))
    dow = t % 7
    x = ys - np.array([ys[dow == d].mean() if (dow == d).any() else 0 for d in range(7)])[dow]
    places = [0, *(int(np.floor(0.8 * (n - 1) * j / 26)) for j in range(1, 26))]
    hinges = np.maximum(0, t[:, None] - np.array(places))

    def sse(chosen):
        z = np.column_stack([np.ones(n), hinges[:, chosen]])
        c = np.linalg.lstsq(z, x, rcond=None)[0]
        return float(((x - z @ c) ** 2).sum()), c[1:]

    chosen = [0]
    for _ in range(5):
        now = sse(chosen)[0]
        found = min((sse([*chosen, k])[0], k) for k in range(1, 26) if k not in chosen)
        if not n * np.log(now / found[0]) > 3 * np.log(n):
            break
        chosen.append(found[1])
    error, slopes = sse(chosen)
    return [places[k] for k in chosen], slopes, error


def test_hinges_are_those_of_least_squares(spark):
    rng = np.random.default_rng(2)
    t = np.arange(400)
    made = {
        "turn": 0.3 * t - 0.5 * np.maximum(0, t - 150) + WEEK[t % 7] + rng.normal(0, 2, 400),
        "two": 0.1 * t + 0.6 * np.maximum(0, t - 100) - 0.9 * np.maximum(0, t - 220) + rng.normal(0, 3, 400),
        "none": 0.05 * t + rng.normal(0, 2, 400),
        "short": list(rng.normal(0, 2, 40)),
    }
    got = {r.series_key: r for r in changepoints.fitted(daily(spark, **made), origins.END).collect()}
    for key, ys in made.items():
        places, slopes, error = forward(ys)
        assert [h.c for h in got[key].hinges] == places, key
        assert [h.slope for h in got[key].hinges] == pytest.approx(list(slopes), rel=1e-6, abs=1e-8)
        assert got[key].sse == pytest.approx(error)
    assert len(got["none"].hinges) == 1


def test_a_planted_change_is_found_within_a_week(spark):
    rng = np.random.default_rng(4)
    made, days = {}, np.arange(300)
    for i, at in enumerate((60, 120, 185, 221)):
        made[f"s{i}"] = 20 + 0.2 * days + (-1) ** i * 1.0 * np.maximum(0, days - at) + WEEK[days % 7] + rng.normal(0, 2, 300)
    found = {}
    for r in changepoints.changes(daily(spark, **made), origins.END).collect():
        found.setdefault(r.series_key, []).append(((r.ds - D0).days, r.change))
    for i, at in enumerate((60, 120, 185, 221)):
        nearest, change = max(found[f"s{i}"], key=lambda f: abs(f[1]))
        assert abs(nearest - at) <= 7 and change * (-1) ** i > 0
    ahead = changepoints.changepoint(daily(spark, **made), origins.END, 30).collect()
    for r in ahead:
        i, at = int(r.series_key[1]), (60, 120, 185, 221)[int(r.series_key[1])]
        t = (r.ds - D0).days
        assert r.yhat == pytest.approx(20 + 0.2 * t + (-1) ** i * (t - at) + WEEK[t % 7], abs=8)


def test_changepoint_folds_equal_fits_of_their_own(spark):
    rng = np.random.default_rng(5)
    t = np.arange(200)
    ys = 0.2 * t - 0.6 * np.maximum(0, t - 90) + rng.normal(0, 1, 200)
    for r in changepoints.fitted(daily(spark, a=ys), origins.rolling(60, 40, 10)).collect():
        alone = changepoints.fitted(daily(spark, a=ys[: (r.cutoff - D0).days + 1]), origins.END).first()
        assert [h.c for h in r.hinges] == [h.c for h in alone.hinges]
        assert r.sse == pytest.approx(alone.sse, rel=1e-6)


def test_short_and_flat_series(spark):
    df = daily(spark, one=[5.0], two=[1.0, 3.0], flat=[4.0] * 50)
    for model in (changepoints.changepoint, harmonics.harmonic):
        got = {(r.series_key, (r.ds - r.cutoff).days): r for r in model(df, origins.END, 9).collect()}
        assert len(got) == 27 and all(r.yhat is not None for r in got.values())
        assert got["one", 3].yhat == pytest.approx(5.0) and got["one", 3].sd is None
        assert got["flat", 9].yhat == pytest.approx(4.0) and got["flat", 9].sd == pytest.approx(0.0, abs=1e-6)


def test_a_clean_wave_is_recovered(spark):
    t = np.arange(3 * 365)
    turn = 2 * np.pi * (t + (D0 - date(2000, 1, 1)).days) / 365.25
    clean = 100 + 0.01 * t + WEEK[t % 7] + 15 * np.sin(turn) - 6 * np.cos(2 * turn)
    ahead = harmonics.harmonic(daily(spark, a=clean[:-200]), origins.END, 200).orderBy("ds").collect()
    assert [r.yhat for r in ahead] == pytest.approx(list(clean[-200:]), abs=1.5)
    rng = np.random.default_rng(1)
    noisy = clean + rng.normal(0, 3, len(t))
    (r,) = harmonics.harmonic(daily(spark, a=noisy), origins.END, 1).collect()
    assert r.sd == pytest.approx(3, rel=0.08)


def test_harmonics_are_ridge_least_squares(spark):
    rng = np.random.default_rng(3)
    ys = 50 + rng.normal(0, 5, 240) + 0.05 * np.arange(240)
    t = np.arange(240)
    turn = 2 * np.pi * (t + (D0 - date(2000, 1, 1)).days) / 365.25
    z = np.column_stack([t / 365.25, *[f((k + 1) * turn) for k in range(3) for f in (np.sin, np.cos)]])
    dummies = np.eye(7)[t % 7]
    full = np.column_stack([z, dummies])
    penalty = np.diag([0, *[15.0] * 6, *[0] * 7])
    c = np.linalg.solve(full.T @ full + penalty, full.T @ ys)
    day = np.arange(240, 260)
    turn = 2 * np.pi * (day + (D0 - date(2000, 1, 1)).days) / 365.25
    ahead = np.column_stack([day / 365.25, *[f((k + 1) * turn) for k in range(3) for f in (np.sin, np.cos)], np.eye(7)[day % 7]])
    got = harmonics.harmonic(daily(spark, a=ys), origins.END, 20).orderBy("ds").collect()
    assert [r.yhat for r in got] == pytest.approx(list(ahead @ c), rel=1e-6)
    assert got[0].sd == pytest.approx(np.sqrt(((ys - full @ c) ** 2).sum() / (240 - 14)), rel=1e-6)
