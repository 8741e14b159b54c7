"""Orders of autoregressions and of differences, recovered from series that were made by them."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest

from sittings.functions import linear
from sittings.operators import arma, autoregression, differencing, levinson, origins

D0 = date(2023, 1, 2)  # a Monday


def daily(spark, **values):
    rows = [(key, D0 + timedelta(days=i), float(y)) for key, ys in values.items() for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "series_key string, ds date, y double")


def autoregressive(rng, n, phi, sd=1.0):
    """A series whose values follow from those `phi` names, by lag."""
    x = np.zeros(n + 100)
    for i in range(len(x)):
        x[i] = rng.normal(0, sd) + sum(f * x[i - lag] for lag, f in phi.items() if i >= lag)
    return x[100:]


def by_definition(ys, order=14):
    """Autocovariances and fits of every order by solving their equations one by one."""
    ys = np.asarray(ys, float)
    dow = np.arange(len(ys)) % 7
    x = ys - np.array([ys[dow == d].mean() for d in range(7)])[dow]
    n = len(x)
    g = np.array([x[k:] @ x[: n - k] / n for k in range(order + 1)])
    fits = []
    for p in range(order + 1):
        r = np.array([[g[abs(i - j)] for j in range(p)] for i in range(p)]).reshape(p, p)
        phi = np.linalg.solve(r, g[1 : p + 1]) if p else np.zeros(0)
        error = g[0] - phi @ g[1 : p + 1]
        k = p + 7
        aic = n * np.log(error) + 2 * k * n / (n - k - 1) if n > k + 1 else None
        fits.append((aic, p, phi, error))
    return x, fits


def test_levinson_is_the_solution_of_its_equations(spark):
    rng = np.random.default_rng(1)
    made = {"a": autoregressive(rng, 300, {1: 0.5, 3: 0.3}), "b": autoregressive(rng, 100, {7: 0.6}), "c": rng.normal(5, 1, 25)}
    got = {r.series_key: r for r in levinson.fitted(daily(spark, **made), origins.END).collect()}
    ahead = {}
    for r in levinson.ar_levinson(daily(spark, **made), origins.END, 5).orderBy("ds").collect():
        ahead.setdefault(r.series_key, []).append(r)
    for key, ys in made.items():
        x, fits = by_definition(ys)
        aic, p, phi, error = min((f for f in fits if f[0] is not None), key=lambda f: (round(f[0], 6), f[1]))
        assert got[key].p == p and got[key].aic == pytest.approx(aic, abs=1e-5)
        assert got[key].phi == pytest.approx(phi, abs=1e-8)
        n = len(x)
        assert got[key].sigma == pytest.approx(np.sqrt(error * n / (n - p - 7)))
        x, psi = list(x), [0.0] * 13 + [1.0]
        dow = np.arange(n) % 7
        means = [np.mean(np.asarray(ys)[dow == d]) for d in range(7)]
        for h in range(5):
            x.append(sum(f * x[-1 - j] for j, f in enumerate(phi)))
            sd = got[key].sigma * np.sqrt(sum(w * w for w in psi[13:]))
            psi.append(sum(f * psi[-1 - j] for j, f in enumerate(phi)))
            assert ahead[key][h].yhat == pytest.approx(means[(n + h) % 7] + x[-1])
            assert ahead[key][h].sd == pytest.approx(sd)


def test_high_orders_are_recovered(spark):
    rng = np.random.default_rng(3)
    n = 3000
    made = {
        "third": autoregressive(rng, n, {1: 0.4, 2: -0.3, 3: 0.4}),
        "season": autoregressive(rng, n, {1: 0.3, 7: 0.5}),
        "none": rng.normal(0, 1, n),
    }
    got = {r.series_key: r for r in levinson.fitted(daily(spark, **made), origins.END).collect()}
    assert 3 <= got["third"].p <= 5 and got["third"].phi[:3] == pytest.approx([0.4, -0.3, 0.4], abs=0.06)
    assert got["season"].p >= 7 and got["season"].phi[6] == pytest.approx(0.5, abs=0.08)
    assert got["none"].p <= 2 and got["none"].sigma == pytest.approx(1, rel=0.05)


def test_levinson_folds_equal_fits_of_their_own(spark):
    """Running sums give each fold what its days alone give."""
    rng = np.random.default_rng(4)
    ys = autoregressive(rng, 90, {1: 0.6}) + 10
    folds = levinson.orders(daily(spark, a=ys), origins.rolling(20, 10, 10)).collect()
    assert len(folds) > 5
    for r in folds:
        alone = levinson.orders(daily(spark, a=ys[: (r.cutoff - D0).days + 1]), origins.END).first()
        assert (r.p, r.phi1) == (alone.p, pytest.approx(alone.phi1)) and r.sigma == pytest.approx(alone.sigma)


def test_few_days(spark):
    """Orders take part as soon as two days more than parameters are there, not before."""
    series = {f"n{n}": [1.0, 4.0, 2.0, 8.0, 5.0, 7.0, 3.0, 6.0, 9.0, 1.0, 2.0, 7.0][:n] for n in (1, 2, 8, 9, 10, 12)}
    got = {r.series_key: r for r in levinson.orders(daily(spark, **series), origins.END).collect()}
    assert [got[f"n{n}"].aic is None for n in (1, 2, 8, 9, 10, 12)] == [True] * 3 + [False] * 3
    assert [got[f"n{n}"].p for n in (1, 2, 8, 9)] == [0] * 4
    assert got["n1"].sigma is None
    flat = levinson.ar_levinson(daily(spark, a=[3.0] * 30), origins.END, 3).collect()
    assert [(r.yhat, r.sd) for r in flat] == [(3.0, 0.0)] * 3


def test_short_folds_compare_all_candidates(spark):
    """With few pairs the choice is made by the same rule as with many."""
    walk = np.cumsum([0, 9, -4, 12, 3, -8, 5] * 3) * 1.0  # 21 days: 7 pairs
    got = autoregression.orders(daily(spark, a=walk[:20], b=walk[:15]), origins.END).collect()
    assert all(r.differenced and r.aic is not None for r in got if r.series_key == "a")
    assert all(r.aic is None for r in got if r.series_key == "b")


def test_moving_average_is_recovered(spark):
    rng = np.random.default_rng(8)
    n, e = 4000, rng.normal(0, 1, (3, 4010))
    weekly = e[1].copy()
    weekly[7:] += 0.6 * e[1][:-7]
    both = np.zeros(n)
    for i in range(1, n):
        both[i] = 0.6 * both[i - 1] + e[2, i] + 0.4 * e[2, i - 1]
    made = {"one": e[0, 1:n] + 0.6 * e[0, : n - 1], "seven": weekly[7:n], "both": both[100:], "none": rng.normal(0, 1, 400)}
    df = daily(spark, **made)
    got = {r.series_key: r for r in arma.orders(df, origins.END).collect()}
    assert got["one"].ma1 == pytest.approx(0.6, abs=0.08) and got["one"].sigma == pytest.approx(1, rel=0.05)
    assert got["seven"].ma7 == pytest.approx(0.6, abs=0.08) and abs(got["seven"].ma1) < 0.1
    assert (got["both"].ar1, got["both"].ma1) == (pytest.approx(0.6, abs=0.08), pytest.approx(0.4, abs=0.08))
    assert got["none"].sigma == pytest.approx(1, rel=0.1)
    ahead = {}
    for r in arma.arma(df, origins.END, 3).orderBy("ds").collect():
        ahead.setdefault(r.series_key, []).append(r)
    # One day ahead the last shock counts, two days ahead only the spread it leaves does.
    assert ahead["one"][0].yhat == pytest.approx(got["one"].ma1 * e[0, n - 1], abs=0.3)
    assert ahead["one"][0].sd == pytest.approx(got["one"].sigma)
    if got["one"].ar1 == got["one"].ar7 == 0:
        assert ahead["one"][1].sd == pytest.approx(got["one"].sigma * np.sqrt(1 + got["one"].ma1 ** 2))


def test_arma_is_least_squares_on_residuals_of_the_long_fit(spark):
    ys = autoregressive(np.random.default_rng(9), 200, {1: 0.5, 2: 0.2}) + np.arange(200) % 7
    x, fits = by_definition(ys)
    phi = fits[14][2]
    e = np.array([np.nan] * 14 + [x[i] - phi @ x[i - 14 : i][::-1] for i in range(14, len(x))])
    rows = range(21, len(x))
    z = np.array([[x[i - 1], x[i - 7], e[i - 1], e[i - 7]] for i in rows])
    y, best = x[21:], None
    for m in range(16):
        on = [i for i in range(4) if m >> i & 1]
        c = np.zeros(4)
        if on:
            c[on] = np.linalg.lstsq(z[:, on], y, rcond=None)[0]
        k, n = len(on) + 7, len(y)
        aic = n * np.log(((y - z @ c) ** 2).sum() / n) + 2 * k * n / (n - k - 1)
        if abs(c[0]) + abs(c[1]) < 1 and (best is None or aic < best[0]):
            best = aic, c
    r = arma.orders(daily(spark, a=ys), origins.END).first()
    assert r.aic == pytest.approx(best[0], abs=1e-5)
    assert [r.ar1, r.ar7, r.ma1, r.ma7] == pytest.approx(list(best[1]), abs=1e-7)


def test_arma_of_short_and_flat_series(spark):
    df = daily(spark, one=[4.0], short=[1.0, 5.0, 2.0] * 6, flat=[2.0] * 60)
    got = {(r.series_key, r.ds): r for r in arma.arma(df, origins.END, 2).collect()}
    assert len(got) == 6
    assert all(r.sd is None for k, r in got.items() if k[0] != "flat")
    assert {(r.yhat, r.sd) for k, r in got.items() if k[0] == "flat"} == {(2.0, 0.0)}
    with pytest.raises(ValueError):
        arma.arma(df, origins.rolling(10, 5, 5), 2)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_systems_are_solved(spark, n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n + 3, n))
    s, b = a.T @ a, rng.normal(size=n)
    cells = {(i, j): repr(float(s[i, j])) for i in range(n) for j in range(i, n)}
    d = f"array({', '.join(f'double({cells[i, i]})' for i in range(n))})"
    text = linear.solution(linear.matrix(cells, [repr(float(v)) for v in b]), d, n)
    assert spark.sql(f"SELECT {text} AS x").first().x == pytest.approx(list(np.linalg.solve(s, b)))


def test_a_repeated_regressor_is_dropped(spark):
    cells = {(0, 0): "2", (0, 1): "4", (1, 1): "8", (0, 2): "1", (1, 2): "2", (2, 2): "3"}
    text = linear.solution(linear.matrix(cells, ["6", "12", "8"]), "array(2D, 8D, 3D)", 3)
    assert spark.sql(f"SELECT {text} AS x").first().x == pytest.approx([2.0, 0.0, 2.0])


def level_statistic(w):
    """The statistic of level stationarity by its definition."""
    w = np.asarray(w, float)
    n, x = len(w), w - np.mean(w)
    reach = min(14, int(4 * (n / 100) ** 0.25))
    variance = x @ x / n + sum(2 * (1 - k / (reach + 1)) * (x[k:] @ x[:-k]) / n for k in range(1, reach + 1))
    return (np.cumsum(x) ** 2).sum() / (n * n * variance)


def test_differences_are_told_apart(spark):
    rng = np.random.default_rng(6)
    n, week = 420, np.array([0, 9, 4, 12, 3, 8, 5])
    noise = rng.normal(0, 1, (6, n))
    made = {
        "level": 50 + noise[0],
        "trend": 0.2 * np.arange(n) + noise[1],
        "walk": np.cumsum(noise[2]),
        "weekly": week[np.arange(n) % 7] + noise[3],
        "twice": np.cumsum(np.cumsum(noise[4])),
        "both": week[np.arange(n) % 7] * 3 + np.cumsum(noise[5]),
    }
    got = {r.series_key: r for r in differencing.orders(daily(spark, **made), origins.END).collect()}
    assert {k: (r.seasonal, r.differences) for k, r in got.items() if k != "both"} == {
        "level": (0, 0), "trend": (0, 1), "walk": (0, 1), "weekly": (1, 0), "twice": (0, 2),
    }
    assert got["both"].seasonal == 1 and got["both"].strength > 0.9
    for key in ("level", "trend", "walk", "twice"):
        assert got[key].statistic == pytest.approx(level_statistic(made[key]), rel=1e-6)
    assert got["weekly"].statistic == pytest.approx(level_statistic(made["weekly"][7:] - made["weekly"][:-7]), rel=1e-6)


def test_differences_of_folds_and_short_series(spark):
    rng = np.random.default_rng(7)
    ys = np.cumsum(rng.normal(0, 1, 120)) + 20
    for r in differencing.orders(daily(spark, a=ys), origins.rolling(30, 20, 10)).collect():
        some = ys[: (r.cutoff - D0).days + 1]
        alone = differencing.orders(daily(spark, a=some), origins.END).first()
        assert (r.seasonal, r.differences) == (alone.seasonal, alone.differences)
        assert (r.strength, r.statistic) == (pytest.approx(alone.strength), pytest.approx(alone.statistic))
    odd = daily(spark, one=[3.0], two=[5.0, 5.0], flat=[2.0] * 40)
    got = {r.series_key: (r.seasonal, r.differences) for r in differencing.orders(odd, origins.END).collect()}
    assert got == {"one": (0, 0), "two": (0, 0), "flat": (0, 0)}
