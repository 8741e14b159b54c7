"""Metrics and intervals by days ahead against plain loops over rows."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest

from sittings.operators import evaluate, horizons, models, origins

D0 = date(2023, 1, 2)


def daily(spark, **values):
    rows = [(key, D0 + timedelta(days=i), float(y)) for key, ys in values.items() for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "series_key string, ds date, y double")


def by_hand(rows, share):
    """Metrics of one run: rows are (horizon, cutoff, y, yhat, sd)."""
    rows = sorted(rows, key=lambda r: r[:2])
    wanted = max(1, int(len(rows) * share + 1e-9))
    out = {}
    for h in sorted({r[0] for r in rows}):
        upto = [r for r in rows if r[0] <= h]
        if len(upto) < wanted:
            continue
        own = sum(r[0] == h for r in rows)
        left, weights = wanted, []
        for other in sorted({r[0] for r in upto}, reverse=True):
            some = [r for r in upto if r[0] == other]
            take = min(left, len(some))
            weights += [(take / len(some), r) for r in some]
            left -= take

        def mean(f):
            parts = [(w, f(r)) for w, r in weights if f(r) is not None]
            total = sum(w for w, _ in parts)
            return sum(w * v for w, v in parts) / total if total > 0 else None

        relative = lambda r: abs(r[2] - r[3]) / abs(r[2]) if r[2] else None
        tail = [relative(r) for r in upto[-max(own, wanted) :] if relative(r) is not None]
        mse = mean(lambda r: (r[2] - r[3]) ** 2)
        out[h] = [
            own, mse, mse**0.5, mean(lambda r: abs(r[2] - r[3])), mean(relative), np.median(tail) if tail else None,
            mean(lambda r: 2 * abs(r[2] - r[3]) / (abs(r[2]) + abs(r[3])) if abs(r[2]) + abs(r[3]) else 0.0),
            mean(lambda r: float(abs(r[2] - r[3]) <= 1.2816 * r[4])),
        ]
    return out


@pytest.mark.parametrize("share", [0.0, 0.1, 0.35, 1.0])
def test_full_metrics(spark, share):
    rng = np.random.default_rng(5)
    df = daily(spark, a=rng.poisson(2, 90), b=rng.poisson(30, 75), zero=[0] * 60)
    folds = origins.rolling(30, 10, 6)
    scored = evaluate.score(models.weekday_mean(df, folds, 6), df)
    got = horizons.full_metrics(scored, share).collect()
    rows = {}
    for r in scored.collect():
        rows.setdefault(r.series_key, []).append(((r.ds - r.cutoff).days, r.cutoff, r.y, r.yhat, r.sd))
    found = {(r.series_key, r.horizon): list(r)[3:] for r in got}
    want = {(key, h): v for key, some in rows.items() for h, v in by_hand(some, share).items()}
    assert found.keys() == want.keys() and len(want) >= 3
    for k, v in want.items():
        assert found[k] == [x if x is None else pytest.approx(x) for x in v], k
    nothing = [v for k, v in found.items() if k[0] == "zero"]
    assert all(v[1:] == [0.0, 0.0, 0.0, None, None, 0.0, 1.0] for v in nothing)


def test_empirical_intervals(spark):
    rng = np.random.default_rng(6)
    # Errors lean to one side, which a normal interval cannot.
    ys = 100 + rng.exponential(10, 900)
    df = daily(spark, a=ys, short=ys[:40])
    folds = origins.rolling(60, 7, 5)
    got = horizons.empirical_interval(models.weekday_mean, df, folds, 5).collect()
    scored = evaluate.score(models.weekday_mean(df, folds, 5), df).collect()
    for r in got:
        h = (r.ds - r.cutoff).days
        errors = [s.y - s.yhat for s in scored if s.series_key == r.series_key and (s.ds - s.cutoff).days == h]
        assert r.n_errors == len(errors)
        if r.series_key == "short":
            assert r.yhat_lower is None and r.yhat_upper is None and r.yhat is not None
        else:
            low, high = np.quantile(errors, [0.1, 0.9])
            assert (r.yhat_lower, r.yhat_upper) == (pytest.approx(r.yhat + low), pytest.approx(r.yhat + high))
    long = [r for r in got if r.series_key == "a"]
    assert sum(r.yhat - r.yhat_lower for r in long) < sum(r.yhat_upper - r.yhat for r in long)


def test_empirical_coverage(spark):
    rng = np.random.default_rng(7)
    made = {
        "skewed": 100 + rng.exponential(10, 1500),
        "normal": 50 + rng.normal(0, 5, 1500),
        "heavy": 80 + rng.standard_t(3, 1500) * 4,
    }
    df = daily(spark, **made)
    got = horizons.empirical_coverage(models.weekday_mean, df, origins.rolling(60, 5, 5), 5).collect()
    assert len(got) == 3
    for r in got:
        assert r.days > 1000 and 0.75 <= r.coverage <= 0.85, r


def test_coverage_uses_only_errors_known_by_then(spark):
    """Errors of the folds that overlap a fold's own days are not used for it."""
    ys = [10.0] * 200 + [30.0] * 30
    df = daily(spark, a=ys)
    folds = origins.rolling(30, 1, 4)
    (r,) = horizons.empirical_coverage(models.weekday_mean, df, folds, 4).collect()
    n = 4 * (len(ys) - 4 - 30)
    assert r.days == n - 4 * (LEAST + 3) and r.coverage < 1


LEAST = horizons.LEAST_ERRORS
