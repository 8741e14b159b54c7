"""Autoregressions of any order up to two weeks, by Levinson's recursion on autocovariances.

What the weekday means leave over is explained by its values one to `MAX_ORDER` days ago. The
autocovariances of all lags follow from running sums of products per weekday, so those of all
folds come from one pass, linear in days. From them the recursion gives the
coefficients and the error of every order in turn, each from the one before; being divided by
the same number of days at every lag, they always give a stationary process. The order of least AICc
is taken, with orders taking part as soon as there are two days more than parameters; a fold in
which none can has order 0, the weekday means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sittings.operators.models import BY_FOLD, FOLD, _by_position, _fold, _over_days
from sittings.operators.origins import Origins, learn, with_calendar

MAX_ORDER = 14
WEEK = 7  # parameters of the weekday means

# An error below this share of the variance counts as none: higher orders have nothing to explain.
EXACT = "1e-9"


def _autocovariances(daily: DataFrame, origins: Origins) -> DataFrame:
    """One row per fold: n, autocovariances g of lags 0 to MAX_ORDER, weekday means, last two weeks."""
    lags = range(1, MAX_ORDER + 1)
    days = with_calendar(daily).selectExpr(
        "*", *[f"lag(v, {k}) OVER (PARTITION BY series_key ORDER BY ds) AS u{k}" for k in lags]
    )
    pairs = {}
    for k in lags:
        pairs |= {
            f"n{k}": f"count(u{k})",
            f"a{k}": f"sum(CASE WHEN u{k} IS NOT NULL THEN v END)",
            f"b{k}": f"sum(u{k})",
            f"p{k}": f"sum(v * u{k})",
        }
    sums = {
        "n": "count(*)",
        "sy": "sum(v)",
        "syy": "sum(v * v)",
        "tail": "max_by(v, ds)",
        "tail7": "max_by(u7, ds)",
        **pairs,
    }
    profile = [f"max(CASE WHEN dow = {i} THEN sy / n END) OVER ({BY_FOLD})" for i in range(7)]
    cells = learn(days, origins, ["dow"], sums).selectExpr(
        *FOLD, "dow", "tail", "tail7", "n", "sy / n AS m", "syy - sy / n * sy AS p0",
        f"array({', '.join(profile)}) AS profile",
        *[f"coalesce({c}, 0) AS {c}" for c in pairs],
    )

    def covariance(k: int) -> str:
        # The mean of the weekday k days before.
        before = f"coalesce(get(profile, (dow + {7 * MAX_ORDER - k}) % 7), 0)"
        return f"sum(p{k} - {before} * a{k} - m * b{k} + m * {before} * n{k}) / sum(n)"

    return _fold(
        cells,
        profile="any_value(profile)",
        n="sum(n)",
        tails=_by_position("dow", "tail", 7),
        tails7=_by_position("dow", "tail7", 7),
        g=f"array(sum(p0) / sum(n), {', '.join(covariance(k) for k in lags)})",
    )


def _aicc(k: str, error: str) -> str:
    free = f"n - ({k} + {WEEK}) - 1"
    return f"""CASE WHEN {free} > 0 THEN
        n * ln(greatest({error}, {EXACT} * g[0], 1e-300)) + 2D * ({k} + {WEEK}) * n / ({free}) END"""


NONE = "CAST(array() AS ARRAY<DOUBLE>)"


def recursion(g: str = "g") -> str:
    """SQL: fits (phi, error) of order 0 and up from the autocovariances `g` of lags 0 to MAX_ORDER.

    No order is added once nothing is left to explain.
    """
    # `sequence(1, 0)` counts down, so order 0 is the start.
    explained = f"""aggregate(sequence(1, size(s.phi)), 0D, (t, j) ->
        t + element_at(s.phi, j) * get({g}, k - j))"""
    reflection = f"(get({g}, k) - IF(size(s.phi) > 0, {explained}, 0D)) / s.error"
    turned = "concat(zip_with(s.phi, reverse(s.phi), (a, b) -> a - r * b), array(r))"
    step = f"""IF(s.error > {EXACT} * {g}[0],
        element_at(transform(
            transform(array({reflection}), r -> named_struct('phi', {turned}, 'error', s.error * (1 - r * r))),
            f -> named_struct('phi', f.phi, 'error', f.error, 'fits', concat(s.fits, array(f)))), 1),
        s)"""
    start = f"""named_struct('phi', {NONE}, 'error', {g}[0],
        'fits', array(named_struct('phi', {NONE}, 'error', {g}[0])))"""
    return f"aggregate(sequence(1, {MAX_ORDER}), {start}, (s, k) -> {step}).fits"


def fitted(daily: DataFrame, origins: Origins) -> DataFrame:
    """Per fold: order p, phi (newest lag first), aic and sigma, beside what forecasts need."""
    scored = f"""transform(fits, f -> named_struct('aic', round({_aicc('size(f.phi)', 'f.error')}, 6),
        'p', size(f.phi), 'phi', f.phi, 'error', f.error))"""
    return (
        _autocovariances(daily, origins)
        .selectExpr("*", f"{recursion()} AS fits")
        .selectExpr("*", f"array_min(filter({scored}, f -> f.aic IS NOT NULL)) AS least", "fits[0].error AS plain")
        .selectExpr(
            *FOLD, "profile", "tails", "tails7", "n",
            "coalesce(least.p, 0) AS p", f"coalesce(least.phi, {NONE}) AS phi", "least.aic AS aic",
            f"""CASE WHEN n > coalesce(least.p, 0) + {WEEK} THEN
                sqrt(greatest(0, coalesce(least.error, plain)) * n / (n - coalesce(least.p, 0) - {WEEK})) END AS sigma""",
        )
    )


def orders(daily: DataFrame, origins: Origins) -> DataFrame:
    """series_key, cutoff, order p, its aic, sigma, and the coefficients of yesterday and the week before."""
    return fitted(daily, origins).selectExpr(
        "series_key", "cutoff", "p", "aic", "sigma", "get(phi, 0) AS phi1", "get(phi, 6) AS phi7"
    )


def ar_levinson(daily: DataFrame, origins: Origins, horizon: int) -> DataFrame:
    """Forecasts by the order of least AICc, h days ahead by repeating its step."""
    next_value = "aggregate(sequence(1, size(phi)), 0D, (t, j) -> t + element_at(phi, j) * element_at(x, -j))"
    ahead = f"aggregate(sequence(1, {horizon}), %s, (x, h) -> concat(x, array(IF(p > 0, {next_value}, 0D))))"
    back = f"transform(sequence({MAX_ORDER} - 1, 0), i -> named_struct('i', i, 'd', weekday(date_sub(cutoff, i))))"
    residual = "IF(q.i < 7, get(tails, q.d), get(tails7, q.d)) - get(profile, q.d)"
    impulse = f"array({', '.join(['0D'] * (MAX_ORDER - 1) + ['1D'])})"
    params = (
        fitted(daily, origins)
        .selectExpr("*", f"transform({back}, q -> coalesce({residual}, 0D)) AS recent")
        .selectExpr("*", f"{ahead % 'recent'} AS path", f"{ahead % impulse} AS psi")
    )
    spread = f"aggregate(slice(psi, {MAX_ORDER}, h), 0D, (s, w) -> s + w * w)"
    return _over_days(
        params,
        "ar_levinson",
        horizon,
        False,
        yhat=f"base + get(profile, weekday(ds)) + get(path, {MAX_ORDER} - 1 + h)",
        sd=f"sigma * sqrt({spread})",
    )
