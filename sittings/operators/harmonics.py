"""A line, weekday effects and a smooth year, fitted together by least squares.

The year is a sum of `HARMONICS` waves and their quarter-shifted partners. Weekday effects are taken out of
everything first (per weekday: sums of products less products of sums), which leaves one small
system of the line and the waves. Its entries are sums over days, so they come as running totals for all
folds at once, and each fold's system is solved in expressions (`functions.linear`). The waves are
drawn towards 0 by `RIDGE` days of their own, so a history shorter than a year does not make up
a season from a trend.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from sittings.functions.linear import matrix, solution
from sittings.operators.models import _by_position, _fold, _over_days
from sittings.operators.origins import Origins, learn, with_calendar

HARMONICS = 3
YEAR = 365.25
RIDGE = 30


def wave(day: str, i: int) -> str:
    """SQL: wave i (sine and cosine by turns) on a day, counted from a fixed date."""
    turn = 2 * math.pi * (i // 2 + 1) / YEAR
    return f"{'cos' if i % 2 else 'sin'}({turn!r}D * datediff({day}, date'2000-01-01'))"


def harmonic(
    daily: DataFrame,
    origins: Origins,
    horizon: int,
    history: bool = False,
    harmonics: int = HARMONICS,
) -> DataFrame:
    """Trend, weekday and yearly waves; errors' deviation counts every parameter fitted."""
    waves = [f"w{i}" for i in range(2 * harmonics)]
    regressors = ["x0", *[f"x{i + 1}" for i in range(len(waves))]]
    n = len(regressors)
    # Years since the series began, so that all regressors are of like size.
    days = with_calendar(daily).selectExpr(
        "*", f"t / {YEAR}D AS x0", *[f"{wave('ds', i)} AS x{i + 1}" for i in range(len(waves))]
    )
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = {
        "n": "sum(1D)",
        "sy": "sum(v)",
        "syy": "sum(v * v)",
        **{f"s{i}": f"sum(x{i})" for i in range(n)},
        **{f"p{i}": f"sum(x{i} * v)" for i in range(n)},
        **{f"q{i}_{j}": f"sum(x{i} * x{j})" for i, j in pairs},
    }
    cells = learn(days, origins, ["dow"], sums)
    params = _fold(
        cells,
        n="sum(n)",
        weekdays="count(*)",
        ys=_by_position("dow", "sy / n", 7),
        means=f"array({', '.join(_by_position('dow', f's{i} / n', 7) for i in range(n))})",
        total="sum(syy - sy * sy / n)",
        **{f"b{i}": f"sum(p{i} - s{i} * sy / n)" for i in range(n)},
        **{f"a{i}_{j}": f"sum(q{i}_{j} - s{i} * s{j} / n)" for i, j in pairs},
    )
    entries = {(i, j): f"a{i}_{j} + {RIDGE / 2 if i == j and i else 0}D" for i, j in pairs}
    diagonal = f"array({', '.join(entries[i, i] for i in range(n))})"
    explained = " - ".join(f"2 * c[{i}] * b{i}" for i in range(n))
    spread = " + ".join(f"{2 if i < j else 1} * c[{i}] * c[{j}] * a{i}_{j}" for i, j in pairs)
    params = (
        params.selectExpr("*", f"{solution(matrix(entries, [f'b{i}' for i in range(n)]), diagonal, n)} AS c")
        .selectExpr("*", f"greatest(1e-9 * total, total - {explained} + {spread}) AS sse")
        .selectExpr("*", f"n - weekdays - {n} AS free")
    )
    at = ["datediff(ds, first_ds) / 365.25D", *[wave("ds", i) for i in range(len(waves))]]
    centre = "coalesce(get(get(means, {i}), weekday(ds)), aggregate(get(means, {i}), 0D, (s, m) -> s + coalesce(m, 0D)) / weekdays)"
    effect = "coalesce(get(ys, weekday(ds)), aggregate(ys, 0D, (s, m) -> s + coalesce(m, 0D)) / weekdays)"
    yhat = " + ".join(f"c[{i}] * ({x} - {centre.format(i=i)})" for i, x in enumerate(at))
    return _over_days(
        params,
        "harmonic",
        horizon,
        history,
        yhat=f"base + {effect} + {yhat}",
        sd="CASE WHEN free > 0 THEN sqrt(sse / free) END",
    )
