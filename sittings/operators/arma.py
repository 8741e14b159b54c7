"""Autoregression with moving-average terms, by two rounds of least squares.

What the weekday means leave over is first explained by a long autoregression
(`levinson.recursion`, up to two weeks). Its residuals stand for the shocks, and the values are
then explained by their own and the shocks' of one and of seven days ago. Every subset of the four
is fitted from the same normal equations on the same days, and the one of least AICc is taken, among those
with a stationary autoregressive part. Both rounds are sums over days, so a fold is one grouped
aggregate in the partitioning by series; there is no search.

The long autoregression is fitted to a fold's own days, so its residuals differ from fold to fold and no
running sums serve several: origins must be a single one per series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sittings.functions.linear import matrix, solution
from sittings.operators.levinson import MAX_ORDER, WEEK, recursion
from sittings.operators.models import _over_days
from sittings.operators.origins import Origins, with_calendar

TERMS = ("x1", "x7", "e1", "e7")  # values and shocks one and seven days ago
BY_SERIES = "PARTITION BY series_key"
IN_ORDER = f"{BY_SERIES} ORDER BY ds"


def _residuals(daily: DataFrame, origins: Origins) -> DataFrame:
    """Days up to the origin: x beside its weekday mean, and shocks e from two weeks on."""
    if origins.step is not None:
        raise ValueError("moving-average terms are fitted to one origin per series")
    days = with_calendar(daily).where(f"{origins.count()} > 0 AND ds <= {origins.cutoff()}")
    days = days.selectExpr("*", f"{origins.cutoff()} AS cutoff", f"count(*) OVER ({BY_SERIES}) AS days")
    days = days.selectExpr("*", "avg(v) OVER (PARTITION BY series_key, dow) AS m").selectExpr("*", "v - m AS x")
    lags = range(1, MAX_ORDER + 1)
    days = days.selectExpr("*", *[f"lag(x, {k}) OVER ({IN_ORDER}) AS u{k}" for k in lags])
    products = ["x * x", *[f"x * u{k}" for k in lags]]
    g = ", ".join(f"coalesce(sum({p}) OVER ({BY_SERIES}), 0) / days" for p in products)
    days = days.selectExpr("*", f"array({g}) AS g")
    before = ", ".join(f"u{k}" for k in lags)
    # The recursion is taken once a series, on its first day.
    days = days.selectExpr("*", f"CASE WHEN ds = first_ds THEN element_at({recursion()}, -1).phi END AS own_phi")
    days = days.selectExpr("*", f"max(own_phi) OVER ({BY_SERIES}) AS phi", f"array({before}) AS us")
    explained = "aggregate(zip_with(slice(us, 1, size(phi)), phi, (a, b) -> a * b), 0D, (s, p) -> s + p)"
    return days.selectExpr(
        "series_key", "first_ds", "base", "cutoff", "ds", "dow", "m", "x", "u1 AS x1", "u7 AS x7",
        f"CASE WHEN u{MAX_ORDER} IS NOT NULL THEN x - IF(size(phi) > 0, {explained}, 0D) END AS e",
    )


def fitted(daily: DataFrame, origins: Origins) -> DataFrame:
    """Per series: the terms' coefficients (0 where left out), aic, sigma, the last two weeks."""
    days = _residuals(daily, origins).selectExpr(
        "*", f"lag(e, 1) OVER ({IN_ORDER}) AS e1", f"lag(e, 7) OVER ({IN_ORDER}) AS e7"
    )
    used = "CASE WHEN e7 IS NOT NULL THEN {} END"
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    recent = "array_sort(collect_list(CASE WHEN ds > date_sub(cutoff, 7) THEN struct(ds, x, coalesce(e, 0D) AS e) END))"
    profile = [f"max(CASE WHEN dow = {i} THEN m END)" for i in range(7)]
    sums = days.groupBy("series_key", "first_ds", "base", "cutoff").agg(
        *[
            F.expr(f"coalesce(sum({used.format(f'{TERMS[i]} * {TERMS[j]}')}), 0D) AS s{i}{j}") for i, j in pairs
        ],
        *[F.expr(f"coalesce(sum({used.format(f'x * {t}')}), 0D) AS b{i}") for i, t in enumerate(TERMS)],
        F.expr(f"coalesce(sum({used.format('x * x')}), 0D) AS total"),
        F.expr("count(e7) AS n"),
        F.expr(f"array({', '.join(profile)}) AS profile"),
        F.expr(f"{recent} AS recent"),
    )
    masks = ", ".join(f"array({', '.join(str(int(m >> i & 1)) for i in range(4))})" for m in range(16))
    cells = {(i, j): f"IF(mask[{i}] * mask[{j}] = 1, s{i}{j}, {int(i == j)})" for i, j in pairs}
    rhs = [f"mask[{i}] * b{i}" for i in range(4)]
    diagonal = f"array({', '.join(cells[i, i] for i in range(4))})"
    fits = (
        sums.selectExpr("*", f"explode(array({masks})) AS mask")
        .selectExpr("*", f"{solution(matrix(cells, rhs), diagonal, 4)} AS c")
        .selectExpr("*", "aggregate(mask, 0, (s, m) -> s + m) AS terms")
        .selectExpr("*", f"greatest(1e-9 * total, total - {' - '.join(f'c[{i}] * b{i}' for i in range(4))}) AS sse")
        .where(f"abs(c[0]) + abs(c[1]) < 1 AND (n > terms + {WEEK} + 1 OR terms = 0)")
    )
    k = f"(terms + {WEEK})"
    aic = f"""CASE WHEN n > {k} + 1 THEN
        round(n * ln(greatest(sse / n, 1e-300)) + 2D * {k} * n / (n - {k} - 1), 6) END"""
    fits = fits.selectExpr("*", f"{aic} AS aic")
    order = "struct(aic IS NULL, aic, terms, transform(mask, m -> -m))"
    best = "struct(c, aic, terms, sse, n, total, profile, recent)"
    return (
        fits.groupBy("series_key", "first_ds", "base", "cutoff")
        .agg(F.expr(f"min_by({best}, {order}) AS best"))
        .selectExpr("series_key", "first_ds", "base", "cutoff", "best.*")
        .selectExpr("*", f"CASE WHEN n > terms + {WEEK} THEN sqrt(sse / (n - terms - {WEEK})) END AS sigma")
    )


def orders(daily: DataFrame, origins: Origins) -> DataFrame:
    """series_key, cutoff, the coefficients of values and shocks one and seven days ago, aic, sigma."""
    names = ("ar1", "ar7", "ma1", "ma7")
    return fitted(daily, origins).selectExpr(
        "series_key", "cutoff", *[f"c[{i}] AS {name}" for i, name in enumerate(names)], "aic", "sigma"
    )


def arma(daily: DataFrame, origins: Origins, horizon: int) -> DataFrame:
    """Forecasts by the terms of least AICc; shocks to come are 0."""
    week = "transform(sequence(6, 0), i -> coalesce(get(filter(recent, r -> r.ds = date_sub(cutoff, i)).{}, 0), 0D))"
    step = """c[0] * element_at(x, -1) + c[1] * element_at(x, -7)
        + IF(h = 1, c[2] * element_at(es, -1), 0D) + IF(h <= 7, c[3] * element_at(es, h - 8), 0D)"""
    # A single shock on the last day passes on through the same steps.
    psi = "c[0] * element_at(x, -1) + c[1] * element_at(x, -7) + IF(h = 1, c[2], 0D) + IF(h = 7, c[3], 0D)"
    impulse = "array(0D, 0D, 0D, 0D, 0D, 0D, 1D)"
    params = (
        fitted(daily, origins)
        .selectExpr("*", f"{week.format('x')} AS xs", f"{week.format('e')} AS es")
        .selectExpr("*", f"aggregate(sequence(1, {horizon}), xs, (x, h) -> concat(x, array({step}))) AS path")
        .selectExpr("*", f"aggregate(sequence(1, {horizon}), {impulse}, (x, h) -> concat(x, array({psi}))) AS psi")
    )
    spread = "aggregate(slice(psi, 7, h), 0D, (s, w) -> s + w * w)"
    return _over_days(
        params,
        "arma",
        horizon,
        False,
        yhat="base + get(profile, weekday(ds)) + get(path, 6 + h)",
        sd=f"sigma * sqrt({spread})",
    )
