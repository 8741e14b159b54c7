"""How often a series must be differenced, per origin and from running sums.

Seasonal differences (from the week before) are taken if the weekly pattern is strong: of what a
centred weekly mean leaves over, the variance that weekday means explain is more than `STRONG`.
Plain differences are taken until the level is stationary: the sum of squares of the partial sums
around the mean, over the squared number of days and a variance that counts lags with falling
weights, must stay below its 5 % point `LEVEL`; at most two are taken.

Partial sums around a fold's mean are partial sums of the values less a multiple of the day's number,
so their squares follow from three running sums whatever the mean is, and all folds of a
series come from one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sittings.operators.origins import Origins, learn, with_calendar

STRONG = 0.64
LEVEL = 0.463
LAGS = 14
FOLD = ["series_key", "cutoff"]
IN_ORDER = "PARTITION BY series_key ORDER BY ds"
# Seasonal and plain differences of the series that are tested, in order.
KINDS = [(s, d) for s in (0, 1) for d in (0, 1)]


def _strength(daily: DataFrame, origins: Origins) -> DataFrame:
    """series_key, cutoff and strength: the share that weekday means explain, 0 with under two weeks."""
    centred = "avg(v) OVER (PARTITION BY series_key ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    middle = f"lag(v, 3) OVER ({IN_ORDER}) - {centred}"
    days = with_calendar(daily).selectExpr(
        "* EXCEPT (dow)",
        "(dow + 4) % 7 AS dow",  # the weekday of the mean's middle, three days before
        f"CASE WHEN lag(v, 6) OVER ({IN_ORDER}) IS NOT NULL THEN {middle} END AS w",
    )
    sums = {"n": "count(w)", "sw": "sum(w)", "sww": "sum(w * w)"}
    cells = learn(days, origins, ["dow"], sums)
    within = "sum(CASE WHEN n > 0 THEN greatest(0, sww - sw * sw / n) ELSE 0 END)"
    around = "sum(coalesce(sww, 0)) - sum(coalesce(sw, 0)) * sum(coalesce(sw, 0)) / sum(n)"
    return cells.groupBy(*FOLD).agg(
        F.expr(
            f"""CASE WHEN sum(n) >= 14 AND {around} > 1e-9 * sum(coalesce(sww, 0))
                THEN greatest(0D, 1 - {within} / ({around})) ELSE 0D END AS strength"""
        )
    )


def _statistics(daily: DataFrame, origins: Origins) -> DataFrame:
    """series_key, cutoff, kind and the statistic of level stationarity (0 for a constant series)."""
    week = f"v - lag(v, 7) OVER ({IN_ORDER})"
    days = with_calendar(daily).selectExpr("*", f"{week} AS s")
    days = days.selectExpr(
        "*", f"v - lag(v) OVER ({IN_ORDER}) AS d", f"s - lag(s) OVER ({IN_ORDER}) AS sd"
    )
    kinds = days.selectExpr(
        "* EXCEPT (v, s, d, sd)", "stack(4, 0, v, 1, d, 2, s, 3, sd) AS (kind, w)"
    ).where("w IS NOT NULL")
    along = "PARTITION BY series_key, kind ORDER BY ds"
    lags = range(1, LAGS + 1)
    kinds = kinds.selectExpr(
        "*",
        f"double(row_number() OVER ({along})) AS i",
        f"sum(w) OVER ({along} ROWS UNBOUNDED PRECEDING) AS c",
        *[f"lag(w, {k}) OVER ({along}) AS u{k}" for k in lags],
    )
    pairs = {}
    for k in lags:
        pairs |= {
            f"a{k}": f"sum(CASE WHEN u{k} IS NOT NULL THEN w END)",
            f"b{k}": f"sum(u{k})",
            f"p{k}": f"sum(w * u{k})",
        }
    sums = {"n": "count(*)", "sw": "sum(w)", "sww": "sum(w * w)", "cc": "sum(c * c)", "ic": "sum(i * c)", **pairs}
    cells = learn(kinds, origins, ["kind"], sums)
    # Lags count with weights that fall to 0; their number grows with the days.
    reach = f"least({LAGS}, int(floor(4 * pow(n / 100D, 0.25D))))"

    def covariance(k: int) -> str:
        return f"greatest(0, n - {k}) * m * m + coalesce(p{k}, 0) - m * (coalesce(a{k}, 0) + coalesce(b{k}, 0))"

    weighted = " + ".join(
        f"IF({k} <= reach, 2 * (1 - {k} / (reach + 1D)) * ({covariance(k)}), 0D)" for k in lags
    )
    squares = "cc - 2 * m * ic + m * m * n * (n + 1D) * (2 * n + 1) / 6"
    return (
        cells.selectExpr("*", "sw / n AS m", f"{reach} AS reach")
        .selectExpr("*", "greatest(0, sww - n * m * m) AS spread", f"{squares} AS squares")
        .selectExpr("*", f"(spread + {weighted}) / n AS variance")
        .selectExpr(
            *FOLD, "kind", "n",
            "CASE WHEN spread > 1e-9 * sww AND variance > 0 THEN squares / (double(n) * n * variance) ELSE 0D END AS statistic",
        )
    )


def orders(daily: DataFrame, origins: Origins) -> DataFrame:
    """series_key, cutoff, strength, seasonal (0 or 1), statistic before plain differences, differences (0 to 2)."""
    at = {kind: f"max(CASE WHEN kind = {i} THEN statistic END)" for i, kind in enumerate(KINDS)}
    tests = _statistics(daily, origins).groupBy(*FOLD).agg(
        *[F.expr(f"{at[s, d]} AS k{s}{d}") for s, d in KINDS]
    )
    return (
        tests.join(_strength(daily, origins), FOLD)
        .selectExpr("*", f"int(strength > {STRONG} AND k10 IS NOT NULL) AS seasonal")
        .selectExpr("*", "IF(seasonal = 1, k10, k00) AS statistic", "IF(seasonal = 1, k11, k01) AS second")
        .selectExpr(
            *FOLD, "strength", "seasonal", "statistic",
            f"CASE WHEN coalesce(statistic, 0) <= {LEVEL} THEN 0 WHEN coalesce(second, 0) <= {LEVEL} THEN 1 ELSE 2 END AS differences",
        )
    )
