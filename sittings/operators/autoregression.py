"""Seasonal autoregression with its order chosen by AICc, in closed form.

A candidate looks either at what the weekday means leave over or at the differences from
the week before, and explains it by none, one or both of its values one and seven days ago.
Coefficients follow from sums of products by normal equations of at most two unknowns, so all
candidates of all folds come from one pass of running sums, linear in days. They are
compared on the same days (those with two weeks behind them) by AIC with its correction for few
days, and a candidate takes part as soon as there are two days more than it has parameters. A fold
in which none can keeps its weekday means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sittings.operators.models import BY_FOLD, FOLD, _by_position, _fold, _over_days
from sittings.operators.origins import Origins, learn, with_calendar

# A pair of lags is used unless one follows from the other but for this share.
DISTINCT = "1e-9"
NO_ERROR = "1e-300"

# An error below this share of what there is to explain counts as that share.
EXACT = "1e-9"

# Value today, one and seven days ago, and those of the differences from the week before.
RAW = ("v", "u1", "u7")
DIFFERENCE = ("(v - u7)", "(u1 - u8)", "(u7 - u14)")
PRODUCTS = {"cc": (0, 0), "c1": (0, 1), "c7": (0, 2), "c11": (1, 1), "c17": (1, 2), "c77": (2, 2)}


def _moments(daily: DataFrame, origins: Origins) -> DataFrame:
    """One row per fold: weekday means, last week, and product sums of both kinds."""
    days = with_calendar(daily).selectExpr(
        "*",
        *[f"lag(v, {k}) OVER (PARTITION BY series_key ORDER BY ds) AS u{k}" for k in (1, 7, 8, 14)],
    )

    def common(value: str) -> str:
        return f"sum(CASE WHEN u14 IS NOT NULL THEN {value} END)"

    single = {f"s{i}": common(RAW[i]) for i in range(3)}
    raw = {f"raw_{name}": common(f"{RAW[i]} * {RAW[j]}") for name, (i, j) in PRODUCTS.items()}
    week = {
        f"week_{name}": common(f"{DIFFERENCE[i]} * {DIFFERENCE[j]}")
        for name, (i, j) in PRODUCTS.items()
    }
    sums = {
        "n": "count(*)",
        "sy": "sum(v)",
        "tail": "max_by(v, ds)",
        "tail7": "max_by(u7, ds)",
        "pairs": "count(u14)",
        **single,
        **raw,
        **week,
    }
    profile = [f"max(CASE WHEN dow = {i} THEN sy / n END) OVER ({BY_FOLD})" for i in range(7)]
    cells = learn(days, origins, ["dow"], sums).selectExpr(
        *FOLD, "dow", "tail", "tail7", "pairs",
        f"array({', '.join(profile)}) AS profile",
        # Means of the weekday and of the one before, 0 where there are no pairs.
        "sy / n AS m",
        *[f"coalesce({c}, 0) AS {c}" for c in (*single, *raw, *week)],
    ).selectExpr("*", "coalesce(get(profile, (dow + 6) % 7), 0) AS p")
    means = ("m", "p", "m")

    def centred(name: str, i: int, j: int) -> str:
        a, b = means[i], means[j]
        return f"sum(raw_{name} - {b} * s{i} - {a} * s{j} + {a} * {b} * pairs)"

    return _fold(
        cells,
        profile="any_value(profile)",
        tails=_by_position("dow", "tail", 7),
        changes=_by_position("dow", "tail - tail7", 7),
        n="sum(pairs)",
        **{f"raw_{name}": centred(name, i, j) for name, (i, j) in PRODUCTS.items()},
        **{f"week_{name}": f"sum(week_{name})" for name in PRODUCTS},
    )


def _candidates(kind: str, weekly: bool) -> list[str]:
    """Structs of the candidates of one kind: coefficients, squared error, parameters."""
    cc, c1, c7, c11, c17, c77 = (f"{kind}_{name}" for name in PRODUCTS)
    det = f"({c11} * {c77} - {c17} * {c17})"
    solved = f"{det} > {DISTINCT} * {c11} * {c77}"
    both1, both7 = f"({c1} * {c77} - {c7} * {c17}) / {det}", f"({c7} * {c11} - {c1} * {c17}) / {det}"
    fits = [
        (False, False, "0D", "0D", "true"),
        (True, False, f"{c1} / {c11}", "0D", f"{c11} > 0"),
        (False, True, "0D", f"{c7} / {c77}", f"{c77} > 0"),
        (True, True, both1, both7, solved),
    ]
    means = 0 if weekly else 7
    out = []
    for lag1, lag7, phi1, phi7, fits_when in fits:
        error = f"greatest({EXACT} * {cc}, {cc} - ({phi1}) * {c1} - ({phi7}) * {c7})"
        out.append(
            f"""CASE WHEN {fits_when} THEN named_struct('differenced', {str(weekly).lower()},
                'lag1', {str(lag1).lower()}, 'lag7', {str(lag7).lower()}, 'phi1', {phi1},
                'phi7', {phi7}, 'sse', {error}, 'parameters', {means + lag1 + lag7}) END"""
        )
    return out


def chosen(daily: DataFrame, origins: Origins) -> DataFrame:
    """The best candidate of every fold beside what a forecast from it needs.

    `aic` is corrected for few days: n ln(sse / n) + 2 k n / (n - k - 1). Ties go to differences last and fewer lags first.
    """
    order = ["differenced", "int(lag1) + int(lag7)", "lag7"]
    plain = "NOT differenced AND NOT lag1 AND NOT lag7"
    candidates = ", ".join([*_candidates("raw", False), *_candidates("week", True)])
    fits = _moments(daily, origins).selectExpr("*", f"explode(array({candidates})) AS fit")
    fits = fits.filter("fit IS NOT NULL").selectExpr("*", "fit.*").drop("fit")
    fits = fits.filter(f"n > parameters + 1 OR ({plain})")
    aic = f"n * ln(greatest(sse / n, {NO_ERROR})) + 2D * parameters * n / (n - parameters - 1)"
    fits = fits.selectExpr("*", f"CASE WHEN n > parameters + 1 THEN {aic} END AS aic")
    kept = ["profile", "tails", "changes", "n", "differenced", "lag1", "lag7", "phi1", "phi7", "sse",
            "parameters", "aic"]
    best = f"min_by(struct({', '.join(kept)}), struct(aic IS NULL, round(aic, 6), {', '.join(order)}))"
    return fits.groupBy(*FOLD).agg(F.expr(f"{best} AS best")).selectExpr(*FOLD, "best.*")


def orders(daily: DataFrame, origins: Origins) -> DataFrame:
    return chosen(daily, origins).select(
        "series_key", "cutoff", "differenced", "lag1", "lag7", "phi1", "phi7", "aic"
    )


def _ahead(start: str, step: str, horizon: int) -> str:
    """Extend an array of seven values by a step on those one and seven back."""
    return f"""aggregate(sequence(1, {horizon}), {start}, (x, h) -> concat(x, array(
        {step.replace("ONE", "element_at(x, -1)").replace("SEVEN", "element_at(x, -7)")})))"""


def ar_select(daily: DataFrame, origins: Origins, horizon: int) -> DataFrame:
    """Forecasts by the candidate of least AIC, h days ahead by repeating its step."""
    own = "get(IF(differenced, changes, zip_with(tails, profile, (a, m) -> a - m)), d)"
    newest = "transform(sequence(1, 7), i -> (weekday(cutoff) + i) % 7)"
    impulse = "array(0D, 0D, 0D, 0D, 0D, 0D, 1D)"
    moved = "phi1 * ONE + phi7 * SEVEN"
    params = (
        chosen(daily, origins)
        .selectExpr("*", f"transform({newest}, d -> coalesce({own}, 0D)) AS week")
        .selectExpr("*", f"transform({newest}, d -> get(tails, d)) AS last")
        .selectExpr("*", f"{_ahead('week', moved, horizon)} AS path")
        .selectExpr("*", f"{_ahead(impulse, moved, horizon)} AS psi")
        .selectExpr("*", f"{_ahead('last', 'SEVEN + get(path, 6 + h)', horizon)} AS level")
        .selectExpr("*", f"{_ahead(impulse, 'SEVEN + get(psi, 6 + h)', horizon)} AS psi_level")
        .selectExpr("*", "IF(differenced, psi_level, psi) AS weights")
        .selectExpr("*", "CASE WHEN n > parameters THEN sqrt(greatest(0, sse) / (n - parameters)) END AS sigma")
    )
    spread = "aggregate(slice(weights, 7, h), 0D, (s, w) -> s + w * w)"
    return _over_days(
        params,
        "ar_select",
        horizon,
        False,
        yhat="""base + IF(differenced, get(level, 6 + h),
            get(profile, weekday(ds)) + get(path, 6 + h))""",
        sd=f"sigma * sqrt({spread})",
    )
