"""Closed-form forecasters, as DataFrame jobs over every series and origin at once.

Each takes a dense daily series and origins and returns
(series_key, model, cutoff, ds, yhat, sd) for the `horizon` days after each cutoff,
or from the first day on with `history=True`. `sd` is the standard deviation of the
training residuals (of the h-step error for the autoregressive model).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sittings.operators.origins import Origins, learn, with_calendar

# A month's index counts in full against so many days of index 1.
MONTH_DAYS = 30
FOLD = ["series_key", "first_ds", "base", "cutoff"]
BY_FOLD = "PARTITION BY series_key, first_ds, base, cutoff"

# Two-sided 80 % point of the normal distribution.
Z80 = 1.2816


def _by_position(position: str, value: str, n: int, first: int = 0) -> str:
    """Aggregate (position, value) rows into an array of n, NULL where there is none."""
    slots = [f"max(CASE WHEN {position} = {i} THEN {value} END)" for i in range(first, first + n)]
    return f"array({', '.join(slots)})"


def _sample_sd(n: str, total: str, squares: str) -> str:
    """Standard deviation from a count, a sum and a sum of squares."""
    spread = f"greatest(0, ({squares}) - ({total}) * ({total}) / {n})"
    return f"CASE WHEN {n} > 1 THEN sqrt({spread} / ({n} - 1)) END"


def _fold(cells: DataFrame, **aggregates: str) -> DataFrame:
    """Bring the cells of a fold together in one row."""
    return cells.groupBy(*FOLD).agg(
        *[F.expr(f"{agg} AS {name}") for name, agg in aggregates.items()]
    )


def _over_days(
    params: DataFrame, model: str, horizon: int, history: bool, yhat: str, sd: str
) -> DataFrame:
    """Evaluate a fitted model (one row per fold) on its days, `h` days ahead."""
    start = "first_ds" if history else "date_add(cutoff, 1)"
    days = f"explode(sequence({start}, date_add(cutoff, {horizon})))"
    return (
        params.withColumn("ds", F.expr(days))
        .withColumn("h", F.expr("datediff(ds, cutoff)"))
        .selectExpr(
            "series_key", f"'{model}' AS model", "cutoff", "ds", f"{yhat} AS yhat", f"{sd} AS sd"
        )
    )


def weekday_mean(
    daily: DataFrame, origins: Origins, horizon: int, history: bool = False
) -> DataFrame:
    """Each day is the training mean of its weekday; NULL for a weekday never seen."""
    sums = {"n": "count(*)", "sy": "sum(v)", "syy": "sum(v * v)"}
    cells = learn(with_calendar(daily), origins, ["dow"], sums)
    params = _fold(
        cells,
        profile=_by_position("dow", "sy / n", 7),
        n="sum(n)",
        sse="sum(syy - sy / n * sy)",
    )
    return _over_days(
        params,
        "weekday_mean",
        horizon,
        history,
        yhat="base + get(profile, weekday(ds))",
        sd=_sample_sd("n", "0", "sse"),
    )


TREND_SUMS = {
    "n": "sum(1D)",
    "st": "sum(t)",
    "stt": "sum(t * t)",
    "sy": "sum(v)",
    "sty": "sum(t * v)",
    "syy": "sum(v * v)",
}
TREND_FOLD = {
    "intercept": "max(intercept)",
    "slope": "max(slope)",
    "weeks": _by_position("dow", "week", 7),
    "years": _by_position("month", "year", 12, first=1),
    "residual": "sum(sy + gap * n - drift * st)",
    "squares": """sum(
        syy + gap * gap * n + drift * drift * stt
        + 2 * gap * sy - 2 * drift * sty - 2 * gap * drift * st)""",
}
TREND_YHAT = """(intercept + slope * datediff(ds, first_ds))
    * coalesce(get(weeks, weekday(ds)), 1) * coalesce(get(years, month(ds) - 1), 1)"""


def _indexed(cells: DataFrame, yearly: bool, *beside: str) -> DataFrame:
    """Cells of month and weekday with the fold's line, the indices, and what they leave of a value.

    `beside` are more columns taken over the whole fold.
    """

    def index(explained: str, over: str) -> str:
        part = f"OVER ({BY_FOLD}, {over})"
        level = f"sum({explained}) {part}"
        return f"CASE WHEN {level} > 0 THEN sum(sy + base * n) {part} / {level} ELSE 1D END"

    spread = "all_n * all_stt - all_st * all_st"
    cross = "all_n * all_sty - all_st * all_sy"
    slope = f"CASE WHEN {spread} > 0 THEN ({cross}) / ({spread}) ELSE 0D END"
    month_days = f"sum(n) OVER ({BY_FOLD}, month)"
    share = f"{month_days} / ({month_days} + {MONTH_DAYS})" if yearly else "0D"
    return (
        cells.selectExpr(
            "*",
            *[f"sum({c}) OVER ({BY_FOLD}) AS all_{c}" for c in ("n", "st", "stt", "sy", "sty")],
            *beside,
        )
        .selectExpr("*", f"{slope} AS slope")
        .selectExpr("*", "base + (all_sy - slope * all_st) / all_n AS intercept")
        .selectExpr("*", "intercept * n + slope * st AS line")
        .selectExpr("*", f"{index('line', 'dow')} AS week")
        .selectExpr("*", "week * line AS weekly")
        .selectExpr("*", f"1D + {share} * ({index('weekly', 'month')} - 1D) AS year")
        # What the model leaves of a day's value is v + gap - drift * t.
        .selectExpr("*", "base - week * year * intercept AS gap", "week * year * slope AS drift")
    )


def seasonal_trend(
    daily: DataFrame,
    origins: Origins,
    horizon: int,
    history: bool = False,
    yearly: bool = True,
) -> DataFrame:
    """Linear trend times a weekday index times (with `yearly`) a month index.

    The trend is the least-squares line. An index is the ratio of what was observed
    on its days to what the factors before it explain there, so it follows from sums
    per (month, weekday) alone. A month's index is drawn towards 1 by MONTH_DAYS days of
    it, so that it gains weight with the days it rests on.
    """
    cells = _indexed(learn(with_calendar(daily), origins, ["month", "dow"], TREND_SUMS), yearly)
    params = _fold(cells, n="sum(n)", **TREND_FOLD)
    return _over_days(
        params,
        "seasonal_trend",
        horizon,
        history,
        yhat=TREND_YHAT,
        sd=_sample_sd("n", "residual", "squares"),
    )


# Sums over a day's value v and the one before it, u, skip the very first day.
PAIRED = {
    "pairs": "count(u)",
    "pv": "sum(CASE WHEN u IS NOT NULL THEN v END)",
    "pu": "sum(u)",
    "pvu": "sum(v * u)",
    "pvv": "sum(CASE WHEN u IS NOT NULL THEN v * v END)",
    "puu": "sum(u * u)",
}
# Moments of the residual r and the one before it, s, over paired days.
AR1_FOLD = {
    "pairs": "sum(pairs)",
    "r": "sum(pv - m * pairs)",
    "s": "sum(pu - p * pairs)",
    "rs": "sum(pvu - p * pv - m * pu + m * p * pairs)",
    "ss": "sum(puu - 2 * p * pu + p * p * pairs)",
    "rr": "sum(pvv - 2 * m * pv + m * m * pairs)",
    "last_residual": "max(CASE WHEN seen = cutoff THEN tail - m END)",
}
AR1_YHAT = "base + get(profile, weekday(ds)) + pow(phi, h) * last_residual"
_GROWTH = "CASE WHEN phi * phi < 1 THEN (1 - pow(phi * phi, h)) / (1 - phi * phi) ELSE h END"
AR1_SD = f"""({_sample_sd("pairs", "r - phi * s", "rr - 2 * phi * rs + phi * phi * ss")}) * sqrt({_GROWTH})"""


def _with_phi(moments: DataFrame) -> DataFrame:
    var = "(ss - s * s / pairs)"
    slope = f"least(1D, greatest(-1D, (rs - r * s / pairs) / {var}))"
    return moments.selectExpr("*", f"CASE WHEN pairs > 1 AND {var} > 0 THEN {slope} ELSE 0D END AS phi")


def seasonal_ar1(daily: DataFrame, origins: Origins, horizon: int) -> DataFrame:
    """Weekday mean plus a first-order autoregression of what it leaves over.

    h days ahead the last residual still counts phi^h. phi is the regression slope of
    each residual on the one before, which expands into sums of y, of the day before
    and of their products per weekday. It is held to [-1, 1], and 0 where the
    residuals do not vary.
    """
    days = with_calendar(daily).selectExpr(
        "*", "lag(v) OVER (PARTITION BY series_key ORDER BY ds) AS u"
    )
    sums = {
        "n": "count(*)",
        "sy": "sum(v)",
        "seen": "max(ds)",
        "tail": "max_by(v, ds)",
        **PAIRED,
    }
    # m: this weekday's mean; p: that of the weekday before, 0 where there are no pairs.
    profile = [f"max(CASE WHEN dow = {i} THEN sy / n END) OVER ({BY_FOLD})" for i in range(7)]
    cells = learn(days, origins, ["dow"], sums).selectExpr(
        "*", f"array({', '.join(profile)}) AS profile"
    )
    cells = cells.selectExpr(
        *FOLD,
        "dow",
        "seen",
        "tail",
        "profile",
        "sy / n AS m",
        "coalesce(get(profile, (dow + 6) % 7), 0) AS p",
        *[f"coalesce({c}, 0) AS {c}" for c in PAIRED],
    )
    # Moments of the residual r and the one before it, s, over paired days.
    params = _with_phi(_fold(cells, profile="any_value(profile)", **AR1_FOLD))
    return _over_days(
        params,
        "seasonal_ar1",
        horizon,
        False,
        yhat=AR1_YHAT,
        sd=AR1_SD,
    )


def closed_forms(
    daily: DataFrame,
    origins: Origins,
    horizon: int,
    chosen: tuple[str, ...] = ("weekday_mean", "seasonal_trend", "seasonal_ar1"),
) -> DataFrame:
    """Forecasts of the three models above from one pass over the days.

    All that they learn are sums by month and weekday, so one set of running totals serves them: weekdays
    sum theirs over the months. A fold is one row with every model's parameters, and its days are made once.
    """
    days = with_calendar(daily).selectExpr(
        "*", "lag(v) OVER (PARTITION BY series_key ORDER BY ds) AS u"
    )
    sums = {**TREND_SUMS, "seen": "max(ds)", "tail": "max_by(v, ds)", **PAIRED}
    by_weekday = f"OVER ({BY_FOLD}, dow)"
    cells = learn(days, origins, ["month", "dow"], sums)
    cells = cells.withColumns({c: F.coalesce(c, F.lit(0)) for c in PAIRED})
    cells = cells.selectExpr("*", f"sum(sy) {by_weekday} / sum(n) {by_weekday} AS m")
    profile = [f"max(CASE WHEN dow = {i} THEN m END) OVER ({BY_FOLD})" for i in range(7)]
    cells = _indexed(cells, True, f"array({', '.join(profile)}) AS profile")
    cells = cells.selectExpr("*", "coalesce(get(profile, (dow + 6) % 7), 0) AS p")
    params = _with_phi(
        _fold(
            cells,
            profile="any_value(profile)",
            n="sum(n)",
            sse="sum(syy - m * sy)",
            **TREND_FOLD,
            **AR1_FOLD,
        )
    )
    made = {
        "weekday_mean": ("base + get(profile, weekday(ds))", _sample_sd("n", "0", "sse")),
        "seasonal_trend": (TREND_YHAT, _sample_sd("n", "residual", "squares")),
        "seasonal_ar1": (AR1_YHAT, AR1_SD),
    }
    models = ", ".join(
        f"named_struct('model', '{name}', 'yhat', double({yhat}), 'sd', double({sd}))"
        for name, (yhat, sd) in made.items()
        if name in chosen
    )
    ahead = f"explode(sequence(date_add(cutoff, 1), date_add(cutoff, {horizon})))"
    return (
        params.withColumn("ds", F.expr(ahead))
        .withColumn("h", F.expr("datediff(ds, cutoff)"))
        .selectExpr("series_key", "cutoff", "ds", f"inline(array({models}))")
        .select("series_key", "model", "cutoff", "ds", "yhat", "sd")
    )


def with_interval(forecast: DataFrame) -> DataFrame:
    """Replace `sd` by the bounds of an 80 % normal interval."""
    kept = [c for c in forecast.columns if c != "sd"]
    return forecast.selectExpr(
        *kept, f"yhat - {Z80}D * sd AS yhat_lower", f"yhat + {Z80}D * sd AS yhat_upper"
    )
