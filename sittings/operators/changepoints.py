"""A trend that may turn, and weekday effects.

Weekday means are taken off first. What is left is explained by a line and by hinges, lines that
begin at a changepoint. Candidates lie evenly over the first four fifths of a fold's days. One
after another the hinge that takes most of the error is added, as long as it lowers n ln(sse) by more
than a penalty for its place and its slope, up to `MOST` of them.

The products of hinges follow from their places alone, and those of a hinge with the values from running
sums of the series at the hinge's place. So every fold is set up from one row per series that
holds these running sums in order (one entry a day), without going through its days again.
Adding a hinge is a sweep of the fold's symmetric system, in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sittings.operators.models import _over_days
from sittings.operators.origins import Origins, with_calendar

CANDIDATES = 25
SHARE = 0.8  # of a fold's days hold candidates
MOST = 5

# What a hinge must lower n ln(sse) by, in units of ln(n).
PENALTY = 3

# A hinge that those before it explain but for this share is left out; an error below this share of all is none.
DISTINCT = "1e-9"


def _folds(daily: DataFrame, origins: Origins) -> DataFrame:
    """One row per fold: its days n and the series' running sums up to each day, in order."""
    running = {"y": "sum(v)", "ty": "sum(t * v)", "yy": "sum(v * v)"}
    running |= {f"w{i}": f"sum(IF(dow = {i}, v, 0D))" for i in range(7)}
    along = "OVER (PARTITION BY series_key ORDER BY ds ROWS UNBOUNDED PRECEDING)"
    key = ["series_key", "first_ds", "last_ds", "base"]
    sums = with_calendar(daily).selectExpr(*key, "ds", *[f"{agg} {along} AS {c}" for c, agg in running.items()])
    entry = f"struct(ds, y, ty, yy, array({', '.join(f'w{i}' for i in range(7))}) AS w)"
    rows = sums.groupBy(*key).agg(F.expr(f"array_sort(collect_list({entry})) AS upto"))
    folds = rows.selectExpr("*", f"explode({origins.cutoffs()}) AS cutoff")
    return folds.selectExpr("*", "datediff(cutoff, first_ds) + 1 AS n", "weekday(first_ds) AS f")


def _system(folds: DataFrame) -> DataFrame:
    """places (0 for the line, then the candidates), the system m with its right-hand side, total, weekday means."""
    weekdays = "sequence(0, 6)"
    # Days of weekday d among the first n, and the sum of their distances from a hinge they lie behind.
    counted = "greatest(0, int(floor((n - 1 - pmod(d - f, 7)) / 7)) + 1)"
    first = "(pmod(d - f - c - 1, 7) + 1)"
    behind = f"greatest(0, int(floor((n - 1 - c - {first}) / 7)) + 1)"
    distances = f"({behind} * {first} + 7D * {behind} * ({behind} - 1) / 2)"
    length = "(n - 1 - {})".format
    total = "{0} * ({0} + 1D) / 2".format
    products = "{0} * ({0} + 1D) * (2D * {0} + 1) / 6 + {1} * {0} * ({0} + 1D) / 2".format
    far = length("greatest(a, c)")
    product = f"{products(far, 'abs(a - c)')} - {total(length('a'))} * {total(length('c'))} / n"
    places = f"concat(array(0), transform(sequence(1, {CANDIDATES}), j -> int(floor({SHARE}D * (n - 1) * j / {CANDIDATES + 1}))))"
    rhs = f"""(last.ty - upto[c].ty) - c * (last.y - upto[c].y)
        - aggregate({weekdays}, 0D, (s, d) -> s + coalesce(means[d], 0D) * {distances})"""
    return (
        folds.selectExpr("*", "upto[n - 1] AS last", f"{places} AS places")
        .selectExpr("*", f"transform({weekdays}, d -> IF({counted} > 0, last.w[d] / {counted}, NULL)) AS means")
        .selectExpr(
            "*",
            f"""last.yy - aggregate({weekdays}, 0D, (s, d) ->
                s + IF({counted} > 0, last.w[d] * last.w[d] / {counted}, 0D)) AS total""",
            f"transform(places, a -> concat(transform(places, c -> {product}), transform(array(a), c -> {rhs}))) AS m",
            f"transform(places, c -> {total(length('c'))} / n) AS centres",
        )
        .drop("upto", "last")
    )


def _choice() -> str:
    """SQL: (m, sse, chosen) with the line and the hinges that pay, from m, total and n."""
    end = CANDIDATES + 1
    # One sweep by row k of s.m; `s.chosen` grows by k and the error shrinks by what k explains.
    row = "zip_with(row, s.m[k], (a, b) -> a - row[k] / s.m[k][k] * b)"
    swept = f"transform(s.m, (row, i) -> IF(i = k, transform(row, a -> a / s.m[k][k]), {row}))"
    gain = f"s.m[k][{end}] * s.m[k][{end}] / s.m[k][k]"
    taken = f"""named_struct('m', {swept}, 'sse', greatest({DISTINCT} * total, s.sse - {gain}),
        'chosen', concat(s.chosen, array(k)))"""

    def sweep(k: str, when: str) -> str:
        return f"IF({when}, element_at(transform(array({k}), k -> {taken}), 1), s)"

    start = "named_struct('m', m, 'sse', total, 'chosen', CAST(array() AS ARRAY<INT>))"
    line = f"element_at(transform(array({start}), s -> {sweep('0', 's.m[0][0] > 0')}), 1)"
    gains = f"""transform(sequence(0, {CANDIDATES}), k -> IF(k > 0 AND NOT array_contains(s.chosen, k)
        AND s.m[k][k] > {DISTINCT} * m[k][k], {gain}, 0D))"""
    best = f"int(array_position({gains}, array_max({gains})) - 1)"
    left = f"greatest({DISTINCT} * total, s.sse - array_max({gains}))"
    pays = f"array_max({gains}) > 0 AND s.sse > 0 AND n * ln(s.sse / {left}) > {PENALTY} * ln(n)"
    return f"aggregate(sequence(1, {MOST}), {line}, (s, step) -> {sweep(best, pays)})"


def fitted(daily: DataFrame, origins: Origins) -> DataFrame:
    """Per fold: weekday means, places, chosen and their slopes, sigma."""
    solved = _system(_folds(daily, origins)).selectExpr("*", f"{_choice()} AS s")
    chosen = f"transform(s.chosen, k -> named_struct('c', places[k], 'slope', s.m[k][{CANDIDATES + 1}], 'centre', centres[k]))"
    return solved.selectExpr(
        "series_key", "first_ds", "base", "cutoff", "n", "means", f"{chosen} AS hinges", "s.sse AS sse",
        "n - size(filter(means, x -> x IS NOT NULL)) - greatest(0, 2 * size(s.chosen) - 1) AS free",
    ).selectExpr("*", "CASE WHEN free > 0 THEN sqrt(greatest(0, sse) / free) END AS sigma")


def changes(daily: DataFrame, origins: Origins) -> DataFrame:
    """series_key, cutoff, the day of each changepoint and by how much the daily slope changes there."""
    hinges = fitted(daily, origins).selectExpr("series_key", "first_ds", "cutoff", "inline(filter(hinges, h -> h.c > 0))")
    return hinges.selectExpr("series_key", "cutoff", "date_add(first_ds, c) AS ds", "slope AS change")


def trends(daily: DataFrame, origins: Origins) -> DataFrame:
    """series_key, cutoff, changes, the first and the last daily slope, and sigma."""
    return fitted(daily, origins).selectExpr(
        "series_key",
        "cutoff",
        "greatest(0, size(hinges) - 1) AS changes",
        "coalesce(get(hinges, 0).slope, 0D) AS first_slope",
        "aggregate(hinges, 0D, (s, h) -> s + h.slope) AS last_slope",
        "sigma",
    )


def changepoint(
    daily: DataFrame, origins: Origins, horizon: int, history: bool = False
) -> DataFrame:
    """The trend's last slope goes on; a weekday never seen takes the mean of the others."""
    effect = """coalesce(means[weekday(ds)],
        aggregate(means, 0D, (s, m) -> s + coalesce(m, 0D)) / size(filter(means, x -> x IS NOT NULL)))"""
    trend = """aggregate(hinges, 0D, (s, h) ->
        s + h.slope * (greatest(0, datediff(ds, first_ds) - h.c) - h.centre))"""
    return _over_days(
        fitted(daily, origins),
        "changepoint",
        horizon,
        history,
        yhat=f"base + {effect} + {trend}",
        sd="sigma",
    )
