"""Daily series, forecasts and evaluation as plain SQL over the given tables.

Folds are joined to their whole history here, which the Spark jobs avoid.
"""

from __future__ import annotations

from sittings.oracle.listening import PLAYS, SESSIONS, sessionized

SEGMENT_DAILY = """
sparse AS (
  SELECT c_mktsegment AS series_key, CAST(o_orderdate AS DATE) AS ds, count(*) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
)"""

USER_DAILY = f"""
{PLAYS}, {sessionized(1200)}, {SESSIONS},
sparse AS (
  SELECT user_id AS series_key, CAST(start_ts AS DATE) AS ds, count(*) AS y
  FROM sessions GROUP BY 1, 2
)"""

TOP_USER_DAILY = f"""
{PLAYS}, {sessionized(1200)}, {SESSIONS},
sparse AS (
  SELECT user_id AS series_key, CAST(start_ts AS DATE) AS ds, count(*) AS y
  FROM sessions WHERE user_id = (
    SELECT user_id FROM sessions GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)
  GROUP BY 1, 2
)"""

DENSE = """
bounds AS (SELECT series_key, min(ds) AS lo, max(ds) AS hi FROM sparse GROUP BY 1),
days AS (
  SELECT series_key, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds
  FROM bounds
),
daily AS (
  SELECT series_key, ds, CAST(coalesce(y, 0) AS BIGINT) AS y
  FROM days LEFT JOIN sparse USING (series_key, ds)
)"""

SEGMENT_SERIES = f"{SEGMENT_DAILY}, {DENSE}"
MIXED_SERIES = f"""
sparse AS (
  SELECT * FROM (WITH {SEGMENT_DAILY} SELECT * FROM sparse)
  QUALIFY series_key >= 'F' OR ds > max(ds) OVER (PARTITION BY series_key) - 20
), {DENSE}"""
TSV_SERIES = f"""{USER_DAILY.replace("user_id AS series_key", "CAST(user_id AS VARCHAR) AS series_key")},
{DENSE}"""
USER_SERIES = f"{USER_DAILY}, {DENSE}"
TOP_USER_SERIES = f"{TOP_USER_DAILY}, {DENSE}"

TSV_TOP_USER_SERIES = TOP_USER_SERIES.replace(
    "user_id AS series_key", "CAST(user_id AS VARCHAR) AS series_key"
).replace("DESC, user_id LIMIT", "DESC, CAST(user_id AS VARCHAR) LIMIT")

AT_END = "folds AS (SELECT series_key, hi AS cutoff FROM bounds)"


def held_out(days: int) -> str:
    return f"""folds AS (
  SELECT series_key, hi - {days} AS cutoff FROM bounds WHERE hi - {days} >= lo
)"""


def rolling(initial: int, period: int, horizon: int) -> str:
    return f"""folds AS (
  SELECT series_key, CAST(hi - {horizon} - {period} * CAST(k AS INTEGER) AS DATE) AS cutoff
  FROM (SELECT *, unnest(range(0, (hi - lo) // {period} + 1)) AS k FROM bounds)
  WHERE hi - {horizon} - {period} * CAST(k AS INTEGER) >= lo + {initial}
)"""


SEGMENT_FOLDS = rolling(180, 30, 30)
USER_FOLDS = rolling(14, 7, 7)

TRAIN = """
train AS (
  SELECT f.series_key, f.cutoff, d.ds, d.y, d.ds - b.lo AS t, isodow(d.ds) - 1 AS dow,
         month(d.ds) AS mon,
         lag(d.y) OVER (PARTITION BY f.series_key, f.cutoff ORDER BY d.ds) AS before
  FROM folds f JOIN bounds b USING (series_key)
  JOIN daily d ON d.series_key = f.series_key AND d.ds <= f.cutoff
),
means AS (SELECT series_key, cutoff, dow, avg(y) AS m FROM train GROUP BY 1, 2, 3)"""


def ahead(horizon: int, history: bool = False) -> str:
    start = "lo" if history else "cutoff + 1"
    return f"""
ahead AS (
  SELECT series_key, cutoff, lo, isodow(ds) - 1 AS dow, month(ds) AS mon, ds, ds - cutoff AS h
  FROM (SELECT series_key, cutoff, lo,
               CAST(unnest(generate_series({start}, cutoff + {horizon}, INTERVAL 1 DAY)) AS DATE)
                 AS ds
        FROM folds JOIN bounds USING (series_key))
)"""


WEEKDAY_MEAN = """
weekday_mean AS (
  SELECT a.series_key, 'weekday_mean' AS model, a.cutoff, a.ds, m AS yhat, sd
  FROM ahead a LEFT JOIN means USING (series_key, cutoff, dow)
  JOIN (SELECT series_key, cutoff, stddev_samp(y - m) AS sd
        FROM train JOIN means USING (series_key, cutoff, dow) GROUP BY 1, 2) s
    USING (series_key, cutoff)
)"""

SEASONAL_TREND = """
lines AS (
  SELECT series_key, cutoff, CASE WHEN count(*) > 1 THEN regr_slope(y, t) ELSE 0 END AS b,
         CASE WHEN count(*) > 1 THEN regr_intercept(y, t) ELSE avg(y) END AS a
  FROM train GROUP BY 1, 2
),
weeks AS (
  SELECT series_key, cutoff, dow,
         CASE WHEN sum(a + b * t) > 0 THEN sum(y) / sum(a + b * t) ELSE 1 END AS w
  FROM train JOIN lines USING (series_key, cutoff) GROUP BY 1, 2, 3
),
years AS (
  SELECT series_key, cutoff, mon,
         CASE WHEN sum(w * (a + b * t)) > 0
              THEN 1 + count(*) / (count(*) + 30.0) * (sum(y) / sum(w * (a + b * t)) - 1)
              ELSE 1 END AS s
  FROM train JOIN lines USING (series_key, cutoff) JOIN weeks USING (series_key, cutoff, dow)
  GROUP BY 1, 2, 3
),
seasonal_trend AS (
  SELECT x.series_key, 'seasonal_trend' AS model, x.cutoff, x.ds,
         (a + b * (x.ds - x.lo)) * coalesce(w, 1) * coalesce(s, 1) + 0 AS yhat, sd
  FROM ahead x JOIN lines USING (series_key, cutoff)
  LEFT JOIN weeks USING (series_key, cutoff, dow)
  LEFT JOIN years USING (series_key, cutoff, mon)
  JOIN (SELECT series_key, cutoff, stddev_samp(y - (a + b * t) * w * s) AS sd
        FROM train JOIN lines USING (series_key, cutoff)
        JOIN weeks USING (series_key, cutoff, dow) JOIN years USING (series_key, cutoff, mon)
        GROUP BY 1, 2) e USING (series_key, cutoff)
)"""

SEASONAL_AR1 = """
residuals AS (
  SELECT series_key, cutoff, ds, before, y - m AS r,
         lag(y - m) OVER (PARTITION BY series_key, cutoff ORDER BY ds) AS s
  FROM train JOIN means USING (series_key, cutoff, dow)
),
phis AS (
  SELECT series_key, cutoff, arg_max(r, ds) AS tail,
         CASE WHEN count(s) > 1 AND var_pop(s) > 0
              THEN greatest(-1, least(1, regr_slope(r, s))) ELSE 0 END AS phi
  FROM residuals GROUP BY 1, 2
),
steps AS (
  SELECT series_key, cutoff, stddev_samp(r - phi * s) AS step
  FROM residuals JOIN phis USING (series_key, cutoff) GROUP BY 1, 2
),
seasonal_ar1 AS (
  SELECT a.series_key, 'seasonal_ar1' AS model, a.cutoff, a.ds,
         m + pow(phi, h) * tail AS yhat,
         step * sqrt(CASE WHEN phi * phi < 1 THEN (1 - pow(phi * phi, h)) / (1 - phi * phi)
                          ELSE h END) AS sd
  FROM ahead a LEFT JOIN means USING (series_key, cutoff, dow)
  JOIN phis USING (series_key, cutoff) JOIN steps USING (series_key, cutoff)
)"""

MODELS = {
    "weekday_mean": WEEKDAY_MEAN,
    "seasonal_trend": SEASONAL_TREND,
    "seasonal_ar1": SEASONAL_AR1,
}


# Candidates of an autoregression, compared by AICc on days with two weeks behind them.
AR_CHOICE = """
ar_days AS (
  SELECT l.*, a.m, y - a.m AS r, u1 - b.m AS r1, u7 - a.m AS r7
  FROM (SELECT *, lag(y, 1) OVER w AS u1, lag(y, 7) OVER w AS u7, lag(y, 8) OVER w AS u8,
               lag(y, 14) OVER w AS u14
        FROM train WINDOW w AS (PARTITION BY series_key, cutoff ORDER BY ds)) l
  JOIN means a USING (series_key, cutoff, dow)
  LEFT JOIN means b ON b.series_key = l.series_key AND b.cutoff = l.cutoff
    AND b.dow = (l.dow + 6) % 7
),
ar_pairs AS (
  SELECT series_key, cutoff, false AS differenced, 7 AS means, r AS x, r1 AS x1, r7 AS x7
  FROM ar_days WHERE u14 IS NOT NULL
  UNION ALL SELECT series_key, cutoff, true, 0, y - u7, u1 - u8, u7 - u14
  FROM ar_days WHERE u14 IS NOT NULL
),
ar_sums AS (
  SELECT series_key, cutoff, differenced, any_value(means) AS means, count(*) AS n,
         sum(x * x) AS cc, sum(x * x1) AS c1, sum(x * x7) AS c7, sum(x1 * x1) AS c11,
         sum(x1 * x7) AS c17, sum(x7 * x7) AS c77
  FROM ar_pairs GROUP BY 1, 2, 3
),
ar_fits AS (
  SELECT *, c11 * c77 - c17 * c17 AS det,
         CASE WHEN lag1 AND lag7 THEN (c1 * c77 - c7 * c17) / nullif(c11 * c77 - c17 * c17, 0)
              WHEN lag1 THEN c1 / nullif(c11, 0) ELSE 0 END AS phi1,
         CASE WHEN lag1 AND lag7 THEN (c7 * c11 - c1 * c17) / nullif(c11 * c77 - c17 * c17, 0)
              WHEN lag7 THEN c7 / nullif(c77, 0) ELSE 0 END AS phi7,
         means + CAST(lag1 AS INTEGER) + CAST(lag7 AS INTEGER) AS parameters
  FROM ar_sums
  CROSS JOIN (VALUES (false, false), (true, false), (false, true), (true, true)) f(lag1, lag7)
  WHERE n > means + CAST(lag1 AS INTEGER) + CAST(lag7 AS INTEGER) + 1 AND (NOT lag1 OR c11 > 0) AND (NOT lag7 OR c77 > 0)
    AND (NOT lag1 OR NOT lag7 OR c11 * c77 - c17 * c17 > 1e-9 * c11 * c77)
),
ar_scored AS (
  SELECT series_key, cutoff, differenced, lag1, lag7, phi1, phi7, n, parameters,
         greatest(1e-9 * cc, cc - phi1 * c1 - phi7 * c7) AS sse,
         n * ln(greatest(greatest(1e-9 * cc, cc - phi1 * c1 - phi7 * c7) / n, 1e-300))
           + 2.0 * parameters * n / (n - parameters - 1) AS aic
  FROM ar_fits
),
ar_best AS (
  SELECT * FROM ar_scored
  QUALIFY row_number() OVER (PARTITION BY series_key, cutoff ORDER BY round(aic, 6), differenced,
    CAST(lag1 AS INTEGER) + CAST(lag7 AS INTEGER), lag7) = 1
  UNION ALL
  SELECT series_key, cutoff, false, false, false, 0, 0, n, 7, sse, NULL
  FROM (SELECT f.series_key, f.cutoff, count(r) FILTER (u14 IS NOT NULL) AS n,
               sum(r * r) FILTER (u14 IS NOT NULL) AS sse
        FROM folds f LEFT JOIN ar_days d ON f.series_key = d.series_key AND f.cutoff = d.cutoff
        GROUP BY 1, 2)
  WHERE (series_key, cutoff) NOT IN (SELECT (series_key, cutoff) FROM ar_scored)
)"""


def ar_select(horizon: int) -> str:
    return f"""{AR_CHOICE},
ar_start AS (
  SELECT series_key, cutoff, any_value(b.differenced) AS differenced, any_value(phi1) AS phi1,
         any_value(phi7) AS phi7,
         list(CASE WHEN b.differenced THEN y - u7 ELSE r END ORDER BY ds) AS x,
         list(CAST(y AS DOUBLE) ORDER BY ds) AS z,
         CASE WHEN any_value(b.n) > any_value(parameters)
              THEN sqrt(greatest(0, any_value(sse)) / (any_value(b.n) - any_value(parameters))) END
           AS sigma
  FROM ar_best b JOIN ar_days d USING (series_key, cutoff)
  WHERE ds > cutoff - 7 GROUP BY 1, 2
),
ar_steps AS (
  SELECT series_key, cutoff, differenced, phi1, phi7, sigma, 0 AS h, x, z,
         [0, 0, 0, 0, 0, 0, 1]::DOUBLE[] AS w, [0, 0, 0, 0, 0, 0, 1]::DOUBLE[] AS wz, 0::DOUBLE AS s
  FROM ar_start
  UNION ALL
  SELECT series_key, cutoff, differenced, phi1, phi7, sigma, h + 1, list_append(x[2:], nx),
         list_append(z[2:], z[1] + nx), list_append(w[2:], nw), list_append(wz[2:], wz[1] + nw),
         s + CASE WHEN differenced THEN wz[7] * wz[7] ELSE w[7] * w[7] END
  FROM (SELECT *, phi1 * coalesce(x[-1], 0) + phi7 * coalesce(x[1], 0) AS nx,
               phi1 * w[7] + phi7 * w[1] AS nw
        FROM ar_steps WHERE h < {horizon})
),
ar_select AS (
  SELECT a.series_key, 'ar_select' AS model, a.cutoff, a.ds,
         CASE WHEN differenced THEN z[-1] ELSE m + x[-1] END AS yhat, sigma * sqrt(s) AS sd
  FROM ahead a JOIN ar_steps USING (series_key, cutoff, h)
  LEFT JOIN means USING (series_key, cutoff, dow)
)"""


LEVINSON_FIT = """
lev_x AS (
  SELECT series_key, cutoff, ds, y - m AS x, count(*) OVER (PARTITION BY series_key, cutoff) AS n
  FROM train JOIN means USING (series_key, cutoff, dow)
),
lev_lags AS (
  SELECT a.series_key, a.cutoff, any_value(a.n) AS n, k, coalesce(sum(a.x * b.x), 0) / any_value(a.n) AS c
  FROM lev_x a CROSS JOIN range(15) r(k)
  LEFT JOIN lev_x b ON b.series_key = a.series_key AND b.cutoff = a.cutoff AND b.ds = a.ds - CAST(k AS INTEGER)
  GROUP BY 1, 2, 4
),
lev_steps AS (
  SELECT series_key, cutoff, any_value(n) AS n, list(c ORDER BY k) AS g, 0 AS k,
         CAST([] AS DOUBLE[]) AS phi, arg_min(c, k) AS error
  FROM lev_lags GROUP BY 1, 2
  UNION ALL
  SELECT series_key, cutoff, n, g, k + 1,
         list_append(list_transform(phi, lambda f, j: f - r * phi[k + 1 - j]), r), error * (1 - r * r)
  FROM (SELECT *, (g[k + 2] - coalesce(list_sum(list_transform(phi, lambda f, j: f * g[k + 2 - j])), 0)) / error AS r
        FROM lev_steps WHERE k < 14 AND error > 1e-9 * g[1])
),
lev_best AS (
  SELECT series_key, cutoff, n, k AS p, phi, error,
         CASE WHEN n > k + 8 THEN round(n * ln(greatest(error, 1e-9 * g[1], 1e-300))
           + 2.0 * (k + 7) * n / (n - k - 8), 6) END AS aic
  FROM lev_steps
  QUALIFY row_number() OVER (PARTITION BY series_key, cutoff ORDER BY aic NULLS LAST, k) = 1
),
lev_fit AS (
  SELECT *, CASE WHEN n > p + 7 THEN sqrt(greatest(0, error) * n / (n - p - 7)) END AS sigma FROM lev_best
)"""


def ar_levinson(horizon: int) -> str:
    zeros = ", ".join(["0"] * 13)
    return f"""{LEVINSON_FIT},
lev_start AS (
  SELECT series_key, cutoff, any_value(phi) AS phi, any_value(sigma) AS sigma,
         list(coalesce(x, 0) ORDER BY back DESC) AS x
  FROM lev_fit CROSS JOIN range(14) r(back)
  LEFT JOIN (SELECT series_key, cutoff, CAST(cutoff - ds AS BIGINT) AS back, x FROM lev_x)
    USING (series_key, cutoff, back)
  GROUP BY 1, 2
),
lev_path AS (
  SELECT series_key, cutoff, phi, sigma, 0 AS h, x, [{zeros}, 1]::DOUBLE[] AS w, 0::DOUBLE AS s FROM lev_start
  UNION ALL
  SELECT series_key, cutoff, phi, sigma, h + 1,
         list_append(x[2:], coalesce(list_sum(list_transform(phi, lambda f, j: f * x[15 - j])), 0)),
         list_append(w[2:], coalesce(list_sum(list_transform(phi, lambda f, j: f * w[15 - j])), 0)),
         s + w[14] * w[14]
  FROM lev_path WHERE h < {horizon}
),
ar_levinson AS (
  SELECT a.series_key, 'ar_levinson' AS model, a.cutoff, a.ds, m + x[14] AS yhat, sigma * sqrt(s) AS sd
  FROM ahead a JOIN lev_path USING (series_key, cutoff, h) LEFT JOIN means USING (series_key, cutoff, dow)
)"""


# Every subset of four terms: normal equations on days with three weeks behind them, swept column by column.
ARMA_FIT = f"""{LEVINSON_FIT},
arma_long AS (
  SELECT series_key, cutoff, phi FROM lev_steps
  QUALIFY row_number() OVER (PARTITION BY series_key, cutoff ORDER BY k DESC) = 1
),
arma_e AS (
  SELECT series_key, cutoff, ds, x, lag(x, 1) OVER w AS x1, lag(x, 7) OVER w AS x7,
         CASE WHEN row_number() OVER w > 14 THEN x - coalesce(list_sum(list_transform(phi, lambda f, j:
           f * (list(x) OVER (w ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))[15 - j])), 0) END AS e
  FROM lev_x JOIN arma_long USING (series_key, cutoff) WINDOW w AS (PARTITION BY series_key, cutoff ORDER BY ds)
),
arma_z AS (
  SELECT *, lag(e, 1) OVER w AS e1, lag(e, 7) OVER w AS e7
  FROM arma_e WINDOW w AS (PARTITION BY series_key, cutoff ORDER BY ds)
),
arma_sums AS (
  SELECT series_key, cutoff, count(e7) AS n,
         coalesce(sum(x * x) FILTER (e7 IS NOT NULL), 0) AS total,
         list_transform([sum(x * x1) FILTER (e7 IS NOT NULL), sum(x * x7) FILTER (e7 IS NOT NULL),
           sum(x * e1) FILTER (e7 IS NOT NULL), sum(x * e7)], lambda v: coalesce(v, 0)) AS b,
         list_transform([sum(x1 * x1) FILTER (e7 IS NOT NULL), sum(x1 * x7) FILTER (e7 IS NOT NULL),
           sum(x1 * e1) FILTER (e7 IS NOT NULL), sum(x1 * e7),
           sum(x7 * x7) FILTER (e7 IS NOT NULL), sum(x7 * e1) FILTER (e7 IS NOT NULL), sum(x7 * e7),
           sum(e1 * e1) FILTER (e7 IS NOT NULL), sum(e1 * e7), sum(e7 * e7)], lambda v: coalesce(v, 0)) AS s
  FROM arma_z GROUP BY 1, 2
),
arma_sets AS (
  SELECT *, [q % 2, q // 2 % 2, q // 4 % 2, q // 8 % 2] AS mask,
         [[s[1], s[2], s[3], s[4]], [s[2], s[5], s[6], s[7]], [s[3], s[6], s[8], s[9]], [s[4], s[7], s[9], s[10]]] AS a
  FROM arma_sums CROSS JOIN range(16) r(q)
),
arma_sweep AS (
  SELECT series_key, cutoff, mask, 0 AS k,
         list_transform(a, lambda row, i: list_append(list_transform(row, lambda v, j:
           CASE WHEN mask[i] * mask[j] = 1 THEN v WHEN i = j THEN 1 ELSE 0 END), mask[i] * b[i])) AS m,
         list_transform(a, lambda row, i: CASE WHEN mask[i] = 1 THEN row[i] ELSE 1 END) AS d
  FROM arma_sets
  UNION ALL
  SELECT series_key, cutoff, mask, k + 1,
         CASE WHEN m[k + 1][k + 1] > 1e-9 * d[k + 1] AND d[k + 1] > 0 THEN
           list_transform(m, lambda row, i: list_transform(row, lambda v, j:
             CASE WHEN i = k + 1 THEN v / m[k + 1][k + 1]
                  ELSE v - row[k + 1] / m[k + 1][k + 1] * m[k + 1][j] END))
         ELSE list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN [0, 0, 0, 0, 0]::DOUBLE[] ELSE row END) END, d
  FROM arma_sweep WHERE k < 4
),
arma_fits AS (
  SELECT f.*, n, total, list_sum(f.mask) AS terms,
         greatest(1e-9 * total, total - c[1] * b[1] - c[2] * b[2] - c[3] * b[3] - c[4] * b[4]) AS sse
  FROM (SELECT series_key, cutoff, mask, [m[1][5], m[2][5], m[3][5], m[4][5]] AS c FROM arma_sweep WHERE k = 4) f
  JOIN arma_sums USING (series_key, cutoff)
),
arma_best AS (
  SELECT *, CASE WHEN n > terms + 7 THEN sqrt(sse / (n - terms - 7)) END AS sigma,
         CASE WHEN n > terms + 8 THEN round(n * ln(greatest(sse / n, 1e-300))
           + 2.0 * (terms + 7) * n / (n - terms - 8), 6) END AS aic
  FROM arma_fits WHERE abs(c[1]) + abs(c[2]) < 1 AND (n > terms + 8 OR terms = 0)
  QUALIFY row_number() OVER (PARTITION BY series_key, cutoff ORDER BY aic NULLS LAST, terms, mask DESC) = 1
)"""


def arma(horizon: int) -> str:
    zeros = ", ".join(["0"] * 6)
    return f"""{ARMA_FIT},
arma_start AS (
  SELECT series_key, cutoff, any_value(c) AS c, any_value(sigma) AS sigma,
         list(coalesce(x, 0) ORDER BY back DESC) AS x, list(coalesce(e, 0) ORDER BY back DESC) AS e
  FROM arma_best CROSS JOIN range(7) r(back)
  LEFT JOIN (SELECT series_key, cutoff, CAST(cutoff - ds AS BIGINT) AS back, x, e FROM arma_z)
    USING (series_key, cutoff, back)
  GROUP BY 1, 2
),
arma_path AS (
  SELECT series_key, cutoff, c, sigma, 0 AS h, x, list_concat(e, [0]::DOUBLE[]) AS e,
         [{zeros}, 1]::DOUBLE[] AS w, [{zeros}, 1, 0]::DOUBLE[] AS we, 0::DOUBLE AS s FROM arma_start
  UNION ALL
  SELECT series_key, cutoff, c, sigma, h + 1,
         list_append(x[2:], c[1] * x[7] + c[2] * x[1] + c[3] * e[7] + c[4] * e[1]),
         list_append(e[2:], 0),
         list_append(w[2:], c[1] * w[7] + c[2] * w[1] + c[3] * we[7] + c[4] * we[1]),
         list_append(we[2:], 0), s + w[7] * w[7]
  FROM arma_path WHERE h < {horizon}
),
arma AS (
  SELECT a.series_key, 'arma' AS model, a.cutoff, a.ds, m + x[7] AS yhat, sigma * sqrt(s) AS sd
  FROM ahead a JOIN arma_path USING (series_key, cutoff, h) LEFT JOIN means USING (series_key, cutoff, dow)
)"""


# One line and 25 hinges: sums of their products by formula, those with the values day by day.
CHANGEPOINTS = """
cp_x AS (
  SELECT series_key, cutoff, t, y - m AS x, count(*) OVER (PARTITION BY series_key, cutoff) AS n
  FROM train JOIN means USING (series_key, cutoff, dow)
),
cp_fold AS (SELECT series_key, cutoff, any_value(n) AS n, sum(x * x) AS total FROM cp_x GROUP BY 1, 2),
cp_place AS (
  SELECT *, CASE WHEN j = 0 THEN 0 ELSE CAST(floor(0.8::DOUBLE * (n - 1) * j / 26) AS BIGINT) END AS c
  FROM cp_fold CROSS JOIN range(26) r(j)
),
cp_sums AS (
  SELECT p.series_key, p.cutoff, j, any_value(p.n) AS n, any_value(total) AS total, any_value(c) AS c,
         coalesce(sum((t - c) * x) FILTER (t > c), 0) AS b, (any_value(p.n) - 1 - any_value(c)) AS l
  FROM cp_place p JOIN cp_x x ON p.series_key = x.series_key AND p.cutoff = x.cutoff
  GROUP BY 1, 2, 3
),
cp_rows AS (
  SELECT a.series_key, a.cutoff, a.j, any_value(a.n) AS n, any_value(a.total) AS total, any_value(a.c) AS c,
         any_value(a.l * (a.l + 1.0::DOUBLE) / 2 / a.n) AS centre,
         list_append(list(least(a.l, z.l) * (least(a.l, z.l) + 1.0::DOUBLE) * (2 * least(a.l, z.l) + 1) / 6
           + abs(a.c - z.c) * least(a.l, z.l) * (least(a.l, z.l) + 1.0::DOUBLE) / 2
           - a.l * (a.l + 1.0::DOUBLE) / 2 * (z.l * (z.l + 1.0::DOUBLE) / 2) / a.n ORDER BY z.j), any_value(a.b)) AS row
  FROM cp_sums a JOIN cp_sums z ON a.series_key = z.series_key AND a.cutoff = z.cutoff
  GROUP BY 1, 2, 3
),
cp_start AS (
  SELECT series_key, cutoff, any_value(n) AS n, any_value(total) AS total, list(row ORDER BY j) AS m,
         list(c ORDER BY j) AS places, list(centre ORDER BY j) AS centres
  FROM cp_rows GROUP BY 1, 2
),
cp_steps AS (
  SELECT series_key, cutoff, n, total, places, centres, m, list_transform(m, lambda row, i: row[i]) AS d, total AS sse,
         CAST([] AS BIGINT[]) AS chosen, 0 AS step, CASE WHEN m[1][1] > 0 THEN 1 ELSE 0 END AS k
  FROM cp_start
  UNION ALL
  SELECT series_key, cutoff, n, total, places, centres, m, d, sse, chosen, step,
         CASE WHEN sse > 0 AND list_max(gains) > 0
                   AND n * ln(sse / greatest(1e-9 * total, sse - list_max(gains))) > 3 * ln(n) AND step < 6
              THEN list_position(gains, list_max(gains)) ELSE 0 END
  FROM (
    SELECT *, list_transform(m, lambda row, i: CASE WHEN i > 1 AND NOT list_contains(chosen, i) AND row[i] > 1e-9 * d[i]
                                                    THEN row[27] * row[27] / row[i] ELSE 0 END) AS gains
    FROM (
      SELECT series_key, cutoff, n, total, places, centres, d, step + 1 AS step,
             greatest(1e-9 * total, sse - m[k][27] * m[k][27] / m[k][k]) AS sse, list_append(chosen, k) AS chosen,
             list_transform(m, lambda row, i: list_transform(row, lambda v, q:
               CASE WHEN i = k THEN v / m[k][k] ELSE v - row[k] / m[k][k] * m[k][q] END)) AS m
      FROM cp_steps WHERE k > 0))
),
cp_fit AS (
  SELECT *, n - least(7, n) - greatest(0, 2 * len(chosen) - 1) AS free,
         list_transform(chosen, lambda q: {'c': places[q], 'slope': m[q][27], 'centre': centres[q]}) AS hinges
  FROM cp_steps QUALIFY row_number() OVER (PARTITION BY series_key, cutoff ORDER BY step DESC) = 1
),
cp_level AS (SELECT series_key, cutoff, avg(m) AS level FROM means GROUP BY 1, 2),
changepoint AS (
  SELECT a.series_key, 'changepoint' AS model, a.cutoff, a.ds,
         coalesce(m, level) + coalesce(list_sum(list_transform(hinges, lambda q:
           q.slope * (greatest(0, a.ds - a.lo - q.c) - q.centre))), 0) AS yhat,
         CASE WHEN free > 0 THEN sqrt(greatest(0, sse) / free) END AS sd
  FROM ahead a JOIN (SELECT * EXCLUDE (m) FROM cp_fit) USING (series_key, cutoff) JOIN cp_level USING (series_key, cutoff)
  LEFT JOIN means USING (series_key, cutoff, dow)
)"""

# Days with their weekday effects taken out, and a small ridge system swept column by column.
HARMONIC = """
ha_x AS (
  SELECT series_key, cutoff, dow, y,
         list_concat([t / 365.25], list_transform(range(6), lambda i:
           CASE WHEN i % 2 = 0 THEN sin(2 * pi() * (i // 2 + 1) / 365.25 * (ds - DATE '2000-01-01'))
                ELSE cos(2 * pi() * (i // 2 + 1) / 365.25 * (ds - DATE '2000-01-01')) END)) AS x
  FROM train
),
ha_long AS (SELECT series_key, cutoff, dow, y, unnest(x) AS x, unnest(range(7)) AS j, x AS all_x FROM ha_x),
ha_means AS (SELECT series_key, cutoff, dow, j, avg(x) AS mx FROM ha_long GROUP BY 1, 2, 3, 4),
ha_mean AS (SELECT series_key, cutoff, dow, list(mx ORDER BY j) AS mxs FROM ha_means GROUP BY 1, 2, 3),
ha_centred AS (
  SELECT h.series_key, h.cutoff, y - m AS y, list_transform(x, lambda v, i: v - mxs[i]) AS x
  FROM ha_x h JOIN ha_mean USING (series_key, cutoff, dow) JOIN means USING (series_key, cutoff, dow)
),
ha_pairs AS (
  SELECT series_key, cutoff, i, j, sum(x[i] * x[j]) AS s
  FROM ha_centred CROSS JOIN range(1, 8) a(i) CROSS JOIN range(1, 8) b(j) GROUP BY 1, 2, 3, 4
),
ha_rows AS (
  SELECT series_key, cutoff, i, list(s ORDER BY j) AS plain,
         list(s + CASE WHEN i = j AND i > 1 THEN 15 ELSE 0 END ORDER BY j) AS row
  FROM ha_pairs GROUP BY 1, 2, 3
),
ha_rhs AS (
  SELECT series_key, cutoff, i, sum(x[i] * y) AS b FROM ha_centred CROSS JOIN range(1, 8) a(i) GROUP BY 1, 2, 3
),
ha_sweep AS (
  SELECT series_key, cutoff, 0 AS k, list(list_append(row, b) ORDER BY i) AS m, list(row[i] ORDER BY i) AS d
  FROM ha_rows JOIN ha_rhs USING (series_key, cutoff, i) GROUP BY 1, 2
  UNION ALL
  SELECT series_key, cutoff, k + 1,
         CASE WHEN m[k + 1][k + 1] > 1e-9 * d[k + 1] AND d[k + 1] > 0 THEN
           list_transform(m, lambda row, i: list_transform(row, lambda v, j:
             CASE WHEN i = k + 1 THEN v / m[k + 1][k + 1] ELSE v - row[k + 1] / m[k + 1][k + 1] * m[k + 1][j] END))
         ELSE list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda v: 0::DOUBLE) ELSE row END) END, d
  FROM ha_sweep WHERE k < 7
),
ha_fit AS (SELECT series_key, cutoff, list_transform(m, lambda row: row[8]) AS c FROM ha_sweep WHERE k = 7),
ha_error AS (
  SELECT series_key, cutoff, count(*) AS n, sum(y * y) AS total,
         sum(pow(y - list_sum(list_transform(x, lambda v, i: v * c[i])), 2)) AS sse
  FROM ha_centred JOIN ha_fit USING (series_key, cutoff) GROUP BY 1, 2
),
ha_free AS (
  SELECT e.*, n - w - 7 AS free FROM ha_error e
  JOIN (SELECT series_key, cutoff, count(*) AS w FROM means GROUP BY 1, 2) USING (series_key, cutoff)
),
ha_level AS (SELECT series_key, cutoff, avg(m) AS level FROM means GROUP BY 1, 2),
ha_middle AS (
  SELECT series_key, cutoff, list(mx ORDER BY j) AS middle
  FROM (SELECT series_key, cutoff, j, avg(mx) AS mx FROM ha_means GROUP BY 1, 2, 3) GROUP BY 1, 2
),
ha_ahead AS (
  SELECT *, list_concat([(ds - lo) / 365.25], list_transform(range(6), lambda i:
           CASE WHEN i % 2 = 0 THEN sin(2 * pi() * (i // 2 + 1) / 365.25 * (ds - DATE '2000-01-01'))
                ELSE cos(2 * pi() * (i // 2 + 1) / 365.25 * (ds - DATE '2000-01-01')) END)) AS x
  FROM ahead
),
harmonic AS (
  SELECT a.series_key, 'harmonic' AS model, a.cutoff, a.ds,
         coalesce(m, level) + list_sum(list_transform(x, lambda v, i: c[i] * (v - coalesce(mxs[i], middle[i])))) AS yhat,
         CASE WHEN free > 0 THEN sqrt(greatest(1e-9 * total, sse) / free) END AS sd
  FROM ha_ahead a JOIN ha_fit USING (series_key, cutoff) JOIN ha_free USING (series_key, cutoff)
  JOIN ha_level USING (series_key, cutoff) JOIN ha_middle USING (series_key, cutoff)
  LEFT JOIN means USING (series_key, cutoff, dow) LEFT JOIN ha_mean USING (series_key, cutoff, dow)
)"""

TRENDS = {"changepoint": CHANGEPOINTS, "harmonic": HARMONIC}


def _fitted(series: str, folds: str, horizon: int, names: list[str], history=False) -> str:
    made = {"ar_select": ar_select, "ar_levinson": ar_levinson, "arma": arma}
    plain = MODELS | TRENDS
    models = [made[n](horizon) if n in made else plain[n] for n in names]
    parts = [series, folds, TRAIN, ahead(horizon, history), *models]
    runs = " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)
    return f"WITH RECURSIVE {', '.join(parts)}, runs AS ({runs})"


def _forecast(series: str, horizon: int, name: str, history: bool = False) -> str:
    return f"""{_fitted(series, AT_END, horizon, [name], history)}
SELECT series_key, model, cutoff, ds, round(round(yhat, 10), 6) + 0 AS yhat,
       round(round(yhat - 1.2816 * sd, 10), 6) + 0 AS yhat_lower,
       round(round(yhat + 1.2816 * sd, 10), 6) + 0 AS yhat_upper
FROM runs"""


SCORED = "scored AS (SELECT runs.*, y FROM runs JOIN daily USING (series_key, ds))"


def _tested(series: str, folds: str, days: int, names: list[str]) -> str:
    return f"{_fitted(series, folds, days, names)}, {SCORED}"


SCORED_ROWS = """
SELECT series_key, model, cutoff, ds, round(round(yhat, 10), 6) + 0 AS yhat, y FROM scored"""

BY_HORIZON = """
by_day AS (
  SELECT series_key, model, CAST(ds - cutoff AS INTEGER) AS horizon, count(yhat) AS n,
         avg(abs(y - yhat)) AS mae, avg((y - yhat) * (y - yhat)) AS mse
  FROM scored GROUP BY 1, 2, 3
)"""

# A tenth of the rows, taken back from each horizon's last.
SMOOTHED = """
counted AS (
  SELECT *, sum(n) OVER (PARTITION BY series_key, model ORDER BY horizon) AS upto,
         greatest(1, floor(sum(n) OVER (PARTITION BY series_key, model) * 0.1 + 1e-9)) AS wanted
  FROM by_day
),
taken AS (
  SELECT a.series_key, a.model, a.horizon, a.n, a.wanted, b.mae, b.mse,
         greatest(0, least(b.n, a.wanted - (a.upto - b.upto))) AS take
  FROM counted a JOIN counted b
    ON a.series_key = b.series_key AND a.model = b.model AND b.horizon <= a.horizon
  WHERE a.upto >= a.wanted
),
smoothed AS (
  SELECT series_key, model, horizon, any_value(n) AS n, sum(take * mae) / any_value(wanted) AS mae,
         sqrt(sum(take * mse) / any_value(wanted)) AS rmse
  FROM taken GROUP BY 1, 2, 3
)"""

HEADLINE = """
SELECT series_key, model, avg(mae) AS mae, avg(rmse) AS rmse FROM smoothed GROUP BY 1, 2"""

ACCURACY = """
SELECT series_key, model, avg(abs(y - yhat)) AS mae,
       sqrt(avg((y - yhat) * (y - yhat))) AS rmse
FROM scored GROUP BY 1, 2"""


def _nested(select: str, name: str) -> str:
    return f"{name} AS ({select})"


def _comparison(series: str, days: int, folds: str, smoothing: str) -> str:
    names = list(MODELS)
    held = f"{_tested(series, held_out(days), days, names)} {ACCURACY}"
    crossed = f"{_tested(series, folds, days, names)}, {BY_HORIZON}, {smoothing} {HEADLINE}"
    return f"""WITH held AS ({held}), crossed AS ({crossed}),
metrics AS (
  SELECT *, 'holdout' AS protocol FROM held
  UNION ALL SELECT *, 'cross_validation' AS protocol FROM crossed
)
SELECT series_key, model, round(round(mae, 10), 6) + 0 AS mae, round(round(rmse, 10), 6) + 0 AS rmse, protocol,
       round(round(CASE WHEN base > 0 THEN (base - mae) / base * 100 END, 10), 6) + 0 AS improvement_pct
FROM (WITH {series} SELECT series_key FROM bounds)
CROSS JOIN (VALUES ('weekday_mean'), ('seasonal_trend'), ('seasonal_ar1')) m(model)
CROSS JOIN (VALUES ('holdout'), ('cross_validation')) p(protocol)
LEFT JOIN metrics USING (series_key, model, protocol)
LEFT JOIN (SELECT series_key, protocol, mae AS base FROM metrics
           WHERE model = 'weekday_mean') USING (series_key, protocol)"""


def _report(series: str, horizon: int, names: tuple[str, ...] = ("seasonal_trend",)) -> str:
    return f"""{_fitted(series, AT_END, horizon, list(names))},
report AS (
  SELECT series_key, model, strftime(ds, '%Y-%m-%d') AS date,
         round_even(round(greatest(yhat, 0.0), 9), 1) + 0 AS predicted_sessions,
         round_even(round(greatest(yhat - 1.2816 * sd, 0.0), 9), 1) + 0 AS lower_bound,
         round_even(round(yhat + 1.2816 * sd, 9), 1) + 0 AS upper_bound
  FROM runs
)"""


def _feed(series: str, horizon: int, name: str, line: str, history: bool) -> str:
    return f"""{_fitted(series, AT_END, horizon, [name], history)}
        SELECT series_key, 'history' AS segment, ds, CAST(y AS DOUBLE) AS value,
               CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper
        FROM daily
        UNION ALL SELECT series_key, 'forecast_start', hi, NULL, NULL, NULL FROM bounds
        UNION ALL SELECT series_key, 'forecast', ds, round(round({line}, 10), 6),
                         round(round(yhat - 1.2816 * sd, 10), 6), round(round(yhat + 1.2816 * sd, 10), 6)
        FROM runs"""


def _cv_feed(series: str, folds: str, days: int) -> str:
    return f"""{_tested(series, folds, days, ["seasonal_trend"])}
        SELECT series_key, model, cutoff, ds, y AS actual, round(round(yhat, 10), 6) + 0 AS yhat,
               round(round(overall_mean, 10), 6) + 0 AS overall_mean
        FROM scored JOIN (SELECT series_key, avg(y) AS overall_mean FROM daily GROUP BY 1)
        USING (series_key)"""


def _orders(series: str, folds: str) -> str:
    return f"""WITH {series}, {folds}, {TRAIN}, {AR_CHOICE}
        SELECT series_key, cutoff, differenced, lag1, lag7, round(round(phi1, 10), 6) + 0 AS phi1,
               round(round(phi7, 10), 6) + 0 AS phi7, round(round(aic, 10), 6) + 0 AS aic
        FROM ar_best"""


def _holdout_report(series: str, days: int, name: str = "seasonal_ar1") -> str:
    return f"""{_tested(series, held_out(days), days, [name])}
        SELECT series_key, model, strftime(ds, '%Y-%m-%d') AS date, y AS actual,
               round_even(round(yhat, 9), 1) + 0 AS predicted
        FROM scored"""


def _every(series: str, names: list[str], results: str) -> str:
    """Results with a row of NULLs for series that have none."""
    models = ", ".join(f"('{n}')" for n in names)
    return f"""WITH results AS ({results})
        SELECT * FROM (WITH {series} SELECT series_key FROM bounds)
        CROSS JOIN (VALUES {models}) m(model) LEFT JOIN results USING (series_key, model)"""


def _held_all(series: str) -> str:
    rows = _tested(series, held_out(30), 30, list(MODELS)) + SCORED_ROWS
    return _every(series, list(MODELS), rows)


def _crossed_all(series: str) -> str:
    metrics = f"""{_tested(series, SEGMENT_FOLDS, 30, list(MODELS))},
        {BY_HORIZON}, {SMOOTHED}, {_nested(HEADLINE, "headline")}
        SELECT series_key, model, round(round(mae, 10), 6) + 0 AS mae, round(round(rmse, 10), 6) + 0 AS rmse
        FROM headline"""
    return _every(series, list(MODELS), metrics)


def _validation(series: str, days: int, folds: str) -> str:
    crossed = f"""{_tested(series, folds, days, ["seasonal_trend"])},
        {BY_HORIZON}, {SMOOTHED} {HEADLINE}"""
    held = f"{_tested(series, held_out(days), days, ['weekday_mean'])} {ACCURACY}"
    return f"""WITH crossed AS ({_every(series, ["seasonal_trend"], crossed)}),
        held AS ({_every(series, ["weekday_mean"], held)}),
        based AS (SELECT c.*, round_even(round(h.mae, 9), 2) AS base
                  FROM crossed c LEFT JOIN held h ON c.series_key = h.series_key)
        SELECT series_key, model AS "Model", round_even(round(mae, 9), 2) + 0 AS "MAE",
               round_even(round(rmse, 9), 2) + 0 AS "RMSE",
               round(CASE WHEN base > 0 THEN (base - round_even(round(mae, 9), 2)) / base * 100 END, 6) + 0
                 AS gain_over_holdout_pct
        FROM based
        UNION ALL SELECT series_key, model, round_even(round(mae, 9), 2), NULL, NULL FROM held"""


_BOUNDS = """
SELECT series_key, min(ds) AS first_ds, max(ds) AS last_ds, count(*) AS days,
       CAST(sum(y) AS BIGINT) AS total, round(round(avg(y), 10), 6) + 0 AS mean_y
FROM daily GROUP BY 1"""

_PROFILE = """
SELECT series_key, CAST(isodow(ds) - 1 AS INTEGER) AS dow, count(*) AS days,
       round(round(avg(y), 10), 6) + 0 AS mean_y
FROM daily GROUP BY 1, 2"""

_NAIVE = ["weekday_mean"]
def _levinson_orders(series: str, folds: str) -> str:
    return f"""WITH RECURSIVE {series}, {folds}, {TRAIN}, {LEVINSON_FIT}
SELECT series_key, cutoff, CAST(p AS INTEGER) AS p, round(round(aic, 10), 6) + 0 AS aic,
       round(round(sigma, 10), 6) + 0 AS sigma, round(round(phi[1], 10), 6) + 0 AS phi1,
       round(round(phi[7], 10), 6) + 0 AS phi7
FROM lev_fit"""


def _arma_orders(series: str) -> str:
    names = ("ar1", "ar7", "ma1", "ma7")
    terms = ", ".join(f"round(round(c[{i + 1}], 10), 6) + 0 AS {name}" for i, name in enumerate(names))
    return f"""WITH RECURSIVE {series}, {AT_END}, {TRAIN}, {ARMA_FIT}
SELECT series_key, cutoff, {terms}, round(round(aic, 10), 6) + 0 AS aic,
       round(round(sigma, 10), 6) + 0 AS sigma
FROM arma_best"""


def _differences(series: str, folds: str) -> str:
    return f"""WITH {series}, {folds}, {TRAIN},
diff_lagged AS (
  SELECT *, y - lag(y, 7) OVER w AS s, lag(y, 3) OVER w AS middle, lag(dow, 3) OVER w AS mid,
         CASE WHEN count(*) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
              THEN avg(y) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS week
  FROM train WINDOW w AS (PARTITION BY series_key, cutoff ORDER BY ds)
),
diff_left_over AS (
  SELECT series_key, cutoff, middle - week AS w, avg(middle - week) OVER (PARTITION BY series_key, cutoff, mid) AS m
  FROM diff_lagged WHERE week IS NOT NULL
),
diff_strengths AS (
  SELECT f.series_key, f.cutoff,
         CASE WHEN count(w) >= 14 AND sum(w * w) - sum(w) * sum(w) / count(w) > 1e-9 * sum(w * w)
              THEN greatest(0, 1 - sum((w - m) * (w - m)) / (sum(w * w) - sum(w) * sum(w) / count(w))) ELSE 0 END AS strength
  FROM folds f LEFT JOIN diff_left_over l ON l.series_key = f.series_key AND l.cutoff = f.cutoff GROUP BY 1, 2
),
diff_kinds AS (
  SELECT series_key, cutoff, ds, 0 AS kind, CAST(y AS DOUBLE) AS w FROM diff_lagged
  UNION ALL SELECT series_key, cutoff, ds, 1, y - before FROM diff_lagged
  UNION ALL SELECT series_key, cutoff, ds, 2, s FROM diff_lagged
  UNION ALL SELECT series_key, cutoff, ds, 3, s - lag(s) OVER (PARTITION BY series_key, cutoff ORDER BY ds) FROM diff_lagged
),
diff_levels AS (
  SELECT series_key, cutoff, kind, ds, w - avg(w) OVER one AS x, count(*) OVER one AS n,
         row_number() OVER (PARTITION BY series_key, cutoff, kind ORDER BY ds) AS i
  FROM diff_kinds WHERE w IS NOT NULL WINDOW one AS (PARTITION BY series_key, cutoff, kind)
),
diff_partials AS (
  SELECT *, sum(x) OVER (PARTITION BY series_key, cutoff, kind ORDER BY ds) AS c,
         least(14, CAST(floor(4 * pow(n / 100.0, 0.25)) AS BIGINT)) AS reach
  FROM diff_levels
),
diff_products AS (
  SELECT a.series_key, a.cutoff, a.kind,
         sum(CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (a.i - b.i) / (a.reach + 1.0)) END * a.x * b.x) / any_value(a.n) AS variance
  FROM diff_partials a JOIN diff_partials b
    ON a.series_key = b.series_key AND a.cutoff = b.cutoff AND a.kind = b.kind AND b.i BETWEEN a.i - a.reach AND a.i
  GROUP BY 1, 2, 3
),
diff_tests AS (
  SELECT series_key, cutoff, kind,
         CASE WHEN sum(x * x) > 1e-9 * any_value(n) AND any_value(variance) > 0
              THEN sum(c * c) / (any_value(n) * any_value(n) * any_value(variance)) ELSE 0 END AS statistic
  FROM diff_partials JOIN diff_products USING (series_key, cutoff, kind) GROUP BY 1, 2, 3
),
diff_wide AS (
  SELECT series_key, cutoff, max(statistic) FILTER (kind = 0) AS k0, max(statistic) FILTER (kind = 1) AS k1,
         max(statistic) FILTER (kind = 2) AS k2, max(statistic) FILTER (kind = 3) AS k3
  FROM diff_tests GROUP BY 1, 2
),
diff_chosen AS (
  SELECT *, CASE WHEN seasonal = 1 THEN k2 ELSE k0 END AS statistic, CASE WHEN seasonal = 1 THEN k3 ELSE k1 END AS second
  FROM (SELECT *, CASE WHEN strength > 0.64 AND k2 IS NOT NULL THEN 1 ELSE 0 END AS seasonal
        FROM diff_wide JOIN diff_strengths USING (series_key, cutoff))
)
SELECT series_key, cutoff, round(round(strength, 10), 6) + 0 AS strength, CAST(seasonal AS INTEGER) AS seasonal,
       round(round(statistic, 10), 6) + 0 AS statistic,
       CASE WHEN coalesce(statistic, 0) <= 0.463 THEN 0 WHEN coalesce(second, 0) <= 0.463 THEN 1 ELSE 2 END AS differences
FROM diff_chosen"""


def _full_metrics(series: str, folds: str, days: int, name: str, share: float) -> str:
    def mean(c: str) -> str:
        total = f"sum(n_{c} * take / n)"
        return f"CASE WHEN {total} > 0 THEN sum(coalesce({c}, 0) * take / n) / {total} END AS {c}"

    sums = ("mse", "mae", "mape", "smape", "coverage")
    shown = ("mse", "rmse", "mae", "mape", "mdape", "smape", "coverage")
    return f"""{_tested(series, folds, days, [name])},
errors AS (
  SELECT series_key, model, cutoff, CAST(ds - cutoff AS INTEGER) AS horizon, (y - yhat) * (y - yhat) AS mse, abs(y - yhat) AS mae,
         CASE WHEN y <> 0 THEN abs(y - yhat) / abs(y) END AS mape,
         CASE WHEN abs(y) + abs(yhat) > 0 THEN 2 * abs(y - yhat) / (abs(y) + abs(yhat)) ELSE 0 END AS smape,
         CAST(y BETWEEN low AND high AS INTEGER) AS coverage,
         row_number() OVER (PARTITION BY series_key, model ORDER BY ds - cutoff, cutoff) AS place
  FROM (SELECT * EXCLUDE (yhat), round(yhat, 9) AS yhat, round(yhat - 1.2816 * sd, 9) AS low, round(yhat + 1.2816 * sd, 9) AS high
        FROM scored WHERE yhat IS NOT NULL)
),
by_horizon AS (
  SELECT series_key, model, horizon, count(*) AS n, max(place) AS upto,
         {', '.join(f'sum({c}) AS {c}, count({c}) AS n_{c}' for c in sums)}
  FROM errors GROUP BY 1, 2, 3
),
counted AS (
  SELECT *, greatest(floor(max(upto) OVER (PARTITION BY series_key, model) * {share} + 1e-9), 1) AS wanted FROM by_horizon
),
means_by_horizon AS (
  SELECT series_key, model, horizon, n, {', '.join(mean(c).replace('n_', 'b_n_').replace('/ n', '/ b_n') for c in sums)}
  FROM (SELECT a.series_key, a.model, a.horizon, a.n, b.n AS b_n, {', '.join(f'b.{c}, b.n_{c} AS b_n_{c}' for c in sums)},
               greatest(0, least(b.n, a.wanted - (a.upto - b.upto))) AS take
        FROM counted a JOIN counted b ON a.series_key = b.series_key AND a.model = b.model AND b.horizon <= a.horizon
        WHERE a.upto >= a.wanted)
  GROUP BY 1, 2, 3, 4
),
medians AS (
  SELECT c.series_key, c.model, c.horizon, median(e.mape) AS mdape
  FROM counted c JOIN errors e ON c.series_key = e.series_key AND c.model = e.model
    AND e.place <= c.upto AND e.place > c.upto - greatest(c.n, c.wanted)
  GROUP BY 1, 2, 3
)
SELECT series_key, model, horizon, n, {', '.join(f'round(round({c}, 10), 6) + 0 AS {c}' for c in shown)}
FROM (SELECT *, sqrt(mse) AS rmse FROM means_by_horizon JOIN medians USING (series_key, model, horizon))"""


ERRORS = """
errors AS (
  SELECT series_key, model, cutoff, CAST(ds - cutoff AS INTEGER) AS horizon, y - yhat AS error
  FROM scored WHERE yhat IS NOT NULL
)"""


def _empirical(series: str, folds: str, horizon: int, name: str) -> str:
    last = _fitted(series, AT_END, horizon, [name])
    return f"""WITH points AS ({_tested(series, folds, horizon, [name])}, {ERRORS}
  SELECT series_key, model, horizon, count(*) AS n_errors, quantile_cont(error, 0.1) AS low, quantile_cont(error, 0.9) AS high
  FROM errors GROUP BY 1, 2, 3),
latest AS ({last} SELECT *, CAST(ds - cutoff AS INTEGER) AS horizon FROM runs)
SELECT series_key, model, cutoff, ds, round(round(yhat, 10), 6) + 0 AS yhat,
       CASE WHEN n_errors >= 10 THEN round(round(yhat + low, 10), 6) + 0 END AS yhat_lower,
       CASE WHEN n_errors >= 10 THEN round(round(yhat + high, 10), 6) + 0 END AS yhat_upper,
       coalesce(n_errors, 0) AS n_errors
FROM latest LEFT JOIN points USING (series_key, model, horizon)"""


def _coverage(series: str, folds: str, horizon: int, name: str) -> str:
    return f"""{_tested(series, folds, horizon, [name])}, {ERRORS},
told AS (
  SELECT a.series_key, a.model, a.error, count(*) AS n, quantile_cont(b.error, 0.1) AS low, quantile_cont(b.error, 0.9) AS high
  FROM errors a JOIN errors b ON a.series_key = b.series_key AND a.model = b.model AND a.horizon = b.horizon
    AND b.cutoff <= a.cutoff - {horizon}
  GROUP BY a.series_key, a.model, a.horizon, a.cutoff, a.error
)
SELECT series_key, model, count(*) AS days,
       round(round(avg(CASE WHEN error BETWEEN low AND high THEN 1.0 ELSE 0.0 END), 10), 6) + 0 AS coverage
FROM told WHERE n >= 10 GROUP BY 1, 2"""


def _trends(series: str, folds: str) -> str:
    return f"""WITH RECURSIVE {series}, {folds}, {TRAIN}, {ahead(1)}, {CHANGEPOINTS}
SELECT series_key, cutoff, CAST(greatest(0, len(hinges) - 1) AS INTEGER) AS changes,
       round(round(coalesce(hinges[1].slope, 0), 10), 6) + 0 AS first_slope,
       round(round(coalesce(list_sum(list_transform(hinges, lambda h: h.slope)), 0), 10), 6) + 0 AS last_slope,
       round(round(CASE WHEN free > 0 THEN sqrt(greatest(0, sse) / free) END, 10), 6) + 0 AS sigma
FROM cp_fit"""


_AR = ["ar_select"]

ORACLE = {
    "daily_sessions": f"WITH {USER_DAILY} SELECT * FROM sparse",
    "daily_sessions_filled": f"WITH {USER_SERIES} SELECT * FROM daily",
    "top_user_daily": f"WITH {TOP_USER_SERIES} SELECT * FROM daily",
    "order_daily_filled": f"WITH {SEGMENT_SERIES} SELECT * FROM daily",
    "series_bounds": f"WITH {SEGMENT_SERIES} {_BOUNDS}",
    "series_bounds_users": f"WITH {USER_SERIES} {_BOUNDS}",
    "weekday_profile": f"WITH {SEGMENT_SERIES} {_PROFILE}",
    "weekday_profile_users": f"WITH {USER_SERIES} {_PROFILE}",
    "forecast_calendar": f"""WITH {SEGMENT_SERIES}
        SELECT series_key, ds, false AS is_future FROM daily
        UNION ALL
        SELECT series_key, CAST(unnest(generate_series(hi + 1, hi + 90, INTERVAL 1 DAY)) AS DATE),
               true
        FROM bounds""",
    "naive_forecast": _forecast(SEGMENT_SERIES, 90, "weekday_mean"),
    "naive_forecast_users": _forecast(USER_SERIES, 7, "weekday_mean"),
    "naive_holdout": _tested(SEGMENT_SERIES, held_out(30), 30, _NAIVE) + SCORED_ROWS,
    "naive_holdout_users": _tested(USER_SERIES, held_out(7), 7, _NAIVE) + SCORED_ROWS,
    "cv_cutoffs": f"WITH {SEGMENT_SERIES}, {SEGMENT_FOLDS} SELECT * FROM folds",
    "cv_cutoffs_users": f"WITH {USER_SERIES}, {USER_FOLDS} SELECT * FROM folds",
    "naive_cv": _tested(SEGMENT_SERIES, SEGMENT_FOLDS, 30, _NAIVE) + SCORED_ROWS,
    "naive_cv_users": _tested(USER_SERIES, USER_FOLDS, 7, _NAIVE) + SCORED_ROWS,
    "naive_cv_by_horizon": f"""{_tested(SEGMENT_SERIES, SEGMENT_FOLDS, 30, _NAIVE)}, {BY_HORIZON}
        SELECT series_key, model, horizon, n, round(round(mae, 10), 6) + 0 AS mae,
               round(round(sqrt(mse), 10), 6) + 0 AS rmse
        FROM by_day""",
    "naive_cv_by_horizon_smoothed": f"""{_tested(SEGMENT_SERIES, SEGMENT_FOLDS, 30, _NAIVE)},
        {BY_HORIZON}, {SMOOTHED}
        SELECT series_key, model, horizon, n, round(round(mae, 10), 6) + 0 AS mae, round(round(rmse, 10), 6) + 0 AS rmse
        FROM smoothed""",
    "seasonal_trend_forecast": _forecast(SEGMENT_SERIES, 90, "seasonal_trend"),
    "seasonal_trend_forecast_users": _forecast(USER_SERIES, 7, "seasonal_trend"),
    "seasonal_trend_fitted": _forecast(SEGMENT_SERIES, 90, "seasonal_trend", history=True),
    "seasonal_trend_cv": _tested(SEGMENT_SERIES, SEGMENT_FOLDS, 30, ["seasonal_trend"])
    + SCORED_ROWS,
    "seasonal_ar1_forecast": _forecast(SEGMENT_SERIES, 90, "seasonal_ar1"),
    "seasonal_ar1_forecast_users": _forecast(USER_SERIES, 7, "seasonal_ar1"),
    "seasonal_ar1_cv": _tested(SEGMENT_SERIES, SEGMENT_FOLDS, 30, ["seasonal_ar1"]) + SCORED_ROWS,
    "ar_orders": _orders(SEGMENT_SERIES, AT_END),
    "ar_orders_users": _orders(USER_SERIES, AT_END),
    "ar_orders_cv": _orders(SEGMENT_SERIES, SEGMENT_FOLDS),
    "changepoint_trends": _trends(SEGMENT_SERIES, SEGMENT_FOLDS),
    "changepoint_trends_users": _trends(USER_SERIES, AT_END),
    "changepoint_forecast": _forecast(SEGMENT_SERIES, 90, "changepoint"),
    "changepoint_forecast_users": _forecast(USER_SERIES, 7, "changepoint"),
    "changepoint_fitted": _forecast(SEGMENT_SERIES, 90, "changepoint", history=True),
    "changepoint_cv": _tested(SEGMENT_SERIES, SEGMENT_FOLDS, 30, ["changepoint"]) + SCORED_ROWS,
    "harmonic_forecast": _forecast(SEGMENT_SERIES, 90, "harmonic"),
    "harmonic_forecast_users": _forecast(USER_SERIES, 7, "harmonic"),
    "harmonic_cv": _tested(SEGMENT_SERIES, SEGMENT_FOLDS, 30, ["harmonic"]) + SCORED_ROWS,
    "cv_metrics_full": _full_metrics(SEGMENT_SERIES, SEGMENT_FOLDS, 30, "seasonal_trend", 0.1),
    "cv_metrics_full_users": _full_metrics(USER_SERIES, USER_FOLDS, 7, "weekday_mean", 0.1),
    "cv_metrics_full_unsmoothed": _full_metrics(SEGMENT_SERIES, SEGMENT_FOLDS, 30, "ar_levinson", 0.0),
    "empirical_interval_forecast": _empirical(SEGMENT_SERIES, rolling(180, 30, 90), 90, "seasonal_trend"),
    "empirical_interval_forecast_users": _empirical(USER_SERIES, USER_FOLDS, 7, "weekday_mean"),
    "empirical_coverage": _coverage(SEGMENT_SERIES, rolling(180, 30, 90), 90, "seasonal_trend"),
    "difference_orders": _differences(SEGMENT_SERIES, AT_END),
    "difference_orders_users": _differences(USER_SERIES, AT_END),
    "difference_orders_cv": _differences(SEGMENT_SERIES, SEGMENT_FOLDS),
    "difference_orders_cv_users": _differences(USER_SERIES, USER_FOLDS),
    "arma_orders": _arma_orders(SEGMENT_SERIES),
    "arma_orders_users": _arma_orders(USER_SERIES),
    "arma_forecast": _forecast(SEGMENT_SERIES, 90, "arma"),
    "arma_forecast_users": _forecast(USER_SERIES, 7, "arma"),
    "arma_holdout": _tested(SEGMENT_SERIES, held_out(30), 30, ["arma"]) + SCORED_ROWS,
    "arma_holdout_users": _tested(USER_SERIES, held_out(7), 7, ["arma"]) + SCORED_ROWS,
    "ar_levinson_orders": _levinson_orders(SEGMENT_SERIES, AT_END),
    "ar_levinson_orders_users": _levinson_orders(USER_SERIES, AT_END),
    "ar_levinson_orders_cv": _levinson_orders(SEGMENT_SERIES, SEGMENT_FOLDS),
    "ar_levinson_forecast": _forecast(SEGMENT_SERIES, 90, "ar_levinson"),
    "ar_levinson_forecast_users": _forecast(USER_SERIES, 7, "ar_levinson"),
    "ar_levinson_cv": _tested(SEGMENT_SERIES, SEGMENT_FOLDS, 30, ["ar_levinson"]) + SCORED_ROWS,
    "ar_levinson_cv_users": _tested(USER_SERIES, USER_FOLDS, 7, ["ar_levinson"]) + SCORED_ROWS,
    "ar_select_forecast": _forecast(SEGMENT_SERIES, 90, "ar_select"),
    "ar_select_forecast_users": _forecast(USER_SERIES, 7, "ar_select"),
    "ar_select_cv": _tested(SEGMENT_SERIES, SEGMENT_FOLDS, 30, _AR) + SCORED_ROWS,
    "ar_select_cv_users": _tested(USER_SERIES, USER_FOLDS, 7, _AR) + SCORED_ROWS,
    "ar_select_holdout": _tested(SEGMENT_SERIES, held_out(30), 30, _AR) + SCORED_ROWS,
    "ar_select_holdout_users": _tested(USER_SERIES, held_out(7), 7, _AR) + SCORED_ROWS,
    "top_user_ar_select_report": f"{_report(TOP_USER_SERIES, 7, ('ar_select',))} SELECT * FROM report",
    "top_user_ar_select_holdout": _holdout_report(TOP_USER_SERIES, 7, "ar_select"),
    "holdout_all_models": _held_all(SEGMENT_SERIES),
    "holdout_mixed_lengths": _held_all(MIXED_SERIES),
    "cv_all_models": _crossed_all(SEGMENT_SERIES),
    "cv_mixed_lengths": _crossed_all(MIXED_SERIES),
    "model_comparison": _comparison(SEGMENT_SERIES, 30, SEGMENT_FOLDS, SMOOTHED),
    "model_comparison_users": _comparison(USER_SERIES, 7, USER_FOLDS, SMOOTHED),
    "top_user_model_comparison": _comparison(TOP_USER_SERIES, 7, USER_FOLDS, SMOOTHED),
    "validation_results": _validation(SEGMENT_SERIES, 30, SEGMENT_FOLDS),
    "validation_mixed_lengths": _validation(MIXED_SERIES, 30, SEGMENT_FOLDS),
    "top_user_validation_results": _validation(TOP_USER_SERIES, 7, USER_FOLDS),
    "forecast_report": f"{_report(SEGMENT_SERIES, 90)} SELECT * FROM report",
    "top_user_forecast_report": f"{_report(TOP_USER_SERIES, 7)} SELECT * FROM report",
    "top_user_ar_forecast_report": f"{_report(TOP_USER_SERIES, 7, ('seasonal_ar1',))} SELECT * FROM report",
    "tsv_daily_filled": f"WITH {TSV_SERIES} SELECT * FROM daily",
    "tsv_top_user_forecast": f"{_report(TSV_TOP_USER_SERIES, 7)} SELECT * FROM report",
    "holdout_report": _holdout_report(SEGMENT_SERIES, 30),
    "top_user_holdout_report": _holdout_report(TOP_USER_SERIES, 7),
    "forecast_preview": f"""{_report(SEGMENT_SERIES, 90)} SELECT * FROM report
        QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY date) <= 10""",
    "forecast_feed": _feed(SEGMENT_SERIES, 90, "seasonal_trend", "yhat", history=True),
    "top_user_forecast_feed": _feed(TOP_USER_SERIES, 7, "seasonal_trend", "yhat", history=True),
    "seasonal_ar1_feed": _feed(SEGMENT_SERIES, 90, "seasonal_ar1", "greatest(yhat, 0.0)", False),
    "cv_feed": _cv_feed(SEGMENT_SERIES, SEGMENT_FOLDS, 30),
    "top_user_cv_feed": _cv_feed(TOP_USER_SERIES, USER_FOLDS, 7),
}

ORACLE |= {
    "forecast_files": f"""{_report(SEGMENT_SERIES, 90, ("seasonal_trend", "seasonal_ar1"))}
        SELECT * FROM report""",
    "holdout_files": ORACLE["holdout_report"],
    "text_edge_roundtrip": """
        SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ''
                            WHEN doc_id % 11 <> 0 THEN
                              '  "' || chr(92) || 't' || chr(9) || text || chr(13) || chr(92)
                              || chr(13) || chr(10) || ' ' || chr(92) END AS text
        FROM documents""",
    "validation_file": f"""SELECT series_key, "Model", "MAE", "RMSE"
        FROM ({ORACLE["validation_results"]})""",
}
