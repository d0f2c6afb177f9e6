"""Queries of regressions: rolling along instruments, across weeks, and kernels that a user adds. The SQL solves the same equations by elimination, window by window."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators import kernels, least_squares, pooled
from factorloom.operators import regression as reg
from factorloom.operators import series as ts
from factorloom.plans.formulas import _shown, shown
from factorloom.plans.panel import _lag
from factorloom.sources.bars import BARS_SQL, bars

C = F.col
WINDOW, LEAST = 26, 12


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with r (from the last week's close), m (the week's mean of close over open, less 1) and the logarithm of volume."""
    from pyspark.sql import Window

    b = bars(spark, sf_dir).select("instrument", "week_no", "sector", C("cap").cast("double").alias("cap"), "close", "volume", (C("close") / C("open") - 1).alias("day"))
    return b.withColumns({"r": ts.returns(C("close")), "m": F.avg("day").over(Window.partitionBy("week_no")), "v": F.ln(C("volume").cast("double"))})


_RETURNS = f"""{BARS_SQL},
rt AS (SELECT instrument, week_no, sector, cap::DOUBLE AS cap, close, close / open - 1 AS day, close / {_lag('close', 1)} - 1 AS r, avg(close / open - 1) OVER (PARTITION BY week_no) AS m, ln(volume::DOUBLE) AS v FROM bars)"""


def solved(name: str, source: str, keys: str, k: int) -> str:
    """WITH items: name has the keys and beta, the solution of source's k rows m of k + 1 numbers, by elimination without pivots."""
    row = "list_transform(m, lambda r, i: CASE WHEN i = c THEN list_transform(m[c], lambda v: v / m[c][c]) ELSE list_transform(r, lambda v, j: v - r[c] / m[c][c] * m[c][j]) END)"
    return f"""{name}_s AS (SELECT {keys}, 1 AS c, m FROM {source} UNION ALL SELECT {keys}, c + 1, {row} FROM {name}_s WHERE c <= {k}),
{name} AS (SELECT {keys}, list_transform(m, lambda r: r[{k + 1}]) AS beta FROM {name}_s WHERE c = {k + 1})"""


def normal(y: str, *xs: str) -> str:
    """The normal equations of y on a constant and xs, as aggregates."""
    all_ = ("1.0::DOUBLE", *xs)
    return "[" + ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in (*all_, y)) + "]" for a in all_) + "]"


def _windows(rows: str, columns: str, until: int = 0) -> str:
    return f"SELECT a.instrument, a.week_no, b.week_no AS back, {columns} FROM {rows} a JOIN {rows} b ON b.instrument = a.instrument AND b.week_no BETWEEN a.week_no - {WINDOW - 1 + until} AND a.week_no - {until}"


def _told(names: list[str]) -> list:
    return [shown(C(n)).alias(n) for n in names]


_OLS = ["n", "b1", "b2", "slopes", "resid_std", "resid_skew", "coskew", "late"]


def rolling_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns on the market and the week's volume over 26 weeks, of which 12 are there; what the residuals say, and how the later half went."""
    out = reg.rolling_ols(returns(spark, sf_dir), "r", ["m", "v"], WINDOW, LEAST, slices={"late": (13, 26)})
    return out.select("instrument", "week_no", *_told(_OLS))


_ROLLING = f"""WITH RECURSIVE {_RETURNS},
w AS ({_windows('rt', 'b.r AS y, b.m AS x, b.v AS z')} WHERE b.r IS NOT NULL),
g AS (SELECT instrument, week_no, {normal('y', 'x', 'z')} AS m FROM w GROUP BY ALL HAVING count(*) >= {LEAST}),
{solved('f', 'g', 'instrument, week_no', 3)},
fb AS MATERIALIZED (SELECT instrument, week_no, beta[1] AS b0, beta[2] AS b1, beta[3] AS b2 FROM f),
fa AS MATERIALIZED (SELECT instrument, week_no, count(*)::DOUBLE AS n, avg(x) AS mx FROM w GROUP BY ALL),
e AS (SELECT w.instrument, w.week_no, back, n, b1, b2, y - b0 - b1 * x - b2 * z AS e, (x - mx) ** 2 AS xx FROM w JOIN fb USING (instrument, week_no) JOIN fa USING (instrument, week_no)),
s AS (SELECT instrument, week_no, max(n) AS n, max(b1) AS b1, max(b2) AS b2, sum(e * e) AS ee, sum(e ** 3) AS eee, sum(e * xx) AS ex, sum(xx) AS xx,
  avg(CASE WHEN back > week_no - 13 THEN e END) AS late_mean, stddev_samp(CASE WHEN back > week_no - 13 THEN e END) AS late_sd, count(CASE WHEN back > week_no - 13 THEN 1 END) AS late_n FROM e GROUP BY instrument, week_no),
o AS (SELECT instrument, week_no, n, b1, b2, b1 + b2 AS slopes, sqrt(ee / (n - 3)) AS resid_std, eee / n / (ee / n) ** 1.5 AS resid_skew, ex / n / (sqrt(ee / n) * xx / n) AS coskew, CASE WHEN late_n >= 6 THEN late_mean / late_sd END AS late FROM s)
SELECT rt.instrument, rt.week_no, {', '.join(f'{_shown(x)} AS {x}' for x in _OLS)} FROM rt LEFT JOIN o USING (instrument, week_no)"""


def dimson_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.dimson_beta(returns(spark, sf_dir), "r", "m", WINDOW, LEAST).select("instrument", "week_no", *_told(["dimson_beta"]))


_DIMSON = f"""WITH RECURSIVE {_RETURNS},
p AS (SELECT a.instrument, a.week_no, a.r AS y, b.m AS m0, a.m AS m1, c.m AS m2 FROM rt a LEFT JOIN rt b ON b.instrument = a.instrument AND b.week_no = a.week_no - 1 LEFT JOIN rt c ON c.instrument = a.instrument AND c.week_no = a.week_no + 1),
w AS (SELECT a.instrument, a.week_no, b.y, m0, m1, m2 FROM rt a JOIN p b ON b.instrument = a.instrument AND b.week_no BETWEEN a.week_no - {WINDOW} AND a.week_no - 1 WHERE b.y IS NOT NULL AND m0 IS NOT NULL AND m2 IS NOT NULL),
g AS (SELECT instrument, week_no, {normal('y', 'm0', 'm1', 'm2')} AS m FROM w GROUP BY ALL HAVING count(*) >= {LEAST}),
{solved('f', 'g', 'instrument, week_no', 4)}
SELECT rt.instrument, rt.week_no, {_shown('(beta[2] + beta[3] + beta[4])')} AS dimson_beta FROM rt LEFT JOIN f USING (instrument, week_no)"""

_DELAY = ["delay_rsq", "delay_slope", "delay_tstat"]


def price_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.price_delay(returns(spark, sf_dir), "r", "m", WINDOW, LEAST, lags=2).select("instrument", "week_no", *_told(_DELAY))


_PRICE_DELAY = f"""WITH RECURSIVE {_RETURNS},
p AS (SELECT a.instrument, a.week_no, a.r AS y, a.m AS m0, b.m AS m1, c.m AS m2 FROM rt a JOIN rt b ON b.instrument = a.instrument AND b.week_no = a.week_no - 1 JOIN rt c ON c.instrument = a.instrument AND c.week_no = a.week_no - 2 WHERE a.r IS NOT NULL),
w AS (SELECT a.instrument, a.week_no, y, m0, m1, m2 FROM rt a JOIN p b ON b.instrument = a.instrument AND b.week_no BETWEEN a.week_no - {WINDOW - 1} AND a.week_no),
g AS (SELECT instrument, week_no, count(*) AS n, avg(y) AS my, {normal('y', 'm0', 'm1', 'm2')} AS m FROM w GROUP BY ALL HAVING count(*) >= {LEAST}),
{solved('f', 'g', 'instrument, week_no', 4)},
""" + ",\n".join(f"u{i} AS (SELECT instrument, week_no, list_transform(m, lambda r, j: list_concat(r[1:4], [CASE WHEN j = {i} THEN 1.0::DOUBLE ELSE 0.0 END])) AS m FROM g),\n" + solved(f"i{i}", f"u{i}", "instrument, week_no", 4) for i in (2, 3, 4)) + f""",
h AS (SELECT instrument, week_no, regr_slope(y, m0) AS b, regr_intercept(y, m0) AS a FROM w GROUP BY ALL),
s AS (SELECT w.instrument, w.week_no, any_value(n)::DOUBLE AS n, sum((y - my) ** 2) AS total, sum((y - beta[1] - beta[2] * m0 - beta[3] * m1 - beta[4] * m2) ** 2) AS rest, sum((y - a - b * m0) ** 2) AS rest1 FROM w JOIN g USING (instrument, week_no) JOIN f USING (instrument, week_no) JOIN h USING (instrument, week_no) GROUP BY ALL),
t AS (SELECT s.*, f.beta AS b, f.beta[2] / sqrt(i2.beta[2] * rest / (n - 4)) AS t0, f.beta[3] / sqrt(i3.beta[3] * rest / (n - 4)) AS t1, f.beta[4] / sqrt(i4.beta[4] * rest / (n - 4)) AS t2 FROM s JOIN f USING (instrument, week_no) JOIN i2 USING (instrument, week_no) JOIN i3 USING (instrument, week_no) JOIN i4 USING (instrument, week_no)),
o AS (SELECT instrument, week_no, 1 - (1 - rest1 / total) / (1 - rest / total) AS delay_rsq, (b[3] + 2 * b[4]) / (b[2] + b[3] + b[4]) AS delay_slope, (t1 + 2 * t2) / (t0 + t1 + t2) AS delay_tstat FROM t)
SELECT rt.instrument, rt.week_no, {', '.join(f'{_shown(x)} AS {x}' for x in _DELAY)} FROM rt LEFT JOIN o USING (instrument, week_no)"""


def market_betas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta in weeks below the market's mean, and from three-week log returns with one-week deviations."""
    out = returns(spark, sf_dir).withColumn("g", C("day") / 8)  # small enough for logarithms
    m = C("m") / 8
    return out.select("instrument", "week_no", shown(reg.downside_beta(C("day"), C("m"), WINDOW, 6)).alias("downside"), shown(reg.frazzini_pedersen_beta(C("g"), m, WINDOW, LEAST)).alias("pedersen"))


_LOGS = "ln(1 + day / 8) AS a, ln(1 + m / 8) AS b"
_BETAS = f"""WITH {_RETURNS},
w AS ({_windows('rt', 'b.day AS y, b.m AS x')}),
d AS (SELECT *, avg(x) OVER (PARTITION BY instrument, week_no) AS mx FROM w),
lo AS (SELECT instrument, week_no, covar_pop(y, x) / nullif(var_pop(x), 0) AS downside FROM d WHERE x < mx GROUP BY ALL HAVING count(*) >= 6),
lg AS (SELECT instrument, week_no, {_LOGS} FROM rt),
t AS (SELECT x.instrument, x.week_no, x.a, x.b, x.a + y.a + z.a AS a3, x.b + y.b + z.b AS b3 FROM lg x LEFT JOIN lg y ON y.instrument = x.instrument AND y.week_no = x.week_no - 1 LEFT JOIN lg z ON z.instrument = x.instrument AND z.week_no = x.week_no - 2),
v AS ({_windows('t', 'b.a, b.b, b.a3, b.b3')}),
fp AS (SELECT instrument, week_no, corr(a3, b3) * stddev_samp(a) / stddev_samp(b) AS pedersen FROM v GROUP BY ALL HAVING count(a) >= {LEAST} AND count(a3 + b3) >= {LEAST})
SELECT rt.instrument, rt.week_no, {_shown('downside')} AS downside, {_shown('pedersen')} AS pedersen FROM rt LEFT JOIN lo USING (instrument, week_no) LEFT JOIN fp USING (instrument, week_no)"""


def cross_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week by week: returns on volume and the week's own move, with a dummy for each sector, among the larger instruments."""
    out = least_squares.cross_fit(returns(spark, sf_dir), "r", ["v", "day"], group="sector", member=C("cap") > 2500, least=30)
    return out.select("instrument", "week_no", *_told(["fit_b1", "fit_b2", "fit_residual"]))


#: By deviations from the sectors' means, which leaves the same slopes and residuals.
_CROSS = f"""WITH RECURSIVE {_RETURNS},
k AS (SELECT instrument, week_no, sector, r, v, day, r - avg(r) OVER s AS y, v - avg(v) OVER s AS x, day - avg(day) OVER s AS z FROM rt WHERE cap > 2500 AND r IS NOT NULL WINDOW s AS (PARTITION BY week_no, sector)),
n AS (SELECT week_no FROM k GROUP BY week_no HAVING count(*) >= 30 AND count(*) >= 2 + count(DISTINCT sector) + 10),
g AS (SELECT week_no, [[sum(x * x), sum(x * z), sum(x * y)], [sum(x * z), sum(z * z), sum(z * y)]] AS m FROM k JOIN n USING (week_no) GROUP BY week_no),
{solved('f', 'g', 'week_no', 2)}
SELECT rt.instrument, rt.week_no, {_shown('beta[1]')} AS fit_b1, {_shown('beta[2]')} AS fit_b2, {_shown('(y - beta[1] * x - beta[2] * z)')} AS fit_residual
FROM rt LEFT JOIN f USING (week_no) LEFT JOIN k USING (instrument, week_no)"""


def regression_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What past weeks paid for the means of 4 and 12 closes over the close, applied to today's."""
    out = returns(spark, sf_dir).withColumns({f"x{d}": ts.trailing(C("close"), d, least, F.avg) / C("close") for d, least in ((4, 3), (12, 9))})
    return least_squares.regression_momentum(out, "r", ["x4", "x12"]).select("instrument", "week_no", *_told(["trend"]))


_MA = lambda d, least: f"CASE WHEN count(close) OVER (PARTITION BY instrument ORDER BY week_no RANGE BETWEEN {d - 1} PRECEDING AND CURRENT ROW) >= {least} THEN avg(close) OVER (PARTITION BY instrument ORDER BY week_no RANGE BETWEEN {d - 1} PRECEDING AND CURRENT ROW) END / close"
_TREND = f"""WITH RECURSIVE {_RETURNS},
x AS (SELECT instrument, week_no, r, {_MA(4, 3)} AS x4, {_MA(12, 9)} AS x12 FROM rt),
k AS (SELECT a.week_no, a.r AS y, b.x4 AS p, b.x12 AS q FROM x a JOIN x b ON b.instrument = a.instrument AND b.week_no = a.week_no - 1 WHERE a.r IS NOT NULL AND b.x4 IS NOT NULL AND b.x12 IS NOT NULL),
g AS (SELECT week_no, {normal('y', 'p', 'q')} AS m FROM k GROUP BY week_no HAVING count(*) >= 36),
{solved('f', 'g', 'week_no', 3)},
d AS (SELECT a.week_no, avg(beta[2]) AS b4, avg(beta[3]) AS b12 FROM (SELECT DISTINCT week_no FROM rt) a JOIN f ON f.week_no BETWEEN a.week_no - 11 AND a.week_no GROUP BY a.week_no HAVING count(*) >= 8)
SELECT x.instrument, x.week_no, {_shown('(x4 * b4 + x12 * b12)')} AS trend FROM x LEFT JOIN d USING (week_no)"""

def tail_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all returns of 21 weeks together."""
    out = pooled.tail_index(returns(spark, sf_dir), C("r"))
    return out.select("week_no", "n", *_told(["threshold", "tail"]))


_POOL = """pl AS (SELECT a.week_no, b.r FROM (SELECT DISTINCT week_no FROM rt) a JOIN rt b ON b.week_no BETWEEN a.week_no - 20 AND a.week_no WHERE b.r IS NOT NULL),
qt AS (SELECT week_no, count(*) AS n, quantile_cont(r, 0.05) AS threshold FROM pl GROUP BY week_no),
tl AS (SELECT week_no, any_value(n) AS n, any_value(threshold) AS threshold, CASE WHEN any_value(n) >= 100 AND any_value(threshold) < 0 THEN avg(CASE WHEN r < threshold THEN ln(r / threshold) END) END AS tail FROM pl JOIN qt USING (week_no) GROUP BY week_no)"""
_TAIL = f"WITH {_RETURNS}, {_POOL} SELECT w.week_no, coalesce(n, 0) AS n, {_shown('threshold')} AS threshold, {_shown('tail')} AS tail FROM (SELECT DISTINCT week_no FROM rt) w LEFT JOIN tl USING (week_no)"


def tail_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns on the tail index of the week before, over 26 weeks."""
    rows = returns(spark, sf_dir)
    before = pooled.tail_index(rows, C("r")).select((C("week_no") + 1).alias("week_no"), C("tail").alias("tail_before"))
    out = reg.rolling_ols(rows.join(before, "week_no", "left"), "r", ["tail_before"], WINDOW, LEAST)
    return out.select("instrument", "week_no", *_told(["b1"]))


_TAIL_BETA = f"""WITH {_RETURNS}, {_POOL},
x AS (SELECT instrument, rt.week_no, r, tail FROM rt JOIN tl ON tl.week_no = rt.week_no - 1 WHERE r IS NOT NULL AND tail IS NOT NULL),
w AS (SELECT a.instrument, a.week_no, regr_slope(b.r, tail) AS b1 FROM rt a JOIN x b ON b.instrument = a.instrument AND b.week_no BETWEEN a.week_no - {WINDOW - 1} AND a.week_no GROUP BY ALL HAVING count(*) >= {LEAST})
SELECT rt.instrument, rt.week_no, {_shown('b1')} AS b1 FROM rt LEFT JOIN w USING (instrument, week_no)"""

#: Kernels as a user would add them.
LIBRARY = kernels.Library()


@LIBRARY.add("drought", kernels.SERIES, ["volume"])
def _drought(columns: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    """Rows since the last one with a volume above all before it."""
    v = columns["volume"]
    tops = np.concatenate([[True], v[1:] > np.maximum.accumulate(v)[:-1]])
    return {"drought": np.arange(len(v)) - np.maximum.accumulate(np.where(tops, np.arange(len(v)), 0))}


@LIBRARY.add("rarity", kernels.CROSS, ["drought"], ["rarity"])
def _rarity(columns: dict[str, np.ndarray], instruments: np.ndarray) -> dict[str, np.ndarray]:
    """The share of the week's instruments with a longer one."""
    d = columns["drought"]
    return {"rarity": (len(d) - np.searchsorted(np.sort(d), d, side="right")) / len(d)}


def user_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series kernel, and a cross kernel over what it gives."""
    return LIBRARY.build(bars(spark, sf_dir).select("instrument", "week_no", "volume")).select("instrument", "week_no", "drought", "rarity")


_LIBRARY = f"""WITH {BARS_SQL},
t AS (SELECT instrument, week_no, volume, row_number() OVER (PARTITION BY instrument ORDER BY week_no) AS k, max(volume) OVER (PARTITION BY instrument ORDER BY week_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM bars),
d AS (SELECT instrument, week_no, (k - max(CASE WHEN top IS NULL OR volume > top THEN k END) OVER (PARTITION BY instrument ORDER BY week_no ROWS UNBOUNDED PRECEDING))::DOUBLE AS drought FROM t)
SELECT instrument, week_no, drought, (count(*) OVER (PARTITION BY week_no) - rank() OVER (PARTITION BY week_no ORDER BY drought) - count(*) OVER (PARTITION BY week_no, drought) + 1) / count(*) OVER (PARTITION BY week_no) AS rarity FROM d"""

QUERIES = {"rolling_ols": rolling_ols, "dimson_beta": dimson_beta, "price_delay": price_delay, "market_betas": market_betas, "cross_fit": cross_fit, "regression_momentum": regression_momentum, "user_library": user_library, "tail_index": tail_index, "tail_beta": tail_beta}
SQL = {"rolling_ols": _ROLLING, "dimson_beta": _DIMSON, "price_delay": _PRICE_DELAY, "market_betas": _BETAS, "cross_fit": _CROSS, "regression_momentum": _TREND, "user_library": _LIBRARY, "tail_index": _TAIL, "tail_beta": _TAIL_BETA}
