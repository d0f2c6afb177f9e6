"""Queries of universes, rolling model windows and factor effectiveness, and the same in SQL. Weeks stand in for days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.operators import effectiveness as eff
from factorloom.operators import series as ts
from factorloom.operators import universe as uni
from factorloom.operators.model_windows import Plan, roles
from factorloom.plans.formulas import _shown, shown
from factorloom.plans.panel import _lag
from factorloom.plans.statements import _LONG, _long
from factorloom.sources.bars import BARS_SQL, bars

C = F.col
PLAN = Plan(first=1995, last=1998, train_years=3, validation_months=6, purge=2)
HOLDING, LEAST = 5, 20
RETURNS = ("top_return", "benchmark_return", "bottom_return")


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of five boards by the key, special treatment where a week's range is wide, the index by the week's turnover."""
    boards = F.array(*[F.lit(x) for x in ("SH60", "SZ00", "SZ30", "SH68", "BJ83")])
    code = F.concat(F.element_at(boards, (C("instrument") % 5 + 1).cast("int")), F.lpad(C("instrument").cast("string"), 4, "0"))
    listed = F.count("*").over(Window.partitionBy("instrument").orderBy("week_no"))
    treated = (C("high") - C("low")) / C("close") > 0.5
    return bars(spark, sf_dir).select("instrument", "week_no", code.alias("code"), treated.alias("treated"), listed.alias("listed"), (C("volume") > 60).alias("in_index"))


def _inside(name: str) -> Column:
    return uni.member(name, C("code"), C("treated"), C("listed"), C("in_index"))


def universe_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("all", "index", "main", "sh_main")
    return _coded(spark, sf_dir).select("instrument", "week_no", *[_inside(x).cast("int").alias(f"in_{x}") for x in names])


def universe_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uni.spans(_coded(spark, sf_dir), _inside("main"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, x = F.max("close").over(ts.frame(1, -1)) / C("close") - 1, ts.returns(C("close"))
    return bars(spark, sf_dir).select("instrument", "week_no", F.date_add(F.lit("1970-01-05").cast("date"), C("week_no") * 7).alias("day"), x.alias("x"), label.alias("label"))


def model_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By window, role and use in the refit: rows, instruments, first and last week, and the mean label."""
    out = roles(_dated(spark, sf_dir), "day", PLAN)
    return out.groupBy("window", "role", "refit").agg(F.count("*").alias("n"), F.countDistinct("instrument").alias("instruments"), F.min("week_no").alias("first_week"), F.max("week_no").alias("last_week"), shown(F.avg("label")).alias("label"))


def rolling_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next week's return on this week's, fitted on each window's refit rows: what it says for the test rows. One line a window is joined back."""
    out = roles(_dated(spark, sf_dir), "day", PLAN)
    fits = out.where("refit").groupBy("window").agg(F.regr_slope("label", "x").alias("slope"), F.regr_intercept("label", "x").alias("intercept"))
    test = out.where("role = 'test' and x is not null").join(fits, "window")
    return test.select("window", "instrument", "week_no", shown(C("intercept") + C("slope") * C("x")).alias("value"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eff.by_date(_long(spark, sf_dir), HOLDING, least=LEAST)


def effectiveness_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir).select("factor", "week_no", "pocket", "n", *[shown(C(x)).alias(x) for x in ("ic", "rank_ic", *RETURNS)])


_TOLD = ("ic_mean", "icir", "rank_ic_mean", "rank_icir", "long_positive", "short_positive", *RETURNS, "long_excess", "short_excess", "long_short")


def effectiveness_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = eff.summary(_daily(spark, sf_dir), F.floor(C("week_no") / 52), HOLDING, least=30)
    return out.select("factor", "year", "ic_dates", "rank_ic_dates", "return_dates", "pockets", *[shown(C(x)).alias(x) for x in _TOLD], "side", "dominant")


QUERIES = {"universe_member": universe_member, "universe_spans": universe_spans, "model_windows": model_windows, "rolling_fit": rolling_fit, "effectiveness_by_date": effectiveness_by_date, "effectiveness_by_year": effectiveness_by_year}

_CODED = f"""{BARS_SQL},
coded AS (SELECT instrument, week_no, ['SH60', 'SZ00', 'SZ30', 'SH68', 'BJ83'][instrument % 5 + 1] AS board, (high - low) / close > 0.5 AS treated, row_number() OVER (PARTITION BY instrument ORDER BY week_no) > 60 AS seasoned, volume > 60 AS in_index FROM bars),
inside AS (SELECT instrument, week_no, in_index, board IN ('SH60', 'SZ00') AND NOT treated AND seasoned AS main, board = 'SH60' AND NOT treated AND seasoned AS sh_main FROM coded)"""

_ROLES = f"""{BARS_SQL},
dated AS (SELECT instrument, week_no, DATE '1970-01-05' + week_no * 7 AS day, close / {_lag('close', 1)} - 1 AS x, max(close) OVER (PARTITION BY instrument ORDER BY week_no RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) / close - 1 AS label FROM bars),
years AS (SELECT unnest(range({PLAN.first}, {PLAN.last + 1})) AS y),
bounds AS (SELECT y, make_date(y, 1, 1) AS t, (make_date(y, 1, 1) - INTERVAL {PLAN.validation_months} MONTH)::DATE AS v FROM years),
limits AS (SELECT y, t, v, list_reverse_sort(list(day) FILTER (WHERE day < v))[{PLAN.purge + 1}] AS last_train, list_reverse_sort(list(day) FILTER (WHERE day < t))[{PLAN.purge + 1}] AS last_seen FROM bounds, (SELECT DISTINCT day FROM dated) GROUP BY ALL),
told AS (SELECT dated.*, y AS "window", CASE WHEN day >= t THEN 'test' WHEN day >= v AND day <= last_seen THEN 'validation' WHEN day <= last_train THEN 'train' END AS role, CASE WHEN day < t THEN day <= last_seen END AS refit
  FROM dated JOIN limits ON day >= make_date(y - {PLAN.train_years}, 1, 1) AND day < make_date(y + 1, 1, 1)),
kept AS (SELECT * FROM told WHERE role IS NOT NULL OR refit)"""

_P = "OVER (PARTITION BY factor, week_no"
_DAILY = f"""{BARS_SQL}, {_LONG},
dates AS (SELECT week_no, (row_number() OVER (ORDER BY week_no) - 1) % {HOLDING} + 1 AS pocket FROM (SELECT DISTINCT week_no FROM lg)),
ranked AS (SELECT *, (rank() {_P} ORDER BY x) + (count(*) {_P}, x) - 1) / 2) / count(*) {_P}) AS rx, (rank() {_P} ORDER BY label) + (count(*) {_P}, label) - 1) / 2) / count(*) {_P}) AS rl FROM lg WHERE x IS NOT NULL AND label IS NOT NULL),
daily AS (SELECT factor, week_no, count(*) AS n, CASE WHEN min(x) < max(x) AND min(label) < max(label) THEN corr(x, label) END AS ic, CASE WHEN min(rx) < max(rx) AND min(rl) < max(rl) THEN corr(rx, rl) END AS rank_ic,
  avg(label) FILTER (greatest(1, least(5, ceil(rx * 5))) = 5) AS top_return, avg(label) AS benchmark_return, avg(label) FILTER (greatest(1, least(5, ceil(rx * 5))) = 1) AS bottom_return FROM ranked GROUP BY ALL HAVING count(*) >= {LEAST}),
placed AS (SELECT * FROM daily JOIN dates USING (week_no))"""

_SIDES = f"""{_DAILY},
years AS (SELECT *, NULL::INT AS year FROM placed UNION ALL SELECT *, floor(week_no / 52)::INT FROM placed),
paid AS (SELECT *, top_return - benchmark_return AS l, benchmark_return - bottom_return AS s FROM years),
base AS (SELECT factor, year, count(ic) AS ic_dates, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, count(rank_ic) AS rank_ic_dates, avg(rank_ic) AS rank_ic_mean, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS rank_icir,
  count(l + s) AS return_dates, avg((l > 0)::INT) FILTER (l + s IS NOT NULL) AS long_positive, avg((s > 0)::INT) FILTER (l + s IS NOT NULL) AS short_positive FROM paid GROUP BY ALL),
grown AS (SELECT factor, year, pocket, {", ".join(f"exp(sum(ln(1 + {x}))) - 1 AS {x}" for x in RETURNS)} FROM paid WHERE l + s IS NOT NULL GROUP BY ALL),
means AS (SELECT factor, year, count(*) AS pockets, {", ".join(f"avg({x}) AS {x}" for x in RETURNS)} FROM grown GROUP BY ALL),
both_sides AS (SELECT base.*, coalesce(pockets, 0) AS pockets, {", ".join(RETURNS)}, top_return - benchmark_return AS long_excess, benchmark_return - bottom_return AS short_excess, top_return - bottom_return AS long_short
  FROM base LEFT JOIN means ON base.factor = means.factor AND base.year IS NOT DISTINCT FROM means.year),
sided AS (SELECT *, CASE WHEN return_dates < 30 OR pockets < {HOLDING} THEN 'insufficient_data' WHEN long_excess > 0 AND short_excess > 0 THEN 'both' WHEN long_excess > 0 THEN 'long' WHEN short_excess > 0 THEN 'short' ELSE 'neither' END AS side FROM both_sides)"""

SQL = {
    "universe_member": f'WITH {_CODED} SELECT instrument, week_no, 1 AS in_all, in_index::INT AS in_index, main::INT AS in_main, sh_main::INT AS in_sh_main FROM inside',
    "universe_spans": f"""WITH {_CODED},
turned AS (SELECT *, main AND NOT coalesce(lag(main) OVER (PARTITION BY instrument ORDER BY week_no), false) AS opens FROM inside),
runs AS (SELECT *, sum(opens::INT) OVER (PARTITION BY instrument ORDER BY week_no) AS run FROM turned)
SELECT instrument, min(week_no) AS first, max(week_no) AS last FROM runs WHERE main GROUP BY instrument, run""",
    "model_windows": f'WITH {_ROLES} SELECT "window", role, refit, count(*) AS n, count(DISTINCT instrument) AS instruments, min(week_no) AS first_week, max(week_no) AS last_week, {_shown("avg(label)")} AS label FROM kept GROUP BY ALL',
    "rolling_fit": f"""WITH {_ROLES},
fits AS (SELECT "window", regr_slope(label, x) AS slope, regr_intercept(label, x) AS intercept FROM kept WHERE refit GROUP BY ALL),
said AS (SELECT "window", instrument, week_no, intercept + slope * x AS value FROM kept JOIN fits USING ("window") WHERE role = 'test' AND x IS NOT NULL)
SELECT "window", instrument, week_no, {_shown("value")} AS value FROM said""",
    "effectiveness_by_date": f"WITH {_DAILY} SELECT factor, week_no, pocket, n, " + ", ".join(f"{_shown(x)} AS {x}" for x in ("ic", "rank_ic", *RETURNS)) + " FROM placed",
    "effectiveness_by_year": f"WITH {_SIDES} SELECT factor, year, ic_dates, rank_ic_dates, return_dates, pockets, " + ", ".join(f"{_shown(x)} AS {x}" for x in _TOLD) + ", side, CASE WHEN side = 'both' THEN CASE WHEN long_excess > short_excess THEN 'long' WHEN short_excess > long_excess THEN 'short' ELSE 'equal' END ELSE side END AS dominant FROM sided",
}
