"""Queries of held portfolios over the weekly bars: membership at quarters of 13 weeks, and the returns of its sorts, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.operators import portfolios
from factorloom.operators import series as ts
from factorloom.plans.formulas import _shown, shown
from factorloom.plans.panel import _lag
from factorloom.sources.bars import BARS_SQL, bars

C = F.col
RULES = portfolios.Rules(year=26, year_least=10, period_least=8, short=4, seasoned=13, least=20)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumns({"r": ts.returns(C("close")), "size_now": C("cap").cast("double") * C("close"), "value": C("close") / C("vwap") - 0.9, "turnover": C("volume").cast("double")})
    return b.withColumn("age", C("week_no") - F.min("week_no").over(Window.partitionBy("instrument"))).select("instrument", "week_no", "sector", "r", "size_now", "value", "turnover", "age")


def _members(rows: DataFrame) -> DataFrame:
    return portfolios.membership(rows, F.floor(C("week_no") / 13).cast("int"), cap="size_now", value="value", turnover="turnover", age="age", allowed=C("sector") < 4, rules=RULES)


def held_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sectors but one; the smallest 30 % by cap times close go; by close over vwap, and by the volume of 4 weeks over that of 26."""
    return _members(_rows(spark, sf_dir))


def held_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    out = portfolios.factor_returns(rows, F.floor(C("week_no") / 13).cast("int"), _members(rows), ret="r", cap="size_now", rules=RULES)
    return out.select("week_no", "n", *[shown(C(x)).alias(x) for x in ("mkt", "smb", "vmg", "pmo", "smb4")])


_Y = "OVER (PARTITION BY instrument ORDER BY week_no RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"
_MEMBERS = f"""{BARS_SQL},
h0 AS (SELECT instrument, week_no, sector, floor(week_no / 13)::INT AS period, close / {_lag('close', 1)} - 1 AS r, cap::DOUBLE * close AS c, close / vwap - 0.9 AS value, volume::DOUBLE AS turnover, week_no - min(week_no) OVER (PARTITION BY instrument) AS age FROM bars),
h1 AS (SELECT *, count(*) {_Y.format(25)} AS in_year, count(*) OVER (PARTITION BY instrument, period) AS in_period, avg(turnover) {_Y.format(3)} / avg(turnover) {_Y.format(25)} AS mood FROM h0),
dp AS (SELECT period, max(week_no) AS week_no, count(DISTINCT week_no) AS open, lead(period) OVER (ORDER BY period) AS after FROM h0 GROUP BY period),
m0 AS (SELECT h1.*, open, after FROM h1 JOIN dp USING (period, week_no) WHERE after IS NOT NULL AND sector < 4 AND c > 0),
m1 AS (SELECT * FROM m0 QUALIFY c > quantile_cont(c, 0.3) OVER (PARTITION BY after)),
m2 AS (SELECT *, CASE WHEN value > 0 THEN value ELSE -1 END AS worth FROM m1 WHERE age >= 13 AND in_year >= 10 AND in_period >= least(8, ceil(0.75 * open))),
m3 AS (SELECT *, quantile_cont(c, 0.5) OVER d AS mid, quantile_cont(worth, 0.3) OVER d AS w3, quantile_cont(worth, 0.7) OVER d AS w7, quantile_cont(mood, 0.3) OVER d AS t3, quantile_cont(mood, 0.7) OVER d AS t7, count(*) OVER d AS n FROM m2 WINDOW d AS (PARTITION BY after)),
mb AS (SELECT after AS period, instrument, CASE WHEN c <= mid THEN 'S' ELSE 'B' END AS size, CASE WHEN worth <= w3 THEN 'G' WHEN worth > w7 THEN 'V' ELSE 'M' END AS worth, CASE WHEN mood <= t3 THEN 'P' WHEN mood > t7 THEN 'O' ELSE 'M' END AS mood FROM m3 WHERE n >= 20)"""
_CELLS = ", ".join(f"sum(CASE WHEN size = '{s}' AND {of} = '{g}' THEN r * w END) / sum(CASE WHEN size = '{s}' AND {of} = '{g}' THEN w END) AS {s}{g}{of[0]}" for of, kinds in (("worth", "VMG"), ("mood", "POM")) for s in "SB" for g in kinds)
_RETURNS = f"""{_MEMBERS},
nd AS (SELECT week_no, lead(week_no) OVER (ORDER BY week_no) AS next_week FROM (SELECT DISTINCT week_no FROM h0)),
hr AS (SELECT a.week_no, a.r, b.c AS w, size, worth, mood FROM h0 a JOIN nd ON nd.next_week = a.week_no JOIN h0 b ON b.instrument = a.instrument AND b.week_no = nd.week_no JOIN mb ON mb.period = a.period AND mb.instrument = a.instrument WHERE a.r IS NOT NULL AND b.c > 0),
ce AS (SELECT week_no, count(*) AS n, sum(r * w) / sum(w) AS mkt, {_CELLS} FROM hr GROUP BY week_no),
fa AS (SELECT week_no, n, mkt, (SVw + SMw + SGw - BVw - BMw - BGw) / 3 AS smb, (SVw + BVw - SGw - BGw) / 2 AS vmg, (SPm + BPm - SOm - BOm) / 2 AS pmo, ((SVw + SMw + SGw - BVw - BMw - BGw) / 3 + (SPm + SOm + SMm - BPm - BOm - BMm) / 3) / 2 AS smb4 FROM ce)"""

QUERIES = {"held_members": held_members, "held_returns": held_returns}
SQL = {
    "held_members": f"WITH {_MEMBERS} SELECT * FROM mb",
    "held_returns": f"WITH {_RETURNS} SELECT week_no, n, {', '.join(f'CASE WHEN n >= 20 THEN {_shown(x)} END AS {x}' for x in ('mkt', 'smb', 'vmg', 'pmo', 'smb4'))} FROM fa",
}
