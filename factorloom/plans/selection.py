"""Queries of factor selection over the weekly bars: correlations of many factors, pruning, stability over the years, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.operators import cross_section as xs
from factorloom.operators import selection
from factorloom.operators import series as ts
from factorloom.plans.formulas import _shown, shown
from factorloom.plans.panel import _lag, _rank, _w
from factorloom.sources.bars import BARS_SQL, bars

C = F.col
LIMIT, LEAST = 0.6, 20
#: Name: the column over bars, and its SQL.
FACTORS = {
    **{f"mom_{d}": (lambda d=d: ts.returns(C("close"), d), f"close / {_lag('close', d)} - 1") for d in (1, 2, 3, 5)},
    **{f"mean_{d}": (lambda d=d: ts.trailing(C("close"), d, d - 1, F.avg) / C("close"), f"CASE WHEN count(close) {_w(d)} >= {d - 1} THEN avg(close) {_w(d)} END / close") for d in (3, 6)},
    "range": (lambda: (C("high") - C("low")) / C("close"), "(high - low) / close"),
    "body": (lambda: C("close") / C("open") - 1, "close / open - 1"),
    "volume": (lambda: C("volume").cast("double"), "volume::DOUBLE"),
    "amount": (lambda: C("amount").cast("double"), "amount::DOUBLE"),
    "cap": (lambda: C("cap").cast("double"), "cap::DOUBLE"),
}
_NEXT = "max(close) OVER (PARTITION BY instrument ORDER BY week_no RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) / close - 1"


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.max("close").over(ts.frame(1, -1)) / C("close") - 1
    return bars(spark, sf_dir).select("instrument", "week_no", *[f().alias(k) for k, (f, _) in FACTORS.items()], label.alias("label"))


_F = f"fr AS (SELECT instrument, week_no, {', '.join(f'{s} AS {k}' for k, (_, s) in FACTORS.items())}, {_NEXT} AS label FROM bars)"


def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven factors and the next week's return."""
    out = selection.mean_rank_correlation(_frame(spark, sf_dir), [*FACTORS, "label"], LEAST)
    return out.select("factor_i", "factor_j", "dates", shown(C("correlation")).alias("correlation"))


def pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factors, by the size of their mean rank correlation with the next week's return; equal sizes by name."""
    found = selection.mean_rank_correlation(_frame(spark, sf_dir), [*FACTORS, "label"], LEAST).cache()
    told = {r["factor_i"]: abs(r["correlation"] or 0.0) for r in found.where("factor_j = 'label'").collect()}
    return selection.prune({k: told[k] for k in sorted(told)}, found.where("factor_j <> 'label'"), LIMIT)


def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By factor over years of 52 weeks: rank correlations with the next week's return, and the spread of its outer fifths."""
    names = list(FACTORS)
    rows = _frame(spark, sf_dir).select("instrument", "week_no", "label", F.expr(f"stack({len(names)}, {', '.join(f'{k!r}, `{k}`' for k in names)}) AS (factor, x)"))
    rows = rows.where("x is not null and label is not null")
    weekly = rows.withColumns({"rf": xs.rank(C("x"), "factor"), "rl": xs.rank(C("label"), "factor")})
    weekly = weekly.groupBy("factor", "week_no").agg(F.count("*").alias("n"), xs.correlation(C("rf"), C("rl")).alias("ic"), F.avg(F.when(C("rf") > 0.8, C("label"))).alias("top"), F.avg(F.when(C("rf") <= 0.2, C("label"))).alias("bottom")).where(f"n >= {LEAST}")
    weekly = weekly.withColumns({"year": F.floor(C("week_no") / 52).cast("int"), "spread": C("top") - C("bottom")})
    annual = weekly.groupBy("factor", "year").agg(F.count("spread").alias("days"), F.avg("ic").alias("rank_ic"), F.sum("spread").alias("spread"))
    summary = weekly.groupBy("factor").agg(F.avg("ic").alias("rank_ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("rank_icir"), F.count("ic").alias("days"), F.sum("spread").alias("spread"))
    counts = weekly.withColumn("best", F.max("n").over(Window.partitionBy("week_no"))).groupBy("factor").agg(F.try_divide(F.sum("n"), F.sum("best")).alias("coverage"))
    out = selection.stability(summary, annual, counts, selection.Criteria(min_days=40, t_stat=1.0))
    return out.select("factor", "direction", "years", "ic_years", "spread_years", "selected", "failed", *[shown(C(x)).alias(x) for x in ("rank_ic", "t_stat", "coverage")])


_NAMES = list(FACTORS)
_LONG = "lr AS (" + " UNION ALL ".join(f"SELECT instrument, week_no, {i} AS k, '{n}' AS factor, {n}::DOUBLE AS x FROM fr WHERE {n} IS NOT NULL" for i, n in enumerate([*_NAMES, "label"])) + ")"
_PAIRS = f"""{BARS_SQL}, {_F}, {_LONG},
rk AS (SELECT *, rank() OVER (PARTITION BY week_no, k ORDER BY x) + (count(*) OVER (PARTITION BY week_no, k, x) - 1) / 2 AS r FROM lr),
pr AS (SELECT a.factor AS factor_i, b.factor AS factor_j, a.week_no, CASE WHEN count(*) >= {LEAST} AND min(a.r) < max(a.r) AND min(b.r) < max(b.r) THEN corr(a.r, b.r) END AS c FROM rk a JOIN rk b ON a.instrument = b.instrument AND a.week_no = b.week_no AND a.k < b.k GROUP BY ALL),
nm AS (SELECT unnest({[*_NAMES, 'label']}) AS factor, generate_subscripts({[*_NAMES, 'label']}, 1) AS k),
mc AS (SELECT x.factor AS factor_i, y.factor AS factor_j, count(c) AS dates, avg(c) AS correlation FROM nm x JOIN nm y ON x.k < y.k LEFT JOIN pr ON pr.factor_i = x.factor AND pr.factor_j = y.factor GROUP BY ALL)"""
_STABLE = f"""{BARS_SQL}, {_F},
lr AS ({' UNION ALL '.join(f"SELECT instrument, week_no, label, '{n}' AS factor, {n}::DOUBLE AS x FROM fr WHERE {n} IS NOT NULL AND label IS NOT NULL" for n in _NAMES)}),
rk AS (SELECT *, {_rank('x', ', factor')} AS rf, {_rank('label', ', factor')} AS rl FROM lr),
wk AS (SELECT factor, week_no, floor(week_no / 52)::INT AS year, count(*) AS n, corr(rf, rl) AS ic, avg(CASE WHEN rf > 0.8 THEN label END) - avg(CASE WHEN rf <= 0.2 THEN label END) AS spread FROM rk GROUP BY ALL HAVING count(*) >= {LEAST}),
sm AS (SELECT factor, avg(ic) AS rank_ic, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)) AS t_stat, coalesce(sign(avg(ic)), 0)::INT AS direction FROM wk GROUP BY factor),
an AS (SELECT factor, year, avg(ic) AS ic, sum(spread) AS spread FROM wk GROUP BY ALL HAVING count(spread) >= 40),
yr AS (SELECT factor, count(*)::INT AS years, count(CASE WHEN ic * direction > 0 THEN 1 END)::INT AS ic_years, count(CASE WHEN spread * direction > 0 THEN 1 END)::INT AS spread_years FROM an JOIN sm USING (factor) GROUP BY factor),
cv AS (SELECT factor, sum(n) / sum(best) AS coverage FROM (SELECT *, max(n) OVER (PARTITION BY week_no) AS best FROM wk) GROUP BY factor),
al AS (SELECT factor, direction, coalesce(years, 0) AS years, coalesce(ic_years, 0) AS ic_years, coalesce(spread_years, 0) AS spread_years, rank_ic, t_stat, coverage FROM sm LEFT JOIN yr USING (factor) LEFT JOIN cv USING (factor)),
fl AS (SELECT *, array_to_string(list_filter([CASE WHEN direction = 0 THEN 'direction' END, CASE WHEN abs(rank_ic) >= 0.01 THEN NULL ELSE 'rank_ic' END, CASE WHEN abs(t_stat) >= 1 THEN NULL ELSE 't_stat' END, CASE WHEN ic_years >= 0.75 * years AND years > 0 THEN NULL ELSE 'ic_years' END, CASE WHEN spread_years >= 0.75 * years AND years > 0 THEN NULL ELSE 'spread_years' END, CASE WHEN coverage >= 0.9 THEN NULL ELSE 'coverage' END], lambda x: x IS NOT NULL), ',') AS failed FROM al)"""

QUERIES = {"factor_correlation": correlation, "factor_pruning": pruning, "factor_stability": stability}
SQL = {
    "factor_correlation": f"WITH {_PAIRS} SELECT factor_i, factor_j, dates, {_shown('correlation')} AS correlation FROM mc",
    "factor_pruning": f"""WITH RECURSIVE {_PAIRS},
od AS (SELECT factor_i AS factor, (row_number() OVER (ORDER BY coalesce(abs(correlation), 0) DESC, factor_i))::INT AS place FROM mc WHERE factor_j = 'label'),
cl AS (SELECT factor_i AS a, factor_j AS b, abs(correlation) AS c FROM mc WHERE abs(correlation) >= {LIMIT} UNION ALL SELECT factor_j, factor_i, abs(correlation) FROM mc WHERE abs(correlation) >= {LIMIT}),
nr AS (SELECT o.factor, o.place, coalesce(list(b ORDER BY c DESC, p.place) FILTER (b IS NOT NULL), []) AS near FROM od o LEFT JOIN cl ON a = o.factor LEFT JOIN od p ON p.factor = cl.b GROUP BY ALL),
st AS (SELECT 0 AS place, []::VARCHAR[] AS keep, NULL::VARCHAR AS factor, NULL::VARCHAR AS hit UNION ALL
  SELECT n.place, CASE WHEN len(list_filter(n.near, lambda x: list_contains(keep, x))) = 0 THEN list_append(keep, n.factor) ELSE keep END, n.factor, list_filter(n.near, lambda x: list_contains(keep, x))[1] FROM st JOIN nr n ON n.place = st.place + 1)
SELECT factor, place, hit IS NULL AS kept, hit AS duplicates FROM st WHERE place > 0""",
    "factor_stability": f"WITH {_STABLE} SELECT factor, direction, years, ic_years, spread_years, failed = '' AS selected, failed, {', '.join(f'{_shown(x)} AS {x}' for x in ('rank_ic', 't_stat', 'coverage'))} FROM fl",
}
