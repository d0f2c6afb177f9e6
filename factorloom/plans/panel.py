"""One query for each panel operator, over the weekly bars, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions import scalars
from factorloom.operators import cross_section as xs
from factorloom.operators import series as ts
from factorloom.sources.bars import BARS_SQL, bars

C = F.col


def _w(d: int, until: int = 0) -> str:
    """A frame of d weeks that ends so many weeks ago."""
    return f"OVER (PARTITION BY instrument ORDER BY week_no RANGE BETWEEN {d - 1 + until} PRECEDING AND {f'{until} PRECEDING' if until else 'CURRENT ROW'})"


def _lag(x: str, d: int) -> str:
    return f"max({x}) {_w(1, d)}"


def _full(d: int, aggregate: str, *inputs: str) -> str:
    return f"CASE WHEN {' AND '.join(f'count({x}) {_w(d)} = {d}' for x in inputs)} THEN {aggregate} {_w(d)} END"


def _rank(x: str, groups: str = "") -> str:
    return f"(rank() OVER (PARTITION BY week_no{groups} ORDER BY {x}) + (count(*) OVER (PARTITION BY week_no{groups}, {x}) - 1) / 2) / count({x}) OVER (PARTITION BY week_no{groups})"


_FLAT = f"min(close) {_w(6)} = max(close) {_w(6)} OR min(volume) {_w(6)} = max(volume) {_w(6)}"

#: Name: the column over bars, and its SQL.
PANEL: dict[str, tuple[Callable[[SimpleNamespace], Column], str]] = {
    "ts_delay": (lambda b: ts.delay(b.close, 3), _lag("close", 3)),
    "ts_delta": (lambda b: ts.delta(b.close, 2), f"close - {_lag('close', 2)}"),
    "ts_returns": (lambda b: ts.returns(b.close), f"close / {_lag('close', 1)} - 1"),
    "ts_sum": (lambda b: ts.ts_sum(b.volume, 5), _full(5, "sum(volume)", "volume")),
    "ts_mean": (lambda b: ts.ts_mean(b.close, 10), _full(10, "avg(close)", "close")),
    "ts_min": (lambda b: ts.ts_min(b.low, 8), _full(8, "min(low)", "low")),
    "ts_max": (lambda b: ts.ts_max(b.high, 8), _full(8, "max(high)", "high")),
    "ts_stddev": (lambda b: ts.stddev(b.close, 6), f"CASE WHEN min(close) {_w(6)} = max(close) {_w(6)} AND count(close) {_w(6)} = 6 THEN 0.0 ELSE {_full(6, 'stddev_samp(close)', 'close')} END"),
    "ts_covariance": (lambda b: ts.covariance(b.close, b.volume, 6), _full(6, "covar_samp(close, volume)", "close", "volume")),
    "ts_correlation": (lambda b: ts.correlation(b.close, b.volume, 6), f"CASE WHEN count(close) {_w(6)} = 6 THEN CASE WHEN {_FLAT} THEN 0.0 ELSE greatest(-1.0, least(1.0, corr(close, volume) {_w(6)})) END END"),
    "ts_decay_linear": (lambda b: ts.decay_linear(b.close, 4), f"(4 * close + 3 * {_lag('close', 1)} + 2 * {_lag('close', 2)} + {_lag('close', 3)}) / 10"),
    "ts_wma": (lambda b: ts.wma(b.close, 3), f"(close + 0.9 * {_lag('close', 1)} + 0.81 * {_lag('close', 2)}) / 2.71"),
    "ts_rank": (lambda b: ts.ts_rank(b.volume, 6), ""),  # its SQL needs a step of its own, see _sql
    "ts_days_since_max": (lambda b: ts.days_since_max(b.high, 6), f"CASE WHEN count(high) {_w(6)} = 6 THEN list_position(list_reverse(list(high) {_w(6)}), max(high) {_w(6)}) - 1 END"),
    "ts_quantile": (lambda b: ts.quantile(b.close, 0.8, 5), _full(5, "quantile_cont(close, 0.8)", "close")),
    "ts_slope": (lambda b: ts.slope(b.close, 8), _full(8, "regr_slope(close, week_no::DOUBLE)", "close")),
    "ts_count_if": (lambda b: ts.count_if(b.close > b.open, b.close, 10), _full(10, "sum(CASE WHEN close > open THEN 1.0 ELSE 0.0 END)", "close")),
    "ts_sum_if": (lambda b: ts.sum_if(b.close > b.open, b.volume, 10), _full(10, "sum(CASE WHEN close > open THEN volume ELSE 0.0 END)", "volume")),
    "xs_rank": (lambda b: xs.rank(b.volume), _rank("volume")),
    "xs_group_rank": (lambda b: xs.rank(b.volume, "sector"), _rank("volume", ", sector")),
    "xs_bucket": (lambda b: xs.bucket(b.close, 5), f"greatest(1, least(5, ceil({_rank('close')} * 5)))"),
    "xs_scale": (lambda b: xs.scale(b.close - b.open), "(close - open) / nullif(sum(abs(close - open)) OVER (PARTITION BY week_no), 0)"),
    "xs_zscore": (lambda b: xs.zscore(b.volume), "greatest(-3.0, least(3.0, (volume - avg(volume) OVER (PARTITION BY week_no)) / stddev_samp(volume) OVER (PARTITION BY week_no)))"),
    "xs_neutralize": (lambda b: xs.neutralize(b.close, "sector"), "close - avg(close) OVER (PARTITION BY week_no, sector)"),
    "xs_weighted_mean": (lambda b: xs.weighted_mean(b.close, b.cap, "sector"), "sum(CASE WHEN cap > 0 THEN close * cap END) OVER (PARTITION BY week_no, sector) / sum(CASE WHEN cap > 0 THEN cap END) OVER (PARTITION BY week_no, sector)"),
    "xs_residual": (lambda b: xs.residual(b.close, b.volume), "close - avg(close) OVER d - covar_samp(close, volume) OVER d / var_samp(volume) OVER d * (volume - avg(volume) OVER d)"),
    "row_safe_div": (lambda b: scalars.safe_div(b.high - b.low, b.close - b.open), "CASE WHEN abs(close - open) > 1e-12 THEN (high - low) / (close - open) END"),
    "row_indicator": (lambda b: scalars.indicator(b.vwap > b.close), "CASE WHEN vwap > close THEN 1.0 ELSE 0.0 END"),
    "ts_stddev_pop": (lambda b: ts.stddev_pop(b.close, 6), _full(6, "stddev_pop(close)", "close")),
    "ts_product": (lambda b: ts.product(b.close / b.open, 4), _full(4, "product(close / open)", "close")),
    "ts_momentum": (lambda b: ts.momentum(b.close, 2, 6), f"{_lag('close', 2)} / {_lag('close', 6)} - 1"),
    "ts_days_since_min": (lambda b: ts.days_since_min(b.low, 6), f"CASE WHEN count(low) {_w(6)} = 6 THEN list_position(list_reverse(list(low) {_w(6)}), min(low) {_w(6)}) - 1 END"),
    "ts_argmax": (lambda b: ts.argmax(b.high, 6), f"CASE WHEN count(high) {_w(6)} = 6 THEN list_position(list(high) {_w(6)}, max(high) {_w(6)}) END"),
    "ts_top_mean": (lambda b: ts.top_mean(b.high, 3, 8), f"CASE WHEN count(high) {_w(8)} = 8 THEN list_avg(list_slice(list_reverse_sort(list(high) {_w(8)}), 1, 3)) END"),
    "xs_rank_zscore": (lambda b: xs.rank_zscore(b.volume), f"({_rank('volume')} * count(volume) OVER d - (count(volume) OVER d + 1) / 2) / sqrt(count(volume) OVER d * (count(volume) OVER d + 1) / 12)"),
    "xs_group_median": (lambda b: xs.group_median(b.close, "sector"), "median(close) OVER (PARTITION BY week_no, sector)"),
    "xs_group_count": (lambda b: xs.group_count(b.close, "sector"), "count(close) OVER (PARTITION BY week_no, sector)"),
    "xs_weight": (lambda b: xs.weight(b.amount), "amount / sum(amount) OVER d"),
    "row_element_max": (lambda b: scalars.element_max(b.vwap, b.close), "greatest(vwap, close)"),
    "row_element_min": (lambda b: scalars.element_min(b.vwap, b.close), "least(vwap, close)"),
    "row_clip": (lambda b: scalars.clip(b.close / b.open - 1, -0.1, 0.1), "greatest(-0.1, least(0.1, close / open - 1))"),
    "row_signed_power": (lambda b: scalars.signed_power(b.close - b.open, 0.5), "sign(close - open) * sqrt(abs(close - open))"),
}


def snapped(x: Column) -> Column:
    """To four decimals, with bounds that decimal prices don't lie on, so that the last bits of a sum don't show."""
    return F.floor(x.cast("double") * 10000 + 0.37).cast("long") / 10000


def _snapped(text: str) -> str:
    return f"floor(({text})::DOUBLE * 10000 + 0.37)::BIGINT / 10000"


def _columns() -> SimpleNamespace:
    """The bars' columns; made when a query runs, because columns need a session."""
    return SimpleNamespace(**{x: C(x) for x in ("open", "high", "low", "close", "volume", "amount", "cap", "vwap")})


def _query(column: Callable[[SimpleNamespace], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: bars(spark, sf_dir).select("instrument", "week_no", snapped(column(_columns())).alias("value"))


def _sql(name: str, text: str) -> str:
    if name == "ts_rank":
        inner = f"SELECT instrument, week_no, volume, list(volume) {_w(6)} AS v FROM bars"
        return f"WITH {BARS_SQL}, r AS ({inner}) SELECT instrument, week_no, {_snapped('CASE WHEN len(v) = 6 THEN (len(list_filter(v, lambda y: y < volume)) + (len(list_filter(v, lambda y: y = volume)) + 1) / 2) / 6 END')} AS value FROM r"
    return f"WITH {BARS_SQL} SELECT instrument, week_no, {_snapped(text)} AS value FROM bars WINDOW d AS (PARTITION BY week_no)"


def bars_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bars(spark, sf_dir)
    return out.select("instrument", "week_no", "sector", *[snapped(C(x)).alias(x) for x in ("open", "high", "low", "close", "volume", "amount", "vwap", "cap")])


def forward_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By week: the correlation of a factor's ranks with those of the next week's return, and the spread of its outer fifths."""
    out = bars(spark, sf_dir).withColumn("factor", -ts.returns(C("close"))).withColumn("label", F.max("close").over(ts.frame(1, -1)) / C("close") - 1).where("factor is not null and label is not null")
    out = out.withColumns({"rf": xs.rank(C("factor")), "rl": xs.rank(C("label")), "q": xs.bucket(C("factor"), 5)})
    spread = F.avg(F.when(C("q") == 5, C("label"))) - F.avg(F.when(C("q") == 1, C("label")))
    return out.groupBy("week_no").agg(F.count("*").alias("n"), snapped(xs.correlation(C("factor"), C("label"))).alias("ic"), snapped(xs.correlation(C("rf"), C("rl"))).alias("rank_ic"), snapped(spread).alias("spread")).where("n >= 20")


_IC = f"""
WITH {BARS_SQL},
f AS (SELECT *, -(close / {_lag("close", 1)} - 1) AS factor, max(close) OVER (PARTITION BY instrument ORDER BY week_no RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) / close - 1 AS label FROM bars),
k AS (SELECT * FROM f WHERE factor IS NOT NULL AND label IS NOT NULL),
r AS (SELECT *, {_rank("factor")} AS rf, {_rank("label")} AS rl FROM k)
SELECT week_no, count(*) AS n, {_snapped('corr(factor, label)')} AS ic, {_snapped('corr(rf, rl)')} AS rank_ic,
  {_snapped('avg(CASE WHEN ceil(rf * 5) >= 5 THEN label END) - avg(CASE WHEN ceil(rf * 5) <= 1 THEN label END)')} AS spread
FROM r GROUP BY week_no HAVING count(*) >= 20
"""

QUERIES = {"rank_ic": forward_rank_ic, "bars": bars_query} | {name: _query(column) for name, (column, _) in PANEL.items()}
SQL = {"rank_ic": _IC, "bars": f"WITH {BARS_SQL} SELECT instrument, week_no, sector, " + ", ".join(f"{_snapped(x)} AS {x}" for x in ("open", "high", "low", "close", "volume", "amount", "vwap", "cap")) + " FROM bars"} | {name: _sql(name, text) for name, (_, text) in PANEL.items()}
