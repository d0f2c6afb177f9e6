"""More panel operators: missing values, comparisons, trailing windows with a least count, regressions, weights that decay, members and groups; with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions import scalars as row
from factorloom.operators import cross_section as xs
from factorloom.operators import series as ts
from factorloom.plans.panel import BARS_SQL, C, _columns, _full, _lag, _rank, _snapped, _w, bars, snapped

P1, P5 = _lag("close", 1), _lag("close", 5)
_ONE = lambda x: f"CASE WHEN {x} THEN 1.0 ELSE 0.0 END"
_UP = "CASE WHEN close > open THEN close END"
_UV = "CASE WHEN close > open THEN volume END"
_S8 = f"count({_UP}) {_w(8)}"
_CAP = "CASE WHEN cap > 3000 THEN {} END"


def _trail(f: str) -> str:
    return f"CASE WHEN {_S8} >= 3 THEN {f}({_UP}) {_w(8)} END"


def _cov(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) {_w(10)}"


_DET = f"({_cov('open', 'open')} * {_cov('volume', 'volume')} - {_cov('open', 'volume')} ** 2)"
_FINE = f"count(*) {_w(10)} = 10 AND {_DET} > 1e-9 * {_cov('open', 'open')} * {_cov('volume', 'volume')}"
_B1 = f"({_cov('volume', 'volume')} * {_cov('open', 'close')} - {_cov('open', 'volume')} * {_cov('volume', 'close')}) / {_DET}"
_B2 = f"({_cov('open', 'open')} * {_cov('volume', 'close')} - {_cov('open', 'volume')} * {_cov('open', 'close')}) / {_DET}"
_K = 3 - 2 * 2**0.5
_CS_B = f"(power(ln(high / low), 2) + power(ln({_lag('high', 1)} / {_lag('low', 1)}), 2))"
_CS_G = f"CASE WHEN {_lag('high', 1)} IS NOT NULL THEN power(ln(greatest(high, {_lag('high', 1)}) / least(low, {_lag('low', 1)})), 2) END"
_CS_A = f"((sqrt(2 * {_CS_B}) - sqrt({_CS_B})) / {_K!r} - sqrt(({_CS_G}) / {_K!r}))"
_Z = "(volume - avg(CASE WHEN cap > 3000 THEN volume END) OVER d) / stddev_samp(CASE WHEN cap > 3000 THEN volume END) OVER d"
_S = "OVER (PARTITION BY week_no, sector)"

#: Name: the column over bars, and its SQL.
RULES: dict[str, tuple[Callable[[SimpleNamespace], Column], str]] = {
    "row_valid": (lambda b: row.indicator(row.valid(ts.delay(b.close, 1), ts.delay(b.close, 5))), _ONE(f"{P1} IS NOT NULL AND {P5} IS NOT NULL")),
    "row_missing": (lambda b: row.indicator(ts.delay(b.close, 1).isNull()), _ONE(f"{P1} IS NULL")),
    "row_and": (lambda b: row.indicator(row.told(ts.delay(b.close, 1) > b.close) & row.told(b.close > b.open)), _ONE(f"coalesce({P1} > close, false) AND close > open")),
    "row_or": (lambda b: row.indicator(row.told(ts.delay(b.close, 1) > b.close) | row.told(b.close > b.open)), _ONE(f"coalesce({P1} > close, false) OR close > open")),
    "row_compare": (lambda b: row.indicator(row.told(ts.delay(b.close, 1) <= b.close)), _ONE(f"coalesce({P1} <= close, false)")),
    "row_not_equal": (lambda b: row.indicator(row.told(ts.delay(b.volume, 1) != b.volume)), _ONE(f"coalesce({_lag('volume', 1)} <> volume, false)")),
    "row_mask": (lambda b: row.mask(b.close > b.open, b.close), _UP),
    "row_select": (lambda b: row.select(ts.delay(b.close, 1) > b.close, b.high, b.low), f"CASE WHEN {P1} > close THEN high ELSE low END"),
    "row_set_inf": (lambda b: row.set_inf(F.try_divide(b.high - b.low, b.close - b.open)), "coalesce((high - low) / nullif(close - open, 0), 0.0)"),
    "row_replace_inf": (lambda b: row.replace_inf(F.when(b.close > b.open, F.lit(float("inf"))).otherwise(b.close)), "CASE WHEN NOT close > open THEN close END"),
    "row_fmin": (lambda b: F.least(ts.delay(b.close, 1), b.close), f"least({P1}, close)"),
    "row_fmax": (lambda b: F.greatest(ts.delay(b.close, 1), b.close), f"greatest({P1}, close)"),
    "row_abs": (lambda b: F.abs(b.close - b.open), "abs(close - open)"),
    "row_sign": (lambda b: F.signum(b.close - b.open), "sign(close - open)"),
    "row_sqrt": (lambda b: row.root(b.close - b.open), "CASE WHEN close >= open THEN sqrt(close - open) END"),
    "row_log": (lambda b: row.log(b.close - b.open), "CASE WHEN close > open THEN ln(close - open) END"),
    "row_exp": (lambda b: F.exp(b.low / b.high), "exp(low / high)"),
    "row_power": (lambda b: row.power(b.close - b.open, 0.25), "CASE WHEN close >= open THEN power(close - open, 0.25) END"),
    "row_log1p": (lambda b: F.log1p(b.volume), "ln(1 + volume)"),
    "row_expm1": (lambda b: F.expm1(b.low / b.high), "exp(low / high) - 1"),
    "row_ceil": (lambda b: F.ceil(b.close / 7).cast("double"), "ceil(close / 7)"),
    "row_fillna": (lambda b: F.coalesce(ts.delay(b.close, 1), F.lit(0.0)), f"coalesce({P1}, 0.0)"),
    "row_nan_mean": (lambda b: row.mean_present(1, ts.delay(b.close, 1), ts.delay(b.close, 5)), f"list_avg([{P1}, {P5}])"),
    "row_mean_lags": (lambda b: row.mean_present(2, *[ts.delay(b.close, k) for k in (1, 2, 3)]), f"CASE WHEN len(list_filter([{P1}, {_lag('close', 2)}, {_lag('close', 3)}], lambda x: x IS NOT NULL)) >= 2 THEN list_avg([{P1}, {_lag('close', 2)}, {_lag('close', 3)}]) END"),
    "row_growth": (lambda b: row.growth(b.close, b.open - 1000), "CASE WHEN open - 1000 > 0 THEN close / (open - 1000) - 1 END"),
    "row_snap": (lambda b: row.snap(b.close / 3 - b.close / 3 * (1 + 2.0**-50)) + row.snap(b.close / 3), "CASE WHEN abs(close / 3) < 1e-12 THEN 0 ELSE round_even(close / 3 * power(2.0, 39 - floor(log2(close / 3))), 0) / power(2.0, 39 - floor(log2(close / 3))) END"),
    "row_limit_flag": (lambda b: row.indicator(F.round(b.open, 2) >= F.round(b.high, 2)), _ONE("round(open, 2) >= round(high, 2)")),
    "row_ohlc_valid": (lambda b: row.indicator((b.high >= F.greatest(b.open, b.close, b.low)) & (b.low <= F.least(b.open, b.close, b.high))), _ONE("high >= greatest(open, close, low) AND low <= least(open, close, high)")),
    "ts_ffill": (lambda b: ts.ffill(row.mask(b.close > b.open, b.close)), f"last_value({_UP} IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY week_no ROWS UNBOUNDED PRECEDING)"),
    "ts_weighted_sum": (lambda b: ts.weighted_sum(b.close, [1.0, -2.0, 1.0]), f"close - 2 * {P1} + {_lag('close', 2)}"),
    "ts_argmin": (lambda b: ts.argmin(b.low, 6), f"CASE WHEN count(low) {_w(6)} = 6 THEN list_position(list(low) {_w(6)}, min(low) {_w(6)}) END"),
    "ts_aroon": (lambda b: ts.aroon(b.high, 6), f"CASE WHEN count(high) {_w(6)} = 6 THEN (7 - list_position(list_reverse(list(high) {_w(6)}), max(high) {_w(6)})) / 6 END"),
    **{f"ts_trailing_{k}": (lambda b, f=f: ts.trailing(row.mask(b.close > b.open, b.close), 8, 3, f), _trail(s)) for k, f, s in (("sum", F.sum, "sum"), ("mean", F.avg, "avg"), ("min", F.min, "min"), ("max", F.max, "max"), ("std", F.stddev_samp, "stddev_samp"))},
    "ts_trailing_var": (lambda b: ts.trailing(row.mask(b.close > b.open, b.close / 1000), 8, 3, F.var_samp), f"CASE WHEN {_S8} >= 3 THEN var_samp({_UP} / 1000) {_w(8)} END"),
    "ts_trailing_skew": (lambda b: ts.trailing_moment(row.mask(b.close > b.open, b.close), 8, 3, 3), f"CASE WHEN {_S8} >= 3 THEN skewness({_UP}) {_w(8)} END"),
    "ts_trailing_kurt": (lambda b: ts.trailing_moment(row.mask(b.close > b.open, b.close), 8, 4, 4), f"CASE WHEN {_S8} >= 4 THEN kurtosis({_UP}) {_w(8)} END"),
    "ts_trailing_stride": (lambda b: ts.trailing(b.close, 10, 2, F.avg, 3), "CASE WHEN count(close) OVER s >= 2 THEN avg(close) OVER s END"),
    "ts_pair_correlation": (lambda b: ts.pair_correlation(row.mask(b.close > b.open, b.close), b.volume, 10, 4), f"CASE WHEN count({_UP}) {_w(10)} >= 4 AND min({_UP}) {_w(10)} < max({_UP}) {_w(10)} AND min({_UV}) {_w(10)} < max({_UV}) {_w(10)} THEN corr({_UP}, {_UV}) {_w(10)} END"),
    "ts_ols_first": (lambda b: ts.ols2(b.close, b.open, b.volume, 10)[0], f"CASE WHEN {_FINE} THEN {_B1} END"),
    "ts_ols_second": (lambda b: ts.ols2(b.close, b.open, b.volume, 10)[1], f"CASE WHEN {_FINE} THEN {_B2} END"),
    "ts_ols_residual_std": (lambda b: ts.ols2(b.close, b.open, b.volume, 10)[2], f"CASE WHEN {_FINE} THEN sqrt(greatest(0.0, {_cov('close', 'close')} - {_B1} * {_cov('open', 'close')} - {_B2} * {_cov('volume', 'close')}) * 10 / 7) END"),
    "ts_coskewness": (lambda b: ts.coskewness(b.close, b.volume, 10), f"CASE WHEN count(*) {_w(10)} = 10 THEN (avg(close * volume * volume) {_w(10)} - 2 * avg(volume) {_w(10)} * avg(close * volume) {_w(10)} - avg(close) {_w(10)} * avg(volume * volume) {_w(10)} + 2 * avg(close) {_w(10)} * avg(volume) {_w(10)} * avg(volume) {_w(10)}) / nullif(stddev_pop(close) {_w(10)} * var_pop(volume) {_w(10)}, 0) END"),
    "ts_seasonal_mean": (lambda b: row.mean_present(1, ts.delay(b.close, 52), ts.delay(b.close, 104)), f"list_avg([{_lag('close', 52)}, {_lag('close', 104)}])"),
    "ts_high_low_spread": (lambda b: ts.spread_high_low(b.high, b.low), f"CASE WHEN {_CS_A} IS NOT NULL THEN greatest(0.0, 2 * (exp({_CS_A}) - 1) / (1 + exp({_CS_A}))) END"),
    "ts_missing_weeks": (lambda b: 10 - F.count(b.close).over(ts.frame(10)), f"10 - count(close) {_w(10)}"),
    "ew_sum": (lambda b: ts.decayed(b.close, 10, 0.9), " + ".join(f"{0.9**k!r} * coalesce({_lag('close', k) if k else 'close'}, 0)" for k in range(10))),
    "ew_slope": (lambda b: ts.decayed_fit(b.close, b.open, 12, 0.9, 6)[0], "b"),  # over rows of their own, see below
    "ew_intercept": (lambda b: ts.decayed_fit(b.close, b.open, 12, 0.9, 6)[1], "my - b * mx"),
    "cumulative_gain": (lambda b: ts.cumulative_gain((b.close / b.open - 1) / 100), "exp(sum(CASE WHEN close > open THEN ln(1 + (close / open - 1) / 100) ELSE 0 END) OVER (PARTITION BY instrument ORDER BY week_no ROWS UNBOUNDED PRECEDING))"),
    "xs_rank_snapped": (lambda b: xs.rank(row.snap(b.volume / 3)), _rank("volume")),
    "xs_rank_members": (lambda b: xs.rank_members(b.volume, b.cap > 3000), f"CASE WHEN cap > 3000 THEN (rank() OVER (PARTITION BY week_no, cap > 3000 ORDER BY volume) + (count(*) OVER (PARTITION BY week_no, cap > 3000, volume) - 1) / 2) / count({_CAP.format('volume')}) OVER d END"),
    "xs_group_mean": (lambda b: xs.group_mean(b.close, "sector"), f"avg(close) {_S}"),
    "xs_group_stddev": (lambda b: xs.group_stddev(b.close, "sector"), f"stddev_samp(close) {_S}"),
    "xs_zscore_members": (lambda b: xs.zscore_members(b.volume, b.cap > 3000), f"CASE WHEN {_Z} IS NOT NULL THEN greatest(-3.0, least(3.0, {_Z})) END"),
    "xs_herfindahl": (lambda b: xs.herfindahl(b.amount, "sector"), f"sum(amount * amount) {_S} / (sum(amount) {_S} * sum(amount) {_S})"),
    "xs_combine": (lambda b: xs.combine([(2.0, ts.delay(b.close, 1)), (1.0, b.open)]), f"CASE WHEN {P1} IS NULL THEN open ELSE (2 * {P1} + open) / 3 END"),
    "xs_winsorised": (lambda b: xs.winsorised(b.amount, 0.1, 0.9), "greatest(quantile_cont(amount, 0.1) OVER d, least(quantile_cont(amount, 0.9) OVER d, amount))"),
    "xs_fill_infinite": (lambda b: xs.fill_infinite(F.when(b.close > b.open, F.lit(float("inf"))).otherwise(b.close)), "CASE WHEN close > open THEN avg(CASE WHEN NOT close > open THEN close END) OVER d ELSE close END"),
    "xs_group_transform_max": (lambda b: F.max(b.close).over(xs._day()), "max(close) OVER d"),
    "adjusted_close": (lambda b: b.close * b.close / F.first(b.close).over(ts.Window.partitionBy("instrument").orderBy("week_no").rowsBetween(ts.Window.unboundedPreceding, 0)), "close * close / first_value(close) OVER (PARTITION BY instrument ORDER BY week_no ROWS UNBOUNDED PRECEDING)"),
    "adjusted_volume": (lambda b: b.volume / (b.close / F.first(b.close).over(ts.Window.partitionBy("instrument").orderBy("week_no").rowsBetween(ts.Window.unboundedPreceding, 0))), "volume / (close / first_value(close) OVER (PARTITION BY instrument ORDER BY week_no ROWS UNBOUNDED PRECEDING))"),
}


def _query(column: Callable[[SimpleNamespace], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: bars(spark, sf_dir).select("instrument", "week_no", snapped(column(_columns())).alias("value"))


_WINDOWS = "WINDOW d AS (PARTITION BY week_no), s AS (PARTITION BY instrument, week_no % 3 ORDER BY week_no RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)"
QUERIES = {name: _query(column) for name, (column, _) in RULES.items()}
SQL = {name: f"WITH {BARS_SQL} SELECT instrument, week_no, {_snapped(text)} AS value FROM bars {_WINDOWS}" for name, (_, text) in RULES.items()}
#: Weights by age, pair by pair of weeks, and deviations from weighted means.
_EW = f"""WITH {BARS_SQL},
ag AS (SELECT a.instrument, a.week_no, power(0.9, a.week_no - b.week_no) AS w, b.open AS x, b.close AS y FROM bars a JOIN bars b ON b.instrument = a.instrument AND b.week_no BETWEEN a.week_no - 11 AND a.week_no),
mn AS (SELECT instrument, week_no, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM ag GROUP BY instrument, week_no HAVING count(*) >= 6),
sl AS (SELECT instrument, week_no, max(mx) AS mx, max(my) AS my, sum(w * (x - mx) * (y - my)) / nullif(sum(w * (x - mx) ** 2), 0) AS b FROM ag JOIN mn USING (instrument, week_no) GROUP BY instrument, week_no)"""
SQL |= {name: f"{_EW} SELECT r.instrument, r.week_no, {_snapped(f'({RULES[name][1]})')} AS value FROM bars r LEFT JOIN sl USING (instrument, week_no)" for name in ("ew_slope", "ew_intercept")}
