"""Two factor sets from bars alone, made by rule: shapes and windows (158 columns), and lags (360 columns), with the same in SQL.

One query holds one window length, or one lagged field, so that a plan has some dozens of columns. The windows of a length run in one stage of Arrow batches.
Windows follow the package's rule: null unless all d values are there. A correlation without a value is 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators import batches
from factorloom.operators import series as ts
from factorloom.plans.panel import _full, _lag, _snapped, _w, snapped
from factorloom.sources.bars import BARS_SQL, bars

C = F.col
TINY = 1e-12
#: Window lengths, and the last lag.
WINDOWS = (5, 10, 20, 30, 60)
LAST_LAG = 59

_TOP, _BOTTOM = "greatest(open, close)", "least(open, close)"
_SHAPES = {"mid": "close - open", "len": "high - low", "up": f"high - {_TOP}", "low": f"{_BOTTOM} - low", "sft": "2 * close - high - low"}
#: Shapes of one bar, by the open or by the bar's range. These texts mean the same in both engines.
CANDLES: dict[str, str] = {
    "KMID": f"({_SHAPES['mid']}) / open", "KLEN": f"({_SHAPES['len']}) / open", "KMID2": f"({_SHAPES['mid']}) / (high - low + {TINY})",
    "KUP": f"({_SHAPES['up']}) / open", "KUP2": f"({_SHAPES['up']}) / (high - low + {TINY})", "KLOW": f"({_SHAPES['low']}) / open",
    "KLOW2": f"({_SHAPES['low']}) / (high - low + {TINY})", "KSFT": f"({_SHAPES['sft']}) / open", "KSFT2": f"({_SHAPES['sft']}) / (high - low + {TINY})",
} | {f"{x.upper()}0": f"{x} / close" for x in ("open", "high", "low", "vwap")}


def _quantile(g: batches.Groups, x: np.ndarray, q: float, d: int) -> np.ndarray:
    """Between the two nearest of the window's values."""
    ordered = np.sort(np.lib.stride_tricks.sliding_window_view(np.r_[np.full(d - 1, np.nan), x], d), axis=1)
    at = q * (d - 1)
    low, high = int(np.floor(at)), int(np.ceil(at))
    value = ordered[:, low] if low == high else (high - at) * ordered[:, low] + (at - low) * ordered[:, high]
    return np.where(np.isnan(batches.extreme(g, x, d, True)), np.nan, value)


def _stage(d: int) -> dict[str, tuple[batches.Window, list[str]]]:
    """The windows of d rows, over `moves`."""
    whole = d * (d * d - 1) / 12

    def total(g, x):
        return batches.weighted(g, x, [1.0] * d)

    def told(g, x, move):
        return total(g, np.where(np.isnan(move), np.nan, x))

    return {
        "w_lag": (lambda g, x: batches.delay(g, x, d), ["close"]),
        "w_mean": (lambda g, x: total(g, x) / d, ["close"]),
        "w_sd": (lambda g, x: batches.deviation(g, x, d), ["close"]),
        "w_slope": (lambda g, x: batches.weighted(g, x, [k - (d - 1) / 2 for k in range(d)]) / whole, ["close"]),
        "w_high": (lambda g, x: batches.extreme(g, x, d, False), ["high"]),
        "w_low": (lambda g, x: batches.extreme(g, x, d, True), ["low"]),
        "w_upper": (lambda g, x: _quantile(g, x, 0.8, d), ["close"]),
        "w_lower": (lambda g, x: _quantile(g, x, 0.2, d), ["close"]),
        "w_rank": (lambda g, x: batches.place_in_window(g, x, d), ["close"]),
        "w_high_at": (lambda g, x: batches.first_place(g, x, d, False), ["high"]),
        "w_low_at": (lambda g, x: batches.first_place(g, x, d, True), ["low"]),
        "w_corr": (lambda g, x, y: batches.correlation(g, x, y, d), ["close", "log_volume"]),
        "w_cord": (lambda g, x, y: batches.correlation(g, x, y, d), ["close_ratio", "volume_ratio"]),
        "w_rose": (lambda g, x, move: told(g, x > 0, move), ["close_up", "close_move"]),
        "w_fell": (lambda g, x, move: told(g, x > 0, move), ["close_down", "close_move"]),
        "w_volume": (lambda g, x: total(g, x) / d, ["volume"]),
        "w_volume_sd": (lambda g, x: batches.deviation(g, x, d), ["volume"]),
        "w_swing": (lambda g, x: total(g, x) / d, ["swing"]),
        "w_swing_sd": (lambda g, x: batches.deviation(g, x, d), ["swing"]),
    } | {f"w_{x}_{move}": (told, [f"{x}_{move}", f"{x}_move"]) for x in ("close", "volume") for move in ("move", "up", "down")}


def _part(x: str, move: str) -> Column:
    return C(f"w_{x}_{move}") / (C(f"w_{x}_move") + TINY)


#: Windows of d rows: name, and the column by d, over `_stage`.
ROLLING: dict[str, Callable[[int], Column]] = {
    "ROC": lambda d: C("w_lag") / C("close"),
    "MA": lambda d: C("w_mean") / C("close"),
    "STD": lambda d: C("w_sd") / C("close"),
    "BETA": lambda d: C("w_slope") / C("close"),
    "RSQR": lambda d: F.when(C("w_sd") > 0, F.try_divide(C("w_slope") * C("w_slope") * (d * (d + 1) / 12), C("w_sd") * C("w_sd"))),
    "RESI": lambda d: (C("close") - C("w_mean") - C("w_slope") * ((d - 1) / 2)) / C("close"),
    "MAX": lambda d: C("w_high") / C("close"),
    "MIN": lambda d: C("w_low") / C("close"),
    "QTLU": lambda d: C("w_upper") / C("close"),
    "QTLD": lambda d: C("w_lower") / C("close"),
    "RANK": lambda d: C("w_rank"),
    "RSV": lambda d: F.when(C("w_low").isNotNull(), F.least(F.lit(10.0), (C("close") - C("w_low")) / (C("w_high") - C("w_low") + TINY))),
    "IMAX": lambda d: C("w_high_at") / d,
    "IMIN": lambda d: C("w_low_at") / d,
    "IMXD": lambda d: (C("w_high_at") - C("w_low_at")) / d,
    "CORR": lambda d: F.coalesce(C("w_corr"), F.lit(0.0)),
    "CORD": lambda d: F.coalesce(C("w_cord"), F.lit(0.0)),
    "CNTP": lambda d: C("w_rose") / d,
    "CNTN": lambda d: C("w_fell") / d,
    "CNTD": lambda d: C("w_rose") / d - C("w_fell") / d,
    "SUMP": lambda d: _part("close", "up"),
    "SUMN": lambda d: _part("close", "down"),
    "SUMD": lambda d: _part("close", "up") - _part("close", "down"),
    "VMA": lambda d: C("w_volume") / (C("volume") + TINY),
    "VSTD": lambda d: C("w_volume_sd") / (C("volume") + TINY),
    "WVMA": lambda d: C("w_swing_sd") / (C("w_swing") + TINY),
    "VSUMP": lambda d: _part("volume", "up"),
    "VSUMN": lambda d: _part("volume", "down"),
    "VSUMD": lambda d: _part("volume", "up") - _part("volume", "down"),
}


def moves(df: DataFrame) -> DataFrame:
    """Adds what the windows take besides bars: changes from the row before, split by sign, ratios, and the swing of a row's volume."""
    before = df.withColumns({"close_1": ts.delay(C("close"), 1), "volume_1": ts.delay(C("volume"), 1)})
    zero = F.lit(0.0)
    split = {}
    for x in ("close", "volume"):
        change = C(x) - C(f"{x}_1")
        split |= {f"{x}_move": F.abs(change), f"{x}_up": F.greatest(change, zero), f"{x}_down": F.greatest(-change, zero)}
    return before.withColumns(split | {
        "log_volume": F.ln(C("volume") + 1), "close_ratio": C("close") / C("close_1"),
        "volume_ratio": F.ln(C("volume") / (C("volume_1") + TINY) + 1), "swing": F.abs(C("close") / C("close_1") - 1) * C("volume"),
    })


_MOVES_SQL = f"""
before AS (SELECT *, {_lag("close", 1)} AS close_1, {_lag("volume", 1)} AS volume_1 FROM bars),
m AS (SELECT *, {", ".join(f"abs({x} - {x}_1) AS {x}_move, greatest({x} - {x}_1, 0.0) AS {x}_up, greatest({x}_1 - {x}, 0.0) AS {x}_down" for x in ("close", "volume"))},
  ln(volume + 1) AS log_volume, close / close_1 AS close_ratio, ln(volume / (volume_1 + {TINY}) + 1) AS volume_ratio, abs(close / close_1 - 1) * volume AS swing FROM before)"""


def _rolling_sql(d: int) -> dict[str, str]:
    whole = lambda f, x: _full(d, f"{f}({x})", x)
    sd = lambda x: f"CASE WHEN min({x}) {_w(d)} = max({x}) {_w(d)} AND count({x}) {_w(d)} = {d} THEN 0.0 ELSE {whole('stddev_samp', x)} END"
    slope = _full(d, "regr_slope(close, week_no::DOUBLE)", "close")
    cor = lambda x, y: f"CASE WHEN count({x}) {_w(d)} < {d} OR count({y}) {_w(d)} < {d} OR min({x}) {_w(d)} = max({x}) {_w(d)} OR min({y}) {_w(d)} = max({y}) {_w(d)} THEN 0.0 ELSE greatest(-1.0, least(1.0, corr({x}, {y}) {_w(d)})) END"
    at = lambda x, f: f"CASE WHEN len({x}s) = {d} THEN list_position({x}s, list_{f}({x}s)) END"
    part = lambda x, move: f"({_full(d, f'sum({x}_{move})', f'{x}_move')}) / ({whole('sum', f'{x}_move')} + {TINY})"
    share = lambda move: f"({_full(d, f'sum(CASE WHEN close_{move} > 0 THEN 1.0 ELSE 0.0 END)', 'close_move')}) / {d}"
    low, high = whole("min", "low"), whole("max", "high")
    return {
        "ROC": f"{_lag('close', d)} / close", "MA": f"({whole('avg', 'close')}) / close", "STD": f"({sd('close')}) / close", "BETA": f"({slope}) / close",
        "RSQR": f"CASE WHEN min(close) {_w(d)} < max(close) {_w(d)} THEN ({slope}) * ({slope}) * {d * (d + 1) / 12} / var_samp(close) {_w(d)} END",
        "RESI": f"(close - ({whole('avg', 'close')}) - ({slope}) * {(d - 1) / 2}) / close", "MAX": f"({high}) / close", "MIN": f"({low}) / close",
        "QTLU": f"({_full(d, 'quantile_cont(close, 0.8)', 'close')}) / close", "QTLD": f"({_full(d, 'quantile_cont(close, 0.2)', 'close')}) / close",
        "RANK": f"CASE WHEN len(closes) = {d} THEN (len(list_filter(closes, lambda y: y < close)) + (len(list_filter(closes, lambda y: y = close)) + 1) / 2) / {d} END",
        "RSV": f"CASE WHEN count(low) {_w(d)} = {d} THEN least(10.0, (close - ({low})) / (({high}) - ({low}) + {TINY})) END",
        "IMAX": f"({at('high', 'max')}) / {d}", "IMIN": f"({at('low', 'min')}) / {d}", "IMXD": f"(({at('high', 'max')}) - ({at('low', 'min')})) / {d}",
        "CORR": cor("close", "log_volume"), "CORD": cor("close_ratio", "volume_ratio"), "CNTP": share("up"), "CNTN": share("down"), "CNTD": f"{share('up')} - {share('down')}",
        "SUMP": part("close", "up"), "SUMN": part("close", "down"), "SUMD": f"{part('close', 'up')} - {part('close', 'down')}",
        "VMA": f"({whole('avg', 'volume')}) / (volume + {TINY})", "VSTD": f"({sd('volume')}) / (volume + {TINY})", "WVMA": f"({sd('swing')}) / (({whole('avg', 'swing')}) + {TINY})",
        "VSUMP": part("volume", "up"), "VSUMN": part("volume", "down"), "VSUMD": f"{part('volume', 'up')} - {part('volume', 'down')}",
    }


def catalogue() -> dict[str, str]:
    """Every factor's id and name, in the sets' order."""
    names = [*CANDLES, *(f"{x}{d}" for x in ROLLING for d in WINDOWS)]
    lags = [f"{x.upper()}{k}" for x in LAGGED for k in range(LAST_LAG, -1, -1)]
    return {f"a158_{i:03d}": x for i, x in enumerate(names, 1)} | {f"a360_{i:03d}": x for i, x in enumerate(lags, 1)}


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("instrument", "week_no", *[snapped(F.expr(x)).alias(f"a158_{i:03d}") for i, x in enumerate(CANDLES.values(), 1)])


def _rolling_id(i: int, d: int) -> str:
    return f"a158_{len(CANDLES) + 1 + len(WINDOWS) * i + WINDOWS.index(d):03d}"


def _rolling(d: int) -> Callable[[SparkSession, str], DataFrame]:
    def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return batches.stage(moves(bars(spark, sf_dir)), ts.KEY, ts.ORDER, _stage(d), [ts.KEY, ts.ORDER, "close", "volume"])

    return lambda spark, sf_dir: windows(spark, sf_dir).select("instrument", "week_no", *[snapped(f(d)).alias(_rolling_id(i, d)) for i, f in enumerate(ROLLING.values())])


#: The lagged fields in order.
LAGGED = ("close", "open", "high", "low", "vwap", "volume")


def _lag_ids(x: str) -> list[tuple[int, str]]:
    """Lags, the oldest first, with their ids."""
    start = LAGGED.index(x) * (LAST_LAG + 1) + 1
    return [(LAST_LAG - i, f"a360_{start + i:03d}") for i in range(LAST_LAG + 1)]


def _lags(x: str) -> Callable[[SparkSession, str], DataFrame]:
    by = lambda: C("volume") + TINY if x == "volume" else C("close")
    return lambda spark, sf_dir: bars(spark, sf_dir).select("instrument", "week_no", *[snapped((ts.delay(C(x), k) if k else C(x)) / by()).alias(name) for k, name in _lag_ids(x)])


def _lags_sql(x: str) -> str:
    by = f"(volume + {TINY})" if x == "volume" else "close"
    return f"WITH {BARS_SQL} SELECT instrument, week_no, " + ", ".join(f"{_snapped(f'{_lag(x, k) if k else x} / {by}')} AS {name}" for k, name in _lag_ids(x)) + " FROM bars"


def _windows_sql(d: int) -> str:
    lists = ", ".join(f"list({x}) {_w(d)} AS {x}s" for x in ("close", "high", "low"))
    return f"WITH {BARS_SQL}, {_MOVES_SQL}, r AS (SELECT *, {lists} FROM m) SELECT instrument, week_no, " + ", ".join(f"{_snapped(x)} AS {_rolling_id(i, d)}" for i, x in enumerate(_rolling_sql(d).values())) + " FROM r"


QUERIES = {"a158_candles": candles} | {f"a158_rolling_{d}": _rolling(d) for d in WINDOWS} | {f"a360_{x}": _lags(x) for x in LAGGED}
SQL = (
    {"a158_candles": f"WITH {BARS_SQL} SELECT instrument, week_no, " + ", ".join(f"{_snapped(x)} AS a158_{i:03d}" for i, x in enumerate(CANDLES.values(), 1)) + " FROM bars"}
    | {f"a158_rolling_{d}": _windows_sql(d) for d in WINDOWS}
    | {f"a360_{x}": _lags_sql(x) for x in LAGGED}
)
