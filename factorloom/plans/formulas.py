"""The published set of 101 formulas over prices and volumes, on dense weekly bars, with the same in SQL.

One query holds eight formulas. Values keep 16 significant bits, so that small factors show as many digits as large ones.
Sectors and industries are groups of instruments; the finest level of a group is the industry.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.plans.nested import ALONG, Panel, Term
from factorloom.sources.bars import BARS_SQL, DENSE_SQL, bars, dense

#: The published formulas, fractional windows as whole rows. `lesser` and `greater` are of two values of one row.
FORMULAS: dict[int, str] = {
    1: "rank(argmax(where(ret < 0, std(ret, 20), close) * where(ret < 0, std(ret, 20), close), 5))",
    2: "fill(-corr(rank(delta(log(volume), 2)), rank((close - open) / open), 6))",
    3: "fill(-corr(rank(open), rank(volume), 10))",
    4: "-ts_rank(rank(low), 9)",
    5: "rank(open - sum(vwap, 10) / 10) * -abs(rank(close - vwap))",
    6: "fill(-corr(open, volume, 10))",
    7: "where(adv(20) >= volume, -1, -(ts_rank(abs(delta(close, 7)), 60) * sign(delta(close, 7))))",
    8: "-rank(sum(open, 5) * sum(ret, 5) - delay(sum(open, 5) * sum(ret, 5), 10))",
    9: "where((ts_min(delta(close), 5) > 0) | (ts_max(delta(close), 5) < 0), delta(close), -delta(close))",
    10: "where((ts_min(delta(close), 4) > 0) | (ts_max(delta(close), 4) < 0), delta(close), -delta(close))",
    11: "(rank(ts_max(vwap - close, 3)) + rank(ts_min(vwap - close, 3))) * rank(delta(volume, 3))",
    12: "sign(delta(volume)) * -delta(close)",
    13: "-rank(cov(rank(close), rank(volume), 5))",
    14: "-(rank(delta(ret, 3)) * fill(corr(open, volume, 10)))",
    15: "-sum(rank(fill(corr(rank(high), rank(volume), 3))), 3)",
    16: "-rank(cov(rank(high), rank(volume), 5))",
    17: "-(rank(ts_rank(close, 10)) * rank(delta(delta(close))) * rank(ts_rank(fill(volume / adv(20)), 5)))",
    18: "-rank(std(abs(close - open), 5) + (close - open) + fill(corr(close, open, 10)))",
    19: "-sign(close - delay(close, 7) + delta(close, 7)) * (1 + rank(1 + sum(ret, 250)))",
    20: "-(rank(open - delay(high, 1)) * rank(open - delay(close, 1)) * rank(open - delay(low, 1)))",
    21: "where(~(mean(close, 8) + std(close, 8) < mean(close, 2)) & ((mean(close, 2) < mean(close, 8) - std(close, 8)) | (volume / adv(20) >= 1)), 1, -1)",
    22: "-(delta(fill(corr(high, volume, 5)), 5) * rank(std(close, 20)))",
    23: "where(mean(high, 20) < high, -fill(delta(high, 2)), 0)",
    24: "where(delta(mean(close, 100), 100) / delay(close, 100) <= 0.05, -(close - ts_min(close, 100)), -delta(close, 3))",
    25: "rank(-ret * adv(20) * vwap * (high - close))",
    26: "-ts_max(fill(corr(ts_rank(volume, 5), ts_rank(high, 5), 5)), 3)",
    27: "where(rank(mean(corr(rank(volume), rank(vwap), 6), 2) / 2) > 0.5, -1, 1)",
    28: "scale(fill(corr(adv(20), low, 5)) + (high + low) / 2 - close)",
    29: "ts_min(rank(rank(scale(log(sum(rank(rank(-rank(delta(close - 1, 5)))), 2))))), 5) + ts_rank(delay(-ret, 6), 5)",
    30: "(1 - rank(sign(delta(close)) + sign(delay(delta(close), 1)) + sign(delay(delta(close), 2)))) * fill(sum(volume, 5) / sum(volume, 20), 1)",
    31: "rank(rank(rank(decay(-rank(rank(delta(close, 10))), 10)))) + rank(-delta(close, 3)) + sign(scale(fill(corr(adv(20), low, 12))))",
    32: "scale(mean(close, 7) / 7 - close) + 20 * scale(corr(vwap, delay(close, 5), 230))",
    33: "rank(open / close - 1)",
    34: "rank(2 - rank(fill(std(ret, 2) / std(ret, 5), 1)) - rank(delta(close)))",
    35: "ts_rank(volume, 32) * (1 - ts_rank(close + high - low, 16)) * (1 - ts_rank(ret, 32))",
    36: "2.21 * rank(corr(close - open, delay(volume, 1), 15)) + 0.7 * rank(open - close) + 0.73 * rank(ts_rank(delay(-ret, 6), 5)) + rank(abs(corr(vwap, adv(20), 6))) + 0.6 * rank((mean(close, 200) / 200 - open) * (close - open))",
    37: "rank(corr(delay(open - close, 1), close, 200)) + rank(open - close)",
    38: "-rank(ts_rank(open, 10)) * rank(fill(close / open, 1))",
    39: "-rank(delta(close, 7) * (1 - rank(decay(volume / adv(20), 9)))) * (1 + rank(mean(ret, 250)))",
    40: "-rank(std(high, 10)) * fill(corr(high, volume, 10), 1)",
    41: "power(high * low, 0.5) - vwap",
    42: "rank(vwap - close) / rank(vwap + close)",
    43: "ts_rank(fill(volume / adv(20)), 20) * ts_rank(-delta(close, 7), 8)",
    44: "-fill(corr(high, rank(volume), 5))",
    45: "-(rank(mean(delay(close, 5), 20)) * fill(corr(close, volume, 2)) * rank(fill(corr(sum(close, 5), sum(close, 20), 2), 1)))",
    46: "where(bend > 0.25, -1, where(bend < 0, 1, -delta(close)))",
    47: "fill(rank(1 / close) * volume / adv(20) * (high * rank(high - close) / (mean(high, 5) / 5)) - rank(vwap - delay(vwap, 5)))",
    48: "neutral(corr(delta(close), delta(delay(close, 1)), 250) * delta(close) / close, 'industry') / sum(delta(close) / delay(close, 1) * (delta(close) / delay(close, 1)), 250)",
    49: "where(bend < -0.1, 1, -delta(close))",
    50: "-ts_max(rank(fill(corr(rank(volume), rank(vwap), 5))), 5)",
    51: "where(bend < -0.05, 1, -delta(close))",
    52: "-delta(ts_min(low, 5), 5) * rank((sum(ret, 240) - sum(ret, 20)) / 220) * ts_rank(volume, 5)",
    53: "-delta((close - low - (high - close)) / apart(close, low), 9)",
    54: "-(low - close) * power(open, 5) / (apart(low, high) * power(close, 5))",
    55: "-fill(corr(rank((close - ts_min(low, 12)) / apart(ts_max(high, 12), ts_min(low, 12))), rank(volume), 6))",
    56: "-(rank(sum(ret, 10) / sum(sum(ret, 2), 3)) * rank(ret * cap))",
    57: "-((close - vwap) / decay(rank(argmax(close, 30)), 2))",
    58: "-ts_rank(decay(corr(neutral(vwap, 'sector'), volume, 4), 8), 6)",
    59: "-ts_rank(decay(corr(neutral(vwap, 'industry'), volume, 4), 16), 8)",
    60: "-(2 * scale(rank((close - low - (high - close)) * volume / apart(high, low))) - scale(rank(argmax(close, 10))))",
    61: "flag(rank(vwap - ts_min(vwap, 16)) < rank(corr(vwap, adv(180), 18)))",
    62: "-flag(rank(corr(vwap, mean(adv(20), 22), 10)) < rank(flag(rank(open) + rank(open) < rank((high + low) / 2) + rank(high))))",
    63: "-(rank(decay(delta(neutral(close, 'industry'), 2), 8)) - rank(decay(corr(blend(vwap, open, 0.318108), sum(adv(180), 38), 14), 12)))",
    64: "-flag(rank(corr(mean(blend(open, low, 0.178404), 13), mean(adv(120), 13), 17)) < rank(delta(blend((high + low) / 2, vwap, 0.178404), 4)))",
    65: "-flag(rank(corr(blend(open, vwap, 0.00817205), mean(adv(60), 9), 6)) < rank(open - ts_min(open, 14)))",
    66: "-(rank(decay(delta(vwap, 4), 7)) + ts_rank(decay(fill((low - vwap) / fixed(open - (high + low) / 2)), 11), 7))",
    67: "-power(rank(high - ts_max(high, 2)), rank(corr(neutral(vwap, 'sector'), neutral(adv(20), 'industry'), 6)))",
    68: "-flag(ts_rank(corr(rank(high), rank(adv(15)), 9), 14) < rank(delta(blend(close, low, 0.518371), 1)))",
    69: "-power(rank(ts_max(delta(neutral(vwap, 'industry'), 3), 5)), ts_rank(corr(blend(close, vwap, 0.490655), adv(20), 5), 9))",
    70: "-power(rank(delta(vwap, 1)), ts_rank(corr(neutral(close, 'industry'), adv(50), 18), 18))",
    71: "greater(ts_rank(decay(corr(ts_rank(close, 3), ts_rank(adv(180), 12), 18), 4), 16), ts_rank(decay(power(rank(low + open - (vwap + vwap)), 2), 16), 4))",
    72: "(rank(decay(corr((high + low) / 2, adv(40), 9), 10)) + 0.0001) / (rank(decay(corr(ts_rank(vwap, 4), ts_rank(volume, 19), 7), 3)) + 0.0001)",
    73: "-greater(rank(decay(delta(vwap, 5), 3)), ts_rank(decay(-(delta(blend(open, low, 0.147155), 2) / blend(open, low, 0.147155)), 3), 17))",
    74: "-flag(rank(corr(close, mean(adv(30), 37), 15)) < rank(corr(rank(blend(high, vwap, 0.0261661)), rank(volume), 11)))",
    75: "flag(rank(corr(vwap, volume, 4)) < rank(corr(rank(low), rank(adv(50)), 12)))",
    76: "-greater(rank(decay(delta(vwap, 1), 12)), ts_rank(decay(ts_rank(corr(neutral(low, 'sector'), adv(81), 8), 20), 17), 19))",
    77: "lesser(rank(decay((high + low) / 2 + high - (vwap + high), 20)), rank(decay(fill(corr((high + low) / 2, adv(40), 3), 1), 6)))",
    78: "power(rank(corr(sum(blend(low, vwap, 0.352233), 20), sum(adv(40), 20), 7)), rank(fill(corr(rank(vwap), rank(volume), 6))))",
    79: "flag(rank(delta(neutral(blend(close, open, 0.60733), 'sector'), 1)) < rank(corr(ts_rank(vwap, 4), ts_rank(adv(150), 9), 15)))",
    80: "-power(rank(sign(delta(neutral(blend(open, high, 0.868128), 'industry'), 4))), ts_rank(corr(high, adv(10), 5), 6))",
    81: "-flag(rank(log(product(rank(power(rank(corr(vwap, sum(adv(10), 50), 8)), 4)), 15))) < rank(corr(rank(vwap), rank(volume), 5)))",
    82: "-lesser(rank(decay(delta(open, 1), 15)), ts_rank(decay(corr(neutral(volume, 'sector'), open, 17), 7), 13))",
    83: "rank(delay((high - low) / (sum(close, 5) / 5), 2)) * rank(rank(volume)) / ((high - low) / (sum(close, 5) / 5) / fixed(vwap - close))",
    84: "power(ts_rank(vwap - ts_max(vwap, 15), 21), delta(close, 5))",
    85: "power(rank(fill(corr(blend(high, close, 0.876703), adv(30), 10), 1)), rank(fill(corr(ts_rank((high + low) / 2, 4), ts_rank(volume, 10), 7), 1)))",
    86: "-flag(ts_rank(corr(close, mean(adv(20), 15), 6), 20) < rank(open + close - (vwap + open)))",
    87: "-greater(rank(decay(delta(blend(close, vwap, 0.369701), 2), 3)), ts_rank(decay(abs(corr(neutral(adv(81), 'industry'), close, 13)), 5), 14))",
    88: "lesser(rank(decay(rank(open) + rank(low) - (rank(high) + rank(close)), 8)), ts_rank(decay(fill(corr(ts_rank(close, 8), ts_rank(adv(60), 21), 8)), 7), 3))",
    89: "ts_rank(decay(corr(low, adv(10), 7), 6), 4) - ts_rank(decay(delta(neutral(vwap, 'industry'), 3), 10), 15)",
    90: "-power(rank(close - ts_max(close, 5)), ts_rank(corr(neutral(adv(40), 'industry'), low, 5), 3))",
    91: "-(ts_rank(decay(decay(corr(neutral(close, 'industry'), volume, 10), 16), 4), 5) - rank(decay(corr(vwap, adv(30), 4), 3)))",
    92: "lesser(ts_rank(decay(flag((high + low) / 2 + close < low + open), 15), 19), ts_rank(decay(fill(corr(rank(low), rank(adv(30)), 8)), 7), 7))",
    93: "ts_rank(decay(corr(neutral(vwap, 'industry'), adv(81), 17), 20), 8) / rank(decay(delta(blend(close, vwap, 0.524434), 3), 16))",
    94: "-power(rank(vwap - ts_min(vwap, 12)), ts_rank(fill(corr(ts_rank(vwap, 20), ts_rank(adv(60), 4), 18)), 3))",
    95: "flag(rank(open - ts_min(open, 12)) < ts_rank(power(rank(corr(mean((high + low) / 2, 19), mean(adv(40), 19), 13)), 5), 12))",
    96: "-greater(ts_rank(decay(fill(corr(rank(vwap), rank(volume), 4)), 4), 8), ts_rank(decay(argmax(fill(corr(ts_rank(close, 7), ts_rank(adv(60), 4), 4)), 13), 14), 13))",
    97: "rank(decay(delta(neutral(blend(low, vwap, 0.721001), 'industry'), 3), 20)) - ts_rank(decay(ts_rank(corr(ts_rank(low, 8), ts_rank(adv(60), 17), 5), 19), 16), 7)",
    98: "rank(decay(corr(vwap, mean(adv(5), 26), 5), 7)) - rank(decay(ts_rank(argmin(fill(corr(rank(open), rank(adv(15)), 21)), 9), 7), 8))",
    99: "-flag(rank(corr(sum((high + low) / 2, 20), sum(adv(60), 20), 9)) < rank(corr(low, volume, 6)))",
    100: "-((1.5 * scale(neutral(neutral(rank((close - low - (high - close)) / fixed(high - low) * volume), 'industry'), 'industry')) - scale(neutral(corr(close, rank(adv(20)), 5) - rank(argmin(close, 30)), 'industry'))) * (volume / adv(20)))",
    101: "(close - open) / (high - low + 0.001)",
}

GROUP, BITS = 8, 16


def shown(x: Column) -> Column:
    """To 16 significant bits, with bounds that simple fractions don't lie on."""
    scale = F.pow(F.lit(2.0), BITS - 1 - F.floor(F.log2(F.abs(x))))
    return F.when(F.abs(x) < 1e-12, F.lit(0.0)).otherwise(F.floor(x * scale + 0.37) / scale)


def _shown_array(x: np.ndarray) -> np.ndarray:
    """As `shown`, for columns that are shuffled before the end; `shown` changes them no further."""
    with np.errstate(all="ignore"):
        scale = np.exp2(BITS - 1 - np.floor(np.log2(np.abs(x))))
        told = np.floor(x * scale + 0.37) / scale
    return np.where(np.abs(x) < 1e-12, 0.0, np.where(np.isfinite(told), told, x))


def short(terms: dict[str, Term]) -> dict[str, Term]:
    """The terms, as `shown` has them where arrays make them."""
    return {name: Term(x.column, lambda arrays, of=x.array: _shown_array(np.asarray(of(arrays), dtype=float)), x.sql, x.level, phase=x.phase) for name, x in terms.items()}


def _shown(x: str) -> str:
    scale = f"power(2.0, {BITS - 1} - floor(log2(abs({x}))))"
    return f"CASE WHEN abs({x}) < 1e-12 THEN 0.0 ELSE floor({x} * {scale} + 0.37) / {scale} END"


def _terms(ids: list[int]) -> tuple[Panel, dict[str, Term]]:
    panel = Panel()
    names = panel.names()
    close, delay = names["close"], panel.delay
    names |= {
        "blend": lambda a, b, share: a * share + b * (1 - share),
        "apart": lambda a, b: panel.where((a - b >= 0) & (a - b <= 0), 0.0001, a - b),
        "fixed": panel._fixed,
        "bend": panel._fixed((delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10),
    }
    return panel, {f"a101_{k:03}": eval(FORMULAS[k], {"__builtins__": {}}, names) for k in ids}


def _query(ids: list[int]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel, terms = _terms(ids)
        out = panel.table(dense(bars(spark, sf_dir)), short(terms), ["instrument", "week_no"], ALONG)
        return out.select("instrument", "week_no", *[shown(F.col(name)).alias(name) for name in terms])

    return query


def _sql(ids: list[int]) -> str:
    panel, terms = _terms(ids)
    steps, last = panel.sql("dense")
    return f"WITH {BARS_SQL}, {DENSE_SQL}{steps}\nSELECT instrument, week_no, " + ", ".join(f"{_shown(term.sql)} AS {name}" for name, term in terms.items()) + f" FROM {last}"


_GROUPS = {f"a101_{k:03}_{min(k + GROUP - 1, 101):03}": [x for x in range(k, k + GROUP) if x in FORMULAS] for k in range(1, 102, GROUP)}
QUERIES = {name: _query(ids) for name, ids in _GROUPS.items()}
SQL = {name: _sql(ids) for name, ids in _GROUPS.items()}
