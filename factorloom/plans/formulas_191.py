"""The published set of 191 formulas over prices, volumes and the market, on dense weekly bars, with the same in SQL.

One query holds eight formulas. Weeks stand in for days, the mean of a week's prices for the market index, and a year of 52 weeks
for one of 252 days in 149. Formula 30 needs series of style returns and is not among them. Missing values: a window is whole
or missing, a comparison with a missing value is false, and a divisor within 1e-12 of zero gives a missing value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factorloom.functions.scalars import snap
from factorloom.plans.formulas import GROUP, _shown, short, shown
from factorloom.plans.nested import ALONG, Panel, Term, constant, snap_sql, snapped
from factorloom.sources.bars import BARS_SQL, DENSE_SQL, bars, dense

#: The published formulas. `per` divides; `when` is a value where a condition holds, else 0, and missing unless the further values are there.
FORMULAS: dict[int, str] = {
    1: "-corr(rank(delta(log(volume))), rank(per(close - open, open)), 6)",
    2: "-delta(location())",
    3: "sum(reached(), 6)",
    4: "given(where(less(mean(close, 8) + std(close, 8), mean(close, 2)), -1, where(less(mean(close, 2), mean(close, 8) - std(close, 8)), 1, given(where(fixed(per(volume, adv(20))) >= 1, 1, -1), per(volume, adv(20))))), mean(close, 8), mean(close, 2), std(close, 8))",
    5: "-ts_max(corr(ts_rank(volume, 5), ts_rank(high, 5), 5), 3)",
    6: "-rank(sign(delta(open * 0.85 + high * 0.15, 4)))",
    7: "(rank(ts_max(vwap - close, 3)) + rank(ts_min(vwap - close, 3))) * rank(delta(volume, 3))",
    8: "-rank(delta(middle * 0.2 + vwap * 0.8, 4))",
    9: "sma(per(delta(middle) * (high - low), volume), 7, 2)",
    10: "rank(ts_max(square(given(where(ret >= 0, close, std(ret, 20)), close, ret)), 5))",
    11: "sum(location() * volume, 6)",
    12: "rank(open - mean(vwap, 10)) * -rank(abs(close - vwap))",
    13: "root(high * low) - vwap",
    14: "delta(close, 5)",
    15: "per(open, before) - 1",
    16: "-ts_max(rank(corr(rank(volume), rank(vwap), 5)), 5)",
    17: "power(rank(vwap - ts_max(vwap, 15)), delta(close, 5))",
    18: "per(close, delay(close, 5))",
    19: "given(where(close < delay(close, 5), growth(5), where(close > delay(close, 5), per(delta(close, 5), close), 0)), close, delay(close, 5))",
    20: "growth(6) * 100",
    21: "trend(mean(close, 6), 6)",
    22: "sma(delta(off(6), 3), 12, 1)",
    23: "per(rough(True), rough(True) + rough(False)) * 100",
    24: "sma(delta(close, 5), 5, 1)",
    25: "-rank(delta(close, 7) * (1 - rank(decay(per(volume, adv(20)), 9)))) * (1 + rank(sum(ret, 250)))",
    26: "mean(close, 7) - close + corr(vwap, delay(close, 5), 230)",
    27: "wma((growth(3) + growth(6)) * 100, 12)",
    28: "sma(stochastic(9), 3, 1) * 3 - sma(sma(stochastic(9), 3, 1), 3, 1) * 2",
    29: "growth(6) * volume",
    31: "off(12) * 100",
    32: "-sum(rank(corr(rank(high), rank(volume), 3)), 3)",
    33: "(delay(ts_min(low, 5), 5) - ts_min(low, 5)) * rank((sum(ret, 240) - sum(ret, 20)) / 220) * ts_rank(volume, 5)",
    34: "per(mean(close, 12), close)",
    35: "-lesser(rank(decay(delta(open), 15)), rank(decay(corr(volume, open, 17), 7)))",
    36: "rank(sum(corr(rank(volume), rank(vwap), 6), 2))",
    37: "-rank(fixed(sum(open, 5) * sum(ret, 5)) - delay(sum(open, 5) * sum(ret, 5), 10))",
    38: "given(where(less(mean(high, 20), high), -delta(high, 2), 0), mean(high, 20), delta(high, 2), high)",
    39: "rank(decay(corr(vwap * 0.3 + open * 0.7, sum(adv(180), 37), 14), 12)) - rank(decay(delta(close, 2), 8))",
    40: "per(sum(when(close > before, volume, close, before, volume), 26), sum(when(close <= before, volume, close, before, volume), 26)) * 100",
    41: "-rank(ts_max(delta(vwap, 3), 5))",
    42: "-rank(std(high, 10)) * corr(high, volume, 10)",
    43: "sum(signed(), 6)",
    44: "ts_rank(decay(corr(low, adv(10), 7), 6), 4) + ts_rank(decay(delta(vwap, 3), 10), 15)",
    45: "rank(delta(close * 0.6 + open * 0.4)) * rank(corr(vwap, adv(150), 15))",
    46: "per(mean(close, 3) + mean(close, 6) + mean(close, 12) + mean(close, 24), close * 4)",
    47: "sma(williams(6), 9, 1)",
    48: "-rank(sign(close - before) + sign(before - delay(close, 2)) + sign(delay(close, 2) - delay(close, 3))) * per(sum(volume, 5), sum(volume, 20))",
    49: "per(sum(falling(), 12), sum(falling(), 12) + sum(rising(), 12))",
    50: "per(sum(rising(), 12), sum(rising(), 12) + sum(falling(), 12)) - per(sum(falling(), 12), sum(rising(), 12) + sum(falling(), 12))",
    51: "per(sum(rising(), 12), sum(rising(), 12) + sum(falling(), 12))",
    52: "per(sum(above_0(high - delay(typical, 1)), 26), sum(above_0(delay(typical, 1) - low), 26)) * 100",
    53: "sum(when(close > before, 1, close, before), 12) / 12 * 100",
    54: "-rank(std(abs(close - open), 10) + (close - open) + corr(close, open, 10))",
    55: "sum(gapped(), 20)",
    56: "below(rank(open - ts_min(open, 12)), rank(power(rank(corr(sum(middle, 19), sum(adv(40), 19), 13)), 5)), 1)",
    57: "sma(stochastic(9), 3, 1)",
    58: "sum(when(close > before, 1, close, before), 20) / 20 * 100",
    59: "sum(reached(), 20)",
    60: "sum(location() * volume, 20)",
    61: "-greater(rank(decay(delta(vwap), 12)), rank(decay(rank(corr(low, adv(80), 8)), 17)))",
    62: "-corr(high, rank(volume), 5)",
    63: "strength(change, 6)",
    64: "-greater(rank(decay(corr(rank(vwap), rank(volume), 4), 4)), rank(decay(ts_max(corr(rank(close), rank(adv(60)), 4), 13), 14)))",
    65: "per(mean(close, 6), close)",
    66: "off(6) * 100",
    67: "strength(change, 24)",
    68: "sma(per(delta(middle) * (high - low), volume), 15, 2)",
    69: "given(where(less(sum(up_open(), 20), sum(down_open(), 20)), per(sum(up_open(), 20) - sum(down_open(), 20), sum(down_open(), 20)), where(less(sum(down_open(), 20), sum(up_open(), 20)), per(sum(up_open(), 20) - sum(down_open(), 20), sum(up_open(), 20)), 0)), sum(up_open(), 20), sum(down_open(), 20))",
    70: "std(amount, 6)",
    71: "off(24) * 100",
    72: "sma(williams(6), 15, 1)",
    73: "rank(decay(corr(vwap, adv(30), 4), 3)) - ts_rank(decay(decay(corr(close, volume, 10), 16), 4), 5)",
    74: "rank(corr(sum(low * 0.35 + vwap * 0.65, 20), sum(adv(40), 20), 7)) + rank(corr(rank(vwap), rank(volume), 6))",
    75: "per(sum(when((close > open) & less(market(close), market(open)), 1, close, open), 50), sum(when(less(market(close), market(open)), 1, close, open), 50))",
    76: "per(std(per(abs(ret), volume), 20), mean(per(abs(ret), volume), 20))",
    77: "lesser(rank(decay(middle - vwap, 20)), rank(decay(corr(middle, adv(40), 3), 6)))",
    78: "per(fixed(typical) - mean(typical, 12), mean(abs(close - mean(typical, 12)), 12) * 0.015)",
    79: "strength(change, 12)",
    80: "per(delta(volume, 5), delay(volume, 5)) * 100",
    81: "sma(volume, 21, 2)",
    82: "sma(williams(6), 20, 1)",
    83: "-rank(cov(rank(high), rank(volume), 5))",
    84: "sum(signed(), 20)",
    85: "ts_rank(per(volume, adv(20)), 20) * ts_rank(-delta(close, 7), 8)",
    86: "given(where(bend() > 0.25, -1, where(bend() < 0, 1, -change)), bend())",
    87: "-(rank(decay(delta(vwap, 4), 7)) + ts_rank(decay(per(low - vwap, open - middle), 11), 7))",
    88: "growth(20) * 100",
    89: "(spread(close) - sma(spread(close), 10, 2)) * 2",
    90: "-rank(corr(rank(vwap), rank(volume), 5))",
    91: "-rank(close - ts_max(close, 5)) * rank(corr(adv(40), low, 5))",
    92: "-greater(rank(decay(delta(close * 0.35 + vwap * 0.65, 2), 3)), ts_rank(decay(abs(corr(adv(180), close, 13)), 5), 15))",
    93: "sum(down_open(), 20)",
    94: "sum(signed(), 30)",
    95: "std(amount, 20)",
    96: "sma(sma(stochastic(9), 3, 1), 3, 1)",
    97: "std(volume, 10)",
    98: "given(where(fixed(per(delta(mean(close, 100), 100), delay(close, 100))) <= 0.05, ts_min(close, 100) - close, -delta(close, 3)), per(delta(mean(close, 100), 100), delay(close, 100)), ts_min(close, 100), delta(close, 3))",
    99: "-rank(cov(rank(close), rank(volume), 5))",
    100: "std(volume, 20)",
    101: "below(rank(corr(close, sum(adv(30), 37), 15)), rank(corr(rank(high * 0.1 + vwap * 0.9), rank(volume), 11)), -1)",
    102: "strength(delta(volume), 6)",
    103: "(20 - lowday(low, 20)) / 20 * 100",
    104: "-delta(corr(high, volume, 5), 5) * rank(std(close, 20))",
    105: "-corr(rank(open), rank(volume), 10)",
    106: "delta(close, 20)",
    107: "-rank(open - delay(high, 1)) * rank(open - before) * rank(open - delay(low, 1))",
    108: "-power(rank(high - ts_min(high, 2)), rank(corr(vwap, adv(120), 6)))",
    109: "per(sma(high - low, 10, 2), sma(sma(high - low, 10, 2), 10, 2))",
    110: "per(sum(above_0(high - before), 20), sum(above_0(before - low), 20)) * 100",
    111: "sma(per((close - low - (high - close)) * volume, high - low), 11, 2) - sma(per((close - low - (high - close)) * volume, high - low), 4, 2)",
    112: "per(sum(above_0(change), 12) - sum(above_0(-change), 12), sum(above_0(change), 12) + sum(above_0(-change), 12)) * 100",
    113: "-rank(mean(delay(close, 5), 20)) * corr(close, volume, 2) * rank(corr(sum(close, 5), sum(close, 20), 2))",
    114: "per(rank(delay(per(high - low, mean(close, 5)), 2)) * rank(rank(volume)), per(per(high - low, mean(close, 5)), vwap - close))",
    115: "power(rank(corr(high * 0.9 + close * 0.1, adv(30), 10)), rank(corr(ts_rank(middle, 4), ts_rank(volume, 10), 7)))",
    116: "trend(close, 20)",
    117: "ts_rank(volume, 32) * (1 - ts_rank(close + high - low, 16)) * (1 - ts_rank(ret, 32))",
    118: "per(sum(high - open, 20), sum(open - low, 20)) * 100",
    119: "rank(decay(corr(vwap, sum(adv(5), 26), 5), 7)) - rank(decay(ts_rank(ts_min(corr(rank(open), rank(adv(15)), 21), 9), 7), 8))",
    120: "per(rank(vwap - close), rank(vwap + close))",
    121: "-power(rank(vwap - ts_min(vwap, 12)), ts_rank(coarse(corr(ts_rank(vwap, 20), ts_rank(adv(60), 2), 18)), 3))",
    122: "per(delta(thrice()), delay(thrice(), 1))",
    123: "below(rank(corr(sum(middle, 20), sum(adv(60), 20), 9)), rank(corr(low, volume, 6)), -1)",
    124: "per(close - vwap, decay(rank(ts_max(close, 30)), 2))",
    125: "per(rank(decay(corr(vwap, adv(80), 17), 20)), rank(decay(delta(close * 0.5 + vwap * 0.5, 3), 16)))",
    126: "(close + high + low) / 3",
    127: "root(mean(square(per((close - ts_max(close, 12)) * 100, ts_max(close, 12))), 12))",
    128: "100 - per(100, 1 + per(sum(when(typical > delay(typical, 1), typical * volume, typical, delay(typical, 1), volume), 14), sum(when(typical < delay(typical, 1), typical * volume, typical, delay(typical, 1), volume), 14)))",
    129: "sum(above_0(-change), 12)",
    130: "per(rank(decay(corr(middle, adv(40), 9), 10)), rank(decay(corr(rank(vwap), rank(volume), 7), 3)))",
    131: "power(rank(delta(vwap)), ts_rank(corr(close, adv(50), 18), 18))",
    132: "mean(amount, 20)",
    133: "(lowday(low, 20) - highday(high, 20)) / 20 * 100",
    134: "growth(12) * volume",
    135: "sma(delay(per(close, delay(close, 20)), 1), 20, 1)",
    136: "-rank(delta(ret, 3)) * corr(open, volume, 10)",
    137: "gapped()",
    138: "ts_rank(decay(ts_rank(coarse(corr(ts_rank(low, 8), ts_rank(adv(60), 17), 5)), 19), 16), 7) - rank(decay(delta(low * 0.7 + vwap * 0.3, 3), 20))",
    139: "-corr(open, volume, 10)",
    140: "lesser(rank(decay(rank(open) + rank(low) - (rank(high) + rank(close)), 8)), ts_rank(decay(corr(ts_rank(close, 8), ts_rank(adv(60), 20), 8), 7), 3))",
    141: "-rank(corr(rank(high), rank(adv(15)), 9))",
    142: "-rank(ts_rank(close, 10)) * rank(delta(delta(close))) * rank(ts_rank(per(volume, adv(20)), 5))",
    143: "climbed(per(change, before))",
    144: "per(sum(when(close < before, per(abs(ret), amount), per(abs(ret), amount)), 20), sum(when(close < before, 1, per(abs(ret), amount)), 20))",
    145: "per(adv(9) - adv(26), adv(12)) * 100",
    146: "per(mean(ret - sma(ret, 61, 2), 20) * (ret - sma(ret, 61, 2)), sma(square(ret - sma(ret, 61, 2)), 60, 2))",
    147: "trend(mean(close, 12), 12)",
    148: "below(rank(corr(open, sum(adv(60), 9), 6)), rank(open - ts_min(open, 14)), -1)",
    149: "slope_where(ret, market_growth(), fixed(market_growth()) < 0, 52)",
    150: "(close + high + low) / 3 * volume",
    151: "sma(delta(close, 20), 20, 1)",
    152: "averages(delay(sma(delay(per(close, delay(close, 9)), 1), 9, 1), 1), 9)",
    153: "(mean(close, 3) + mean(close, 6) + mean(close, 12) + mean(close, 24)) / 4",
    154: "below(vwap - ts_min(vwap, 16), corr(vwap, adv(180), 18), 1)",
    155: "spread(volume) - sma(spread(volume), 10, 2)",
    156: "-greater(rank(decay(delta(vwap, 5), 3)), rank(decay(-per(delta(open * 0.15 + low * 0.85, 2), open * 0.15 + low * 0.85), 3)))",
    157: "ts_min(rank(rank(scale(log(ts_min(rank(rank(-rank(delta(close - 1, 5)))), 2))))), 5) + ts_rank(delay(-ret, 6), 5)",
    158: "per(high - sma(close, 15, 2) - (low - sma(close, 15, 2)), close)",
    159: "(within(6) * 288 + within(12) * 144 + within(24) * 144) * 100 / 504",
    160: "rough(False)",
    161: "mean(true_range(), 12)",
    162: "per(fixed(strength(change, 12)) - ts_min(strength(change, 12), 12), ts_max(strength(change, 12), 12) - ts_min(strength(change, 12), 12))",
    163: "rank(-ret * adv(20) * vwap * (high - close))",
    164: "sma(per((fixed(given(where(change > 0, per(1, change), 1), change)) - ts_min(given(where(change > 0, per(1, change), 1), change), 12)) * 100, high - low), 13, 2)",
    165: "strayed(48)",
    166: "per(sum(square(ret - mean(ret, 20)) * (ret - mean(ret, 20)), 20) * -(20 * 19**1.5), power(sum(square(ret - mean(ret, 20)), 20), 1.5) * (19 * 18))",
    167: "sum(above_0(change), 12)",
    168: "-per(volume, adv(20))",
    169: "averages(delay(sma(change, 9, 1), 1), 10)",
    170: "per(rank(per(1, close)) * volume, adv(20)) * per(high * rank(high - close), mean(high, 5)) - rank(delta(vwap, 5))",
    171: "per((close - low) * power(open, 5), (close - high) * power(close, 5))",
    172: "directed()",
    173: "sma(close, 13, 2) * 3 - sma(sma(close, 13, 2), 13, 2) * 2 + thrice()",
    174: "rough(True)",
    175: "mean(true_range(), 6)",
    176: "corr(rank(per(close - ts_min(low, 12), ts_max(high, 12) - ts_min(low, 12))), rank(volume), 6)",
    177: "(20 - highday(high, 20)) / 20 * 100",
    178: "ret * volume",
    179: "rank(corr(vwap, volume, 4)) * rank(corr(rank(low), rank(adv(50)), 12))",
    180: "given(where(less(adv(20), volume), -ts_rank(abs(delta(close, 7)), 60) * sign(delta(close, 7)), -volume), ts_rank(abs(delta(close, 7)), 60), volume, adv(20))",
    181: "per(sum(ret - mean(ret, 20) - square(market(close) - mean(market(close), 20)), 20), sum(square(market(close) - mean(market(close), 20)) * (market(close) - mean(market(close), 20)), 20))",
    182: "sum(when((close > open) & less(market(open), market(close)) | (close < open) & less(market(close), market(open)), 1, close, open), 20) / 20",
    183: "strayed(24)",
    184: "rank(corr(delay(open - close, 1), close, 200)) + rank(open - close)",
    185: "rank(-square(1 - per(open, close)))",
    186: "(directed() + delay(directed(), 6)) / 2",
    187: "sum(up_open(), 20)",
    188: "per(high - low - sma(high - low, 11, 2), sma(high - low, 11, 2)) * 100",
    189: "mean(abs(close - mean(close, 6)), 6)",
    190: "log(per((sum(when(ret > usual(), 1, ret, usual()), 20) - 1) * sum(when(ret < usual(), square(ret - usual()), ret, usual()), 20), sum(when(ret < usual(), 1, ret, usual()), 20) * sum(when(ret > usual(), square(ret - usual()), ret, usual()), 20)))",
    191: "corr(adv(20), low, 5) + middle - close",
}


def words(panel: Panel) -> dict[str, object]:
    """What these formulas may say beyond the panel's own words. Those with parentheses make their steps only where they are said."""
    w = panel.names()
    p, fixed, where, delay = panel, panel._fixed, panel.where, panel.delay
    o, h, low, c, v = (w[x] for x in ("open", "high", "low", "close", "volume"))
    before, middle, typical = delay(c, 1), (h + low) / 2, (h + low + c) / 3

    def per(a, b):
        b = constant(b)
        return constant(a) / p.mask(b, p.abs(b) >= 1e-12)

    def given(x, *inputs):
        return p.mask(x, p.valid(*inputs))

    def when(condition, x, *inputs):
        return given(where(condition, x, 0), *inputs)

    def delta(x, d=1):
        return fixed(x) - delay(x, d)

    def coarse(x):
        """To 30 bits: correlations of few ranks tie often, and those of one value must not part at a bound of finer rounding."""
        return Term(lambda: snap(x.column(), 30), lambda arrays, array=x.array: snapped(array(arrays), 30), snap_sql(x.sql, 30), x.level, phase=x.phase)

    def above_0(x):
        return when(x > 0, x, x)

    def less(a, b):
        return fixed(a) < fixed(b)

    def below(a, b, yes):
        return when(less(a, b), yes, a, b)

    def shifted(x, y, back):
        """The larger of two values where the open moved one way against the open before."""
        return when(back, p.greater(x, y), o, delay(o, 1), x)

    def moved(up):
        now, then = h + low, delay(h, 1) + delay(low, 1)
        size = p.greater(p.abs(h - delay(h, 1)), p.abs(low - delay(low, 1)))
        return fixed(when(now > then if up else now < then, size, now, then))

    def rough(up):
        return p.sma(when(c > before if up else c <= before, p.std(c, 20), p.std(c, 20), c, before), 20, 1)

    def gapped():
        a, b, cross, gap = fixed(p.abs(h - before)), fixed(p.abs(low - before)), fixed(p.abs(h - delay(low, 1))), fixed(p.abs(before - delay(o, 1)))
        size = where((a > b) & (a > cross), a + b / 2 + gap / 4, where((b > cross) & (b > a), b + a / 2 + gap / 4, cross + gap / 4))
        return per((c - before + (c - o) / 2 + before - delay(o, 1)) * 16, size) * p.greater(a, b)

    def true_range():
        return fixed(p.greater(p.greater(h - low, p.abs(h - before)), p.abs(low - before)))

    def directed():
        up, down = fixed(h - delay(h, 1)), fixed(delay(low, 1) - low)
        share = lambda x, y: fixed(per(p.sum(when((x > 0) & (x > y), x, x, y), 14) * 100, p.sum(true_range(), 14)))
        plus, minus = share(down, up), share(up, down)
        return p.mean(per(p.abs(plus - minus), plus + minus) * 100, 6)

    def within(d):
        floor, ceiling = fixed(p.lesser(low, before)), fixed(p.greater(h, before))
        return per(c - p.sum(floor, d), p.sum(ceiling - floor, d))

    def strayed(d):
        total = p.sum(c - p.mean(c, d), d)
        return per(p.ts_max(total, d) - p.ts_min(total, d), p.std(c, d))

    def market_growth():
        level = p.market(c)
        return fixed(per(delta(level), delay(level, 1)))

    return w | {
        "before": before, "middle": middle, "typical": typical, "change": c - before, "fixed": fixed,
        "per": per, "given": given, "when": when, "delta": delta, "above_0": above_0, "less": less, "below": below, "coarse": coarse,
        "square": lambda x: x * x,
        "growth": lambda d: per(c - delay(c, d), delay(c, d)),
        "off": lambda d: per(c - p.mean(c, d), p.mean(c, d)),
        "location": lambda: per(c - low - (h - c), h - low),
        "reached": lambda: given(where(c > before, c - p.lesser(low, before), where(c < before, c - p.greater(h, before), 0)), c, before, low, h),
        "signed": lambda: given(where(c > before, v, where(c < before, -v, 0)), c, before, v),
        "up_open": lambda: shifted(h - o, o - delay(o, 1), o > delay(o, 1)),
        "down_open": lambda: shifted(o - low, o - delay(o, 1), o < delay(o, 1)),
        "rising": lambda: moved(True), "falling": lambda: moved(False),
        "rough": rough, "gapped": gapped, "true_range": true_range, "directed": directed, "within": within, "strayed": strayed,
        "stochastic": lambda d: per(c - p.ts_min(low, d), p.ts_max(h, d) - p.ts_min(low, d)) * 100,
        "williams": lambda d: per(p.ts_max(h, d) - c, p.ts_max(h, d) - p.ts_min(low, d)) * 100,
        "strength": lambda x, n: per(p.sma(above_0(x), n, 1), p.sma(p.abs(x), n, 1)) * 100,
        "spread": lambda x: p.sma(x, 13, 2) - p.sma(x, 27, 2),
        "averages": lambda x, n: p.sma(p.mean(x, 12) - p.mean(x, 26), n, 1),
        "thrice": lambda: p.sma(p.sma(p.sma(p.log(c), 13, 2), 13, 2), 13, 2),
        "bend": lambda: fixed((delay(c, 20) - delay(c, 10)) / 10 - (delay(c, 10) - c) / 10),
        "usual": lambda: fixed(p.power(per(c, delay(c, 19)), 1 / 20) - 1),
        "market_growth": market_growth,
    }


def _terms(ids: list[int]) -> tuple[Panel, dict[str, Term]]:
    panel = Panel()
    names = words(panel)
    return panel, {f"a191_{k:03}": eval(FORMULAS[k], {"__builtins__": {}}, names) for k in ids}


def columns(rows: DataFrame, ids: list[int], laid: int | None = None, rounded: bool = False) -> DataFrame:
    """instrument, week_no and a column a191_NNN for each of the formulas, over dense bars with the columns of `sources.bars`. rounded: they are shown rounded, so they may be rounded where they are made."""
    panel, terms = _terms(ids)
    return panel.table(rows, short(terms) if rounded else terms, ["instrument", "week_no"], laid)


def _query(ids: list[int]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = columns(dense(bars(spark, sf_dir)), ids, ALONG, rounded=True)
        return out.select("instrument", "week_no", *[shown(out[x]).alias(x) for x in out.columns[2:]])

    return query


def _sql(ids: list[int]) -> str:
    panel, terms = _terms(ids)
    steps, last = panel.sql("dense")
    told = ", ".join(f"{term.sql} AS {name}" for name, term in terms.items())
    return f"WITH {BARS_SQL}, {DENSE_SQL}{steps},\ntold AS (SELECT instrument, week_no, {told} FROM {last})\nSELECT instrument, week_no, " + ", ".join(f"{_shown(name)} AS {name}" for name in terms) + " FROM told"


_GROUPS = {f"a191_{k:03}_{min(k + GROUP - 1, 191):03}": [x for x in range(k, k + GROUP) if x in FORMULAS] for k in range(1, 192, GROUP)}
QUERIES = {name: _query(ids) for name, ids in _GROUPS.items()}
SQL = {name: _sql(ids) for name, ids in _GROUPS.items()}
