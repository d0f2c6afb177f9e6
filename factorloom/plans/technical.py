"""Classic technical indicators over each instrument's own traded weeks, with the same in SQL.

Weeks without a complete quote are left out of every window and have no indicator. Prices are told relative to the close. The
first quotes of an instrument, as many as an indicator looks back, have none. Averages of Chinese terminals: ema has a weight of
2 / (n + 1), ewm a given one; both carry their value over missing values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators import series as ts
from factorloom.operators.traded import numbered, over_traded
from factorloom.plans.formulas import _shown, shown
from factorloom.plans.formulas_191 import words
from factorloom.plans.nested import Panel, Term, week
from factorloom.sources.bars import BARS_SQL, GAPPED_SQL, bars, gapped

C = F.col
AVERAGES = (5, 10, 20, 30, 60, 90, 250)

#: The public terminal formulas with their usual parameters, and the quotes that each looks back.
INDICATORS: dict[str, tuple[str, int]] = {
    "asi": ("per(sum(gapped(), 26), close)", 26),
    "asit": ("per(mean(sum(gapped(), 26), 10), close)", 35),
    "atr": ("per(mean(true_range(), 20), close)", 20),
    "bbi": ("per(mean(close, 3) + mean(close, 6) + mean(close, 12) + mean(close, 24), close * 4) - 1", 23),
    "bias1": ("off(6) * 100", 5),
    "bias2": ("off(12) * 100", 11),
    "bias3": ("off(24) * 100", 23),
    "boll_upper": ("per(mean(close, 20) + population(close, 20) * 2, close) - 1", 19),
    "boll_lower": ("per(mean(close, 20) - population(close, 20) * 2, close) - 1", 19),
    "brar_ar": ("per(sum(high - open, 26), sum(open - low, 26)) * 100", 25),
    "brar_br": ("per(sum(above_0(high - before), 26), sum(above_0(before - low), 26)) * 100", 26),
    "cci": ("per(fixed(typical) - mean(typical, 14), scatter(typical, 14) * 0.015)", 13),
    "cr": ("per(sum(above_0(high - delay(middle, 1)), 20), sum(above_0(delay(middle, 1) - low), 20)) * 100", 20),
    "dfma_dif": ("per(mean(close, 10) - mean(close, 50), close)", 49),
    "dfma_difma": ("per(mean(mean(close, 10) - mean(close, 50), 10), close)", 58),
    "dmi_pdi": ("pushed(True)", 14),
    "dmi_mdi": ("pushed(False)", 14),
    "dmi_adx": ("directed()", 19),
    "dmi_adxr": ("(directed() + delay(directed(), 6)) / 2", 25),
    "dpo": ("per(close - delay(mean(close, 20), 10), close)", 29),
    "madpo": ("per(mean(close - delay(mean(close, 20), 10), 6), close)", 34),
    **{f"ema_{n}": (f"per(ema(close, {n}), close) - 1", n - 1) for n in AVERAGES},
    "emv": ("eased()", 28),
    "maemv": ("mean(eased(), 9)", 36),
    "expma_12": ("per(ema(close, 12), close) - 1", 11),
    "expma_50": ("per(ema(close, 50), close) - 1", 49),
    "kdj_k": ("ewm(stochastic(9), 1 / 3)", 10),
    "kdj_d": ("ewm(ewm(stochastic(9), 1 / 3), 1 / 3)", 12),
    "kdj": ("ewm(stochastic(9), 1 / 3) * 3 - ewm(ewm(stochastic(9), 1 / 3), 1 / 3) * 2", 12),
    "ktn_upper": ("per(ema(typical, 20) + ema(true_range(), 10) * 2, close) - 1", 19),
    "ktn_mid": ("per(ema(typical, 20), close) - 1", 19),
    "ktn_down": ("per(ema(typical, 20) - ema(true_range(), 10) * 2, close) - 1", 19),
    **{f"ma_{n}": (f"per(mean(close, {n}), close) - 1", n - 1) for n in AVERAGES},
    "macd_dif": ("per(ema(close, 12) - ema(close, 26), close)", 25),
    "macd_dea": ("per(ema(ema(close, 12) - ema(close, 26), 9), close)", 33),
    "macd": ("per((ema(close, 12) - ema(close, 26) - ema(ema(close, 12) - ema(close, 26), 9)) * 2, close)", 33),
    "mass": ("sum(per(mean(high - low, 9), mean(mean(high - low, 9), 9)), 25)", 40),
    "ma_mass": ("mean(sum(per(mean(high - low, 9), mean(mean(high - low, 9), 9)), 25), 6)", 45),
    "mfi": ("per(flow(True) * 100, flow(True) + flow(False))", 14),
    "mtm": ("per(delta(close, 12), close)", 12),
    "mtmma": ("per(mean(delta(close, 12), 6), close)", 17),
    "obv": ("per(sum(signed(), 20), sum(volume, 20))", 20),
    "psy": ("sum(when(close > before, 1, close, before), 12) * 100 / 12", 12),
    "psyma": ("mean(sum(when(close > before, 1, close, before), 12) * 100 / 12, 6)", 17),
    "roc": ("growth(12) * 100", 12),
    "maroc": ("mean(growth(12) * 100, 6)", 17),
    **{f"rsi_{n}": (f"per(ewm(above_0(change), 1 / {n}), ewm(abs(change), 1 / {n})) * 100", n) for n in (6, 12, 24)},
    "taq_up": ("per(ts_max(high, 20), close) - 1", 19),
    "taq_mid": ("per((ts_max(high, 20) + ts_min(low, 20)) / 2, close) - 1", 19),
    "taq_down": ("per(ts_min(low, 20), close) - 1", 19),
    "trix": ("per(delta(triple()) * 100, delay(triple(), 1))", 34),
    "trma": ("mean(per(delta(triple()) * 100, delay(triple(), 1)), 20)", 53),
    "vr": ("per((on(change > 0) * 2 + on(still)) * 100, on(change < 0) * 2 + on(still))", 26),
    "wr": ("williams(10)", 9),
    "wr1": ("williams(6)", 5),
    "xsii_td1": ("per(mean((close * 2 + high + low) / 4, 5) * 1.02, close) - 1", 4),
    "xsii_td3": ("per(blend(close, per(abs((close * 2 + high + low) / 4 - mean(close, 20)), mean(close, 20))) * 1.07, close) - 1", 19),
    "updays": ("streak(close > before)", 1),
    "downdays": ("streak(close < before)", 1),
    "topdays": ("unbeaten(high)", 1),
    "lowdays": ("unbeaten(low, False)", 1),
}

GROUP = 11


def _terms(names: list[str]) -> tuple[Panel, dict[str, Term]]:
    p = Panel()
    w = words(p)
    per, when, delta = w["per"], w["when"], w["delta"]
    high, low, volume, typical, change = (w[x] for x in ("high", "low", "volume", "typical", "change"))
    place = week()

    def ema(x, n):
        return p.ewm(x, 2 / (n + 1))

    def pushed(up):
        a, b = p._fixed(high - p.delay(high, 1)), p._fixed(p.delay(low, 1) - low)
        a, b = (a, b) if up else (b, a)
        return per(p.sum(when((a > 0) & (a > b), a, a, b), 14) * 100, p.sum(w["true_range"](), 14))

    def eased():
        moved = per(delta(high + low) * 100, high + low) * per(p.mean(volume, 14), volume) * (high - low)
        return p.mean(per(moved, p.mean(high - low, 14)), 14)

    def flow(up):
        then = p.delay(typical, 1)
        return p.sum(when(p._fixed(typical) > then if up else p._fixed(typical) < then, typical * volume, typical, then, volume), 14)

    w |= {
        "ema": ema, "pushed": pushed, "eased": eased, "flow": flow,
        "population": lambda x, d: p.std(x, d) * ((d - 1) / d) ** 0.5,
        "triple": lambda: ema(ema(ema(w["close"], 12), 12), 12),
        "still": (change <= 0) & (change >= 0),
        "on": lambda condition: p.sum(when(condition, volume, change, volume), 26),
    }
    return p, {x: p.mask(eval(INDICATORS[x][0], {"__builtins__": {}}, w), place > INDICATORS[x][1]) for x in names}


def columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """instrument, week_no and the named indicators for every row; those without a complete quote have none."""
    panel, terms = _terms(names)
    traded = C("open").isNotNull() & C("high").isNotNull() & C("low").isNotNull() & C("close").isNotNull() & C("volume").isNotNull()
    own, calendar = numbered(rows, traded)
    return panel.apply(own, terms.values(), keep=[calendar]).select("instrument", C(calendar).alias("week_no"), *[term.column().alias(name) for name, term in terms.items()])


def _query(names: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = columns(gapped(bars(spark, sf_dir)), names)
        return out.select("instrument", "week_no", *[shown(C(x)).alias(x) for x in names])

    return query


_OWN = f"{BARS_SQL}, {GAPPED_SQL}, own AS (SELECT * REPLACE (CASE WHEN close IS NOT NULL THEN count(close) OVER (PARTITION BY instrument ORDER BY week_no ROWS UNBOUNDED PRECEDING) END AS week_no), week_no AS calendar FROM gapped)"


def _sql(names: list[str]) -> str:
    panel, terms = _terms(names)
    steps, last = panel.sql("own")
    told = ", ".join(f"{term.sql} AS {name}" for name, term in terms.items())
    return f"WITH {_OWN}{steps},\ntold AS (SELECT instrument, calendar, {told} FROM {last})\nSELECT instrument, calendar AS week_no, " + ", ".join(f"{_shown(x)} AS {x}" for x in names) + " FROM told"


def own_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of traded weeks on a calendar with gaps: mean and deviation of 10, correlation of 8, the change over 12."""
    told = over_traded(gapped(bars(spark, sf_dir)), C("close").isNotNull(), {"mean": ts.ts_mean(C("close"), 10), "deviation": ts.stddev(C("close"), 10), "beside": ts.covariance(C("close"), C("volume"), 8), "change": ts.returns(C("close"), 12)})
    return told.select("instrument", "week_no", *[shown(C(x)).alias(x) for x in ("mean", "deviation", "beside", "change")])


_NAMES = list(INDICATORS)
_GROUPS = {f"technical_{names[0]}": names for names in (_NAMES[k : k + GROUP] for k in range(0, len(_NAMES), GROUP))}
QUERIES = {name: _query(names) for name, names in _GROUPS.items()} | {"own_windows": own_windows}
SQL = {name: _sql(names) for name, names in _GROUPS.items()} | {
    # by the rows of bars, which are the traded ones, joined to the calendar
    "own_windows": f"""WITH {BARS_SQL}, {GAPPED_SQL},
k AS (SELECT instrument, week_no, close, volume, row_number() OVER (PARTITION BY instrument ORDER BY week_no) AS nth FROM bars),
t AS (SELECT a.instrument, a.week_no, a.close, a.nth, avg(b.close) AS mean, stddev_samp(b.close) AS deviation, covar_samp(b.close, b.volume) FILTER (b.nth > a.nth - 8) AS beside FROM k a JOIN k b ON a.instrument = b.instrument AND b.nth BETWEEN a.nth - 9 AND a.nth GROUP BY ALL),
s AS (SELECT t.*, t.close / k.close - 1 AS change FROM t LEFT JOIN k ON k.instrument = t.instrument AND k.nth = t.nth - 12)
SELECT g.instrument, g.week_no, {_shown("CASE WHEN nth >= 10 THEN mean END")} AS mean, {_shown("CASE WHEN nth >= 10 THEN deviation END")} AS deviation, {_shown("CASE WHEN nth >= 8 THEN beside END")} AS beside, {_shown("change")} AS change
FROM gapped g LEFT JOIN s ON s.instrument = g.instrument AND s.week_no = g.week_no""",
}
