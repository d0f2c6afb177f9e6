"""Queries of the structured risk model over the weekly bars: sectors, size and liquidity. The SQL solves the weeks' equations by elimination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators import risk
from factorloom.operators import series as ts
from factorloom.plans.formulas import _shown, shown
from factorloom.plans.panel import _lag
from factorloom.plans.regressions import solved
from factorloom.sources.bars import BARS_SQL, bars

C = F.col
STYLES = {"size": ["log_cap"], "liquidity": ["log_volume", "log_amount"]}
SIGNALS, LOOKBACK, HALF_LIFE, LEAST = [1250, 1350, 1450], 52, 20.0, 30


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    logs = {"log_cap": F.ln(F.when(C("cap") > 0, C("cap").cast("double"))), "log_volume": F.ln(C("volume").cast("double")), "log_amount": F.ln(C("amount").cast("double"))}
    return b.withColumns(logs | {"r": ts.returns(C("close")) * 100}).select("instrument", "week_no", "sector", C("cap").cast("double").alias("cap"), "r", *logs)


def _model(spark: SparkSession, sf_dir: str) -> risk.RiskModel:
    return risk.risk_model(_panel(spark, sf_dir), "r", "cap", "sector", STYLES, least=LEAST)


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.style_exposures(_panel(spark, sf_dir), STYLES, "cap")
    return out.select("instrument", "week_no", *[shown(C(s)).alias(s) for s in STYLES])


def factor_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _model(spark, sf_dir)
    each = F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in m.names]).alias("factor"), C("beta"))).alias("f")
    return m.factor_returns.select("week_no", "n", each).select("week_no", "n", "f.factor", shown(C("f.beta")).alias("value"))


def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _model(spark, sf_dir).covariance(SIGNALS, LOOKBACK, HALF_LIFE)
    return out.select("signal", "factor_i", "factor_j", shown(C("covariance")).alias("covariance"))


def specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).specific(SIGNALS, LOOKBACK, HALF_LIFE).select("signal", "instrument", "n", shown(C("volatility")).alias("volatility"))


def _standard(x: str) -> str:
    """Clipped, centred and scaled, from a column x with its quantiles in q."""
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(quantile_cont({x}, 0.01) OVER d, least(quantile_cont({x}, 0.99) OVER d, {x})) END"


def _scaled(x: str) -> str:
    return f"CASE WHEN count({x}) OVER d >= 3 THEN CASE WHEN min({x}) OVER d = max({x}) OVER d THEN 0 * {x} ELSE ({x} - coalesce(sum({x} * w) OVER d / sum(CASE WHEN {x} IS NOT NULL THEN w END) OVER d, avg({x}) OVER d)) / stddev_samp({x}) OVER d END END"


_D = "WINDOW d AS (PARTITION BY week_no)"
_X = f"""{BARS_SQL},
p AS (SELECT instrument, week_no, sector, cap::DOUBLE AS cap, CASE WHEN cap > 0 THEN cap::DOUBLE END AS w, 100 * (close / {_lag('close', 1)} - 1) AS r, CASE WHEN cap > 0 THEN ln(cap::DOUBLE) END AS a, ln(volume::DOUBLE) AS v, ln(amount::DOUBLE) AS m FROM bars),
c1 AS (SELECT * REPLACE ({', '.join(f'{_standard(x)} AS {x}' for x in 'avm')}) FROM p {_D}),
c2 AS (SELECT * REPLACE ({', '.join(f'{_scaled(x)} AS {x}' for x in 'avm')}) FROM c1 {_D}),
c3 AS (SELECT * EXCLUDE (a, v, m), a AS s1, CASE WHEN v IS NULL THEN m WHEN m IS NULL THEN v ELSE (v + m) / 2 END AS s2 FROM c2),
c4 AS (SELECT * REPLACE ({', '.join(f'{_standard(x)} AS {x}' for x in ('s1', 's2'))}) FROM c3 {_D}),
xs AS (SELECT * REPLACE ({', '.join(f'coalesce({_scaled(x)}, 0) AS {x}' for x in ('s1', 's2'))}) FROM c4 {_D})"""
_COLS = [f"(sector = {g})::INT::DOUBLE" for g in range(5)] + ["s1", "s2"]
_EQ = "[" + ", ".join("[" + ", ".join(f"sum(q * {a} * {b})" for b in (*_COLS, "y")) + "]" for a in _COLS) + "]"
_NAMES = [*[f"sector_{g}" for g in range(5)], "sector_unknown", *STYLES]
_FIT = f"""{_X},
nx AS (SELECT week_no, lead(week_no) OVER (ORDER BY week_no) AS after FROM (SELECT DISTINCT week_no FROM xs)),
t AS (SELECT x.instrument, nx.after AS week_no, x.sector, x.s1, x.s2, sqrt(x.cap) AS q, y.r AS y FROM xs x JOIN nx ON nx.week_no = x.week_no JOIN xs y ON y.instrument = x.instrument AND y.week_no = nx.after WHERE y.r IS NOT NULL AND x.cap > 0),
g AS (SELECT week_no, {_EQ} AS m FROM t GROUP BY week_no HAVING count(*) >= {LEAST}),
{solved('f', 'g', 'week_no', 7)},
fr AS (SELECT week_no, list_concat(beta[1:5], [0.0::DOUBLE], beta[6:7]) AS beta, row_number() OVER (ORDER BY week_no) AS place FROM f),
sg AS (SELECT signal, max(place) AS p FROM fr, (SELECT unnest({SIGNALS}) AS signal) WHERE week_no <= signal GROUP BY signal HAVING max(place) >= {LOOKBACK}),
sv AS (SELECT signal, fr.*, power(0.5, (p - place) / {HALF_LIFE!r}) AS w FROM fr JOIN sg ON place <= p AND place > p - {LOOKBACK})"""

QUERIES = {"risk_exposures": exposures, "risk_factor_returns": factor_returns, "risk_covariance": covariance, "risk_specific": specific}
SQL = {
    "risk_exposures": f"WITH {_X} SELECT instrument, week_no, {_shown('s1')} AS size, {_shown('s2')} AS liquidity FROM xs",
    "risk_factor_returns": f"WITH RECURSIVE {_FIT}, n AS (SELECT week_no, count(*) AS n FROM t GROUP BY week_no), u AS (SELECT week_no, unnest({_NAMES}) AS factor, unnest(beta) AS b FROM fr) SELECT week_no, n, factor, {_shown('b')} AS value FROM u JOIN n USING (week_no)",
    "risk_covariance": f"""WITH RECURSIVE {_FIT},
u AS (SELECT signal, place, w / sum(w) OVER (PARTITION BY signal) AS w, beta FROM sv),
lf AS (SELECT signal, place, w, unnest({_NAMES}) AS factor, unnest(beta) AS b FROM u),
cf AS (SELECT *, b - sum(w * b) OVER (PARTITION BY signal, factor) AS e FROM lf),
cv AS (SELECT a.signal, a.factor AS factor_i, b.factor AS factor_j, sum(a.w * a.e * b.e) AS c FROM cf a JOIN cf b ON a.signal = b.signal AND a.place = b.place GROUP BY ALL)
SELECT signal::INT AS signal, factor_i, factor_j, {_shown('c')} AS covariance FROM cv""",
    "risk_specific": f"""WITH RECURSIVE {_FIT},
e AS (SELECT signal, instrument, w, y - beta[sector + 1] - beta[7] * s1 - beta[8] * s2 AS e FROM t JOIN sv USING (week_no)),
s AS (SELECT signal, instrument, count(*) AS n, sum(w * e * e) / sum(w) AS v FROM e GROUP BY ALL),
k AS (SELECT *, CASE WHEN n >= 20 THEN v END AS own FROM s)
SELECT signal::INT AS signal, instrument, n, {_shown('sqrt(coalesce(own, median(own) OVER (PARTITION BY signal)))')} AS volatility FROM k""",
}
