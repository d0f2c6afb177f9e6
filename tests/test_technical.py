"""Own traded rows and the technical indicators against pandas on packed rows: suspensions, locked and flat weeks, nulls, late starts, empty tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import series as ts
from factorloom.operators.traded import over_traded
from factorloom.plans.nested import blended, carried, unbeaten_rows
from factorloom.plans.technical import INDICATORS, columns

NAMES = ("instrument", "week_no", "open", "high", "low", "close", "vwap", "amount", "volume", "sector", "industry", "cap")
SCHEMA = "instrument int, week_no int, open double, high double, low double, close double, vwap double, amount double, volume double, sector int, industry int, cap double"


@pytest.fixture(scope="module")
def rows():
    draw, out = np.random.default_rng(3), []
    for k in range(4):
        price = 20.0
        for week in range(10 * k, 110):
            price = round(price * float(np.exp(draw.normal(0, 0.03))), 1)  # ticks tie
            o, span = round(price * float(np.exp(draw.normal(0, 0.01))), 1), round(float(draw.uniform(0, 0.6)), 1)
            high, low, volume = max(o, price) + span, min(o, price) - span, float(draw.integers(1, 50))
            if k == 1 and 50 <= week < 57:
                o = high = low = price = 21.0  # locked
            gone = (k == 0 and 40 <= week < 48) or draw.random() < 0.03  # suspended
            out.append((k, week, *((None,) * 4 if gone else (o, high, low, price)), price, price, None if gone or (k == 2 and week == 60) else volume, 0, 0, 1.0))
    return out


def _packed(rows, k):
    f = pd.DataFrame(rows, columns=NAMES)
    f = f[f["instrument"] == k].set_index("week_no")
    return f, f.dropna(subset=["open", "high", "low", "close", "volume"])


def _ema(x, n):
    return x.ewm(alpha=2 / (n + 1), adjust=False).mean()


def _rsv(f, n=9):
    low, high = f.low.rolling(n).min(), f.high.rolling(n).max()
    return (f.close - low) / (high - low) * 100


def _dif(f):
    return _ema(f.close, 12) - _ema(f.close, 26)


def _streak(told):
    run, out = 0, []
    for x in told:
        run = run + 1 if x else 0
        out.append(float(run))
    return out


def _td3(f):
    mean = f.close.rolling(20).mean()
    weight = (((2 * f.close + f.high + f.low) / 4) - mean).abs() / mean
    y, out = np.nan, []
    for x, w in zip(f.close, weight, strict=True):
        if not np.isnan(w):
            y = x if np.isnan(y) else w * x + (1 - w) * y
        out.append(y)
    return pd.Series(out, f.index) * 1.07 / f.close - 1


def _top(x):
    return pd.Series([float(next((j for j in range(1, i + 1) if x.iloc[i - j] > x.iloc[i]), i + 1) - 1) for i in range(len(x))], x.index)


def _mfi(f):
    typical = (f.high + f.low + f.close) / 3
    sign = np.sign(typical.diff().round(9))
    up, down = (typical * f.volume).where(sign > 0, 0.0), (typical * f.volume).where(sign < 0, 0.0)
    return 100 * up.rolling(14).sum() / (up.rolling(14).sum() + down.rolling(14).sum())


PLAIN = {
    "ma_20": lambda f: f.close.rolling(20).mean() / f.close - 1,
    "ema_30": lambda f: _ema(f.close, 30) / f.close - 1,
    "boll_upper": lambda f: (f.close.rolling(20).mean() + 2 * f.close.rolling(20).std(ddof=0)) / f.close - 1,
    "cci": lambda f: (lambda t: (t - t.rolling(14).mean()) / (0.015 * t.rolling(14).apply(lambda v: np.abs(v - v.mean()).mean(), raw=True)))((f.high + f.low + f.close) / 3),
    "kdj": lambda f: (lambda k: 3 * k - 2 * k.ewm(alpha=1 / 3, adjust=False).mean())(_rsv(f).ewm(alpha=1 / 3, adjust=False).mean()),
    "macd": lambda f: 2 * (_dif(f) - _ema(_dif(f), 9)) / f.close,
    "mfi": _mfi,
    "rsi_6": lambda f: (lambda d: d.clip(lower=0).ewm(alpha=1 / 6, adjust=False).mean() / d.abs().ewm(alpha=1 / 6, adjust=False).mean() * 100)(f.close.diff()),
    "obv": lambda f: (np.sign(f.close.diff()) * f.volume).fillna(0).cumsum().diff(20) / f.volume.rolling(20).sum(),
    "psy": lambda f: (f.close.diff() > 0).astype(float).rolling(12).sum() * 100 / 12,
    "trix": lambda f: _ema(_ema(_ema(f.close, 12), 12), 12).pct_change() * 100,
    "mass": lambda f: (lambda r: (r / r.rolling(9).mean()).rolling(25).sum())((f.high - f.low).rolling(9).mean()),
    "wr": lambda f: 100 - _rsv(f, 10),
    "xsii_td3": _td3,
    "updays": lambda f: pd.Series(_streak(f.close.diff() > 0), f.index),
    "downdays": lambda f: pd.Series(_streak(f.close.diff() < 0), f.index),
    "topdays": lambda f: _top(f.high),
    "lowdays": lambda f: _top(-f.low),
}


def test_like_pandas_on_packed_rows(spark, rows):
    out = columns(spark.createDataFrame(rows, SCHEMA), list(PLAIN)).toPandas()
    assert len(out) == len(rows)
    for k in range(4):
        every, packed = _packed(rows, k)
        got = out[out["instrument"] == k].set_index("week_no").sort_index()
        assert len(packed) < len(every)
        for name, plain in PLAIN.items():
            want = plain(packed).replace([np.inf, -np.inf], np.nan)
            want.iloc[: INDICATORS[name][1]] = np.nan
            np.testing.assert_allclose(got[name].to_numpy(float), want.reindex(every.index).to_numpy(float), rtol=1e-7, atol=1e-8, err_msg=f"{name} of {k}")


def test_no_look_ahead(spark, rows):
    """What is known at a week doesn't change when later weeks are cut off."""
    names = ["macd", "kdj_d", "topdays", "emv", "dmi_adx"]
    whole = columns(spark.createDataFrame(rows, SCHEMA), names).where("week_no < 80").toPandas()
    part = columns(spark.createDataFrame([r for r in rows if r[1] < 80], SCHEMA), names).toPandas()
    at = ["instrument", "week_no"]
    pd.testing.assert_frame_equal(whole.sort_values(at, ignore_index=True), part.sort_values(at, ignore_index=True))


def test_flat_and_empty(spark):
    flat = [(0, week, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 2.0, 0, 0, 1.0) for week in range(40)]
    out = columns(spark.createDataFrame(flat, SCHEMA), ["cci", "kdj", "rsi_6", "ma_20", "updays", "topdays"]).orderBy("week_no").toPandas()
    assert out[["cci", "kdj", "rsi_6"]].isna().all().all() and (out["ma_20"].dropna() == 0).all() and (out["updays"].dropna() == 0).all()
    assert out["topdays"].tolist()[1:] == list(range(1, 40))
    assert columns(spark.createDataFrame([], SCHEMA), ["macd"]).count() == 0


def test_over_traded(spark):
    """Nulls in the condition, repeated names, rows without an ordinal apart from all others."""
    data = [("a", 1, 1.0, True, "x"), ("a", 2, 50.0, False, "x"), ("a", 5, 3.0, True, None), ("a", 6, 70.0, None, "y"), ("a", 9, 8.0, True, "y"), ("b", 1, 2.0, False, "z")]
    df = spark.createDataFrame(data, "instrument string, week_no int, x double, traded boolean, calendar string")
    out = over_traded(df, F.col("traded"), {"sum": ts.ts_sum(F.col("x"), 2), "before": ts.delay(F.col("x"), 1)}).orderBy("instrument", "week_no")
    assert out.columns == ["instrument", "week_no", "x", "traded", "calendar", "sum", "before"]
    assert [(r.week_no, r["sum"], r.before) for r in out.collect()] == [(1, None, None), (2, None, None), (5, 4.0, 1.0), (6, None, None), (9, 11.0, 3.0), (1, None, None)]
    assert over_traded(df.limit(0), F.col("traded"), {"sum": ts.ts_sum(F.col("x"), 2)}).count() == 0


def test_small_recursions():
    x = np.array([np.nan, 2.0, np.nan, 4.0])
    np.testing.assert_allclose(carried({"x": x}, np.arange(4), 0.5), pd.Series(x).ewm(alpha=0.5, adjust=False).mean())
    np.testing.assert_allclose(blended({"x": np.array([1.0, 3.0, 5.0]), "w": np.array([0.5, np.nan, 0.5])}), [1, 1, 3])
    assert unbeaten_rows({"x": np.array([5.0, 3.0, 3.0, 4.0, 9.0])}).tolist() == [0, 0, 1, 2, 4]
    assert len(unbeaten_rows({"x": np.zeros(0)})) == 0
