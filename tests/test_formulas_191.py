"""Recursive levels and the set of 191 formulas against plain Python, on ties, gaps, nulls, flat and empty tables."""

import numpy as np
import pandas as pd
import pytest

from factorloom.plans.formulas_191 import FORMULAS, columns, words
from factorloom.plans.nested import Panel, held_slope, smoothed

SCHEMA = "instrument int, week_no int, open double, high double, low double, close double, vwap double, amount double, volume double, sector int, industry int, cap double"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def rows():
    draw, out = np.random.default_rng(8), []
    for k in range(5):
        for week in range(45):
            o, c = (draw.integers(8, 16, 2) / 2.0).tolist()  # ties and unchanged closes are common
            volume = float(draw.integers(1, 9))
            out.append((k, week, o, max(o, c) + 1, min(o, c) - 0.5, c, (o + c) / 2, volume * c, volume, k % 2, k % 3, 100.0 + k))
    return out


def _value(spark, rows, text):
    panel = Panel()
    term = eval(text, {"__builtins__": {}}, words(panel))
    out = panel.apply(spark.createDataFrame(rows, SCHEMA), [term]).select("instrument", "week_no", term.column().alias("value")).toPandas()
    return out.pivot(index="week_no", columns="instrument", values="value").sort_index()


def _wide(rows, name):
    return pd.DataFrame(rows, columns=NAMES).pivot(index="week_no", columns="instrument", values=name).sort_index()


def _sma(x, n, m):
    """Value by value."""
    out = x.copy() * np.nan
    for k in x.columns:
        before = np.nan
        for i in x.index:
            v = x.at[i, k]
            before = np.nan if np.isnan(v) else v if np.isnan(before) else (m * v + (n - m) * before) / n
            out.at[i, k] = before
    return out


def _rank(x):
    return x.rank(axis=1, pct=True)


def _rsi(x, n):
    return _sma(x.clip(lower=0), n, 1) / _sma(x.abs(), n, 1) * 100


def _market(w, name):
    return w(name).mean(axis=1)


def _when(condition, x, usable):
    return x.where(condition, 0.0).where(usable)


def _range_down(w):
    h, low = w("high"), w("low")
    size = np.maximum((h - h.shift()).abs(), (low - low.shift()).abs())
    return size.where(h + low < (h + low).shift(), 0.0).where(size.notna())


def _range_up(w):
    h, low = w("high"), w("low")
    size = np.maximum((h - h.shift()).abs(), (low - low.shift()).abs())
    return size.where(h + low > (h + low).shift(), 0.0).where(size.notna())


def _stochastic(w, d):
    least, most = w("low").rolling(d).min(), w("high").rolling(d).max()
    return (w("close") - least) / (most - least) * 100


def _wma(x, d):
    weights = 0.9 ** np.arange(d)[::-1]
    return x.rolling(d).apply(lambda v: (v * weights).sum() / weights.sum(), raw=True)


def _clv_sum(w, d):
    c, prev = w("close"), w("close").shift()
    up, down = c - np.minimum(w("low"), prev), c - np.maximum(w("high"), prev)
    return up.where(c > prev, down.where(c < prev, 0.0)).where(prev.notna()).rolling(d).sum()


def _together(w):
    """182: rows that move with the market."""
    c, o = w("close"), w("open")
    rise, fall = _market(w, "close") > _market(w, "open"), _market(w, "close") < _market(w, "open")
    same = (c > o).mul(rise, axis=0) | (c < o).mul(fall, axis=0)
    return same.astype(float).rolling(20).sum() / 20


PLAIN = {
    3: lambda w: _clv_sum(w, 6),
    9: lambda w: _sma(((w("high") + w("low")) / 2).diff() * (w("high") - w("low")) / w("volume"), 7, 2),
    21: lambda w: w("close").rolling(6).mean().rolling(6).apply(lambda v: np.polyfit(np.arange(6), v, 1)[0], raw=True),
    24: lambda w: _sma(w("close").diff(5), 5, 1),
    27: lambda w: _wma((w("close").pct_change(3) + w("close").pct_change(6)) * 100, 12),
    28: lambda w: 3 * _sma(_stochastic(w, 9), 3, 1) - 2 * _sma(_sma(_stochastic(w, 9), 3, 1), 3, 1),
    40: lambda w: 100 * _when(w("close") > w("close").shift(), w("volume"), w("close").shift().notna()).rolling(26).sum() / _when(w("close") <= w("close").shift(), w("volume"), w("close").shift().notna()).rolling(26).sum(),
    49: lambda w: _range_down(w).rolling(12).sum() / (_range_down(w).rolling(12).sum() + _range_up(w).rolling(12).sum()),
    63: lambda w: _rsi(w("close").diff(), 6),
    81: lambda w: _sma(w("volume"), 21, 2),
    89: lambda w: 2 * ((_sma(w("close"), 13, 2) - _sma(w("close"), 27, 2)) - _sma(_sma(w("close"), 13, 2) - _sma(w("close"), 27, 2), 10, 2)),
    103: lambda w: (20 - w("low").rolling(20).apply(lambda v: 19 - np.flatnonzero(v == v.min())[-1], raw=True)) / 20 * 100,
    109: lambda w: _sma(w("high") - w("low"), 10, 2) / _sma(_sma(w("high") - w("low"), 10, 2), 10, 2),
    114: lambda w: (lambda r: (_rank(r.shift(2)) * _rank(_rank(w("volume"))) / (r / (w("vwap") - w("close")).where(lambda x: x.abs() >= 1e-12))))((w("high") - w("low")) / w("close").rolling(5).mean()),
    122: lambda w: _sma(_sma(_sma(np.log(w("close")), 13, 2), 13, 2), 13, 2).pct_change(),
    143: lambda w: (1 + w("close").pct_change().clip(lower=0).fillna(0)).cumprod(),
    152: lambda w: (lambda x: _sma(x.rolling(12).mean() - x.rolling(26).mean(), 9, 1))(_sma((w("close") / w("close").shift(9)).shift(), 9, 1).shift()),
    176: lambda w: _rank(_stochastic(w, 12).round(9)).rolling(6).corr(_rank(w("volume"))),
    182: _together,
    188: lambda w: ((w("high") - w("low")) / _sma(w("high") - w("low"), 11, 2) - 1) * 100,
}


@pytest.mark.parametrize("number", list(PLAIN))
def test_like_pandas(spark, rows, number):
    got, want = _value(spark, rows, FORMULAS[number]), PLAIN[number](lambda name: _wide(rows, name))
    want = want.replace([np.inf, -np.inf], np.nan)
    if number == 176:  # a flat window has a correlation of 0 here
        want = want.fillna(0.0).where(got.notna())
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-8, atol=1e-9)
    assert got.notna().any().any()


def test_smoothing_restarts():
    x, at = np.array([1.0, 4, 7, 5, np.nan, 2, 5, 8]), np.array([0, 1, 2, 3, 4, 5, 6, 9])
    np.testing.assert_allclose(smoothed({"x": x}, at, 1 / 3), [1, 2, 11 / 3, 37 / 9, np.nan, 2, 3, 8])
    assert len(smoothed({"x": np.zeros(0)}, np.zeros(0, int), 0.5)) == 0
    assert np.isnan(smoothed({"x": np.full(3, np.nan)}, np.arange(3), 0.5)).all()


def test_recursion_in_a_rank_and_nulls(spark, rows):
    holes = [(*r[:5], None if r[1] == 9 else r[5], *r[6:]) for r in rows]
    got = _value(spark, holes, "rank(sma(close, 5, 2))")
    want = _rank(_sma(_wide(holes, "close"), 5, 2))
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-12)
    assert got.loc[9].isna().all() and got.loc[10].notna().all()


def test_locked_examples(spark):
    row = lambda week, x: (1, week, x, x, x, x, x, x, 1.0, 0, 0, 1.0)
    short = [row(i, x) for i, x in enumerate((1.0, 4.0, 7.0, 5.0))]
    assert _value(spark, short, "sma(close, 3, 1)")[1].tolist() == pytest.approx([1, 2, 11 / 3, 37 / 9])
    assert _value(spark, short, "wma(close, 3)")[1].tolist()[2] == pytest.approx((7 + 0.9 * 4 + 0.81) / 2.71)
    assert _value(spark, short, "highday(close, 4)")[1].tolist()[3] == 1 and _value(spark, short, "lowday(close, 4)")[1].tolist()[3] == 3
    assert _value(spark, [row(i, 2.0 * i + 3) for i in range(4)], "trend(close, 4)")[1].tolist()[3] == pytest.approx(2)


def test_slope_over_kept_rows(spark, rows):
    text, d = "slope_where(ret, fixed(market_growth()), fixed(market_growth()) < 0, 8)", 8
    got = _value(spark, rows, text)
    close = _wide(rows, "close")
    growth, ret = close.mean(axis=1).pct_change(), close.pct_change()
    for k in close.columns:
        seen, told = [], []
        for i in close.index:
            if growth[i] < 0:
                seen.append((growth[i], ret.at[i, k]))
            told.append(np.polyfit(*np.array(seen[-d:]).T, 1)[0] if len(seen) >= d else np.nan)
        np.testing.assert_allclose(got[k].to_numpy(float), told, rtol=1e-7)
    flat = {"y": np.arange(5.0), "x": np.ones(5), "flag": np.ones(5)}
    assert np.isnan(held_slope(flat, 3)).all() and np.isnan(held_slope({k: v[:0] for k, v in flat.items()}, 3)).all()


def test_all_on_flat_and_empty(spark, rows):
    """Prices and volumes that never change, and no rows at all."""
    some = [k for k in (19, 28, 69, 78, 137, 165, 172) if k in FORMULAS]
    flat = [(k, week, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 1.0, 0, 0, 1.0) for k in range(2) for week in range(30)]
    out = columns(spark.createDataFrame(flat, SCHEMA), some).toPandas()
    assert len(out) == 60 and (out["a191_019"].dropna() == 0).all() and (out["a191_069"].dropna() == 0).all()
    assert out[["a191_028", "a191_078", "a191_137", "a191_165", "a191_172"]].isna().all().all()
    assert columns(spark.createDataFrame([], SCHEMA), [28, 69, 143]).count() == 0


def test_every_number_is_there():
    assert sorted(FORMULAS) == [k for k in range(1, 192) if k != 30]
