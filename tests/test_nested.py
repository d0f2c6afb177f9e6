"""Nested formulas and dense bars against plain pandas, on gaps, ties, nulls and empty tables."""

import numpy as np
import pandas as pd
import pytest

from factorloom.plans.formulas import FORMULAS
from factorloom.plans.nested import Panel
from factorloom.sources.bars import dense

SCHEMA = "instrument int, week_no int, open double, high double, low double, close double, vwap double, amount double, volume double, sector int, industry int, cap double"


@pytest.fixture(scope="module")
def rows():
    draw, out = np.random.default_rng(5), []
    for k in range(6):
        for week in range(30):
            o, c = (draw.integers(5, 12, 2) / 2.0).tolist()  # ties are common
            volume = float(draw.integers(1, 6))
            out.append((k, week, o, max(o, c) + 1, min(o, c) - 1, c, (o + c) / 2, volume * c, volume, k % 2, k % 3, 100.0 + k))
    return out


def _value(spark, rows, text):
    panel = Panel()
    term = eval(text, {"__builtins__": {}}, panel.names())
    out = panel.apply(spark.createDataFrame(rows, SCHEMA)).select("instrument", "week_no", term.column().alias("value")).toPandas()
    return out.pivot(index="week_no", columns="instrument", values="value").sort_index()


def _wide(rows, name):
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
    return frame.pivot(index="week_no", columns="instrument", values=name).sort_index()


def _rank(x):
    return x.rank(axis=1, pct=True)


def _decay(x, d):
    return x.rolling(d).apply(lambda v: (v * np.arange(1, d + 1)).sum() / (d * (d + 1) / 2), raw=True)


PLAIN = {
    "rank(close)": lambda w: _rank(w("close")),
    "decay(rank(volume), 4)": lambda w: _decay(_rank(w("volume")), 4),
    "ts_rank(rank(low), 5)": lambda w: _rank(w("low")).rolling(5).rank(pct=True),
    "rank(ts_max(delta(close), 3))": lambda w: _rank(w("close").diff().rolling(3).max()),
    "corr(rank(open), close, 6)": lambda w: _rank(w("open")).rolling(6).corr(w("close")),
    "neutral(mean(vwap, 3), 'sector')": lambda w: w("vwap").rolling(3).mean() - w("vwap").rolling(3).mean().T.groupby(lambda k: k % 2).transform("mean").T,
    "scale(close - open)": lambda w: (w("close") - w("open")).div((w("close") - w("open")).abs().sum(axis=1), axis=0),
    "argmax(high, 4)": lambda w: w("high").rolling(4).apply(lambda v: v.argmax() + 1.0, raw=True),
    "where(close > delay(close, 1), std(close, 4), -volume)": lambda w: w("close").rolling(4).std().where(w("close") > w("close").shift(1), -w("volume")),
    FORMULAS[8]: lambda w: -_rank((w("open").rolling(5).sum() * w("close").pct_change().rolling(5).sum()).diff(10).round(9)),
    FORMULAS[33]: lambda w: _rank(w("open") / w("close") - 1),
}


@pytest.mark.parametrize("text", list(PLAIN))
def test_like_pandas(spark, rows, text):
    got, want = _value(spark, rows, text), PLAIN[text](lambda name: _wide(rows, name))
    # inputs of windows are rounded to 40 bits, about 1e-12 of a value; these values are below 10
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-11)


def test_missing_values_and_empty(spark, rows):
    holes = [(*r[:5], None if r[1] == 7 else r[5], *r[6:]) for r in rows]
    got = _value(spark, holes, "rank(mean(close, 3))")
    assert got.loc[[7, 8, 9]].isna().all().all() and got.loc[10].notna().all()
    assert _value(spark, [], "rank(mean(close, 3))").empty


def test_dense(spark):
    row = lambda week, close: (1, week, 1.0, 9.0, 0.5, close, 2.0, 8.0, 4.0, 0, 0, 5.0)
    out = dense(spark.createDataFrame([row(3, 7.0), row(6, None), row(8, 2.0)], SCHEMA)).orderBy("week_no").collect()
    assert [(r.week_no, r.high, r.close, r.volume) for r in out] == [(3, 9.0, 7.0, 4.0), (4, 7.0, 7.0, 1.0), (5, 7.0, 7.0, 1.0), (6, 9.0, None, 4.0), (7, None, None, 1.0), (8, 9.0, 2.0, 4.0)]
    assert dense(spark.createDataFrame([], SCHEMA)).count() == 0


def test_phases_share_shuffles(spark, sf_dir):
    """Levels that need no turn between instruments and weeks share a shuffle; before, each of the eleven levels of 153 to 160 shuffled all rows, and 1 GB of tables filled the disk."""
    from factorloom.plans.formulas_191 import QUERIES

    plan = QUERIES["a191_153_160"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 4  # a turn each; the dense bars lie by instrument already


def test_steps_wait_where_rows_are_narrower(spark, rows):
    """What only later phases read is made there, from columns that are carried anyway, and results are the same in every order of the steps."""
    text = "corr(rank(close), delta(close, 1) + delta(close, 2) + ts_max(close, 3), 6) + rank(ts_min(rank(ts_min(rank(close), 2)) + volume, 2))"
    panel = Panel()
    term = eval(text, {"__builtins__": {}}, panel.names())
    df = spark.createDataFrame(rows, SCHEMA)
    steps = [x for level in panel._levels() for x in level]
    want = panel.apply(df).select("instrument", "week_no", term.column().alias("value")).orderBy("instrument", "week_no").toPandas()
    got = panel.table(df, {"value": term}, ["instrument", "week_no"]).orderBy("instrument", "week_no").toPandas()
    np.testing.assert_array_equal(got["value"].to_numpy(float), want["value"].to_numpy(float))
    read = {n: {x.sql for x in panel.windows[n][1]} if n in panel.windows else {x for x in ("close", "volume", *[m for m, _ in steps]) if x in made.sql.replace("(", " ").replace(")", " ").split()} for n, made in steps}
    phases = panel._phases(steps, read, 5)
    assert all(phases[n] >= phases.get(c, 0) for n, _ in steps for c in read[n]) and all(phases[n] >= made.phase for n, made in steps)


@pytest.mark.parametrize("missing", [0.0, 0.2, 0.9, 1.0])
def test_averages_of_many_runs(missing):
    from factorloom.plans.nested import smoothed

    draw = np.random.default_rng(3)
    x = np.where(draw.random(400) < missing, np.nan, draw.integers(1, 9, 400).astype(float))
    at, group = np.arange(400) % 50, np.arange(400) // 50
    y, want = np.nan, []
    for k, v in enumerate(x.tolist()):
        y = v if y != y or at[k] == 0 else 0.3 * v + 0.7 * y
        want.append(y)
    np.testing.assert_allclose(smoothed({"x": x}, at, 0.3, group), want, rtol=1e-12)


def test_powers_of_missing_values(spark, rows):
    """A missing base or exponent gives a missing value, also to the power of 0 and of a base of 1."""
    got = _value(spark, rows, "power(ts_rank(close, 4), delta(close, 2))")
    want = (lambda x: x.rolling(4).rank(pct=True) ** x.diff(2))(_wide(rows, "close")).where(lambda v: _wide(rows, "close").rolling(4).count() == 4)
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-9)
    ones = _value(spark, rows, "power(sign(volume), delta(close, 2))")
    assert ones.iloc[:2].isna().all().all() and (ones.iloc[2:] == 1).all().all()


def test_values_of_one_row_stay_in_the_stage(spark, sf_dir):
    """What is fed to a window is made in the window's stage; before, Spark made it in columns of its own, which were passed to Python and, where read again, back."""
    from factorloom.plans.formulas import _query

    plan = _query([81, 82, 83, 84, 85, 86, 87, 88])(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.rindex("MapInArrow")]
    assert above.count("134217729") == above.count("8193") == 0  # the rounding's factor


def test_rounded_before_the_turn():
    """What is rounded for a window after a turn is shuffled rounded; before, its whole last bits were. What only ranks are in is not: ranks are shorter."""
    panel = Panel()
    words = panel.names()
    words["rank"](words["sum"](words["close"], 3) / 7)
    words["sum"](1 / words["rank"](words["open"]), 3)
    steps = [x for level in panel._levels() for x in level]
    read = {n: {x.sql for x in panel.windows[n][1]} if n in panel.windows else {m for m, _ in steps if m in made.sql.replace("(", " ").replace(")", " ").split()} for n, made in steps}
    phases = panel._phases(steps, read, max(made.phase for _, made in steps))
    rounded = [n for n, made in steps if n not in panel.windows]
    assert [n in panel.rounded for n in rounded] == [True, False]
    assert phases[rounded[0]] == 0 and phases[rounded[1]] == 2


def test_shown_early_and_again(spark):
    from pyspark.sql import functions as F

    from factorloom.plans.formulas import _shown_array, shown

    draw = np.random.default_rng(6)
    edge = np.outer(np.exp2(np.arange(-30, 31, 1.0)), [1.0, 1 - 2**-53, 1 + 2**-52, 1 - 2**-17, 1 + 2**-16]).ravel()
    x = np.r_[edge, -edge, draw.normal(size=500) * np.exp2(draw.integers(-45, 45, 500)), 0.0, 1e-12, 9e-13]
    df = spark.createDataFrame(pd.DataFrame({"x": x, "early": _shown_array(x)}))
    told = df.select(shown(F.col("x")).alias("once"), shown(F.col("early")).alias("twice")).toPandas()
    np.testing.assert_array_equal(told["twice"], told["once"])
    assert np.isnan(_shown_array(np.array([np.nan]))[0]) and np.isinf(_shown_array(np.array([-np.inf]))[0])
