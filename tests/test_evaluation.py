"""Universes, model windows and effectiveness against plain Python: unknown and missing values, ties, gaps, flat dates, empty tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import effectiveness as eff
from factorloom.operators import universe as uni
from factorloom.operators.model_windows import Plan, roles

CODES = "instrument string, week_no int, treated boolean, listed int, in_index boolean"


def _inside(name):
    return uni.member(name, F.col("instrument"), F.col("treated"), F.col("listed"), F.col("in_index"))


def test_universes(spark):
    rows = [
        ("SH600000", 1, False, 100, True), ("SZ000001", 1, False, 100, None), ("SZ300001", 1, None, 100, True), ("SH688001", 1, False, 100, False),
        ("BJ830001", 1, False, 100, False), ("SH600005", 1, True, 100, False), ("SH600006", 1, False, 60, False), ("sh600007", 1, False, 61, False), ("SH600008", 1, False, None, False),
    ]
    df = spark.createDataFrame(rows, CODES)
    told = lambda name: {r.instrument for r in df.where(_inside(name)).collect()}
    assert told("main") == {"SH600000", "SZ000001", "sh600007"}
    assert told("sh_main") == {"SH600000", "sh600007"}
    assert told("index") == {"SH600000", "SZ300001"}
    assert len(told("all")) == len(rows) and df.limit(0).where(_inside("main")).count() == 0
    with pytest.raises(ValueError):
        _inside("none")
    with pytest.raises(Exception, match="special treatment"):
        spark.createDataFrame([("SH600000", 1, None, 100, True)], CODES).select(_inside("main")).collect()


def test_spans(spark):
    inside = [("a", 1, True), ("a", 2, True), ("a", 9, True), ("a", 10, False), ("a", 11, True), ("b", 1, None), ("b", 2, True), ("c", 1, False)]
    df = spark.createDataFrame(inside, "instrument string, week_no int, x boolean")
    assert sorted(tuple(r) for r in uni.spans(df, F.col("x")).collect()) == [("a", 1, 9), ("a", 11, 11), ("b", 2, 2)]
    assert uni.spans(df.limit(0), F.col("x")).count() == 0


def _plain_roles(days, plan):
    """Day by day, from sorted lists of the days before each boundary."""
    calendar, out = sorted({d for d in days if d}), []
    for y in range(plan.first, plan.last + 1):
        index = y * 12 - plan.validation_months
        v, t = dt.date(index // 12, index % 12 + 1, 1), dt.date(y, 1, 1)
        usable = lambda b: set(([d for d in calendar if d < b])[: -plan.purge or None])
        for d in days:
            if d is None or not dt.date(y - plan.train_years, 1, 1) <= d <= dt.date(y, 12, 31):
                continue
            role = "test" if d >= t else ("validation" if d in usable(t) else None) if d >= v else "train" if d in usable(v) else None
            refit = None if d >= t else d in usable(t)
            if role or refit:
                out.append((str(d), y, role, refit))
    return sorted(map(str, out))


@pytest.mark.parametrize("plan", [Plan(2001, 2004, 3, 6, 5), Plan(2002, 2003, 1, 1, 1), Plan(2000, 2005, 2, 14, 0)])
def test_windows(spark, plan):
    draw = np.random.default_rng(2)
    days = [dt.date(1999, 3, 1) + dt.timedelta(int(x)) for x in draw.choice(2000, 300)]
    days = [d for d in days if not dt.date(2001, 11, 1) <= d <= dt.date(2002, 2, 20)] + [None]  # months without dates around a boundary
    df = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "day date, position int")
    out = roles(df, "day", plan)
    assert out.columns == ["day", "position", "window", "role", "refit"]
    assert sorted(str((str(r.day), r.window, r.role, r.refit)) for r in out.collect()) == _plain_roles(days, plan)


def test_windows_bounds(spark):
    df = spark.createDataFrame([], "day date, window int")
    assert roles(df.drop("window"), "day", Plan(2001, 2001)).count() == 0
    with pytest.raises(ValueError):
        roles(df, "day", Plan(2001, 2001))
    for bad in ((2001, 2000), (2001, 2001, 0), (2001, 2001, 1, 12)):
        with pytest.raises(ValueError):
            Plan(*bad)


def _lines(seed=4):
    draw, out = np.random.default_rng(seed), []
    for week in range(60):
        for k in range(25):
            label = float(draw.normal(0, 0.05))
            for name, x in (("good", label + draw.normal(0, 0.05)), ("tied", float(draw.integers(0, 4))), ("flat", 1.0)):
                out.append((name, week * 2, k, None if (k == 3 and week % 7 == 0) else float(x), None if k == 5 and week == 9 else label))
    out += [("rare", 3, k, float(k), 0.01 * k) for k in range(5)]  # too few rows
    return out


def test_effectiveness(spark):
    rows, holding = _lines(), 4
    schema = "factor string, week_no int, k int, x double, label double"
    daily = eff.by_date(spark.createDataFrame(rows, schema), holding)
    f = pd.DataFrame(rows, columns=["factor", "week_no", "k", "x", "label"])
    place = {w: i % holding + 1 for i, w in enumerate(sorted(f["week_no"].unique()))}
    want = {}
    for (name, week), g in f.dropna().groupby(["factor", "week_no"]):
        if len(g) < 20:
            continue
        share = g["x"].rank() / len(g)
        part = np.ceil(share * 5).clip(1, 5)
        flat = g["x"].nunique() == 1
        want[name, week] = (place[week], np.nan if flat else g["x"].corr(g["label"]), np.nan if flat else g["x"].rank().corr(g["label"].rank()), g["label"][part == 5].mean(), g["label"].mean(), g["label"][part == 1].mean())
    got = {(r.factor, r.week_no): (r.pocket, r.ic, r.rank_ic, r.top_return, r.benchmark_return, r.bottom_return) for r in daily.collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        np.testing.assert_allclose(np.array(got[key], float), np.array(values, float), rtol=1e-9, atol=1e-12)

    lines = pd.DataFrame([(*key, *v) for key, v in want.items()], columns=["factor", "week_no", "pocket", "ic", "rank_ic", "top", "all", "bottom"])
    told = {(r.factor, r.year): r for r in eff.summary(daily, F.floor(F.col("week_no") / 52), holding, least=20).collect()}
    assert {k for k in told if k[1] is None} == {("good", None), ("tied", None), ("flat", None)}
    for (name, year), r in told.items():
        g = lines[(lines["factor"] == name) & ((lines["week_no"] // 52 == year) if year is not None else True)]
        assert (r.ic_dates, r.rank_ic_dates) == (g["ic"].count(), g["rank_ic"].count())
        if g["ic"].count():
            assert r.icir == pytest.approx(g["ic"].mean() / g["ic"].std()) and r.rank_ic_mean == pytest.approx(g["rank_ic"].mean())
        paid = g.dropna(subset=["top", "all", "bottom"])
        assert r.return_dates == len(paid) and r.pockets == paid["pocket"].nunique()
        if len(paid):
            grown = paid.groupby("pocket")[["top", "all", "bottom"]].apply(lambda p: (1 + p).prod() - 1).mean()
            assert [r.top_return, r.benchmark_return, r.bottom_return] == pytest.approx(grown.tolist())
            assert r.long_positive == pytest.approx((paid["top"] > paid["all"]).mean())
        if r.return_dates < 20 or r.pockets < holding:
            assert r.side == r.dominant == "insufficient_data"
    assert told["good", None].side == "both" and told["good", None].dominant in ("long", "short")
    assert told["good", 2].side == "insufficient_data" and told["flat", None].side == "insufficient_data"


def test_effectiveness_of_nothing(spark):
    empty = spark.createDataFrame([], "factor string, week_no int, x double, label double")
    daily = eff.by_date(empty, 5)
    assert daily.count() == 0 and eff.summary(daily, F.floor(F.col("week_no") / 52), 5, 1).count() == 0
