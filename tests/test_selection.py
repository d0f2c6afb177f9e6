"""Correlations, pruning and stability of factors against pandas."""

import numpy as np
import pandas as pd
import pytest

from factorloom.operators import selection

NAMES = [f"f{i}" for i in range(6)]
RNG = np.random.default_rng(9)


@pytest.fixture(scope="module")
def frame():
    parts = []
    for t in range(9):
        n = 40 if t else 15  # the first date is too small
        x = RNG.normal(size=(n, 6))
        x[:, 1] = x[:, 0] + 0.1 * x[:, 1]
        x[:, 2] = np.round(x[:, 2])
        x[:, 3] = 1.0 if t == 4 else x[:, 3]
        x[RNG.random((n, 6)) < 0.1] = np.nan
        x[:25, 5] = np.nan
        x[3, 4] = np.inf
        parts.append(pd.DataFrame(x, columns=NAMES).assign(week_no=t, instrument=range(n)))
    return pd.concat(parts)


@pytest.mark.parametrize("parts", [1, 4])
def test_mean_rank_correlation(spark, frame, parts, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        df = spark.createDataFrame(frame.astype({"week_no": int})).repartition(parts)
        got = {(r["factor_i"], r["factor_j"]): r for r in selection.mean_rank_correlation(df, NAMES).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    finite = frame.replace([np.inf, -np.inf], np.nan)
    told = {t: f[NAMES].rank().corr(min_periods=20) for t, f in finite.groupby("week_no")}
    assert len(got) == 15
    for (a, b), r in got.items():
        each = [c.loc[a, b] for c in told.values() if np.isfinite(c.loc[a, b])]
        assert r["dates"] == len(each) and (r["correlation"] is None if not each else r["correlation"] == pytest.approx(np.mean(each), abs=1e-12))
    assert got["f0", "f5"]["correlation"] is None and got["f0", "f3"]["dates"] == 7
    none = selection.mean_rank_correlation(df.where("false"), NAMES).collect()
    assert all(r["dates"] == 0 for r in none)


def test_pruning_is_greedy_by_strength(spark):
    pairs = [("a", "b", 0.9), ("a", "c", -0.85), ("b", "d", 0.95), ("c", "d", 0.1), ("a", "d", None), ("d", "e", 0.8), ("c", "e", 0.9)]
    c = spark.createDataFrame(pairs, "factor_i string, factor_j string, correlation double")
    got = {r["factor"]: (r["place"], r["kept"], r["duplicates"]) for r in selection.prune({"b": 0.2, "a": 0.3, "c": 0.2, "d": 0.1, "e": 0.05}, c, 0.8).collect()}
    assert got == {"a": (1, True, None), "b": (2, False, "a"), "c": (3, False, "a"), "d": (4, True, None), "e": (5, False, "d")}
    with pytest.raises(ValueError):
        selection.prune({"a": 1.0}, c, 1.0)


def test_stability(spark):
    annual = []
    for year in range(2010, 2018):
        annual.append(("steady", year, 240, -0.03, -0.2, -0.3, 0.3))
        sign = 1.0 if year % 2 else -0.5
        annual.append(("flaky", year, 240, 0.03 * sign, 0.1 * sign, 0.1 * sign, 0.0))
    annual.append(("steady", 2018, 30, 0.05, 0.3, 0.3, -0.3))
    annual = spark.createDataFrame(annual, "factor string, year int, days int, rank_ic double, spread double, top double, bottom double")
    summary = spark.createDataFrame([("steady", -0.03, -0.2, 1920, -1.0), ("flaky", 0.01, 0.05, 1920, 0.2), ("flat", 0.0, 0.0, 1920, 0.0), ("new", 0.02, None, 0, None)], "factor string, rank_ic double, rank_icir double, days int, spread double")
    coverage = spark.createDataFrame([("steady", 0.99), ("flaky", 0.99), ("flat", 0.5)], "factor string, coverage double")
    universe = spark.createDataFrame([(y, 0.1) for y in range(2010, 2019)], "year int, ret double")
    got = {r["factor"]: r for r in selection.stability(summary, annual, coverage, universe=universe).collect()}
    s = got["steady"]
    assert (s["direction"], s["years"], s["ic_years"], s["spread_years"], s["spread"], s["selected"], s["failed"]) == (-1, 8, 8, 8, 1.0, True, "")
    assert s["t_stat"] == pytest.approx(-0.2 * np.sqrt(1920)) and s["long_years"] == 8 and s["long_excess"] == pytest.approx(0.2)
    assert got["flaky"]["failed"] == "ic_years,spread_years" and not got["flaky"]["selected"] and got["flaky"]["ic_years"] == 4
    assert got["flat"]["failed"] == "direction,rank_ic,ic_years,spread_years,coverage" and got["new"]["failed"] == "ic_years,spread_years,coverage"
    strict = {r["factor"]: r["failed"] for r in selection.stability(summary, annual, coverage, selection.Criteria(t_stat=3.0, positive_long_years=0.5), universe).collect()}
    assert strict["steady"] == "" and strict["flaky"] == "t_stat,ic_years,spread_years,long_years"
    with pytest.raises(ValueError):
        selection.stability(summary, annual, coverage, selection.Criteria(positive_long_years=0.5))
    assert selection.stability(summary.where("false"), annual, coverage).count() == 0
