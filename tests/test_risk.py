"""The structured risk model against numpy on a market whose factor returns are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import risk

STYLES = {"size": ["d0"], "mood": ["d1", "d2"]}
RNG = np.random.default_rng(2)


def scaled(x, cap):
    x, cap = np.array(x, dtype=float), np.array(cap, dtype=float)
    there = np.isfinite(x)
    if there.sum() < 3:
        return np.full(len(x), np.nan)
    x = np.clip(x, *np.quantile(x[there], [0.01, 0.99]))
    w = np.where(np.isfinite(cap) & (cap > 0) & there, cap, 0.0)
    mid = np.average(x[there], weights=w[there]) if w.sum() else x[there].mean()
    sd = np.std(x[there], ddof=1)
    return (x - mid) / sd if sd > 0 else np.where(there, 0.0, np.nan)


@pytest.fixture(scope="module")
def market(spark):
    weeks, n = 40, 60
    sector = [None if i < 4 else i % 3 for i in range(n)]
    base = RNG.normal(size=(n, 3))
    true = RNG.normal(size=(weeks, 6)) * 0.5
    rows, exposures, caps = [], [], []
    for t in range(weeks):
        d = base + 0.05 * RNG.normal(size=base.shape)
        d[t % n, 1] = np.nan
        d[7, 1:] = np.nan
        if t == 5:
            d[:, 0] = 2.0
        cap = RNG.lognormal(3, 1, size=n)
        cap[9] = -1.0
        with np.errstate(all="ignore"):
            parts = [scaled(d[:, k], cap) for k in range(3)]
            mood = np.array([np.nanmean([a, b]) if np.isfinite([a, b]).any() else np.nan for a, b in zip(*parts[1:], strict=True)])
        styles = np.nan_to_num(np.column_stack([scaled(parts[0], cap), scaled(mood, cap)]))
        x = np.column_stack([*[[float(s == g) for s in sector] for g in range(3)], [float(s is None) for s in sector], styles])
        y = exposures[-1] @ true[t] + RNG.normal(size=n) * 0.01 if t else np.zeros(n)
        for i in range(n):
            if (i + t) % 23 and not (i == 11 and t < 35):
                rows.append((i, 100 + 2 * t, float(y[i]), float(cap[i]), sector[i], *[None if np.isnan(v) else float(v) for v in d[i]]))
        exposures.append(x)
        caps.append(cap)
    df = spark.createDataFrame(rows, "instrument int, week_no int, y double, cap double, sector int, d0 double, d1 double, d2 double")
    return df, rows, true


def plain(rows):
    """Exposures, factor returns and residuals by date, straight from the rows."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    dates, x, beta, residual = sorted(by), {}, {}, {}
    for t in dates:
        own = by[t]
        cap = [r[3] for r in own]
        raw = np.array([[np.nan if v is None else v for v in r[5:8]] for r in own])
        parts = [scaled(raw[:, k], cap) for k in range(3)]
        mood = np.array([np.nanmean([a, b]) if np.isfinite([a, b]).any() else np.nan for a, b in zip(*parts[1:], strict=True)])
        styles = np.nan_to_num(np.column_stack([scaled(parts[0], cap), scaled(mood, cap)]))
        x[t] = {r[0]: (np.array([*[float(r[4] == g) for g in range(3)], float(r[4] is None), *s]), r[3]) for r, s in zip(own, styles, strict=True)}
    for before, t in zip(dates[:-1], dates[1:], strict=True):
        own = [(r[0], r[2], *x[before][r[0]]) for r in by[t] if r[0] in x[before] and x[before][r[0]][1] > 0]
        root = np.sqrt(np.sqrt([o[3] for o in own]))
        d, y = np.array([o[2] for o in own]), np.array([o[1] for o in own])
        beta[t] = np.linalg.lstsq(d * root[:, None], y * root, rcond=1e-9)[0]
        residual[t] = {o[0]: o[1] - o[2] @ beta[t] for o in own}
    return x, beta, residual


def test_standardise(spark):
    x = [*RNG.normal(size=300), 1e6, float("nan"), None]
    cap = RNG.lognormal(0, 1, size=303)
    rows = [(1, i, None if v is None else float(v), float(c)) for i, (v, c) in enumerate(zip(x, cap, strict=True))] + [(2, i, 5.0, 1.0) for i in range(4)] + [(3, 0, 1.0, 1.0), (3, 1, 2.0, None)] + [(4, i, float(i), -1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "week_no int, instrument int, x double, cap double").withColumn("risk_n_z", F.lit("own"))
    out = risk.standardise(df, {"z": "x"}, "cap")
    assert out.columns == [*df.columns, "z"]
    got = {(r["week_no"], r["instrument"]): r["z"] for r in out.collect()}
    mine = np.array([np.nan if got[1, i] is None else got[1, i] for i in range(303)])
    there = np.isfinite(mine)
    assert there.sum() == 301 and got[1, 300] < 4
    assert abs(np.average(mine[there], weights=cap[there])) < 1e-10 and np.std(mine[there], ddof=1) == pytest.approx(1)
    assert [got[2, i] for i in range(4)] == [0.0] * 4 and got[3, 0] is None and got[3, 1] is None
    assert [got[4, i] for i in range(5)] == pytest.approx(list((np.clip(np.arange(5.0), 0.04, 3.96) - 2) / np.std(np.clip(np.arange(5.0), 0.04, 3.96), ddof=1)))


def test_factor_returns_and_residuals(market):
    df, rows, true = market
    model = risk.risk_model(df.repartition(5), "y", "cap", "sector", STYLES)
    assert model.names == ["sector_0", "sector_1", "sector_2", "sector_unknown", "size", "mood"]
    x, beta, residual = plain(rows)
    got = {r["week_no"]: r for r in model.factor_returns.collect()}
    assert set(got) == set(beta) and sorted(r["place"] for r in got.values()) == list(range(1, len(beta) + 1))
    for t, r in got.items():
        assert np.allclose(r["beta"], beta[t], atol=1e-8)
    # rows are left out of the panel after the truth was made, which moves standardised styles a little
    assert np.mean([np.abs(np.array(r["beta"]) - true[(t - 100) // 2]).mean() for t, r in got.items() if t != 112]) < 0.05
    for r in model.exposures.collect():
        assert np.allclose(r["x"], x[r["week_no"]][r["instrument"]][0], atol=1e-9)
    mine = {(r["week_no"], r["instrument"]): r["residual"] for r in model.residuals.collect()}
    want = {(t, i): v for t in residual for i, v in residual[t].items()}
    assert set(mine) == set(want) and all(abs(mine[k] - want[k]) < 1e-8 for k in want)


def test_covariance_and_specific_risk(market):
    df, rows, _ = market
    model = risk.risk_model(df, "y", "cap", "sector", STYLES)
    _, beta, residual = plain(rows)
    signals, lookback, half = [103, 171, 178, 300], 30, 7.0
    cov = model.covariance(signals, lookback, half).collect()
    specific = model.specific(signals, lookback, half).collect()
    assert {r["signal"] for r in cov} == {171, 178, 300} == {r["signal"] for r in specific}
    for s in (171, 178, 300):
        dates = [t for t in sorted(beta) if t <= s][-lookback:]
        w = 0.5 ** (np.arange(lookback)[::-1] / half)
        w /= w.sum()
        b = np.array([beta[t] for t in dates])
        c = ((b - w @ b) * w[:, None]).T @ (b - w @ b)
        got = {(r["factor_i"], r["factor_j"]): r["covariance"] for r in cov if r["signal"] == s}
        assert np.allclose([[got[i, j] for j in model.names] for i in model.names], c, atol=1e-10)
        want, few = {}, []
        for i in {k for t in dates for k in residual[t]}:
            own = [(v, residual[t][i]) for v, t in zip(w, dates, strict=True) if i in residual[t]]
            want[i] = sum(v * e * e for v, e in own) / sum(v for v, _ in own)
            if len(own) < 20:
                few.append(i)
        middle = np.median([v for i, v in want.items() if i not in few])
        told = {r["instrument"]: r["volatility"] for r in specific if r["signal"] == s}
        assert set(told) == set(want) and (11 in few or s == 171)
        assert all(told[i] == pytest.approx(np.sqrt(middle if i in few else want[i]), rel=1e-7) for i in want)
    assert model.covariance([], lookback).count() == 0
    with pytest.raises(ValueError):
        model.covariance(signals, lookback, 0.0)


def test_limits_and_empty(spark, market):
    limits = risk.exposure_limits(["sector_0", "sector_unknown", "size", "mood"], "sector", groups=0.02, size=0.1)
    assert limits == {"sector_0": 0.02, "sector_unknown": 0.02, "size": 0.1, "mood": 100.0}
    with pytest.raises(ValueError):
        risk.exposure_limits(["size"], "sector", size=-1.0)
    model = risk.risk_model(market[0].where("false"), "y", "cap", "sector", STYLES)
    assert model.factor_returns.count() == 0 and model.residuals.count() == 0 and model.specific([1]).count() == 0


def test_factor_returns_are_made_once(spark, sf_dir):
    """The places of signal dates and the residuals read the same factor returns; before, each fitted the whole panel anew."""
    from factorloom.plans.risk import specific

    plan = specific(spark, sf_dir)._jdf.queryExecution().withCachedData().toString()
    assert plan.count("InMemoryRelation") == 1
    above = plan[: plan.index("InMemoryRelation")]
    assert "MapInPandas" not in above and "FlatMapGroupsInPandas" not in above
