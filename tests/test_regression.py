"""Kernels, rolling regressions and fits by date against numpy on small panels with gaps, missing values, ties and singular windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import kernels, least_squares
from factorloom.operators import regression as reg

RNG = np.random.default_rng(5)


def panel(spark, instruments=3, weeks=60, kind="ordinary", gaps=0.1):
    rows = []
    for i in range(instruments):
        for t in range(weeks):
            if RNG.random() < gaps:
                continue
            x = {"zero": 0.0, "constant": 1.0, "repeated": float(t % 3), "ordinary": RNG.normal() * 0.01, "mixed": 0.0 if t < 30 else RNG.normal() * 0.01}[kind]
            rows.append((i, t + 100, None if RNG.random() < 0.05 else RNG.normal() * 0.01, x, 2 * x if kind == "repeated" else RNG.normal(), f"note {t}", None if t % 7 else t))
    df = spark.createDataFrame(rows, "instrument int, week_no int, y double, x double, z double, note string, extra long")
    return df, {(r[0], r[1]): r for r in rows}


def fit(rows, least, k):
    """lstsq over the rows of a window that are complete."""
    rows = [r for r in rows if r is not None and None not in r]
    if len(rows) < least:
        return None
    a = np.array(rows)
    d = np.column_stack([np.ones(len(a)), a[:, 1 : k + 1]])
    beta = np.linalg.lstsq(d, a[:, 0], rcond=1e-10)[0]
    return d, a[:, 0], beta


@pytest.mark.parametrize("kind", ["zero", "constant", "repeated", "ordinary", "mixed"])
@pytest.mark.parametrize("stride", [1, 3])
def test_rolling_ols(spark, kind, stride):
    window, least = 12, 6
    df, known = panel(spark, kind=kind)
    got = reg.rolling_ols(df, "y", ["x", F.col("z")], window, least, stride=stride, slices={"late": (6, 12)}, prefix="o_").collect()
    assert len(got) == len(known)
    seen = 0
    for r in got:
        i, t = r["instrument"], r["week_no"]
        assert (r["note"], r["extra"]) == known[i, t][5:7]
        at = [t - stride * (window - 1 - j) for j in range(window)]
        raw = [known.get((i, u)) for u in at]
        told = fit([None if v is None else v[2:5] for v in raw], least, 2)
        if told is None:
            assert r["o_b0"] is None and r["o_n"] is None and r["o_resid_std"] is None
            continue
        d, y, beta = told
        seen += 1
        assert [r["o_b0"], r["o_b1"], r["o_b2"]] == pytest.approx(beta, rel=1e-6, abs=1e-9) and r["o_slopes"] == pytest.approx(beta[1:].sum(), rel=1e-6, abs=1e-9) and r["o_n"] == len(y)
        e = y - d @ beta
        s = (e**2).sum()
        if s <= 1e-14 * (y**2).sum():
            continue
        if len(y) > 3:
            assert r["o_resid_std"] == pytest.approx(np.sqrt(s / (len(y) - 3)), rel=1e-7)
        assert r["o_resid_skew"] == pytest.approx((e**3).mean() / (s / len(y)) ** 1.5, rel=1e-5, abs=1e-7)
        apart = (d[:, 1] - d[:, 1].mean()) ** 2
        if apart.sum() > 1e-12:
            assert r["o_coskew"] == pytest.approx((e * apart).mean() / (np.sqrt((e**2).mean()) * apart.mean()), rel=1e-5, abs=1e-7)
        else:
            assert r["o_coskew"] is None or kind == "constant"
        late = [v[2] - (np.array([1.0, *v[3:5]]) @ beta) for v in raw[6:12] if v is not None and v[2] is not None]
        if len(late) >= 3:
            assert r["o_late"] == pytest.approx(np.mean(late) / np.std(late, ddof=1), rel=1e-5, abs=1e-7)
        else:
            assert r["o_late"] is None
    assert seen > 30


def test_least_norm_where_singular():
    for last in (2.0, 3.0):
        m = np.array([[4.0, 2.0, 2.0], [2.0, 2.0, 2.0], [2.0, 2.0, last]])
        beta, inverse = reg.least_norm(m[None], np.array([[1.0, 2.0, 3.0]]))
        assert np.allclose(inverse[0], np.linalg.pinv(m), atol=1e-9) and np.allclose(beta[0], np.linalg.pinv(m) @ [1, 2, 3], atol=1e-9)


def test_units_do_not_make_a_window_singular():
    d = np.column_stack([np.ones(50), RNG.normal(size=50) * 1e-9, RNG.normal(size=50) * 1e9])
    y = d @ [1.0, 2e9, 3e-9]
    assert np.allclose(reg.least_norm((d.T @ d)[None], (d.T @ y)[None])[0][0], [1.0, 2e9, 3e-9], rtol=1e-6)


def test_since_and_history_before_the_calendar(spark):
    df, known = panel(spark, gaps=0)
    got = reg.rolling_ols(df, "y", ["x"], 12, 1, since=reg.calendar_start(df)).collect()
    assert all((r["b1"] is None) == (r["week_no"] < 111) for r in got)


def test_dimson_beta_and_price_delay(spark):
    window, least = 20, 12
    df, known = panel(spark, weeks=50)
    got = reg.price_delay(reg.dimson_beta(df, "y", "x", window, least), "y", "x", window, least, lags=2).collect()
    value = lambda i, t, c: known[i, t][c] if (i, t) in known else None
    seen = 0
    for r in got:
        i, t = r["instrument"], r["week_no"]
        rows = [[value(i, u, 2), value(i, u - 1, 3), value(i, u, 3), value(i, u + 1, 3)] for u in range(t - window, t)]
        told = fit([None if v[0] is None or None in v else v for v in rows], least, 3)
        assert r["dimson_beta"] is None if told is None else r["dimson_beta"] == pytest.approx(told[2][1:].sum(), rel=1e-7)
        rows = [[value(i, u, 2), *[value(i, u - s, 3) for s in range(3)]] for u in range(t - window + 1, t + 1)]
        rows = [v for v in rows if None not in v]
        told, alone = fit(rows, least, 3), fit(rows, least, 1)
        if told is None:
            assert r["delay_rsq"] is None and r["delay_slope"] is None and r["delay_tstat"] is None
            continue
        seen += 1
        (d, y, b), (d1, _, b1) = told, alone
        total, rest = ((y - y.mean()) ** 2).sum(), ((y - d @ b) ** 2).sum()
        assert r["delay_rsq"] == pytest.approx(1 - (1 - ((y - d1 @ b1) ** 2).sum() / total) / (1 - rest / total), rel=1e-7, abs=1e-9)
        assert r["delay_slope"] == pytest.approx((b[2] + 2 * b[3]) / b[1:].sum(), rel=1e-6)
        stat = b[1:] / np.sqrt(np.diag(np.linalg.inv(d.T @ d))[1:] * rest / (len(y) - 4))
        assert r["delay_tstat"] == pytest.approx((stat[1] + 2 * stat[2]) / stat.sum(), rel=1e-6)
    assert seen > 10


def test_betas_by_windows(spark):
    df, known = panel(spark, weeks=40, gaps=0.05)
    out = df.withColumns({"down": reg.downside_beta(F.col("y"), F.col("x"), 15, 4), "fp": reg.frazzini_pedersen_beta(F.col("y"), F.col("x"), 15, 8)}).collect()
    seen = 0
    for r in out:
        i, t = r["instrument"], r["week_no"]
        rows = [known.get((i, u)) for u in range(t - 14, t + 1)]
        there = [v for v in rows if v is not None]
        mean = np.mean([v[3] for v in there])
        low = [(v[2], v[3]) for v in there if v[2] is not None and v[3] < mean]
        if len(low) < 4:
            assert r["down"] is None
        else:
            y, m = np.array(low).T
            assert r["down"] == pytest.approx(((y - y.mean()) * (m - m.mean())).sum() / ((m - m.mean()) ** 2).sum(), rel=1e-9)
        la = {u: np.log1p(known[i, u][2]) for u in range(t - 16, t + 1) if (i, u) in known and known[i, u][2] is not None}
        lb = {u: np.log1p(known[i, u][3]) for u in range(t - 16, t + 1) if (i, u) in known}
        one = [u for u in la if u >= t - 14]
        three = [u for u in range(t - 14, t + 1) if all(u - j in la and u - j in lb for j in range(3))]
        if len(one) < 8 or len(three) < 8:
            assert r["fp"] is None
            continue
        seen += 1
        a3, b3 = ([sum(v[u - j] for j in range(3)) for u in three] for v in (la, lb))
        ratio = np.std([la[u] for u in one], ddof=1) / np.std([lb[u] for u in one], ddof=1)
        assert r["fp"] == pytest.approx(np.corrcoef(a3, b3)[0, 1] * ratio, rel=1e-7)
    assert seen > 10


def cross(spark, n=80, weeks=4, groups=5):
    rows = []
    for t in range(weeks):
        for i in range(n):
            g = None if i % 17 == 3 else int(RNG.integers(0, groups if t else 2))
            a, b = RNG.normal(), RNG.normal()
            rows.append((i, t, None if i % 13 == 5 else RNG.normal() + a, a, (3 * a if t == 2 else float("nan") if i % 19 == 2 else b), g, i % 3 > 0, 5.0 + i if i % 11 else -1.0))
    return spark.createDataFrame(rows, "instrument int, week_no int, y double, a double, b double, g int, member boolean, w double"), rows


def test_fits_are_weighted_least_squares_of_least_norm(spark):
    df, rows = cross(spark)
    got = {r["week_no"]: r for r in least_squares.fits(df.repartition(6), F.col("y"), F.array(F.lit(1.0), F.col("a"), F.col("b")), F.col("w")).collect()}
    assert set(got) == {0, 1, 2, 3}
    for t in got:
        own = [r for r in rows if r[1] == t and r[2] is not None and r[4] is not None and not np.isnan(r[4]) and r[7] > 0]
        root = np.sqrt([r[7] for r in own])
        d, y = np.array([[1.0, r[3], r[4]] for r in own]), np.array([r[2] for r in own])
        assert got[t]["n"] == len(own)
        assert np.allclose(got[t]["beta"], np.linalg.lstsq(d * root[:, None], y * root, rcond=1e-9)[0], atol=1e-8)


@pytest.mark.parametrize("group", [None, "g"])
def test_cross_fit(spark, group):
    df, rows = cross(spark)
    df = df.withColumnRenamed("member", "fit_work_use")
    out = least_squares.cross_fit(df, "y", ["a", "b"], group=group, member=F.col("fit_work_use"), least=30, spare=10)
    assert out.columns[:8] == df.columns
    got = {(r["week_no"], r["instrument"]): r for r in out.collect()}
    assert len(got) == len(rows)
    for t in range(4):
        own = [r for r in rows if r[1] == t and r[2] is not None and not np.isnan(r[4]) and r[6] and (group is None or r[5] is not None)]
        codes = sorted({r[5] for r in own})[1:] if group else []
        d = np.array([[1.0, r[3], r[4], *[float(r[5] == c) for c in codes]] for r in own])
        beta = np.linalg.lstsq(d, np.array([r[2] for r in own]), rcond=1e-9)[0]
        for r in [r for r in rows if r[1] == t]:
            mine = got[t, r[0]]
            assert [mine["fit_b0"], mine["fit_b1"], mine["fit_b2"]] == pytest.approx(beta[:3], abs=1e-8)
            if r in own:
                assert mine["fit_residual"] == pytest.approx(r[2] - np.array([1.0, r[3], r[4], *[float(r[5] == c) for c in codes]]) @ beta, abs=1e-8)
            else:
                assert mine["fit_residual"] is None
    none = least_squares.cross_fit(df, "y", ["a", "b"], group=group, least=200)
    assert none.where("fit_b0 is not null or fit_residual is not null").count() == 0 and none.count() == len(rows)
    assert least_squares.cross_fit(df.where("false"), "y", ["a"], group=group).count() == 0


def test_libraries_of_kernels(spark):
    df, known = panel(spark, kind="ordinary")
    library = kernels.Library()

    @library.add("total", kernels.SERIES, ["y"])
    def total(columns, at):
        return {"total": np.cumsum(np.nan_to_num(columns["y"]))}

    @library.add("age", kernels.SERIES, {"v": F.col("y") * 2}, ["age", "twice"])
    def age(columns, at):
        return {"age": at - at[0], "twice": columns["v"]}

    @library.add("apart", kernels.CROSS, ["total"], ["apart"])
    def apart(columns, instruments):
        return {"apart": columns["total"] - columns["total"].mean() if len(instruments) > 1 else np.full(1, np.inf)}

    with pytest.raises(ValueError):
        library.add("age", kernels.SERIES, ["y"])
    with pytest.raises(KeyError):
        library.build(df, ["nothing"])
    with pytest.raises(ValueError):
        library.build(df.withColumn("AGE", F.lit(1)))
    assert library.names() == ["age", "apart", "total"]
    out = library.build(df)
    assert out.columns == [*df.columns, "total", "age", "twice", "apart"]
    got = out.collect()
    totals, first = {}, {}
    for i, t in sorted(known):
        totals[i, t] = totals.get((i, "now"), 0.0) + (known[i, t][2] or 0.0)
        totals[i, "now"] = totals[i, t]
        first.setdefault(i, t)
    for r in got:
        i, t = r["instrument"], r["week_no"]
        day = [totals[k] for k in totals if k[1] == t]
        assert r["total"] == pytest.approx(totals[i, t]) and r["age"] == t - first[i] and (r["twice"] is None) == (known[i, t][2] is None)
        assert r["apart"] is None if len(day) == 1 else r["apart"] == pytest.approx(totals[i, t] - np.mean(day), abs=1e-12)
    assert library.build(df.where("false")).count() == 0
