"""Regressions with decaying weights against numpy, over weeks around every bound that a calendar number may have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import cross_section as xs
from factorloom.operators import series as ts


@pytest.mark.parametrize("first", [985, 1985, 100_000, -15])
def test_decayed_fit(spark, first):
    rng = np.random.default_rng(3)
    rows = [(1, first + t, 50 + rng.normal(), None if t % 11 == 4 else 1e3 + rng.normal()) for t in range(31) if t not in (3, 17)]
    rows += [(2, first + t, 1.0, 2.0) for t in range(12)]  # flat
    df = spark.createDataFrame(rows, "instrument int, week_no int, x double, y double")
    b, a = ts.decayed_fit(F.col("y"), F.col("x"), 12, 0.9, 6)
    for r in df.select("instrument", "week_no", b.alias("b"), a.alias("a")).collect():
        own = [(v[1], v[2], v[3]) for v in rows if v[0] == r["instrument"] and r["week_no"] - 12 < v[1] <= r["week_no"] and v[3] is not None]
        if len(own) < 6 or r["instrument"] == 2:
            assert r["b"] is None and r["a"] is None
            continue
        t, x, y = np.array(own).T
        w = 0.9 ** (r["week_no"] - t)
        d = np.column_stack([np.ones(len(x)), x - 50]) * np.sqrt(w)[:, None]
        c = np.linalg.lstsq(d, y * np.sqrt(w), rcond=None)[0]
        assert r["b"] == pytest.approx(c[1], rel=1e-8) and r["a"] == pytest.approx(c[0] - 50 * c[1], rel=1e-8)


def test_correlation_of_flat_and_single_rows_is_missing(spark):
    rows = [(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 1.0), (3, None, 1.0), (4, 1.0, 2.0), (4, 2.0, 4.0), (4, 3.0, 5.0), (4, None, 9.0), (5, 0.1 + 0.2, 1.0), (5, 0.1 + 0.2, 2.0), (5, 0.1 + 0.2, 7.0)]
    df = spark.createDataFrame(rows, "week_no int, a double, b double")
    got = {r["week_no"]: r["c"] for r in df.groupBy("week_no").agg(xs.correlation(F.col("a"), F.col("b")).alias("c")).collect()}
    assert [got[k] for k in (1, 2, 3, 5)] == [None] * 4 and got[4] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 5])[0, 1])
