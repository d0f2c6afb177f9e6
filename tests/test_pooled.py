"""Tail statistics of pooled rows against numpy, whatever the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import pooled


@pytest.mark.parametrize("block", [0, 5, 7, 1000])
def test_tail_index(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, t, None if i == t % 9 else float("inf") if i == 30 else round(rng.normal() + (2.5 if 40 < t < 46 else 0.0), 1)) for t in range(-6, 60) if t not in (11, 12) for i in range(31 if t < 20 else 8)] + [(1, None, 1.0)]
    df = spark.createDataFrame(rows, "instrument int, week_no int, r double").withColumn("block", F.lit("own"))
    got = {r["week_no"]: r for r in pooled.tail_index(df.repartition(6), F.col("r"), 5, 0.05, 30, since=-6, block=block).collect()}
    assert set(got) == {r[1] for r in rows if r[1] is not None}
    some = 0
    for t, r in got.items():
        pool = np.array([v for _, u, v in rows if u is not None and t - 5 < u <= t and v is not None and np.isfinite(v)])
        q = np.quantile(pool, 0.05)
        below = pool[pool < q]
        assert r["n"] == len(pool) and r["threshold"] == pytest.approx(q, abs=1e-12)
        if len(pool) < 30 or q >= 0 or not len(below) or t < -2:
            assert r["tail"] is None
        else:
            some += 1
            assert r["tail"] == pytest.approx(np.log(below / q).mean(), rel=1e-12)
    assert 30 < some < len(got)


def test_pools_of_nothing(spark):
    none = spark.createDataFrame([], "instrument int, week_no int, r double")
    assert pooled.tail_index(none, F.col("r")).count() == 0
    flat = spark.createDataFrame([(i, 1, -1.0) for i in range(200)] + [(0, 2, None)], "instrument int, week_no int, r double")
    assert [(r["n"], r["threshold"], r["tail"]) for r in pooled.tail_index(flat, F.col("r")).orderBy("week_no").collect()] == [(200, -1.0, None)] * 2
    with pytest.raises(ValueError):
        pooled.tail_index(none, F.col("r"), 0)
