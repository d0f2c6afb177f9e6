"""Row rules, trailing windows, recursions and quarters on rows with gaps, nulls and ties, and on empty tables."""

import math

from pyspark.sql import functions as F

from factorloom.functions import scalars as row
from factorloom.operators import fiscal, recursive
from factorloom.operators import series as ts

BARS = "instrument long, week_no int, close double"


def test_row_rules(spark):
    df = spark.createDataFrame([(1, -4.0, 2.0), (2, None, 2.0), (3, 9.0, None), (4, None, None)], "id int, a double, b double")
    a, b = F.col("a"), F.col("b")
    got = {r[0]: tuple(r)[1:] for r in df.select("id", row.told(a > b), row.mean_present(1, a, b), row.root(a), row.log(a), row.power(a, 0.5), row.growth(a, b), row.set_inf(a, 7.0)).collect()}
    assert got == {1: (False, -1.0, None, None, None, -3.0, -4.0), 2: (False, 2.0, None, None, None, None, 7.0), 3: (False, 9.0, 3.0, math.log(9), 3.0, None, 9.0), 4: (False, None, None, None, None, None, 7.0)}


def test_snap_ties(spark):
    x = 0.1 + 0.2
    r = spark.createDataFrame([(x, 0.3, 1e-13, None)], "x double, y double, z double, n double").select(*[row.snap(F.col(c)) for c in "xyzn"]).head()
    assert x != 0.3 and r[0] == r[1] and r[2] == 0.0 and r[3] is None


def test_windows_over_gaps_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, None), (1, 4, 3.0), (1, 5, 3.0), (2, 1, None)], BARS)
    out = df.select("instrument", "week_no", ts.ffill(F.col("close")), ts.trailing(F.col("close"), 4, 2, F.sum), ts.trailing_moment(F.col("close"), 2, 2, 3)).orderBy("instrument", "week_no").collect()
    assert [tuple(r)[2:] for r in out] == [(1.0, None, None), (1.0, None, None), (3.0, 4.0, None), (3.0, 6.0, None), (None, None, None)]
    assert df.where("false").select(ts.ffill(F.col("close"))).count() == 0


def test_ema_loses_weight_over_gaps(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 4.0), (1, 5, 2.0)], BARS)
    got = [r["value"] for r in recursive.along(df, ["close"], recursive.ema(0.5)).orderBy("week_no").collect()]
    assert got == [1.0, 2.5, (0.125 * 2.5 + 0.5 * 2.0) / 0.625]
    assert recursive.along(df.where("false"), ["close"], recursive.ema(0.5)).count() == 0


def test_quarters(spark):
    rows = [(1, 8, 10.0, 5, 0), (1, 8, 11.0, 5, 1), (1, 8, 99.0, 9, 1), (1, 10, 30.0, 4, 0), (1, 11, 50.0, 20, 0)]
    df = spark.createDataFrame(rows, "code long, quarter int, ytd double, available int, corrected int")
    grid = fiscal.grid(fiscal.first_reported(df))
    out = grid.select("quarter", "ytd", "usable", fiscal.single(F.col("ytd"))).orderBy("quarter").collect()
    assert [tuple(r) for r in out] == [(8, 11.0, 5, 11.0), (9, None, 5, None), (10, 30.0, 5, None), (11, 50.0, 20, 20.0)]
    assert fiscal.grid(fiscal.first_reported(df.where("false"))).count() == 0
