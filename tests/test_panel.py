"""Panel queries against DuckDB, and locked operator examples."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from factorloom.functions import scalars
from factorloom.operators import series as ts
from factorloom.plans import registry
from factorloom.sources.bars import bars


@pytest.mark.parametrize("name", list(registry.queries()))
def test_like_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert got == sorted(map(str, want.select(*cols).fetchall()))


def test_locked_examples(spark):
    df = spark.createDataFrame([(1, k, x, None if k == 2 else x) for k, x in enumerate((1.0, 4.0, 7.0, 5.0))], "instrument int, week_no int, x double, hole double")
    rows = df.select("week_no", ts.wma(F.col("x"), 3).alias("wma"), ts.days_since_max(F.col("x"), 4).alias("high"), ts.slope(F.col("x"), 3).alias("slope"), ts.ts_sum(F.col("hole"), 2).alias("part")).orderBy("week_no").collect()
    assert rows[2]["wma"] == pytest.approx((7 + 0.9 * 4 + 0.81) / 2.71) and rows[3]["high"] == 1 and rows[2]["slope"] == pytest.approx(3)
    assert [r["part"] for r in rows] == [None, 5.0, None, None]


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 1.0), (float("inf"), 1.0)], "a double, b double")
    out = df.select(scalars.safe_div(F.col("a"), F.col("b")).alias("q"), scalars.indicator(F.col("a") > F.col("b")).alias("i"), scalars.select(F.col("a") > 0, F.col("b"), F.lit(-1.0)).alias("s")).collect()
    assert [tuple(r) for r in out] == [(None, 1.0, 0.0), (0.5, 0.0, 2.0), (None, 0.0, -1.0), (None, 1.0, 1.0)]


def test_amounts_do_not_depend_on_splits(spark, sf_dir, tmp_path):
    """Two suppliers with the same items; one's lie in one split of the file, the other's in two. Before, partial sums settled the last bit: 0.6000000000000001 and 0.6."""
    import shutil
    from datetime import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq

    for name in ("supplier", "nation"):
        shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path)
    own = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").collect())[:2]
    pad = 5000
    suppliers = [own[0]] * 3 + [own[1]] + [-1] * pad + [own[1]] * 2
    prices = [0.1, 0.2, 0.3, 0.1, *[1.0] * pad, 0.2, 0.3]
    n = len(prices)
    table = pa.table({"l_orderkey": pa.array(range(n), pa.int64()), "l_linenumber": pa.array([1] * n, pa.int32()), "l_suppkey": pa.array(suppliers, pa.int64()), "l_quantity": [1.0] * n, "l_extendedprice": prices, "l_shipdate": pa.array([datetime(2001, 1, 3)] * n, pa.timestamp("us"))})
    pq.write_table(table, f"{tmp_path}/lineitem.parquet", row_group_size=4, use_dictionary=False, compression="none")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = {r.instrument: r.amount for r in bars(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {own[0]: 0.6, own[1]: 0.6}
