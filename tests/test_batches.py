"""Windows in Arrow batches: groups cut over batches, ordinals with gaps, and the work that a plan of many windows takes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factorloom.operators import batches
from factorloom.operators import series as ts
from factorloom.plans.formulas import _query


def test_groups_over_batches():
    keys = [1, 1, 2, 2, 2, 2, 2, None, None, 3, 4, 4]
    table = pa.table({"k": pa.array(keys, pa.int64()), "v": range(12)})
    for size in (1, 2, 3, 5, 12):
        told = [t["k"].to_pylist() for t in batches.whole(table.to_batches(max_chunksize=size), "k")]
        assert sum(told, []) == keys
        assert all(a[-1] != b[0] for a, b in zip(told, told[1:], strict=False))


def test_like_spark_windows(spark):
    draw = np.random.default_rng(2)
    rows = [(k, w, None if draw.random() < 0.1 else float(draw.integers(1, 5)), float(draw.integers(1, 5))) for k in range(30) for w in range(k, 60) if k % 3 or draw.random() > 0.2]
    df = spark.createDataFrame(rows, "instrument int, week_no int, x double, y double")
    x, y = F.col("x"), F.col("y")
    pairs = {
        "lag": (lambda g, a, b: batches.delay(g, a, 3), ts.delay(x, 3)),
        "total": (lambda g, a, b: batches.weighted(g, a, [1.0] * 4), ts.ts_sum(x, 4)),
        "least": (lambda g, a, b: batches.extreme(g, a, 5, True), ts.ts_min(x, 5)),
        "sd": (lambda g, a, b: batches.deviation(g, b, 5), ts.stddev(y, 5)),
        "cov": (lambda g, a, b: batches.covariance(g, a, b, 4), ts.covariance(x, y, 4)),
        "place": (lambda g, a, b: batches.place_in_window(g, a, 4), ts.ts_rank(x, 4)),
        "top": (lambda g, a, b: batches.first_place(g, a, 4, False), ts.argmax(x, 4).cast("double")),
    }
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = batches.stage(df, "instrument", "week_no", {n: (f, ["x", "y"]) for n, (f, _) in pairs.items()}).orderBy("instrument", "week_no").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = df.select("instrument", "week_no", *[c.alias(n) for n, (_, c) in pairs.items()]).orderBy("instrument", "week_no").toPandas()
    for n in pairs:
        np.testing.assert_array_equal(got[n].to_numpy(float), want[n].to_numpy(float), err_msg=n)


def test_one_sort_for_a_stage(spark, sf_dir):
    """A level is one shuffle and one sort: before, each rank sorted whole rows twice, and each row of a window folded its frame anew in the JVM."""
    plan = _query([33, 34, 35, 36, 37, 38, 39, 40])(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1  # of the dense bars
    assert plan.count("MapInArrow") == 6


def test_rolling_factors_in_one_stage(spark, sf_dir):
    """Quantiles and fits of rows with gaps as Spark's windows have them, in one stage; before, every row folded some forty frames in the JVM."""
    from factorloom.plans import price_volume as pv

    draw = np.random.default_rng(4)
    df = spark.createDataFrame([(k, w, float(draw.integers(2, 9))) for k in range(6) for w in range(40) if draw.random() > 0.1], "instrument int, week_no int, close double")
    made = {n: v for n, v in pv._stage(5).items() if n in ("w_upper", "w_lower", "w_slope", "w_lag")}
    got = batches.stage(df, "instrument", "week_no", made).orderBy("instrument", "week_no").toPandas()
    c = F.col("close")
    want = df.select("instrument", "week_no", ts.quantile(c, 0.8, 5).alias("w_upper"), ts.quantile(c, 0.2, 5).alias("w_lower"), ts.slope(c, 5).alias("w_slope"), ts.delay(c, 5).alias("w_lag")).orderBy("instrument", "week_no").toPandas()
    for n in made:
        np.testing.assert_allclose(got[n].to_numpy(float), want[n].to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=n)
    plan = pv.QUERIES["a158_rolling_20"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("collect_list") == 0


def test_stages_like_one_after_the_other(spark):
    """Blocks of few rows, short pieces, gaps, and missing keys and values: what stages in blocks make is what they make row by row."""
    draw = np.random.default_rng(8)
    rows = [(k if k < 38 else None, w, float(draw.integers(1, 9)) / 3 if draw.random() > 0.1 else None, k % 3, f"n{k}") for k in range(39) for w in [*range(k % 7, 25), None] if w is not None or k % 5 == 0 if draw.random() > 0.1]
    df = spark.createDataFrame(rows, "instrument int, week_no int, x double, part int, label string").repartition(5)
    total, rank = (lambda g, a: batches.weighted(g, a, [1.0] * 3)), (lambda g, a: g.each(batches.rank_present, a))
    parts = [
        batches.Part(True, {"a": (total, ["x"]), "b": (lambda g, a: a * 2, ["a"])}, None, frozenset(["b"]), frozenset(["a"])),
        batches.Part(True, {"c": (lambda g, a: batches.delay(g, a, 2), ["b"])}),
        batches.Part(False, {"d": (rank, ["c"]), "e": (lambda g, a: g.each(batches.mean_present, a), ["x"])}),
        batches.Part(False, {"f": (rank, ["e"])}, frozenset(["instrument", "week_no", "label", "b", "d", "e", "part"])),
        batches.Part(True, {"h": (total, ["d"])}, frozenset(["instrument", "week_no", "label", "part", "d", "e", "h"])),
    ]
    for some in (parts, parts[:3], [batches.Part(False, {"d": (rank, ["x"])}), batches.Part(True, {"h": (total, ["d"])})]):
        want = df
        for p in some:
            want = batches.stage(want, *(("instrument", "week_no") if p.along else ("week_no", "instrument")), p.runs, p.keep, False, p.infinite, p.inner)
        for size in (1, 40, 10**6):
            got = batches.stages(df, "instrument", "week_no", some, size=size)
            assert got.dtypes == want.dtypes
            assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == len(rows)
    assert batches.stages(df.where("false"), "instrument", "week_no", parts).count() == 0


def test_pieces_are_bounded():
    table = pa.table({"k": pa.array([1] * (batches.PIECE + 5) + [None, None], pa.int32()), "v": np.arange(batches.PIECE + 7.0)})
    sent = list(batches._sent(table, "k"))
    assert sum((b["key"].to_pylist() for b in sent), []) == [1, 1, None]
    assert [t.to_pydict() for t in batches._gathered(sent)] == [table.slice(0, batches.PIECE + 5).to_pydict(), table.slice(batches.PIECE + 5).to_pydict()]


def test_turns_shuffle_pieces(spark, sf_dir):
    """Before, every turn made all rows anew, and every level passed them to Python one by one."""
    plan = _query([41, 42, 43, 44, 45, 46, 47, 48])(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [key") == plan.count("RepartitionByExpression") == 2


def test_bars_sort_once(spark, sf_dir):
    """Line items are dealt by instrument and sorted by instrument and week, which later windows need anyway; before, partial sums were sorted before and after a shuffle by instrument and week."""
    from factorloom.sources.bars import bars

    plan = bars(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(instrument") == plan.count("Sort [instrument") == 1
    assert plan.count("REBALANCE_PARTITIONS_BY_COL") == 1


def test_long_rows_of_stages_share_a_process(spark, sf_dir):
    """Before, each of five stages in a row had a process with a block of its own in every task, which took more memory than an executor of 10 GB has at 1 GB of tables."""
    from factorloom.plans.formulas_191 import QUERIES

    plan = QUERIES["a191_113_120"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 4
    draw = np.random.default_rng(9)
    df = spark.createDataFrame([(k, w, float(draw.integers(1, 9)) / 3 if draw.random() > 0.1 else None) for k in range(20) for w in range(k % 7, 25)], "instrument int, week_no int, x double")
    total, over, rank = (lambda g, a: batches.weighted(g, a, [1.0] * 2)), (lambda g, a: a / 0), (lambda g, a: g.each(batches.rank_present, a))
    rows = [
        batches.Part(True, {"a": (total, ["x"]), "b": (over, ["a"])}, None, frozenset(["b"]), frozenset(["a"])),
        batches.Part(True, {"c": (total, ["b"]), "d": (total, ["x"])}, frozenset(["x", "c", "d"])),
        batches.Part(True, {"e": (total, ["d"])}),
        batches.Part(True, {"f": (total, ["e"]), "h": (total, ["x"])}, frozenset(["instrument", "week_no", "c", "e", "f", "h"])),
    ]
    across = [batches.Part(False, {f"r{k}": (rank, [c])}) for k, c in enumerate(["c", "e", "f", "h"])]
    for some in (rows, [*rows, *across], [*rows, *across, batches.Part(True, {"z": (total, ["r3"])}, frozenset(["instrument", "week_no", "r0", "z"]))]):
        want = df
        for p in some:
            keep = p.keep if p.keep is None else p.keep | {"instrument", "week_no"}
            want = batches.stage(want, *(("instrument", "week_no") if p.along else ("week_no", "instrument")), p.runs, keep, False, p.infinite, p.inner)
        got = batches.stages(df, "instrument", "week_no", some, size=40)
        assert got.dtypes == want.dtypes
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == df.count()
        assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == sum(1 for k, p in enumerate(some) if k == 0 or p.along != some[k - 1].along)


def test_shuffled_pieces_are_short():
    """Before, pieces were plain Arrow bytes: the shuffle's compression finds little in them, and 6 GB of tables filled the disks."""
    draw = np.random.default_rng(3)
    x = np.where(draw.random(3000) < 0.1, np.nan, draw.integers(1, 400, 3000) / 7)
    same, odd = draw.random(3000), np.where(np.arange(3000) % 3 == 0, [np.nan, -0.0, np.inf] * 1000, 0.5)
    table = pa.table({"k": np.arange(3000) // 1000, "rank": batches.rank_present(np.where(np.isnan(x), x, draw.random(3000))), "x": x, "same": same, "again": same, "odd": odd, "some": pa.array([None, *x[1:]], pa.float64())})
    sent = list(batches._sent(table, "k", packed=True, date=True))
    got = pa.concat_tables(batches._gathered(sent, packed=True))
    assert got.schema == table.schema and got["some"].null_count == 1
    for c in table.column_names:
        np.testing.assert_array_equal(got[c].fill_null(7).to_numpy().view(np.int64), table[c].fill_null(7).to_numpy().view(np.int64), err_msg=c)
    size = lambda table, **how: sum(len(p) for b in batches._sent(table, "k", **how) for p in b["piece"].to_pylist())
    assert size(table, packed=True) < 0.7 * size(table)
    ranks = table.select(["k", "rank"])
    assert size(ranks, packed=True, date=True) < 0.5 * size(ranks, packed=True)
    assert batches._counted(np.full(3, np.nan)) is None and batches._counted(np.array([0.0, 0.5])) is None and batches._counted(np.array([np.inf, 0.5])) is None
