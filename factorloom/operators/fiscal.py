"""Fiscal quarters: what was first reported, a dense grid of quarters with the day each becomes usable, and values built on it.

Frames are ranges of the quarter's number (4 a year), so a missing quarter leaves a gap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, QUARTER = "code", "quarter"


def _frame(d: int, until: int = 0):
    return Window.partitionBy(KEY).orderBy(QUARTER).rangeBetween(-(d - 1) - until, -until)


def first_reported(df: DataFrame) -> DataFrame:
    """Of rows (code, quarter, available, corrected, ..): for each quarter the earliest available one, the corrected one on ties."""
    own = Window.partitionBy(KEY, QUARTER).orderBy("available", F.col("corrected").desc())
    return df.withColumn("report_no", F.row_number().over(own)).where("report_no = 1").drop("report_no")


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two statements of a quarter; usable once both that exist are out."""
    both = left.withColumnRenamed("available", "one").join(right.withColumnRenamed("available", "two"), [KEY, QUARTER], "full_outer")
    return both.withColumn("available", F.greatest("one", "two")).drop("one", "two")


def grid(df: DataFrame) -> DataFrame:
    """A row for every quarter from a code's first to its last, with usable: the latest availability up to it, so that no quarter is used before an earlier one."""
    ends = df.groupBy(KEY).agg(F.min(QUARTER).alias("q0"), F.max(QUARTER).alias("q1"))
    dense = ends.select(KEY, F.explode(F.sequence("q0", "q1")).alias(QUARTER)).join(df, [KEY, QUARTER], "left")
    past = Window.partitionBy(KEY).orderBy(QUARTER).rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumn("usable", F.max("available").over(past))


def lag(x: Column, n: int) -> Column:
    return F.max(x).over(_frame(1, n))


def single(ytd: Column) -> Column:
    """The quarter's own amount, from the sum since the year's start."""
    return F.when(F.pmod(F.col(QUARTER), F.lit(4)) == 0, ytd).otherwise(ytd - lag(ytd, 1))


def full(d: int, value: Callable[[], Column], x: Column, until: int = 0) -> Column:
    return F.when(F.count(x).over(_frame(d, until)) == d, value().over(_frame(d, until)))


def ttm(x: Column) -> Column:
    """The sum of the last four quarters, all needed."""
    return full(4, lambda: F.sum(x), x)


def annual(x: Column) -> Column:
    """The fourth quarter's values only."""
    return F.when(F.pmod(F.col(QUARTER), F.lit(4)) == 3, x)


def zero_filled(x: Column, anchor: Column) -> Column:
    """A blank line is 0 once the statement, told by its anchor line, exists."""
    return F.when(anchor.isNotNull(), F.coalesce(x, F.lit(0.0)))


def surprise(change: Column, d: int = 8) -> Column:
    """A change less the mean of the d changes before, over their deviation."""
    return F.try_divide(change - full(d, lambda: F.avg(change), change, 1), full(d, lambda: F.stddev_samp(change), change, 1))


def yearly_mean(x: Column, years: int, least: int) -> Column:
    """The mean of the values at lags of 0, 4, 8 .. quarters, if at least so many are there."""
    w = Window.partitionBy(KEY, F.pmod(F.col(QUARTER), F.lit(4))).orderBy(QUARTER).rangeBetween(-4 * (years - 1), 0)
    return F.when(F.count(x).over(w) >= least, F.avg(x).over(w))


def yearly_slope(x: Column, years: int, least: int) -> Column:
    """The least-squares slope on the years over the mean of absolute values."""
    w = Window.partitionBy(KEY, F.pmod(F.col(QUARTER), F.lit(4))).orderBy(QUARTER).rangeBetween(-4 * (years - 1), 0)
    return F.when(F.count(x).over(w) >= least, F.try_divide(F.regr_slope(x, F.col(QUARTER) / 4).over(w), F.avg(F.abs(x)).over(w)))


def published(days: DataFrame, quarters: DataFrame, at: str, *values: str) -> DataFrame:
    """Days (code, at) with the values of the latest quarter that is usable on that day; days before the first have none."""
    newest = quarters.where("usable is not null").groupBy(KEY, F.col("usable").alias(at)).agg(F.max(F.struct(QUARTER, *values)).alias("fiscal_told")).withColumn("fiscal_turn", F.lit(0))
    both = newest.unionByName(days.select(KEY, at).withColumn("fiscal_turn", F.lit(1)), allowMissingColumns=True)
    past = Window.partitionBy(KEY).orderBy(at, "fiscal_turn").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("fiscal_told", F.max("fiscal_told").over(past)).where("fiscal_turn = 1")
    return out.select(KEY, at, F.col(f"fiscal_told.{QUARTER}").alias(QUARTER), *[F.col(f"fiscal_told.{v}").alias(v) for v in values])
