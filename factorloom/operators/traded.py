"""Frames over an instrument's own traded rows, beside frames of the calendar: a suspension neither breaks a window nor shortens it.

Traded rows are numbered along their instrument, and that number takes the calendar ordinal's place while columns are made. Other
rows have no number: range frames keep rows without one apart from all others, so every operator of `series` runs as it is, and
results stand on their own calendar rows without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.names import free
from factorloom.operators.series import KEY, ORDER


def numbered(df: DataFrame, traded: Column) -> tuple[DataFrame, str]:
    """df with ORDER as the count of traded rows so far, null on rows that are not traded (also where that is unknown), and the name of the column that keeps the calendar ordinal. Rows of one ordinal are numbered in any order."""
    calendar = free(df, "calendar")
    so_far = F.count(F.when(traded, F.lit(1))).over(Window.partitionBy(KEY).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({calendar: F.col(ORDER), ORDER: F.when(traded, so_far)}), calendar


def over_traded(df: DataFrame, traded: Column, columns: dict[str, Column]) -> DataFrame:
    """df with columns of series operators whose windows are so many traded rows; missing on other rows."""
    out, calendar = numbered(df, traded)
    own = F.col(ORDER).isNotNull()
    out = out.withColumns({name: F.when(own, c) for name, c in columns.items()})
    return out.select(*[F.col(calendar).alias(ORDER) if c == ORDER else F.col(f"`{c}`") for c in out.columns if c != calendar])
