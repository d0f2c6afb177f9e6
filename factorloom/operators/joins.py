"""Joins along time, without range joins: a union of both sides and one window by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """left with the value of right's latest row at or before it, by key; null before the first. Of right rows of one key and time the greatest value counts. Rows without a time stay, without a value."""
    turn, told = "asof_turn", "asof_told"
    values = right.select(key, F.col(since).alias(at), F.struct(value).alias(told), F.lit(0).alias(turn))
    both = values.unionByName(left.withColumn(turn, F.lit(1)), allowMissingColumns=True)
    past = Window.partitionBy(key).orderBy(F.col(at).asc_nulls_last(), turn, F.col(told).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(told, F.when(F.col(at).isNotNull(), F.last(told, ignorenulls=True).over(past))).where(F.col(turn) == 1)
    return out.select(*left.columns, F.col(told)[value].alias(value))


def interval(left: DataFrame, spans: DataFrame, key: str, at: str, since: str, until: str, value: str) -> DataFrame:
    """left with the value of the last span that started at or before it, if that span has not ended; an open end is null."""
    both = spans.select(key, since, F.struct(F.col(since).alias("since"), F.col(until).alias("until"), F.col(value).alias("value")).alias("span"))
    out = asof_backward(left, both, key, at, since, "span")
    inside = F.col("span.until").isNull() | (F.col("span.until") >= F.col(at))
    return out.select(*left.columns, F.when(inside, F.col("span.value")).alias(value))


def collapse(df: DataFrame, key: str, at: str) -> DataFrame:
    """Rows of one key at consecutive ordinals become one span (key, since, until); repeated rows count once."""
    own = Window.partitionBy(key).orderBy(at)
    rows = df.select(key, at).withColumn("island", F.col(at) - F.dense_rank().over(own))
    return rows.groupBy(key, "island").agg(F.min(at).alias("since"), F.max(at).alias("until")).drop("island")


def newest_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the last in the given order."""
    own = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("newest", F.row_number().over(own)).where("newest = 1").drop("newest")
