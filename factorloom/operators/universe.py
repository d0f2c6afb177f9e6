"""Which rows belong to a universe on their date: boards by code, names under special treatment, and fresh listings left out; members as spans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.series import KEY, ORDER

#: The code prefixes of boards that every account may trade, and the rows of a fresh listing that are left out.
BOARDS: dict[str, tuple[str, ...]] = {"main": ("SH60", "SZ00"), "sh_main": ("SH60",)}
FRESH = 60


def on_board(code: Column, prefixes: Iterable[str]) -> Column:
    told = F.lit(False)
    for x in prefixes:
        told = told | F.upper(code).startswith(x)
    return F.coalesce(told, F.lit(False))


def member(universe: str, code: Column, treated: Column, listed: Column, in_index: Column) -> Column:
    """Whether a row is inside: `all`, `index` (members of their date; unknown is outside), or a board's rows that are not under special treatment and listed for more than FRESH rows. On a board, an unknown treatment is an error, as history would be judged by guesses."""
    if universe == "all":
        return code.isNotNull()
    if universe == "index":
        return F.coalesce(in_index.cast("boolean"), F.lit(False))
    if universe not in BOARDS:
        raise ValueError(f"no universe named {universe!r}; there are all, index, {', '.join(BOARDS)}")
    known = F.when(treated.isNull(), F.raise_error(F.lit(f"the universe {universe} needs to know the special treatment of every row on its boards"))).otherwise(~treated.cast("boolean"))
    return F.when(on_board(code, BOARDS[universe]), F.coalesce(known & (listed > FRESH), F.lit(False))).otherwise(F.lit(False))


def spans(df: DataFrame, inside: Column) -> DataFrame:
    """KEY, first and last of each run of an instrument's rows that are inside. Calendar gaps don't end a run; a row outside does, also one of the same ordinal in any order."""
    along = Window.partitionBy(KEY).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(KEY, ORDER, F.coalesce(inside, F.lit(False)).alias("inside"))
    rows = rows.withColumn("breaks", F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(along)).where("inside")
    return rows.groupBy(KEY, "breaks").agg(F.min(ORDER).alias("first"), F.max(ORDER).alias("last")).drop("breaks")
