"""Weekly bars of suppliers, from line items: the panel that factors are computed on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Parts of a number down to this step, and what is left of it.
STEP = 2.0**-10


def total(name: str) -> Column:
    """A sum that doesn't depend on the order in which partial sums arrive: multiples of STEP and what is left of the numbers add up without rounding, and are rounded once. So it is for numbers of 0.06 and more, some hundreds of them, and sums below 2 to the power of 43."""
    x = F.col(name)
    above = F.rint(x / STEP) * STEP
    return F.sum(above) + F.sum(x - above)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (instrument, week_no) with prices, volume, amount, sector and cap. Weeks count Mondays, so gaps stay visible.

    Line items are dealt and sorted by instrument once, so bars, the dimension tables' join and later windows along an instrument need no further shuffle or sort: a week
    has few line items of an instrument, so sums before the shuffle would sort all of them for little. A last bit of an amount settles whether later ranks
    tie, so amounts are the same in whatever order line items come: reruns and copies of an instrument agree.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    week = F.floor(F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-05")) / 7).cast("int")
    lines = read("lineitem").select(F.col("l_suppkey").alias("instrument"), week.alias("week_no"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").hint("rebalance", F.col("instrument"))
    lines = lines.withColumn("p", F.col("l_extendedprice") / F.col("l_quantity")).withColumn("at", F.struct("l_orderkey", "l_linenumber", "p"))
    out = lines.groupBy("instrument", "week_no").agg(
        F.min("at")["p"].alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max("at")["p"].alias("close"), total("l_quantity").alias("volume"), total("l_extendedprice").alias("amount")
    )
    where = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("instrument"), F.col("n_regionkey").alias("sector"), F.col("n_nationkey").alias("industry"), (F.col("s_acctbal") + 2000).alias("cap"))
    return out.join(where, "instrument").withColumn("vwap", F.col("amount") / F.col("volume"))


#: The same rows in DuckDB.
BARS_SQL = """
l AS (SELECT l_suppkey AS instrument, floor(date_diff('day', DATE '1970-01-05', l_shipdate::DATE) / 7)::INT AS week_no, l_extendedprice / l_quantity AS p, l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem),
b AS (SELECT instrument, week_no, min(row(l_orderkey, l_linenumber, p))[3] AS open, max(p) AS high, min(p) AS low, max(row(l_orderkey, l_linenumber, p))[3] AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM l GROUP BY ALL),
bars AS (SELECT b.*, n_regionkey AS sector, n_nationkey AS industry, s_acctbal + 2000 AS cap, amount / volume AS vwap FROM b JOIN supplier ON s_suppkey = instrument JOIN nation ON n_nationkey = s_nationkey)
"""


def dense(panel: DataFrame) -> DataFrame:
    """The panel without gaps between an instrument's first and last week: a week without a row carries the last close as all prices, with a volume of 1.

    A row repeats up to the next one's week, so no grid is made and nothing is joined; later windows of an instrument share the shuffle.
    """
    after = F.lead("week_no").over(Window.partitionBy("instrument").orderBy("week_no"))
    out = panel.withColumn("last_week", F.coalesce(after - 1, F.col("week_no"))).withColumn("week", F.explode(F.sequence("week_no", "last_week")))
    own = F.col("week") == F.col("week_no")
    kept = [F.when(own, F.col(x)).otherwise(F.col("close")).alias(x) for x in ("open", "high", "low", "close", "vwap", "amount")]
    return out.select("instrument", F.col("week").alias("week_no"), *kept, F.when(own, F.col("volume").cast("double")).otherwise(F.lit(1.0)).alias("volume"), "sector", "industry", "cap")


#: The dense rows in DuckDB, after BARS_SQL.
DENSE_SQL = """
n AS (SELECT *, lead(week_no) OVER (PARTITION BY instrument ORDER BY week_no) AS after FROM bars),
u AS (SELECT *, unnest(range(week_no, coalesce(after, week_no + 1))) AS week FROM n),
dense AS (SELECT instrument, week::INT AS week_no, sector, industry, cap::DOUBLE AS cap, CASE WHEN week = week_no THEN volume::DOUBLE ELSE 1.0 END AS volume,
  """ + ", ".join(f"(CASE WHEN week = week_no THEN {x} ELSE close END)::DOUBLE AS {x}" for x in ("open", "high", "low", "close", "vwap", "amount")) + """ FROM u)
"""


def gapped(panel: DataFrame) -> DataFrame:
    """The panel with a row for every week between an instrument's first and last; a week without a row has no prices, volume or amount."""
    after = F.lead("week_no").over(Window.partitionBy("instrument").orderBy("week_no"))
    out = panel.withColumn("last_week", F.coalesce(after - 1, F.col("week_no"))).withColumn("week", F.explode(F.sequence("week_no", "last_week")))
    told = [F.when(F.col("week") == F.col("week_no"), F.col(x).cast("double")).alias(x) for x in ("open", "high", "low", "close", "vwap", "amount", "volume")]
    return out.select("instrument", F.col("week").alias("week_no"), *told, "sector", "industry", "cap")


#: The same in DuckDB, after BARS_SQL.
GAPPED_SQL = """
n AS (SELECT *, lead(week_no) OVER (PARTITION BY instrument ORDER BY week_no) AS after FROM bars),
u AS (SELECT *, unnest(range(week_no, coalesce(after, week_no + 1))) AS week FROM n),
gapped AS (SELECT instrument, week::INT AS week_no, sector, industry, cap::DOUBLE AS cap, """ + ", ".join(f"(CASE WHEN week = week_no THEN {x} END)::DOUBLE AS {x}" for x in ("open", "high", "low", "close", "vwap", "amount", "volume")) + " FROM u)"
