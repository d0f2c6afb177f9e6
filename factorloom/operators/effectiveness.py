"""How well factors told labels: correlations and returns by date, and their summary over all dates and by year, with staggered pockets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators import cross_section as xs

DATE = xs.DATE


def by_date(rows: DataFrame, holding: int, groups: int = 5, least: int = 20) -> DataFrame:
    """From rows (factor, DATE, x, label): correlations, mean labels of the highest and lowest of so many groups and of all, and the pocket, 1 to `holding`, by the date's position on the calendar of rows.

    Rows without x or label don't count, and a date has a line if at least `least` do. A flat date has no correlation. Positions
    are given in one task, one row a date; a date's rows meet only through its ranks.
    """
    usable = rows.where("x is not null and label is not null and not isnan(x) and not isnan(label)")
    dates = rows.select(DATE).distinct().withColumn("pocket", F.pmod(F.row_number().over(Window.orderBy(DATE)) - 1, F.lit(holding)) + 1)
    each = Window.partitionBy("factor", DATE)

    def share(c: str) -> Column:
        """The average rank over the number of rows, from two ranks."""
        n = F.count("*").over(each)
        return (F.rank().over(each.orderBy(F.col(c))) + n + 1 - F.rank().over(each.orderBy(F.col(c).desc()))) / 2 / n

    usable = usable.withColumns({"rx": share("x"), "rl": share("label")})
    part = F.greatest(F.lit(1), F.least(F.lit(groups), F.ceil(F.col("rx") * groups)))
    told = usable.groupBy("factor", DATE).agg(
        F.count("*").alias("n"),
        xs.correlation(F.col("x"), F.col("label")).alias("ic"),
        xs.correlation(F.col("rx"), F.col("rl")).alias("rank_ic"),
        F.avg(F.when(part == groups, F.col("label"))).alias("top_return"),
        F.avg("label").alias("benchmark_return"),
        F.avg(F.when(part == 1, F.col("label"))).alias("bottom_return"),
    )
    return told.where(F.col("n") >= least).join(dates, DATE)


def summary(daily: DataFrame, year: Column, holding: int, least: int) -> DataFrame:
    """Of by_date's lines: a line for each factor over all dates (year null) and for each of its years.

    Returns compound within a pocket and are averaged over pockets; dates without all three don't count. A side is effective if its
    excess is above 0; with fewer than `least` dates or without all pockets the sides are `insufficient_data`.
    """
    lines = daily.withColumns({"long": F.col("top_return") - F.col("benchmark_return"), "short": F.col("benchmark_return") - F.col("bottom_return")})
    lines = lines.withColumn("year", F.explode(F.array(F.lit(None).cast("int"), year.cast("int"))))
    paid = F.col("long").isNotNull() & F.col("short").isNotNull()

    def over_deviation(c: str) -> Column:
        return F.try_divide(F.avg(c), F.stddev_samp(c))

    keys = ["factor", "year"]
    base = lines.groupBy(*keys).agg(
        F.count("ic").alias("ic_dates"), F.avg("ic").alias("ic_mean"), over_deviation("ic").alias("icir"),
        F.count("rank_ic").alias("rank_ic_dates"), F.avg("rank_ic").alias("rank_ic_mean"), over_deviation("rank_ic").alias("rank_icir"),
        F.count(F.when(paid, 1)).alias("return_dates"),
        F.avg(F.when(paid, (F.col("long") > 0).cast("double"))).alias("long_positive"), F.avg(F.when(paid, (F.col("short") > 0).cast("double"))).alias("short_positive"),
    )
    names = ("top_return", "benchmark_return", "bottom_return")
    pockets = lines.where(paid).groupBy(*keys, "pocket").agg(*[(F.product(F.col(x) + 1) - 1).alias(x) for x in names])
    pockets = pockets.groupBy(*keys).agg(F.count("*").alias("pockets"), *[F.avg(x).alias(x) for x in names])
    out = base.alias("b").join(pockets.alias("p"), (F.col("b.factor") == F.col("p.factor")) & F.col("b.year").eqNullSafe(F.col("p.year")), "left")
    out = out.select("b.*", F.coalesce("p.pockets", F.lit(0)).alias("pockets"), *[f"p.{x}" for x in names])
    long, short = F.col("top_return") - F.col("benchmark_return"), F.col("benchmark_return") - F.col("bottom_return")
    out = out.withColumns({"long_excess": long, "short_excess": short, "long_short": F.col("top_return") - F.col("bottom_return")})
    short_of = (F.col("return_dates") < least) | (F.col("pockets") < holding)
    up, down = F.col("long_excess") > 0, F.col("short_excess") > 0
    side = F.when(short_of, "insufficient_data").when(up & down, "both").when(up, "long").when(down, "short").otherwise("neither")
    stronger = F.when(F.col("long_excess") > F.col("short_excess"), "long").when(F.col("short_excess") > F.col("long_excess"), "short").otherwise("equal")
    return out.withColumns({"side": side, "dominant": F.when(side == "both", stronger).otherwise(side)})
