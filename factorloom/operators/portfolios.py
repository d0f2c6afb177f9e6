"""Factor returns from sorted portfolios that are formed at period starts and held: size by value, and size by abnormal turnover.

Membership is formed from the state of the last date before a period, carried through the period by a join on it, and weighted by the caps of
the date before each return. History that membership needs (dates traded, turnover) comes from windows along instruments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.cross_section import DATE
from factorloom.operators.series import KEY


@dataclass(frozen=True)
class Rules:
    """Dates are calendar ordinals. shell: the smallest part by cap, left out before other filters; year, short: the long and the short history in dates; year_least, period_least: dates traded in the long history and in the period before, the latter scaled by period_share in short periods."""

    shell: float = 0.3
    year: int = 250
    year_least: int = 120
    period_least: int = 15
    period_share: float = 0.75
    short: int = 20
    seasoned: int = 183
    least: int = 100


def membership(df: DataFrame, period: Column, *, cap: str, value: str, turnover: str, age: str, allowed: Column | None = None, rules: Rules = Rules()) -> DataFrame:
    """Rows (period, instrument, size, worth, mood) formed from each period's last date, for the period that comes next among those there are.

    size is S up to the median cap and B above; worth is G (low), M or V by value at the 30th and 70th percentile, missing or not positive values lowest; mood is P
    (low), M or O by the mean turnover of the short history over that of the long one, missing where that is, and for everyone if fewer than least have it. Only dates with a row count
    as traded. Periods with fewer than least members have none.
    """
    r = rules
    own = Window.partitionBy(KEY).orderBy(DATE)
    long, short = own.rangeBetween(-(r.year - 1), 0), own.rangeBetween(-(r.short - 1), 0)
    rows = df.select(KEY, DATE, period.alias("period"), F.col(cap).cast("double").alias("cap"), F.col(value).cast("double").alias("value"), F.col(turnover).cast("double").alias("turnover"), F.col(age).cast("double").alias("age"), (F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))).alias("allowed"))
    rows = rows.withColumns({"in_year": F.count("*").over(long), "in_period": F.count("*").over(Window.partitionBy(KEY, "period")), "mood": F.try_divide(F.avg("turnover").over(short), F.avg("turnover").over(long))})
    dates = rows.groupBy("period").agg(F.max(DATE).alias("last"), F.countDistinct(DATE).alias("open")).withColumn("after", F.lead("period").over(Window.orderBy("period")))  # one row a period
    last = rows.join(dates.where("after is not null").select("period", F.col("last").alias(DATE), "open", "after"), ["period", DATE]).where(F.col("allowed") & (F.col("cap") > 0))
    all_ = Window.partitionBy("after")
    last = last.withColumn("edge", F.percentile("cap", F.lit(r.shell)).over(all_)).where("cap > edge")
    need = F.least(F.lit(r.period_least), F.ceil(F.col("open") * r.period_share))
    last = last.where((F.col("age") >= r.seasoned) & (F.col("in_year") >= r.year_least) & (F.col("in_period") >= need))
    last = last.withColumns({"n": F.count("*").over(all_), "moods": F.count("mood").over(all_), "worth": F.when(F.col("value") > 0, F.col("value")).otherwise(F.lit(-1.0))}).where(F.col("n") >= r.least)
    cuts = {"mid": F.percentile("cap", F.lit(0.5)), "worth_cut": F.percentile("worth", F.array(F.lit(0.3), F.lit(0.7))), "mood_cut": F.percentile("mood", F.array(F.lit(0.3), F.lit(0.7)))}
    last = last.withColumns({k: v.over(all_) for k, v in cuts.items()})
    three = lambda x, low, high: F.when(F.col(x) <= F.col(f"{x}_cut")[0], F.lit(low)).when(F.col(x) > F.col(f"{x}_cut")[1], F.lit(high)).otherwise(F.lit("M"))
    mood = F.when(F.col("mood").isNotNull() & (F.col("moods") >= r.least), three("mood", "P", "O"))
    return last.select(F.col("after").alias("period"), KEY, F.when(F.col("cap") <= F.col("mid"), "S").otherwise("B").alias("size"), three("worth", "G", "V").alias("worth"), mood.alias("mood"))


def factor_returns(df: DataFrame, period: Column, members: DataFrame, *, ret: str, cap: str, rules: Rules = Rules()) -> DataFrame:
    """Rows (date, n, mkt, smb, vmg, pmo, smb4): cap-weighted returns of the members with a return and a positive cap on the date before, and the differences of sorted portfolios.

    smb and vmg come from size by worth, pmo from size by mood, smb4 is the mean of both sorts' smb. A portfolio without members makes what it enters missing, and so does a date with fewer than least. One shuffle by date after membership joins; portfolios add up map-side.
    """
    dates = df.select(DATE).distinct().withColumn("next_date", F.lead(DATE).over(Window.orderBy(DATE)))  # one row a date
    before = df.join(dates, DATE).where("next_date is not null").select(KEY, F.col("next_date").alias(DATE), F.col(cap).cast("double").alias("w"))
    rows = df.select(KEY, DATE, period.alias("period"), F.col(ret).cast("double").alias("r")).join(before, [KEY, DATE]).join(members, ["period", KEY])
    rows = rows.where("w > 0 and r is not null and not isnan(r)")
    cell = lambda use: F.try_divide(F.sum(F.when(use, F.col("r") * F.col("w"))), F.sum(F.when(use, F.col("w"))))
    cells = {f"{s}{g}_{of}": cell((F.col("size") == s) & (F.col(of) == g)) for of, kinds in (("worth", "VMG"), ("mood", "POM")) for s in "SB" for g in kinds}
    out = rows.groupBy(DATE).agg(F.count("*").alias("n"), cell(F.lit(True)).alias("mkt"), *[v.alias(k) for k, v in cells.items()])
    c = lambda x: F.when(F.col("n") >= rules.least, F.col(x))
    smb = lambda of, kinds: (sum(c(f"S{g}_{of}") for g in kinds) - sum(c(f"B{g}_{of}") for g in kinds)) / 3
    spread = lambda of, a, b: (c(f"S{a}_{of}") + c(f"B{a}_{of}") - c(f"S{b}_{of}") - c(f"B{b}_{of}")) / 2
    told = out.select(DATE, "n", c("mkt").alias("mkt"), smb("worth", "VMG").alias("smb"), spread("worth", "V", "G").alias("vmg"), spread("mood", "P", "O").alias("pmo"), smb("mood", "POM").alias("turned"))
    return told.withColumn("smb4", (F.col("smb") + F.col("turned")) / 2).drop("turned")
