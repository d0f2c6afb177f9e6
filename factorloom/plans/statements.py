"""Queries over fiscal quarters, recursions, joins, summaries and evaluation, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions import scalars as row
from factorloom.operators import cross_section as xs
from factorloom.operators import fiscal, joins, recursive
from factorloom.operators import series as ts
from factorloom.plans.panel import BARS_SQL, C, _lag, _rank, _snapped, bars, snapped

_BY = "PARTITION BY instrument ORDER BY week_no"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _quarter(day) -> Column:
    return (F.year(day) * 4 + F.quarter(day) - 1).cast("int")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements made of orders: a customer's quarter, its sum since the year's start, told 30 days after its last order; a correction follows where the order count is even."""
    o = _orders(spark, sf_dir).select(C("o_custkey").alias("code"), _quarter(C("o_orderdate")).alias("quarter"), "o_totalprice", F.to_date("o_orderdate").alias("day"))
    q = o.groupBy("code", "quarter").agg(F.sum("o_totalprice").alias("own"), F.date_add(F.max("day"), 30).alias("available"), F.count("*").alias("n"))
    year = Window.partitionBy("code", F.floor(C("quarter") / 4)).orderBy("quarter").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("ytd", F.sum("own").over(year))
    again = q.where("n % 2 = 0").select("code", "quarter", (C("ytd") + 1).alias("ytd"), "available", F.lit(1).alias("corrected"))
    late = q.select("code", "quarter", (C("ytd") + 2).alias("ytd"), F.date_add("available", 10).alias("available"), F.lit(1).alias("corrected"))
    return q.select("code", "quarter", "ytd", "available", F.lit(0).alias("corrected")).unionByName(again).unionByName(late)


_REPORTS = """
o AS (SELECT o_custkey AS code, (year(o_orderdate::DATE) * 4 + quarter(o_orderdate::DATE) - 1)::INT AS quarter, o_totalprice, o_orderdate::DATE AS day FROM orders),
q AS (SELECT code, quarter, sum(o_totalprice) AS own, max(day) + 30 AS available, count(*) AS n FROM o GROUP BY ALL),
y AS (SELECT code, quarter, available, n, sum(own) OVER (PARTITION BY code, quarter // 4 ORDER BY quarter ROWS UNBOUNDED PRECEDING) AS ytd FROM q),
f AS (SELECT code, quarter, available, CASE WHEN n % 2 = 0 THEN ytd + 1 ELSE ytd END AS ytd, (n % 2 = 0)::INT AS corrected FROM y),
ends AS (SELECT code, min(quarter) AS q0, max(quarter) AS q1 FROM f GROUP BY code),
dense AS (SELECT code, unnest(range(q0, q1 + 1))::INT AS quarter FROM ends),
g AS (SELECT d.code, d.quarter, ytd, max(available) OVER (PARTITION BY d.code ORDER BY d.quarter ROWS UNBOUNDED PRECEDING) AS usable FROM dense d LEFT JOIN f USING (code, quarter)),
s AS (SELECT *, CASE WHEN quarter % 4 = 0 THEN ytd ELSE ytd - max(ytd) OVER (PARTITION BY code ORDER BY quarter RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) END AS single FROM g)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fiscal.grid(fiscal.first_reported(_reports(spark, sf_dir)))
    return out.withColumn("single", fiscal.single(C("ytd")))


def _fq(d: int, until: int = 0) -> str:
    return f"OVER (PARTITION BY code ORDER BY quarter RANGE BETWEEN {d - 1 + until} PRECEDING AND {until} PRECEDING)"


def _fq_full(d: int, f: str, x: str, until: int = 0) -> str:
    return f"CASE WHEN count({x}) {_fq(d, until)} = {d} THEN {f}({x}) {_fq(d, until)} END"


_FY = "OVER (PARTITION BY code, quarter % 4 ORDER BY quarter RANGE BETWEEN 16 PRECEDING AND CURRENT ROW)"
#: Name: the column over the grid, and its SQL.
FISCAL = {
    "fiscal_single": (lambda: C("single"), "single"),
    "fiscal_ttm": (lambda: fiscal.ttm(C("single")), _fq_full(4, "sum", "single")),
    "fiscal_annual": (lambda: fiscal.annual(C("ytd")), "CASE WHEN quarter % 4 = 3 THEN ytd END"),
    "fiscal_lag": (lambda: fiscal.lag(C("ytd"), 4), f"max(ytd) {_fq(1, 4)}"),
    "fiscal_zero_fill": (lambda: fiscal.zero_filled(C("single"), C("ytd")), "CASE WHEN ytd IS NOT NULL THEN coalesce(single, 0) END"),
    "fiscal_surprise": (lambda: fiscal.surprise(C("single"), 3), f"(single - ({_fq_full(3, 'avg', 'single', 1)})) / nullif({_fq_full(3, 'stddev_samp', 'single', 1)}, 0)"),
    "fiscal_yearly_mean": (lambda: fiscal.yearly_mean(C("ytd"), 5, 3), f"CASE WHEN count(ytd) {_FY} >= 3 THEN avg(ytd) {_FY} END"),
    "fiscal_yearly_slope": (lambda: fiscal.yearly_slope(C("ytd"), 5, 3), f"CASE WHEN count(ytd) {_FY} >= 3 THEN regr_slope(ytd, quarter / 4) {_FY} / nullif(avg(abs(ytd)) {_FY}, 0) END"),
}


def _fiscal(column):
    return lambda spark, sf_dir: _grid(spark, sf_dir).select("code", "quarter", snapped(column()).alias("value"))


def first_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fiscal.first_reported(_reports(spark, sf_dir)).select("code", "quarter", snapped(C("ytd")).alias("ytd"), "available", "corrected")


def quarter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("code", "quarter", C("ytd").isNotNull().cast("int").alias("there"), "usable")


def statement_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of customers and quarters of open orders, full outer; usable once both that exist are out."""
    left = fiscal.first_reported(_reports(spark, sf_dir)).select("code", "quarter", C("ytd").alias("a"), "available")
    o = _orders(spark, sf_dir).where("o_orderstatus = 'O'").select(C("o_custkey").alias("code"), (_quarter(C("o_orderdate")) + 1).alias("quarter"), "o_totalprice", F.to_date("o_orderdate").alias("day"))
    right = o.groupBy("code", "quarter").agg(F.sum("o_totalprice").alias("b"), F.max("day").alias("available"))
    return fiscal.merged(left, right).select("code", "quarter", snapped(C("a")).alias("a"), snapped(C("b")).alias("b"), "available")


def fiscal_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order day of a customer with the quarter that is usable then, and its last four quarters' sum."""
    days = _orders(spark, sf_dir).select(C("o_custkey").alias("code"), F.to_date("o_orderdate").alias("day")).distinct()
    quarters = _grid(spark, sf_dir).withColumn("ttm", fiscal.ttm(C("single")))
    return fiscal.published(days, quarters, "day", "ttm").select("code", "day", "quarter", snapped(C("ttm")).alias("ttm"))


def announcement_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order day of a customer after each quarter became available."""
    days = _orders(spark, sf_dir).select(C("o_custkey").alias("code"), F.to_date("o_orderdate").alias("day")).distinct()
    told = fiscal.first_reported(_reports(spark, sf_dir)).select("code", F.date_add("available", 1).alias("since"), C("quarter").alias("told"))
    seen = joins.asof_backward(days, told, "code", "day", "since", "told")
    first = Window.partitionBy("code").orderBy("day")
    return seen.withColumn("before", F.lag("told").over(first)).where("told IS NOT NULL AND (before IS NULL OR told <> before)").select("code", "day", "told")


def _recursion(step, columns):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = recursive.along(bars(spark, sf_dir).withColumn("weight", C("volume") / (C("volume") + 50)), columns, step)
        return out.select("instrument", "week_no", snapped(C("value")).alias("value"))

    return query


def _recursion_sql(first: str, update: str, least: int = 1) -> str:
    return f"""WITH RECURSIVE {BARS_SQL}, n AS (SELECT *, volume / (volume + 50) AS weight, row_number() OVER ({_BY}) AS rn, week_no - lag(week_no) OVER ({_BY}) AS gap FROM bars),
y AS (SELECT instrument, week_no, rn, {first} AS v FROM n WHERE rn = 1
UNION ALL SELECT n.instrument, n.week_no, n.rn, {update} FROM y JOIN n ON n.instrument = y.instrument AND n.rn = y.rn + 1)
SELECT instrument, week_no, {_snapped(f'CASE WHEN rn >= {least} THEN v END')} AS value FROM y"""


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in a row whose close rose from the row before."""
    by = Window.partitionBy("instrument").orderBy("week_no")
    out = bars(spark, sf_dir).withColumn("up", row.indicator(C("close") > F.lag("close").over(by)))
    out = out.withColumn("island", F.sum(1 - C("up")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("instrument", "island").orderBy("week_no").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("instrument", "week_no", F.sum("up").over(run).cast("long").alias("value"))


def value_at_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The close so many weeks back as the row itself says."""
    b = bars(spark, sf_dir).select("instrument", "week_no", "close", (C("week_no") - F.pmod(C("volume").cast("int"), F.lit(4))).alias("wanted"))
    return b.select("instrument", "week_no", "wanted").join(b.select("instrument", C("week_no").alias("wanted"), "close"), ["instrument", "wanted"], "left").select("instrument", "week_no", snapped(C("close")).alias("value"))


def filtered_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope over the last five rows that rose, held until the next one."""
    b = bars(spark, sf_dir).select("instrument", "week_no", "open", "close")
    by = Window.partitionBy("instrument").orderBy("week_no")
    rose = b.where("close > open").withColumn("n", F.row_number().over(by))
    w = by.rowsBetween(-4, 0)
    rose = rose.select("instrument", C("week_no").alias("since"), F.when(F.count("*").over(w) == 5, F.regr_slope("close", C("n").cast("double")).over(w)).alias("slope"))
    return joins.asof_backward(b.select("instrument", "week_no"), rose, "instrument", "week_no", "since", "slope").select("instrument", "week_no", snapped(C("slope")).alias("value"))


def leader_spillover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For all but the largest 30 % of a sector by cap: the mean return of those."""
    out = bars(spark, sf_dir).withColumn("r", C("close") / C("open") - 1)
    out = out.withColumn("leads", xs.rank(C("cap"), "sector") > 0.7)
    day = Window.partitionBy("week_no", "sector")
    return out.select("instrument", "week_no", snapped(F.when(~C("leads"), F.avg(F.when(C("leads"), C("r"))).over(day))).alias("value"))


def sector_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By week: the best two fifths of the sectors, one at least, by median return."""
    s = bars(spark, sf_dir).groupBy("week_no", "sector").agg(F.median(C("close") / C("open") - 1).alias("m"))
    week = Window.partitionBy("week_no")
    s = s.withColumns({"place": F.row_number().over(week.orderBy(C("m").desc(), "sector")), "n": F.count("*").over(week)})
    return s.where(C("place") <= F.greatest(F.lit(1), F.ceil(C("n") * 0.4))).select("week_no", "sector", "place", snapped(C("m")).alias("m"))


def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the customer's last order of the day: the last duplicate wins."""
    o = _orders(spark, sf_dir)
    last = joins.newest_by(o.select("o_custkey", "o_orderdate", C("o_orderkey").alias("last_key"), C("o_totalprice").alias("last_price")), ["o_custkey", "o_orderdate"], "last_key")
    return o.select("o_orderkey", "o_custkey", "o_orderdate").join(last, ["o_custkey", "o_orderdate"], "left").select("o_orderkey", "last_key", "last_price")


def full_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    a = o.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("urgent"))
    b = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("done"))
    return a.join(b, "o_custkey", "full_outer").select("o_custkey", "urgent", "done")


def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments that ever were members, with their whole history."""
    b = bars(spark, sf_dir).select("instrument", "week_no", "volume")
    return b.join(b.where("volume > 100").select("instrument").distinct(), "instrument", "left_semi")


def membership_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    top = b.withColumn("place", F.row_number().over(Window.partitionBy("week_no").orderBy(C("volume").desc(), "instrument"))).where("place <= 10").select("instrument", "week_no", F.lit(1).alias("in_top"))
    return b.select("instrument", "week_no").join(top, ["instrument", "week_no"], "left").select("instrument", "week_no", F.coalesce("in_top", F.lit(0)).alias("member"))


def market_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's return less that of its week's market, a series with one row a week."""
    b = bars(spark, sf_dir).withColumn("r", C("close") / C("open") - 1)
    market = b.groupBy("week_no").agg(F.avg("r").alias("market"))
    return b.join(market, "week_no").select("instrument", "week_no", snapped(C("r") - C("market")).alias("value"))


def aligned_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores of the same rows side by side; a row that one lacks is an error."""
    b = bars(spark, sf_dir)
    one, two = b.select("instrument", "week_no", "volume", F.lit(1).alias("in_one")), b.select("instrument", "week_no", "cap", F.lit(1).alias("in_two"))
    both = one.join(two, ["instrument", "week_no"], "full_outer")
    same = F.when(F.assert_true(C("in_one").isNotNull() & C("in_two").isNotNull()).isNull(), C("cap"))
    return both.select("instrument", "week_no", "volume", snapped(same).alias("cap"))


def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    return o.where("o_custkey % 2 = 0").unionByName(o.where("o_custkey % 3 = 0").select("o_orderkey"), allowMissingColumns=True)


def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_custkey", "o_orderpriority").distinct()


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order, by keys."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").exceptAll(_orders(spark, sf_dir).select("o_custkey").distinct())


def ohlc_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose prices contradict themselves, here made by a fee on some closes; the others are not told."""
    b = bars(spark, sf_dir).withColumn("close", F.when(F.pmod("week_no", F.lit(7)) == 0, C("close") * 1.5).otherwise(C("close")))
    fine = (C("high") >= F.greatest("open", "close", "low")) & (C("low") <= F.least("open", "close", "high"))
    return b.where(~fine).select("instrument", "week_no")


def code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names turned round at their sign, a prefix test, a pattern, and a date from digits, which may be none."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    parts = F.split("s_name", "#")
    digits = F.concat(F.lit("2020"), F.lpad((F.pmod("s_suppkey", F.lit(14)) + 0).cast("string"), 2, "0"), F.lpad((F.pmod("s_suppkey", F.lit(33)) + 0).cast("string"), 2, "0"))
    return s.select("s_suppkey", F.concat(parts[1], parts[0]).alias("code"), F.col("s_name").startswith("Supplier#00000001").cast("int").alias("board"), F.col("s_name").rlike("[02468]$").cast("int").alias("even"), F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date").alias("day"))


def first_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy("instrument").agg(F.min("week_no").alias("first_week"), snapped(F.min_by("close", "week_no")).alias("first_close"), F.count("*").alias("weeks"))


def compounded_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By instrument and year of 52 weeks, of a hundredth of the open-to-close returns; a loss of all or more is an error."""
    r = (C("close") / C("open") - 1) / 100
    fine = F.when(F.assert_true(r > -1).isNull(), F.log1p(r))
    return bars(spark, sf_dir).groupBy("instrument", F.floor(C("week_no") / 52).cast("int").alias("year")).agg(snapped(F.expm1(F.sum(fine))).alias("value"))


def risk_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By instrument: mean and deviation of the returns, their ratio over 52 weeks, and the deepest fall of the running sum below its maximum."""
    b = bars(spark, sf_dir).withColumn("r", (C("close") / C("open") - 1) / 100)
    past = Window.partitionBy("instrument").orderBy("week_no").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("total", F.sum("r").over(past)).withColumn("top", F.max("total").over(past))
    return b.groupBy("instrument").agg(snapped(F.avg("r") * 52).alias("annual"), snapped(F.try_divide(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.lit(52.0))).alias("ratio"), snapped(F.min(C("total") - C("top"))).alias("drawdown"))


_TWO = {"momentum": lambda: -ts.returns(C("close")), "size": lambda: -C("volume"), "range": lambda: (C("high") - C("low")) / C("close")}


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.max("close").over(ts.frame(1, -1)) / C("close") - 1
    return bars(spark, sf_dir).withColumns({k: f() for k, f in _TWO.items()} | {"label": label}).select("instrument", "week_no", *_TWO, "label")


_FACTORS = f"fs AS (SELECT instrument, week_no, -(close / {_lag('close', 1)} - 1) AS momentum, -volume AS size, (high - low) / close AS range, max(close) OVER ({_BY} RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) / close - 1 AS label FROM bars)"


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _factors(spark, sf_dir).select("instrument", "week_no", "label", F.expr(f"stack(3, {', '.join(f'{k!r}, {k}' for k in _TWO)}) AS (factor, x)"))


_LONG = f"{_FACTORS}, lg AS (" + " UNION ALL ".join(f"SELECT instrument, week_no, label, '{k}' AS factor, {k} AS x FROM fs" for k in _TWO) + ")"


def effectiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By factor: weeks with a correlation, its mean and the mean over its deviation, and the side to take."""
    ic = _long(spark, sf_dir).where("x is not null and label is not null").groupBy("factor", "week_no").agg(F.count("*").alias("n"), xs.correlation(C("x"), C("label")).alias("ic")).where("n >= 20")
    return ic.groupBy("factor").agg(F.count("ic").alias("weeks"), snapped(F.avg("ic")).alias("mean"), snapped(F.try_divide(F.avg("ic"), F.stddev_samp("ic"))).alias("ir"), F.signum(F.round(F.avg("ic"), 6)).cast("int").alias("side"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By factor: its values over those of each week's best covered factor."""
    n = _long(spark, sf_dir).groupBy("week_no", "factor").agg(F.count("x").alias("n"))
    n = n.withColumn("best", F.max("n").over(Window.partitionBy("week_no")))
    return n.groupBy("factor").agg(snapped(F.sum("n") / F.sum("best")).alias("value"))


def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of factors: the mean over weeks of their ranks' correlation, where at least 20 instruments have a value."""
    f = _factors(spark, sf_dir).where("momentum is not null").withColumns({f"r_{k}": xs.rank(C(k)) for k in _TWO})
    names = list(_TWO)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    weekly = f.groupBy("week_no").agg(F.count("*").alias("n"), *[xs.correlation(C(f"r_{a}"), C(f"r_{b}")).alias(f"{a}_{b}") for a, b in pairs]).where("n >= 20")
    return weekly.agg(*[snapped(F.avg(f"{a}_{b}")).alias(f"{a}_{b}") for a, b in pairs])


def two_by_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By week: small less big and high less low, of six groups by the median of cap and the 30th and 70th percentile of close over open."""
    week = Window.partitionBy("week_no")
    b = bars(spark, sf_dir).withColumns({"r": C("close") / C("open") - 1, "value": C("low") / C("high")})
    b = b.withColumns({"mid": F.median("cap").over(week), "low3": F.percentile("value", F.lit(0.3)).over(week), "high3": F.percentile("value", F.lit(0.7)).over(week)})
    cell = lambda small, low, high: F.avg(F.when((C("cap") <= C("mid")) == small, F.when(low & high, C("r"))))
    thirds = {"l": (C("value") <= C("low3"), F.lit(True)), "m": (C("value") > C("low3"), C("value") <= C("high3")), "h": (C("value") > C("high3"), F.lit(True))}
    g = b.groupBy("week_no").agg(*[cell(small, *thirds[t]).alias(f"{s}{t}") for s, small in (("s", True), ("b", False)) for t in thirds])
    return g.select("week_no", snapped((C("sl") + C("sm") + C("sh") - C("bl") - C("bm") - C("bh")) / 3).alias("smb"), snapped((C("sh") + C("bh") - C("sl") - C("bl")) / 2).alias("hml"))


def previous_weighted_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By week: returns weighted by the amount of the row before, where at least 20 instruments have both."""
    b = bars(spark, sf_dir).withColumns({"r": ts.returns(C("close")), "w": ts.delay(C("amount"), 1)}).where("r is not null and w > 0")
    return b.groupBy("week_no").agg(F.count("*").alias("n"), snapped(F.sum(C("r") * C("w")) / F.sum("w")).alias("ret")).where("n >= 20")


def every_fifth_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth week that there is, by its position in the calendar; weeks are few, so one task numbers them."""
    weeks = bars(spark, sf_dir).select("week_no").distinct().withColumn("position", F.row_number().over(Window.orderBy("week_no")) - 1)
    return weeks.where("position % 5 = 0").select("week_no", "position")


_B = f"WITH {BARS_SQL}"
QUERIES = {name: _fiscal(column) for name, (column, _) in FISCAL.items()} | {
    "first_reported": first_reported, "quarter_grid": quarter_grid, "statement_merge": statement_merge, "fiscal_published": fiscal_published, "announcement_events": announcement_events,
    "ema_with_gaps": _recursion(recursive.ema(1 / 3, 4), ["close"]), "dma": _recursion(recursive.dma, ["close", "weight"]), "streaks": streaks, "value_at_row": value_at_row, "filtered_slope": filtered_slope,
    "leader_spillover": leader_spillover, "sector_strength": sector_strength, "left_join": left_join, "full_outer_join": full_outer_join, "semi_join": semi_join, "membership_flag": membership_flag,
    "market_excess": market_excess, "aligned_concat": aligned_concat, "union_all": union_all, "distinct_rows": distinct_rows, "set_difference": set_difference, "ohlc_quarantine": ohlc_quarantine, "code_names": code_names,
    "first_quote": first_quote, "compounded_return": compounded_return, "risk_analysis": risk_analysis, "effectiveness": effectiveness, "coverage": coverage, "rank_correlation": rank_correlation,
    "two_by_three": two_by_three, "previous_weighted_return": previous_weighted_return, "every_fifth_position": every_fifth_position,
}

_RANKED = ", ".join(f"{_rank(k)} AS r_{k}" for k in _TWO)
SQL = {name: f"WITH {_REPORTS} SELECT code, quarter, {_snapped(text)} AS value FROM s" for name, (_, text) in FISCAL.items()} | {
    "first_reported": f"WITH {_REPORTS} SELECT code, quarter, {_snapped('ytd')} AS ytd, available, corrected FROM f",
    "quarter_grid": f"WITH {_REPORTS} SELECT code, quarter, (ytd IS NOT NULL)::INT AS there, usable FROM g",
    "statement_merge": f"WITH {_REPORTS}, r AS (SELECT o_custkey AS code, (year(o_orderdate::DATE) * 4 + quarter(o_orderdate::DATE))::INT AS quarter, sum(o_totalprice) AS b, max(o_orderdate::DATE) AS available FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) SELECT coalesce(f.code, r.code) AS code, coalesce(f.quarter, r.quarter) AS quarter, {_snapped('ytd')} AS a, {_snapped('b')} AS b, greatest(f.available, r.available) AS available FROM f FULL JOIN r ON f.code = r.code AND f.quarter = r.quarter",
    "fiscal_published": f"WITH {_REPORTS}, t AS (SELECT code, quarter, usable, {_fq_full(4, 'sum', 'single')} AS ttm FROM s), u AS (SELECT DISTINCT code, day FROM o), m AS (SELECT u.code, u.day, max(quarter) AS quarter FROM u LEFT JOIN t ON t.code = u.code AND usable <= day GROUP BY ALL) SELECT m.code, day, m.quarter, {_snapped('ttm')} AS ttm FROM m LEFT JOIN t ON t.code = m.code AND t.quarter = m.quarter",
    "announcement_events": f"WITH {_REPORTS}, k AS (SELECT code, available + 1 AS since, max(quarter) AS told FROM f GROUP BY ALL), u AS (SELECT DISTINCT code, day FROM o), a AS (SELECT u.code, u.day, told, lag(told) OVER (PARTITION BY u.code ORDER BY u.day) AS before FROM u ASOF LEFT JOIN k ON u.code = k.code AND u.day >= since) SELECT code, day, told FROM a WHERE told IS NOT NULL AND (before IS NULL OR told <> before)",
    "ema_with_gaps": _recursion_sql("close", "(power(2 / 3::DOUBLE, gap) * y.v + n.close / 3) / (power(2 / 3::DOUBLE, gap) + 1 / 3::DOUBLE)", 4),
    "dma": _recursion_sql("close", "n.weight * n.close + (1 - n.weight) * y.v"),
    "streaks": f"{_B}, u AS (SELECT instrument, week_no, coalesce(close > lag(close) OVER ({_BY}), false)::INT AS up FROM bars), i AS (SELECT *, sum(1 - up) OVER ({_BY} ROWS UNBOUNDED PRECEDING) AS island FROM u) SELECT instrument, week_no, (sum(up) OVER (PARTITION BY instrument, island ORDER BY week_no ROWS UNBOUNDED PRECEDING))::BIGINT AS value FROM i",
    "value_at_row": f"{_B} SELECT a.instrument, a.week_no, {_snapped('b.close')} AS value FROM bars a LEFT JOIN bars b ON a.instrument = b.instrument AND b.week_no = a.week_no - a.volume::INT % 4",
    "filtered_slope": f"{_B}, n AS (SELECT instrument, week_no, close, row_number() OVER ({_BY}) AS n FROM bars WHERE close > open), k AS (SELECT instrument, week_no AS since, CASE WHEN count(*) OVER w = 5 THEN regr_slope(close, n::DOUBLE) OVER w END AS slope FROM n WINDOW w AS ({_BY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), h AS (SELECT * FROM k WHERE slope IS NOT NULL) SELECT b.instrument, b.week_no, {_snapped('slope')} AS value FROM bars b ASOF LEFT JOIN h ON b.instrument = h.instrument AND b.week_no >= since",
    "leader_spillover": f"{_B}, k AS (SELECT *, close / open - 1 AS r, {_rank('cap', ', sector')} > 0.7 AS leads FROM bars) SELECT instrument, week_no, {_snapped('CASE WHEN NOT leads THEN avg(CASE WHEN leads THEN r END) OVER (PARTITION BY week_no, sector) END')} AS value FROM k",
    "sector_strength": f"{_B}, m AS (SELECT week_no, sector, median(close / open - 1) AS m FROM bars GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY week_no ORDER BY m DESC, sector)::INT AS place, count(*) OVER (PARTITION BY week_no) AS n FROM m) SELECT week_no, sector, place, {_snapped('m')} AS m FROM p WHERE place <= greatest(1, ceil(n * 0.4))",
    "left_join": "WITH l AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS last_key FROM orders GROUP BY ALL) SELECT o.o_orderkey, l.last_key, p.o_totalprice AS last_price FROM orders o LEFT JOIN l USING (o_custkey, o_orderdate) LEFT JOIN orders p ON p.o_orderkey = l.last_key",
    "full_outer_join": "WITH a AS (SELECT o_custkey, count(*) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS done FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o_custkey, urgent, done FROM a FULL JOIN b USING (o_custkey)",
    "semi_join": f"{_B} SELECT instrument, week_no, volume FROM bars WHERE instrument IN (SELECT instrument FROM bars WHERE volume > 100)",
    "membership_flag": f"{_B} SELECT instrument, week_no, (row_number() OVER (PARTITION BY week_no ORDER BY volume DESC, instrument) <= 10)::INT AS member FROM bars",
    "market_excess": f"{_B} SELECT instrument, week_no, {_snapped('close / open - 1 - avg(close / open - 1) OVER (PARTITION BY week_no)')} AS value FROM bars",
    "aligned_concat": f"{_B} SELECT instrument, week_no, volume, {_snapped('cap')} AS cap FROM bars",
    "union_all": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_custkey % 3 = 0",
    "distinct_rows": "SELECT DISTINCT o_custkey, o_orderpriority FROM orders",
    "set_difference": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "ohlc_quarantine": f"{_B}, c AS (SELECT instrument, week_no, open, high, low, CASE WHEN week_no % 7 = 0 THEN close * 1.5 ELSE close END AS close FROM bars) SELECT instrument, week_no FROM c WHERE NOT (high >= greatest(open, close, low) AND low <= least(open, close, high))",
    "code_names": "SELECT s_suppkey, split_part(s_name, '#', 2) || split_part(s_name, '#', 1) AS code, starts_with(s_name, 'Supplier#00000001')::INT AS board, regexp_matches(s_name, '[02468]$')::INT AS even, try_strptime('2020' || lpad((s_suppkey % 14)::VARCHAR, 2, '0') || lpad((s_suppkey % 33)::VARCHAR, 2, '0'), '%Y%m%d')::DATE AS day FROM supplier",
    "first_quote": f"{_B} SELECT instrument, min(week_no) AS first_week, {_snapped('arg_min(close, week_no)')} AS first_close, count(*) AS weeks FROM bars GROUP BY instrument",
    "compounded_return": f"{_B} SELECT instrument, floor(week_no / 52)::INT AS year, {_snapped('exp(sum(ln(1 + (close / open - 1) / 100))) - 1')} AS value FROM bars GROUP BY ALL",
    "risk_analysis": f"{_B}, t AS (SELECT *, (close / open - 1) / 100 AS r, sum((close / open - 1) / 100) OVER ({_BY} ROWS UNBOUNDED PRECEDING) AS total FROM bars), u AS (SELECT *, max(total) OVER ({_BY} ROWS UNBOUNDED PRECEDING) AS top FROM t) SELECT instrument, {_snapped('avg(r) * 52')} AS annual, {_snapped('avg(r) / nullif(stddev_samp(r), 0) * sqrt(52.0)')} AS ratio, {_snapped('min(total - top)')} AS drawdown FROM u GROUP BY instrument",
    "effectiveness": f"{_B}, {_LONG}, i AS (SELECT factor, week_no, corr(x, label) AS ic FROM lg WHERE x IS NOT NULL AND label IS NOT NULL GROUP BY ALL HAVING count(*) >= 20) SELECT factor, count(ic) AS weeks, {_snapped('avg(ic)')} AS mean, {_snapped('avg(ic) / nullif(stddev_samp(ic), 0)')} AS ir, sign(round(avg(ic), 6))::INT AS side FROM i GROUP BY factor",
    "coverage": f"{_B}, {_LONG}, n AS (SELECT week_no, factor, count(x) AS n FROM lg GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY week_no) AS best FROM n) SELECT factor, {_snapped('sum(n) / sum(best)')} AS value FROM m GROUP BY factor",
    "rank_correlation": f"{_B}, {_FACTORS}, k AS (SELECT * FROM fs WHERE momentum IS NOT NULL), r AS (SELECT week_no, {_RANKED} FROM k), w AS (SELECT week_no, corr(r_momentum, r_size) AS a, corr(r_momentum, r_range) AS b, corr(r_size, r_range) AS c FROM r GROUP BY week_no HAVING count(*) >= 20) SELECT {_snapped('avg(a)')} AS momentum_size, {_snapped('avg(b)')} AS momentum_range, {_snapped('avg(c)')} AS size_range FROM w",
    "two_by_three": f"{_B}, v AS (SELECT week_no, cap, close / open - 1 AS r, low / high AS value FROM bars), q AS (SELECT *, median(cap) OVER d AS mid, quantile_cont(value, 0.3) OVER d AS l3, quantile_cont(value, 0.7) OVER d AS h3 FROM v WINDOW d AS (PARTITION BY week_no)), c AS (SELECT week_no, CASE WHEN cap <= mid THEN 's' ELSE 'b' END || CASE WHEN value <= l3 THEN 'l' WHEN value <= h3 THEN 'm' ELSE 'h' END AS cell, r FROM q), g AS (SELECT week_no, " + ", ".join(f"avg(CASE WHEN cell = '{x}' THEN r END) AS {x}" for x in ("sl", "sm", "sh", "bl", "bm", "bh")) + f" FROM c GROUP BY week_no) SELECT week_no, {_snapped('(sl + sm + sh - bl - bm - bh) / 3')} AS smb, {_snapped('(sh + bh - sl - bl) / 2')} AS hml FROM g",
    "previous_weighted_return": f"{_B}, r AS (SELECT week_no, close / {_lag('close', 1)} - 1 AS r, {_lag('amount', 1)} AS w FROM bars) SELECT week_no, count(*) AS n, {_snapped('sum(r * w) / sum(w)')} AS ret FROM r WHERE r IS NOT NULL AND w > 0 GROUP BY week_no HAVING count(*) >= 20",
    "every_fifth_position": f"{_B}, w AS (SELECT week_no, (row_number() OVER (ORDER BY week_no) - 1)::INT AS position FROM (SELECT DISTINCT week_no FROM bars)) SELECT * FROM w WHERE position % 5 = 0",
}
