"""Queries of more than one step: joins along time, labels, attribution and summaries of factors, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.operators import cross_section as xs
from factorloom.operators import joins
from factorloom.operators import series as ts
from factorloom.plans.panel import _lag, _snapped, snapped
from factorloom.sources.bars import BARS_SQL, bars

C = F.col
_BY = "PARTITION BY instrument ORDER BY week_no"


def _label(h: int):
    """From the next open to the open h weeks later."""
    return F.max("open").over(ts.frame(1, -1 - h)) / F.max("open").over(ts.frame(1, -1)) - 1


def _label_sql(h: int) -> str:
    at = lambda k: f"max(open) OVER ({_BY} RANGE BETWEEN {k} FOLLOWING AND {k} FOLLOWING)"
    return f"{at(1 + h)} / {at(1)} - 1"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("instrument", "week_no", *[snapped(_label(h)).alias(f"label_{h}") for h in (1, 5, 20)])


def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders with the price of the customer's last order of the first priority on or before that day."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    first = orders.where(C("o_orderpriority") == "1-URGENT").select("o_custkey", C("o_orderdate").alias("since"), C("o_totalprice").alias("urgent_price"))
    return joins.asof_backward(orders.select("o_orderkey", "o_custkey", "o_orderdate"), first, "o_custkey", "o_orderdate", "since", "urgent_price").select("o_orderkey", "urgent_price")


def _volume_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    busy = bars(spark, sf_dir).where("volume > 50").select("instrument", "week_no")
    return joins.collapse(busy, "instrument", "week_no")


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the first week of the busy span that they are in."""
    spans = _volume_spans(spark, sf_dir).withColumn("start", C("since"))
    return joins.interval(bars(spark, sf_dir).select("instrument", "week_no"), spans, "instrument", "week_no", "since", "until", "start")


def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.newest_by(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_custkey"], "o_orderdate", "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", "o_totalprice")


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).withColumns({"amount": snapped(C("amount")), "place": F.row_number().over(Window.partitionBy("week_no").orderBy(snapped(C("amount")).desc(), "instrument"))}).where("place <= 5").select("week_no", "instrument", "place")


def every_kth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth week of the calendar that the rows have, from its first. Weeks are numbered after the aggregation, so the one window holds no more rows than the calendar."""
    weeks = bars(spark, sf_dir).groupBy("week_no").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))
    return weeks.withColumn("place", F.row_number().over(Window.orderBy("week_no"))).where("place % 5 = 1").drop("place")


def _factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).withColumns({"factor": snapped(-ts.returns(C("close"))), "label": _label(1)}).where("factor is not null and label is not null")


_FACTOR = f"""
f AS (SELECT *, {_snapped(f'-(close / {_lag("close", 1)} - 1)')} AS factor, {_label_sql(1)} AS label FROM bars),
k AS (SELECT * FROM f WHERE factor IS NOT NULL AND label IS NOT NULL)"""


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By week: the mean label of the lowest and the highest fifth, ties by instrument."""
    day = Window.partitionBy("week_no")
    out = _factor(spark, sf_dir).withColumns({"place": F.row_number().over(day.orderBy("factor", "instrument")), "n": F.count("*").over(day)}).where("n >= 20")
    side = F.floor(C("n") / 5)
    return out.groupBy("week_no").agg(snapped(F.avg(F.when(C("place") <= side, C("label")))).alias("short"), snapped(F.avg(F.when(C("place") > C("n") - side, C("label")))).alias("long"))


def pockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staggered pockets of five weeks: rows, mean label, and its deviation."""
    return _factor(spark, sf_dir).groupBy((F.pmod("week_no", F.lit(5)) + 1).alias("pocket")).agg(F.count("*").alias("n"), snapped(F.avg("label")).alias("mean"), snapped(F.stddev_samp("label")).alias("sd"))


def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By year of 52 weeks: weeks, mean rank correlation, its deviation, the share of positive weeks."""
    out = _factor(spark, sf_dir).withColumns({"rf": xs.rank(C("factor")), "rl": xs.rank(C("label"))})
    weekly = out.groupBy("week_no").agg(F.count("*").alias("n"), F.covar_samp("rf", "rl").alias("c"), F.stddev_samp("rf").alias("a"), F.stddev_samp("rl").alias("b")).where("n >= 20")
    weekly = weekly.withColumn("ic", F.try_divide("c", C("a") * C("b")))
    return weekly.groupBy(F.floor(C("week_no") / 52).cast("int").alias("year")).agg(F.count("*").alias("weeks"), snapped(F.avg("ic")).alias("ic_mean"), snapped(F.stddev_samp("ic")).alias("ic_sd"), snapped(F.avg(F.when(C("ic") > 0, 1.0).otherwise(0.0))).alias("positive"))


def weighted_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By week: returns weighted by the amount of the week before, where at least 20 instruments have both."""
    out = bars(spark, sf_dir).withColumns({"r": ts.returns(C("close")), "w": ts.delay(C("amount"), 1).cast("double")}).where("r is not null and w > 0")
    return out.groupBy("week_no").agg(F.count("*").alias("n"), snapped(F.sum(C("r") * C("w")) / F.sum("w")).alias("ret")).where("n >= 20")


def on_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running sum of volume, signed by the change of the close."""
    out = bars(spark, sf_dir).withColumn("signed", F.coalesce(F.signum(ts.delta(C("close"), 1)), F.lit(0.0)) * C("volume"))
    past = Window.partitionBy("instrument").orderBy("week_no").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("instrument", "week_no", snapped(F.sum("signed").over(past)).alias("value"))


def gain_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the last six changes: the rises' share of all absolute change."""
    out = bars(spark, sf_dir).withColumn("change", ts.delta(C("close"), 1))
    rise, every = ts.ts_sum(F.greatest(C("change"), F.lit(0.0)), 6), ts.ts_sum(F.abs("change"), 6)
    return out.select("instrument", "week_no", snapped(F.when(C("change").isNotNull(), F.try_divide(rise, every + 1e-12))).alias("value"))


def sma_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y = (x + 2 y before) / 3, from the first row on and anew after every missing week. One pass over each instrument's history."""

    def along(f):
        f = f.sort_values("week_no")
        run = (f["week_no"].diff() != 1).cumsum()
        return f.assign(value=f.groupby(run)["close"].transform(lambda x: x.ewm(alpha=1 / 3, adjust=False).mean()))[["instrument", "week_no", "value"]]

    out = bars(spark, sf_dir).select("instrument", "week_no", "close").groupBy("instrument").applyInPandas(along, "instrument long, week_no int, value double")
    return out.select("instrument", "week_no", snapped(C("value")).alias("value"))


FIT_WEEKS = 1500


def zscore_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close and volume by the mean and population deviation of the weeks before FIT_WEEKS, one row that every task gets; a constant column passes."""
    out = bars(spark, sf_dir)
    sd = lambda x: F.stddev_pop(x)
    fit = out.where(C("week_no") < FIT_WEEKS).agg(*[f(x).alias(f"{x}_{n}") for x in ("close", "volume") for n, f in (("mean", F.avg), ("sd", sd))])
    norm = lambda x: F.when(C(f"{x}_sd") == 0, C(x)).otherwise(F.try_divide(C(x) - C(f"{x}_mean"), C(f"{x}_sd")))
    return out.crossJoin(F.broadcast(fit)).select("instrument", "week_no", *[snapped(norm(x)).alias(x) for x in ("close", "volume")])


def label_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next week's label by its week's mean and deviation; rows without a label go."""
    week = Window.partitionBy("week_no")
    out = bars(spark, sf_dir).withColumn("label", _label(1)).where("label is not null")
    return out.select("instrument", "week_no", snapped(F.try_divide(C("label") - F.avg("label").over(week), F.stddev_samp("label").over(week))).alias("value"))


_BUSY = """
s AS (SELECT instrument, min(week_no) AS since, max(week_no) AS until FROM (SELECT instrument, week_no, week_no - row_number() OVER (PARTITION BY instrument ORDER BY week_no) AS island FROM bars WHERE volume > 50) GROUP BY instrument, island)"""

QUERIES = {
    "labels": labels, "asof_join": asof_join, "membership_spans": _volume_spans, "interval_join": interval_join, "newest_rows": newest_rows, "top_k": top_k, "every_kth_date": every_kth,
    "attribution": attribution, "pockets": pockets, "ic_summary": ic_summary, "weighted_return": weighted_return, "on_balance_volume": on_balance, "gain_share": gain_share, "sma_recursive": sma_recursive,
    "zscore_norm": zscore_norm, "label_zscore": label_zscore,
}

SQL = {
    "labels": f"WITH {BARS_SQL} SELECT instrument, week_no, " + ", ".join(f"{_snapped(_label_sql(h))} AS label_{h}" for h in (1, 5, 20)) + " FROM bars",
    "asof_join": "WITH u AS (SELECT o_custkey, o_orderdate, max(o_totalprice) AS urgent_price FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL) SELECT o_orderkey, urgent_price FROM orders o ASOF LEFT JOIN u ON o.o_custkey = u.o_custkey AND o.o_orderdate >= u.o_orderdate",
    "membership_spans": f"WITH {BARS_SQL}, {_BUSY} SELECT instrument, since, until FROM s",
    "interval_join": f"WITH {BARS_SQL}, {_BUSY} SELECT b.instrument, week_no, since AS start FROM bars b LEFT JOIN s ON s.instrument = b.instrument AND week_no BETWEEN since AND until",
    "newest_rows": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC, o_totalprice DESC) = 1",
    "top_k": f"WITH {BARS_SQL}, r AS (SELECT week_no, instrument, (row_number() OVER (PARTITION BY week_no ORDER BY {_snapped('amount')} DESC, instrument))::INT AS place FROM bars) SELECT * FROM r WHERE place <= 5",
    "every_kth_date": f"WITH {BARS_SQL} SELECT week_no, count(*) AS n, sum(volume) AS volume FROM bars GROUP BY week_no QUALIFY row_number() OVER (ORDER BY week_no) % 5 = 1",
    "attribution": f"WITH {BARS_SQL}, {_FACTOR}, r AS (SELECT *, row_number() OVER (PARTITION BY week_no ORDER BY factor, instrument) AS place, count(*) OVER (PARTITION BY week_no) AS n FROM k) SELECT week_no, {_snapped('avg(CASE WHEN place <= n // 5 THEN label END)')} AS short, {_snapped('avg(CASE WHEN place > n - n // 5 THEN label END)')} AS long FROM r WHERE n >= 20 GROUP BY week_no",
    "pockets": f"WITH {BARS_SQL}, {_FACTOR} SELECT week_no % 5 + 1 AS pocket, count(*) AS n, {_snapped('avg(label)')} AS mean, {_snapped('stddev_samp(label)')} AS sd FROM k GROUP BY 1",
    "ic_summary": f"""WITH {BARS_SQL}, {_FACTOR},
r AS (SELECT *, {{rf}} AS rf, {{rl}} AS rl FROM k),
w AS (SELECT week_no, covar_samp(rf, rl) / (stddev_samp(rf) * stddev_samp(rl)) AS ic FROM r GROUP BY week_no HAVING count(*) >= 20)
SELECT floor(week_no / 52)::INT AS year, count(*) AS weeks, {_snapped('avg(ic)')} AS ic_mean, {_snapped('stddev_samp(ic)')} AS ic_sd, {_snapped('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)')} AS positive FROM w GROUP BY 1""".format(**{f"r{x[0]}": f"(rank() OVER (PARTITION BY week_no ORDER BY {x}) + (count(*) OVER (PARTITION BY week_no, {x}) - 1) / 2) / count(*) OVER (PARTITION BY week_no)" for x in ("factor", "label")}),
    "weighted_return": f"WITH {BARS_SQL}, r AS (SELECT *, close / {_lag('close', 1)} - 1 AS r, ({_lag('amount', 1)})::DOUBLE AS w FROM bars) SELECT week_no, count(*) AS n, {_snapped('sum(r * w) / sum(w)')} AS ret FROM r WHERE r IS NOT NULL AND w > 0 GROUP BY week_no HAVING count(*) >= 20",
    "on_balance_volume": f"WITH {BARS_SQL}, c AS (SELECT *, coalesce(sign(close - {_lag('close', 1)}), 0) * volume AS signed FROM bars) SELECT instrument, week_no, {_snapped(f'sum(signed) OVER ({_BY} ROWS UNBOUNDED PRECEDING)')} AS value FROM c",
    "gain_share": f"WITH {BARS_SQL}, c AS (SELECT *, close - {_lag('close', 1)} AS change FROM bars), v AS (SELECT instrument, week_no, CASE WHEN count(change) OVER w = 6 THEN sum(greatest(change, 0)) OVER w / (sum(abs(change)) OVER w + 1e-12) END AS x FROM c WINDOW w AS ({_BY} RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)) SELECT instrument, week_no, {_snapped('x')} AS value FROM v",
    "sma_recursive": f"""WITH RECURSIVE {BARS_SQL},
y AS (SELECT b.instrument, b.week_no, b.close AS v FROM bars b LEFT JOIN bars p ON p.instrument = b.instrument AND p.week_no = b.week_no - 1 WHERE p.week_no IS NULL
UNION ALL SELECT b.instrument, b.week_no, (b.close + 2 * y.v) / 3 FROM y JOIN bars b ON b.instrument = y.instrument AND b.week_no = y.week_no + 1)
SELECT instrument, week_no, {_snapped('v')} AS value FROM y""",
    "zscore_norm": f"WITH {BARS_SQL}, f AS (SELECT avg(close) AS cm, stddev_pop(close) AS cs, avg(volume) AS vm, stddev_pop(volume) AS vs FROM bars WHERE week_no < {FIT_WEEKS}) SELECT instrument, week_no, {_snapped('CASE WHEN cs = 0 THEN close ELSE (close - cm) / cs END')} AS close, {_snapped('CASE WHEN vs = 0 THEN volume ELSE (volume - vm) / vs END')} AS volume FROM bars, f",
    "label_zscore": f"WITH {BARS_SQL}, k AS (SELECT *, {_label_sql(1)} AS label FROM bars), n AS (SELECT * FROM k WHERE label IS NOT NULL) SELECT instrument, week_no, {_snapped('(label - avg(label) OVER d) / nullif(stddev_samp(label) OVER d, 0)')} AS value FROM n WINDOW d AS (PARTITION BY week_no)",
}
