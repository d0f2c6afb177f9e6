"""Queries through the store by year: bars written once, some years read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.plans.formulas import _shown, shown
from factorloom.sources.bars import BARS_SQL, bars
from factorloom.sources.store import Store

C = F.col
FIRST, LAST = 24, 28


def _folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; on a local master without one, a new temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{found}/store-{uuid.uuid4().hex}"


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by years of 52 weeks: all are written, then one year again with its corrected volumes, and five years read."""
    store = Store(spark, _folder(spark))
    rows = bars(spark, sf_dir).select("instrument", "week_no", "close", C("volume").cast("double").alias("volume"), F.floor(C("week_no") / 52).cast("int").alias("of"))
    store.write(rows, "of")
    again = store.read(FIRST + 1, FIRST + 1).drop("year")
    store.write(again.withColumn("volume", C("volume") + 1), "of")
    return store.read(FIRST, LAST).select("instrument", "week_no", "year", shown(C("close")).alias("close"), "volume")


QUERIES = {"stored_bars": stored_bars}
SQL = {"stored_bars": f"WITH {BARS_SQL} SELECT instrument, week_no, floor(week_no / 52)::INT AS year, {_shown('close')} AS close, volume::DOUBLE + CASE WHEN floor(week_no / 52) = {FIRST + 1} THEN 1 ELSE 0 END AS volume FROM bars WHERE floor(week_no / 52) BETWEEN {FIRST} AND {LAST}"}
