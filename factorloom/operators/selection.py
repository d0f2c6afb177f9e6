"""Choosing among many factors: their mean rank correlations, greedy pruning, and how steady each one's record is over the years."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.operators.cross_section import DATE


def date_correlation(values: np.ndarray, least: int = 20) -> np.ndarray:
    """Of one date's values (instruments, factors): rank correlations of all pairs by matrix products. Each factor is ranked over its own values, ties averaged; a pair counts the rows that have both, and is missing with fewer than least of them or without variance."""
    ranks = pd.DataFrame(np.where(np.isfinite(values), values, np.nan)).rank().to_numpy()
    there = np.isfinite(ranks)
    one = there.astype(float)
    mid = (np.where(there, ranks, 0.0).sum(axis=0) / np.maximum(one.sum(axis=0), 1.0))[None, :]
    x = np.where(there, ranks - mid, 0.0)
    n, sx, sxx = one.T @ one, x.T @ one, (x * x).T @ one
    with np.errstate(invalid="ignore", divide="ignore"):
        var = sxx - sx * sx / n
        told = (x.T @ x - sx * sx.T / n) / np.sqrt(var * var.T)
    flat = (n < max(least, 2)) | ~(var > 1e-9 * np.maximum(sxx, 1.0)) | ~(var.T > 1e-9 * np.maximum(sxx.T, 1.0))
    return np.where(flat, np.nan, np.clip(told, -1.0, 1.0))


def mean_rank_correlation(df: DataFrame, factors: list[str], least: int = 20, key: str = DATE) -> DataFrame:
    """Rows (factor_i, factor_j, dates, correlation) of each pair i before j: the mean over the dates that have one; a pair that never has is missing.

    Dates meet in tasks whole, one shuffle; a task adds up its dates and gives one row for each pair, whatever the number of dates.
    """
    k = len(factors)
    i, j = np.triu_indices(k, 1)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, dates, rest = np.zeros((k, k)), np.zeros((k, k), dtype=np.int64), None

        def take(f: pd.DataFrame) -> None:
            for _, own in f.groupby(key, dropna=False):
                c = date_correlation(own[factors].to_numpy(dtype=float), least)
                fine = np.isfinite(c)
                total[fine] += c[fine]
                dates[fine] += 1

        for f in batches:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            last = f[key].to_numpy() == f[key].iloc[-1] if len(f) else np.zeros(0, dtype=bool)
            take(f[~last])
            rest = f[last]
        if rest is not None:
            take(rest)
        yield pd.DataFrame({"i": i, "j": j, "dates": dates[i, j], "total": total[i, j]})

    rows = df.where(F.col(key).isNotNull()).select(key, *[F.col(f"`{x}`").cast("double").alias(x) for x in factors])
    sums = rows.repartition(key).sortWithinPartitions(key).mapInPandas(add, "i int, j int, dates long, total double").groupBy("i", "j").agg(F.sum("dates").alias("dates"), F.sum("total").alias("total"))
    name = F.array(*[F.lit(x) for x in factors])
    return sums.select(name[F.col("i")].alias("factor_i"), name[F.col("j")].alias("factor_j"), "dates", F.when(F.col("dates") > 0, F.col("total") / F.col("dates")).alias("correlation"))


def prune(strength: dict[str, float], correlation: DataFrame, limit: float) -> DataFrame:
    """Rows (factor, place, kept, duplicates): the strongest first, ties in the given order; a factor goes if its absolute correlation with one that is kept reaches the limit, and names the kept one that it is closest to.

    Only pairs at the limit or above leave Spark, at most one for each pair of factors.
    """
    if not 0 < limit < 1:
        raise ValueError("the limit lies strictly between 0 and 1")
    close: dict[str, dict[str, float]] = {}
    for r in correlation.where(F.abs("correlation") >= limit).collect():
        for a, b in ((r["factor_i"], r["factor_j"]), (r["factor_j"], r["factor_i"])):
            close.setdefault(a, {})[b] = abs(r["correlation"])
    order = sorted(strength, key=lambda x: -strength[x])
    kept: list[str] = []
    told = []
    for place, name in enumerate(order, 1):
        near = [(close.get(name, {})[x], x) for x in kept if x in close.get(name, {})]
        best = max(near, key=lambda x: x[0])[1] if near else None
        if best is None:
            kept.append(name)
        told.append((name, place, best is None, best))
    return correlation.sparkSession.createDataFrame(told, "factor string, place int, kept boolean, duplicates string")


@dataclass(frozen=True)
class Criteria:
    """What a factor needs: a year counts with min_days; shares are of the counted years."""

    min_days: int = 120
    positive_ic_years: float = 0.75
    positive_spread_years: float = 0.75
    rank_ic: float = 0.01
    t_stat: float = 0.0
    coverage: float = 0.9
    positive_long_years: float = 0.0


def stability(summary: DataFrame, annual: DataFrame, coverage: DataFrame, criteria: Criteria = Criteria(), universe: DataFrame | None = None) -> DataFrame:
    """One row for each factor of summary (factor, rank_ic, rank_icir, days, spread): its direction, the yearly records turned that way, whether it is selected, and the checks it fails.

    annual has (factor, year, days, rank_ic, spread), and (top, bottom) where universe, (year, ret), is given: the side that a long-only
    portfolio could use must then beat it. coverage has (factor, coverage). A factor without a direction, or without counted years,
    fails; missing statistics fail their checks.
    """
    c = criteria
    full = summary.withColumn("direction", F.coalesce(F.signum("rank_ic"), F.lit(0.0)).cast("int"))
    years = annual.where(F.col("days") >= c.min_days).join(full.select("factor", "direction"), "factor")
    turned = lambda x: F.when(F.col("direction") != 0, F.col(x) * F.col("direction"))
    positive = lambda x: F.sum(F.when(x > 0, 1).otherwise(0)).cast("int")
    aggregates = [F.countDistinct("year").cast("int").alias("years"), positive(turned("rank_ic")).alias("ic_years"), positive(turned("spread")).alias("spread_years")]
    if universe is not None:
        years = years.join(F.broadcast(universe), "year", "left")  # one row a year
        extra = F.when(F.col("direction") > 0, F.col("top")).otherwise(F.col("bottom")) - F.col("ret")
        aggregates += [positive(extra).alias("long_years"), F.avg(extra).alias("long_excess")]
    elif c.positive_long_years > 0:
        raise ValueError("positive_long_years needs the universe's returns")
    out = full.join(years.groupBy("factor").agg(*aggregates), "factor", "left").join(coverage.select("factor", "coverage"), "factor", "left")
    out = out.withColumns({x: F.coalesce(F.col(x), F.lit(0)) for x in ("years", "ic_years", "spread_years", *(["long_years"] if universe is not None else []))} | {"coverage": F.coalesce(F.col("coverage"), F.lit(0.0))})
    share = lambda x: F.coalesce(F.try_divide(F.col(x), F.col("years")), F.lit(0.0))
    out = out.withColumns({"t_stat": F.col("rank_icir") * F.sqrt(F.col("days").cast("double")), "spread": turned("spread")})
    checks = {
        "direction": F.col("direction") != 0,
        "rank_ic": F.abs("rank_ic") >= c.rank_ic,
        "t_stat": F.coalesce(F.abs("t_stat"), F.lit(0.0)) >= c.t_stat,
        "ic_years": share("ic_years") >= c.positive_ic_years,
        "spread_years": share("spread_years") >= c.positive_spread_years,
        "coverage": F.col("coverage") >= c.coverage,
    }
    if c.positive_long_years > 0:
        checks["long_years"] = (share("long_years") >= c.positive_long_years) & (F.coalesce(F.col("long_excess"), F.lit(0.0)) > 0)
    failed = F.concat_ws(",", *[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in checks.items()])
    return out.withColumn("failed", failed).withColumn("selected", F.col("failed") == "")
