"""Weighted least squares by date (or any keys) over the panel: normal equations add up, so tasks sum them before the only shuffle.

Regressors come as one array column. What is shuffled is a matrix of their number squared for each date and task, whatever the number
of rows; a solve sees one date's sums. Solutions are those of least norm, so a group that has no member, or a regressor that repeats
others, does no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.cross_section import DATE
from factorloom.operators.names import free
from factorloom.operators.regression import least_norm


def fits(df: DataFrame, y: Column, x: Column, weight: Column | None = None, key: str = DATE, least: int = 1) -> DataFrame:
    """Rows (key, n, beta): the solution over the rows that have y, all of x (an array of one length) and a positive weight; keys with fewer rows than least have none."""
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(F.col(key), y.cast("double").alias("y"), x.cast("array<double>").alias("x"), w.cast("double").alias("w"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.where(finite(F.col("y")) & finite(F.col("w")) & (F.col("w") > 0) & F.col("x").isNotNull() & F.forall("x", finite))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            keys, of = np.unique(f[key].to_numpy(), return_inverse=True)
            d = np.column_stack([np.stack(f["x"].to_numpy()), f["y"].to_numpy()]) if len(f) else np.zeros((0, 1))
            for i, k in enumerate(keys):
                own = d[of == i]
                g = (own * f["w"].to_numpy()[of == i][:, None]).T @ own
                yield pd.DataFrame({key: [k], "n": [len(own)], "g": [g.ravel().tolist()]})

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        n, g = int(f["n"].sum()), np.sum(np.stack(f["g"].to_numpy()), axis=0)
        k = int(round(len(g) ** 0.5)) - 1
        g = g.reshape(k + 1, k + 1)
        if n < least:
            return pd.DataFrame({key: [], "n": [], "beta": []}, dtype=object)
        beta, _ = least_norm(g[None, :k, :k], g[None, :k, k])
        return pd.DataFrame({key: [f[key].iloc[0]], "n": [n], "beta": [beta[0].tolist()]})

    kind = dict(df.dtypes)[key]
    return rows.mapInPandas(sums, f"{key} {kind}, n long, g array<double>").groupBy(key).applyInPandas(solve, f"{key} {kind}, n long, beta array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def dummies(group: Column, members: list, first: int = 0) -> Column:
    """An array of ones and zeros, one place for each member from first on."""
    return F.array(*[F.when(group == F.lit(m), F.lit(1.0)).otherwise(F.lit(0.0)) for m in members[first:]]).cast("array<double>")


def members_of(df: DataFrame, group: str, most: int = 1000) -> list:
    """The groups there are, in order; more than most is an error, since a solve squares their number."""
    found = [r[0] for r in df.where(F.col(group).isNotNull()).select(group).distinct().orderBy(group).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} groups in {group}")
    return found


def cross_fit(df: DataFrame, y: str, xs: list[str], *, group: str | None = None, member: Column | None = None, least: int = 30, spare: int = 10, prefix: str = "fit_") -> DataFrame:
    """df with the date's coefficients on a constant and xs in columns b0 to bk, and the residual of the rows that the fit saw, each under the prefix.

    Rows count if member holds, and y, all of xs and the group are there. The groups that a date has, but the lowest, get a dummy each. A date
    is fitted if it has least rows, and as many as there are columns and spare ones more. Coefficients are of least norm and
    stand on every row of the date.
    """
    use = F.lit(True) if member is None else F.coalesce(member, F.lit(False))
    named = [F.col(f"`{c}`").cast("double") for c in [y, *xs]]
    for c in named:
        use = use & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    work = {n: free(df, f"fit_work_{n}") for n in ("use", "x", "low", "groups")}
    out = df.withColumn(work["use"], use if group is None else use & F.col(f"`{group}`").isNotNull())
    design = [F.lit(1.0), *named[1:]]
    if group is not None:
        known = members_of(out.where(F.col(work["use"])), group)
        own = F.when(F.col(work["use"]), F.col(f"`{group}`"))
        day = Window.partitionBy(DATE)
        out = out.withColumns({work["low"]: F.min(own).over(day), work["groups"]: F.size(F.collect_set(own).over(day))})
        design += [F.when((F.col(f"`{group}`") == F.lit(m)) & (F.col(work["low"]) != F.lit(m)), F.lit(1.0)).otherwise(F.lit(0.0)) for m in known]
        columns = F.lit(1 + len(xs)) + F.greatest(F.col(work["groups"]) - 1, F.lit(0))
    else:
        columns = F.lit(1 + len(xs))
    out = out.withColumn(work["x"], F.array(*design))
    need = out.where(F.col(work["use"])).groupBy(DATE).agg((F.max(columns) + spare).alias("need"))
    solved = fits(out.where(F.col(work["use"])), named[0], F.col(work["x"]), least=least).join(need, DATE).where("n >= need").select(DATE, F.col("beta").alias(free(df, "fit_work_beta")))
    beta = F.col(free(df, "fit_work_beta"))
    out = out.join(solved, DATE, "left")
    told = {f"{prefix}b{i}": beta[i] for i in range(len(xs) + 1)}
    told[f"{prefix}residual"] = F.when(F.col(work["use"]), named[0] - dot(F.col(work["x"]), beta))
    return out.withColumns(told).select(*[F.col(f"`{c}`") for c in df.columns], *told)


def regression_momentum(df: DataFrame, y: str, xs: list[str], out: str = "trend", *, lag: int = 1, lags: int = 12, stride: int = 1, enough: int = 8, least: int = 36, spare: int = 10) -> DataFrame:
    """df with the sum of xs times their expected coefficients: those of y on a constant and xs of lag rows ago, date by date, averaged over this date and each stride-th before it, lags in all, if enough of them are there.

    Averages stand in a table of one row for each date, which joins the panel at the end.
    """
    from factorloom.operators.series import delay

    work = [free(df, f"trend_work_{i}") for i in range(len(xs))]
    shifted = df.withColumns({w: delay(F.col(f"`{x}`").cast("double"), lag) for w, x in zip(work, xs, strict=True)})
    found = fits(shifted, F.col(f"`{y}`"), F.array(F.lit(1.0), *[F.col(w) for w in work]), least=max(least, len(xs) + 1 + spare))
    dates = df.select(DATE).distinct().join(found, DATE, "left")  # a date without a fit has an average too
    past = Window.partitionBy(F.pmod(DATE, F.lit(stride))).orderBy(DATE).rangeBetween(-(lags - 1) * stride, 0)
    means = [F.when(F.count("beta").over(past) >= enough, F.avg(F.col("beta")[i + 1]).over(past)).alias(w) for i, w in enumerate(work)]
    told = sum((F.col(f"`{x}`") * F.col(w) for x, w in zip(xs, work, strict=True)), F.lit(0.0))
    return df.join(dates.select(DATE, *means), DATE, "left").select(*[F.col(f"`{c}`") for c in df.columns], told.alias(out))
