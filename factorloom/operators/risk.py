"""A structured risk model: exposures to groups and styles, factor returns by weighted regressions, their decaying covariance, and specific risk.

Exposures of a date explain the next date's returns. Cross-sections standardise in windows of a date; normal equations add up in tasks;
decaying sums are made at the signal dates only: a row of history goes to the signal dates whose lookback it is in, and
its weight is by its age there, so no running weight can grow or vanish over a long calendar.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.cross_section import DATE
from factorloom.operators.least_squares import dot, dummies, fits, members_of
from factorloom.operators.names import free
from factorloom.operators.series import KEY

#: Residuals that a specific risk needs.
LEAST_RESIDUALS = 20
#: A limit that no active exposure reaches.
UNBOUNDED = 100.0


def standardise(df: DataFrame, columns: dict[str, str], cap: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """df with columns (new name: old name) clipped at the date's quantiles, less their cap-weighted mean, over their sample deviation.

    Missing stays missing; a date with fewer than three values has none, and a constant one has zeros. Without a positive cap beside any
    value, the mean is plain.
    """
    day = Window.partitionBy(DATE)
    clip, n, mid, sd = ({new: free(df, f"risk_{k}_{new}") for new in columns} for k in ("clip", "n", "mid", "sd"))
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    x = {new: finite(F.col(f"`{old}`").cast("double")) for new, old in columns.items()}
    weight = F.when(F.col(f"`{cap}`") > 0, F.col(f"`{cap}`").cast("double"))
    out = df.withColumns({n[c]: F.percentile(v, F.array(F.lit(low), F.lit(high))).over(day) for c, v in x.items()})
    out = out.withColumns({clip[c]: F.when(v.isNotNull(), F.greatest(F.col(n[c])[0], F.least(F.col(n[c])[1], v))) for c, v in x.items()})
    told = {}
    for c in columns:
        v = F.col(clip[c])
        told[mid[c]] = F.coalesce(F.try_divide(F.sum(v * weight).over(day), F.sum(F.when(v.isNotNull(), weight)).over(day)), F.avg(v).over(day))
        told[sd[c]] = F.when(F.count(v).over(day) >= 3, F.when(F.min(v).over(day) == F.max(v).over(day), F.lit(0.0)).otherwise(F.stddev_samp(v).over(day)))
    out = out.withColumns(told)
    scaled = {c: F.when(F.col(sd[c]).isNotNull() & F.col(clip[c]).isNotNull(), F.coalesce(F.try_divide(F.col(clip[c]) - F.col(mid[c]), F.col(sd[c])), F.lit(0.0))) for c in columns}
    return out.withColumns(scaled).drop(*clip.values(), *n.values(), *mid.values(), *sd.values())


def style_exposures(df: DataFrame, styles: dict[str, list[str]], cap: str) -> DataFrame:
    """df with a column for each style: the mean of its standardised descriptors that are there, standardised again; 0 where none is."""
    parts = {d: free(df, f"risk_part_{d}") for members in styles.values() for d in members}
    out = standardise(df, {new: old for old, new in parts.items()}, cap)
    mean = {}
    for style, members in styles.items():
        n = sum((F.when(F.col(parts[d]).isNotNull(), 1.0).otherwise(0.0) for d in members), F.lit(0.0))
        mean[style] = F.try_divide(sum((F.coalesce(F.col(parts[d]), F.lit(0.0)) for d in members), F.lit(0.0)), n)
    out = standardise(out.withColumns(mean).drop(*parts.values()), {s: s for s in styles}, cap)
    return out.withColumns({s: F.coalesce(F.col(s), F.lit(0.0)) for s in styles})


@dataclass(frozen=True)
class RiskModel:
    """names of the factors; exposures (instrument, date, x); factor_returns (date, place, n, beta); residuals (instrument, date, place, residual). place numbers the dates that have factor returns."""

    names: list[str]
    exposures: DataFrame
    factor_returns: DataFrame
    residuals: DataFrame

    def _served(self, rows: DataFrame, signals: list[int], lookback: int, half_life: float) -> DataFrame:
        """Rows of a place, once for each signal date whose last lookback factor returns they are among, with their weight there. Signal dates are as many as a user names."""
        found = self.factor_returns.agg(F.lit(0).alias("zero"), *[F.max(F.when(F.col(DATE) <= s, F.col("place"))).alias(str(s)) for s in signals]).head().asDict()
        places = {s: p for s, p in found.items() if s != "zero"}
        known = [(int(s), p) for s, p in places.items() if p is not None and p >= lookback]
        if not known:
            return rows.where("false").withColumns({"signal": F.lit(0), "weight": F.lit(0.0)})
        at = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(p).cast("int").alias("p")) for s, p in known]))
        out = rows.withColumn("served", at).where((F.col("place") <= F.col("served.p")) & (F.col("place") > F.col("served.p") - lookback))
        return out.withColumns({"signal": F.col("served.s"), "weight": F.pow(F.lit(0.5), (F.col("served.p") - F.col("place")) / F.lit(float(half_life)))}).drop("served")

    def covariance(self, signals: list[int], lookback: int = 240, half_life: float = 90.0) -> DataFrame:
        """Rows (signal, factor_i, factor_j, covariance): of the last lookback factor returns up to each signal date, the newest with weight 1, halving every half_life; deviations are from the weighted mean. A signal date with a shorter history has none."""
        if half_life <= 0:
            raise ValueError("half_life must be positive")
        names = self.names

        def matrix(f: pd.DataFrame) -> pd.DataFrame:
            w = f["weight"].to_numpy() / f["weight"].sum()
            x = np.stack(f["beta"].to_numpy())
            x = x - w @ x
            c = (x * w[:, None]).T @ x
            i, j = np.meshgrid(np.arange(len(names)), np.arange(len(names)), indexing="ij")
            return pd.DataFrame({"signal": f["signal"].iloc[0], "factor_i": np.array(names)[i.ravel()], "factor_j": np.array(names)[j.ravel()], "covariance": c.ravel()})

        rows = self._served(self.factor_returns, signals, lookback, half_life).select("signal", "weight", "beta")
        return rows.groupBy("signal").applyInPandas(matrix, "signal int, factor_i string, factor_j string, covariance double")

    def specific(self, signals: list[int], lookback: int = 240, half_life: float = 90.0, least: int = LEAST_RESIDUALS) -> DataFrame:
        """Rows (signal, instrument, n, volatility): the root of the weighted mean square of the residuals in the lookback; instruments with fewer than least take the median of the others."""
        rows = self._served(self.residuals, signals, lookback, half_life)
        w, e = F.col("weight"), F.col("residual")
        out = rows.groupBy("signal", KEY).agg(F.count(e).alias("n"), F.sum(w * e * e).alias("square"), F.sum(F.when(e.isNotNull(), w)).alias("mass"))
        own = F.when(F.col("n") >= least, F.try_divide("square", "mass"))
        return out.select("signal", KEY, "n", F.sqrt(F.coalesce(own, F.median(own).over(Window.partitionBy("signal")))).alias("volatility"))


def risk_model(df: DataFrame, y: str, cap: str, group: str, styles: dict[str, list[str]], *, least: int = 0) -> RiskModel:
    """The model of a panel with the return y of each row, the cap, the group and the styles' descriptors.

    Factors are a dummy for each group there is, one for rows without a group, and the styles. A date's returns are fitted on the
    exposures of the date before, of the instruments that have both, weighted by the root of that date's cap; dates with no more
    such rows than factors, or fewer than least, have no factor returns. A factor without members on a date returns 0 there.
    """
    groups = members_of(df, group)
    names = [f"{group}_{g}" for g in groups] + [f"{group}_unknown", *styles]
    out = style_exposures(df, styles, cap)
    unknown = F.array(F.when(F.col(f"`{group}`").isNull(), F.lit(1.0)).otherwise(F.lit(0.0)))
    x = F.concat(dummies(F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("")), [str(g) for g in groups]), unknown, F.array(*[F.col(s) for s in styles]).cast("array<double>"))
    exposures = out.select(KEY, DATE, x.alias("x"), F.col(f"`{cap}`").cast("double").alias("cap"))
    dates = df.select(DATE).distinct().withColumn("next", F.lead(DATE).over(Window.orderBy(DATE)))  # one row a date
    before = exposures.join(dates, DATE).where("next is not null").select(KEY, F.col("next").alias(DATE), "x", "cap")
    told = df.select(KEY, DATE, F.col(f"`{y}`").cast("double").alias("y")).join(before, [KEY, DATE])
    beta = fits(told, F.col("y"), F.col("x"), F.sqrt(F.when(F.col("cap") > 0, F.col("cap"))), least=max(least, len(names) + 1))
    returns = beta.withColumn("place", F.row_number().over(Window.orderBy(DATE))).persist()  # one row a date; signal dates look their places up in it before the residuals read it again
    use = (F.col("cap") > 0) & F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") < float("inf"))
    residuals = told.where(use).join(returns.select(DATE, "place", "beta"), DATE).select(KEY, DATE, "place", (F.col("y") - dot(F.col("x"), F.col("beta"))).alias("residual"))
    return RiskModel(names, exposures.select(KEY, DATE, "x"), returns, residuals)


def exposure_limits(names: list[str], group: str, *, groups: float | None = 0.03, size: float | None = 0.2, styles: float | None = None) -> dict[str, float]:
    """The most that a portfolio's exposure to each factor may differ from the benchmark's; None is no limit."""
    for limit in (groups, size, styles):
        if limit is not None and (limit < 0 or math.isnan(limit)):
            raise ValueError("limits must not be negative")
    told = lambda x: UNBOUNDED if x is None else float(x)
    return {n: told(groups if n.startswith(f"{group}_") else size if n == "size" else styles) for n in names}
