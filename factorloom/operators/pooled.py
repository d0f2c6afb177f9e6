"""Statistics over rows pooled across instruments and several dates.

Dates are dealt to blocks; a row goes to its date's block, and to the next one if a frame there reaches back to it. So a row is shuffled
once, and a few twice, whatever the frame's length, and a task holds one block: as many dates, times the instruments of a date.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.operators.cross_section import DATE


def tail_index(df: DataFrame, x: Column, dates: int = 21, share: float = 0.05, least: int = 100, *, since: int | None = None, block: int = 0) -> DataFrame:
    """Rows (date, n, threshold, tail), one for each date that df has: over the values of the last dates ordinals, the quantile of share, linear between values, and the mean logarithm of the ratio to it of the values below it.

    tail is missing where fewer than least values are there, where the quantile is not negative, where nothing lies below it, and on dates whose
    frame starts before since. Missing and infinite values don't count; ties at the quantile lie not below it.
    """
    if dates < 1 or not 0 < share < 1:
        raise ValueError("a frame has a date or more, and a share lies between 0 and 1")
    size = max(block or 10 * dates, dates)
    value = x.cast("double")
    rows = df.where(F.col(DATE).isNotNull()).select(F.col(DATE).cast("int").alias(DATE), F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value).alias("x"))
    of = lambda d: F.floor(d / size).cast("int")
    rows = rows.withColumn("block", F.explode(F.array_distinct(F.array(of(F.col(DATE)), of(F.col(DATE) + dates - 1)))))

    def told(f: pd.DataFrame) -> pd.DataFrame:
        at, v = f[DATE].to_numpy(), f["x"].to_numpy(dtype=float)
        order = np.argsort(at, kind="stable")
        at, v = at[order], v[order]
        out = []
        for d in np.unique(at[at // size == f["block"].iloc[0]]):
            pool = v[np.searchsorted(at, d - dates + 1) : np.searchsorted(at, d, side="right")]
            pool = pool[np.isfinite(pool)]
            q = float(np.quantile(pool, share)) if len(pool) else np.nan
            below = pool[pool < q]
            fine = len(pool) >= least and q < 0 and len(below) and (since is None or d - dates + 1 >= since)
            out.append((int(d), len(pool), q, float(np.log(below / q).mean()) if fine else np.nan))
        told = pd.DataFrame(out, columns=[DATE, "n", "threshold", "tail"])
        return told.astype({"threshold": "Float64", "tail": "Float64"})

    return rows.groupBy("block").applyInPandas(told, f"{DATE} int, n long, threshold double, tail double")
