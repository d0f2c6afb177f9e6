"""Recursions along one instrument: a step function with carried state, run in one pass over the instrument's sorted history."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from factorloom.operators.series import KEY, ORDER


def along(df: DataFrame, columns: list[str], step: Callable[[Any, int, tuple], tuple[Any, float | None]], out: str = "value") -> DataFrame:
    """Rows (KEY, ORDER, out). step(state, gap, row's columns) gives the next state and the row's value; the first row has state None, and gap counts calendar rows since the row before.

    Any recursive average or state machine can be told this way. Memory is bounded by one instrument's history.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(ORDER)
        state, told, before = None, [], None
        for at, *row in f[[ORDER, *columns]].itertuples(index=False):
            state, value = step(state, 1 if before is None else int(at - before), tuple(row))
            told.append(value)
            before = at
        return pd.DataFrame({KEY: f[KEY].to_numpy(), ORDER: f[ORDER].to_numpy(), out: pd.array(told, dtype="Float64")})

    kinds = dict(df.dtypes)
    return df.select(KEY, ORDER, *columns).groupBy(KEY).applyInPandas(run, f"{KEY} {kinds[KEY]}, {ORDER} {kinds[ORDER]}, {out} double")


def ema(alpha: float, least: int = 1) -> Callable:
    """The exponential average; what came before loses weight over missing rows too, and the first least - 1 rows have no value."""

    def step(state, gap, row):
        x = row[0]
        if state is None:
            return (x, 1), x if least <= 1 else None
        y, n = state
        old = (1 - alpha) ** gap
        y = (old * y + alpha * x) / (old + alpha)
        return (y, n + 1), y if n + 1 >= least else None

    return step


def dma(state, gap, row):
    """y = a x + (1 - a) y before, with a weight a of each row, at most 1."""
    x, a = row
    y = x if state is None else min(a, 1.0) * x + (1 - min(a, 1.0)) * state
    return y, y
