"""Kernels that users write in numpy: along an instrument's history (series) or across a date (cross). A library collects kernels by name, each with declared outputs.

A kernel sees plain arrays in which missing values are not-a-number, and gives one array for each output. All series kernels
of a call run in one grouped stage, and all cross kernels in another; every other column passes through as it is, of any type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.operators.cross_section import DATE
from factorloom.operators.names import free
from factorloom.operators.series import KEY, ORDER

#: Of arrays by input name, and the rows' calendar ordinals (series) or instruments (cross): arrays by output name.
Function = Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]
SERIES, CROSS = "series", "cross"


@dataclass(frozen=True)
class Kernel:
    """A function with the columns that it reads and the columns that it declares. inputs: its names, as columns or column names."""

    kind: str
    inputs: dict[str, Column | str]
    outputs: tuple[str, ...]
    function: Function

    def __post_init__(self):
        if self.kind not in (SERIES, CROSS):
            raise ValueError(f"a kernel runs along a series or across a date, not {self.kind!r}")
        if not self.outputs:
            raise ValueError("a kernel declares at least one output")


def _run(df: DataFrame, kernels: list[Kernel], key: str, order: str) -> DataFrame:
    """df with the kernels' outputs: one shuffle by key, one pass over each group, sorted by order. Groups are as long as a history, or as a date has instruments."""
    outputs = [o for k in kernels for o in k.outputs]
    taken = {c.lower() for c in df.columns}
    clash = [o for i, o in enumerate(outputs) if o.lower() in taken or o in outputs[:i]]
    if clash:
        raise ValueError(f"outputs that are columns already, or declared twice: {clash}")
    base, places = df.columns, []
    for i, k in enumerate(kernels):
        for name, c in k.inputs.items():
            at = free(df, f"kernel_{i}_{name}")
            df = df.withColumn(at, (F.col(f"`{c}`") if isinstance(c, str) else c).cast("double"))
            places.append((i, name, at))

    run = [(k.outputs, k.function, [(name, place) for j, name, place in places if j == i]) for i, k in enumerate(kernels)]  # what tasks need: no columns

    def along(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(order, "ascending")]))
        at = table[order].to_numpy()
        out = table.select(base)
        for outs, function, read in run:
            told = function({name: np.array(table[place].to_numpy(), dtype=float) for name, place in read}, at)
            for o in outs:
                values = np.asarray(told[o], dtype=float)
                if values.shape != at.shape:
                    raise ValueError(f"{o} has {values.shape} values for {at.shape} rows")
                out = out.append_column(pa.field(o, pa.float64()), pa.array(np.where(np.isfinite(values), values, np.nan), pa.float64(), from_pandas=True))
        return out

    schema = T.StructType([df.schema[c] for c in base] + [T.StructField(o, T.DoubleType()) for o in outputs])
    return df.groupBy(key).applyInArrow(along, schema)


def apply(df: DataFrame, kernels: Iterable[Kernel]) -> DataFrame:
    """df with the outputs of all kernels: series kernels first, so that cross kernels may read their outputs. Infinite results are missing. Rows of one key and ordinal stay, in any order among themselves; a key that is null is a group too."""
    kernels = list(kernels)
    for kind, key, order in ((SERIES, KEY, ORDER), (CROSS, DATE, KEY)):
        some = [k for k in kernels if k.kind == kind]
        if some:
            df = _run(df, some, key, order)
    return df


class Library:
    """Named kernels that a user adds; a build asks for some of them by name."""

    def __init__(self) -> None:
        self._kernels: dict[str, Kernel] = {}

    def add(self, name: str, kind: str, inputs: dict[str, Column | str] | Iterable[str], outputs: Iterable[str] | None = None) -> Callable[[Function], Function]:
        """A decorator. inputs may be a list of column names; without outputs, the kernel has one of its own name."""
        if name in self._kernels:
            raise ValueError(f"{name!r} is there already")
        known = inputs if isinstance(inputs, dict) else {c: c for c in inputs}

        def keep(function: Function) -> Function:
            self._kernels[name] = Kernel(kind, dict(known), tuple(outputs or (name,)), function)
            return function

        return keep

    def names(self) -> list[str]:
        return sorted(self._kernels)

    def build(self, df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
        """df with the named kernels' outputs, all of them if no name is given."""
        names = list(self._kernels) if names is None else list(dict.fromkeys(names))
        unknown = [n for n in names if n not in self._kernels]
        if unknown:
            raise KeyError(f"no kernel named {unknown}")
        return apply(df, [self._kernels[n] for n in names])
