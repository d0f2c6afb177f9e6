"""Embedding whitening: exactly centred rows, their Gramian by MLlib's RowMatrix, a local eigendecomposition, and the projection in tasks.

Vectors become whole numbers first, so that n and the sums by dimension are exact and centring is one subtraction of whole numbers.
What the driver holds is one number for each pair of dimensions, whatever the number of rows. Nothing is shuffled but sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A vector's numbers become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Numbers of this size and more are not told exactly in whole steps; their vectors are left out like infinite ones.
_MOST = 2.0**46
_LOW = (1 << 26) - 1
_LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    """Whether a vector is there, and holds neither null nor not-a-number, infinite or huge numbers."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _MOST))


def whole(vector: Column) -> Column:
    """In whole numbers; null where a number isn't usable, since the optimizer may ask before rows are left out."""
    return F.transform(vector, lambda c: F.when(F.abs(c) < _MOST, F.floor(c * SCALE).cast("long") + SHIFT))


def sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length of the column x: the number of rows and the exact sum of each dimension. High and low bits are summed apart, so nothing overflows."""
    parts = rows.select(F.size("x").alias("d"), F.posexplode("x").alias("at", "v")).groupBy("d", "at")
    found = parts.agg(F.count("*").alias("n"), F.sum(F.shiftright("v", 26)).alias("high"), F.sum(F.col("v").bitwiseAND(F.lit(_LOW))).alias("low")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(found, key=lambda r: (r["d"], r["at"])):
        out.setdefault(r["d"], (r["n"], []))[1].append((r["high"] << 26) + r["low"])
    return out


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x less the sums: in machine integers where they hold them, else in Python's."""
    largest = max(n * int(np.abs(x).max(initial=0)), max(map(abs, total), default=0))
    if largest < 2**62:
        return x * np.int64(n) - np.array(total, dtype=np.int64)
    return x.astype(object) * n - np.array(total, dtype=object)


def squares(apart: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; null where a long doesn't hold it."""
    if apart.dtype != object and apart.shape[1] * float(np.abs(apart).max(initial=0)) ** 2 < 2.0**62:
        return (apart * apart).sum(axis=1).tolist()
    told = [sum(int(v) ** 2 for v in row) for row in apart]
    return [v if v <= _LONG else None for v in told]


def gramian(rows: DataFrame, n: int, d: int) -> np.ndarray:
    """The Gramian of the array column v, divided by n, by RowMatrix."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v")
    return RowMatrix(vectors, n, d).computeGramianMatrix().toArray() / n


@dataclass(frozen=True)
class Whitening:
    """Of vectors of one length: their number, the exact sums, the projection (a column for each component, falling eigenvalues), and shares of the trace."""

    n: int
    total: list[int]
    projection: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return deviations(x, self.n, self.total).astype(np.float64) / self.n


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """By vector length, the whitening of rows with an array of long x. Components whose eigenvalue is nothing but rounding are left out, so a flat dimension, or one row alone, gives fewer."""
    out = {}
    for d, (n, total) in sums(rows).items():
        plain = Whitening(n, total, np.zeros((d, 0)), np.zeros(0))

        def centre(batches: Iterator[pd.DataFrame], known: Whitening = plain) -> Iterator[pd.DataFrame]:
            for f in batches:
                if len(f):
                    yield pd.DataFrame({"v": list(known.centred(np.stack(f["x"].to_numpy())))})

        covariance = gramian(rows.where(F.size("x") == d).select("x").mapInPandas(centre, "v array<double>"), n, d)
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        values, vectors, trace = values[::-1], vectors[:, ::-1], float(np.trace(covariance))
        real = np.flatnonzero(values > trace * d * np.finfo(float).eps)[:components]
        out[d] = Whitening(n, total, vectors[:, real] / np.sqrt(values[real]), values[real] / trace if len(real) else np.zeros(0))
    return out


def transform(rows: DataFrame, found: dict[int, Whitening]) -> DataFrame:
    """Of rows (id as string, x): id, length d, n, deviation, and the components whitened and explained as arrays."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for d, g in f.groupby(f["x"].map(len)):
                if d not in found:
                    continue
                w, x = found[d], np.stack(g["x"].to_numpy())
                apart = deviations(x, w.n, w.total)
                told = apart.astype(np.float64) / w.n @ w.projection
                yield pd.DataFrame({"id": g["id"].to_numpy(), "d": d, "n": w.n, "deviation": pd.array(squares(apart), dtype="Int64"), "whitened": list(told), "explained": [w.explained] * len(g)})

    return rows.select("id", "x").mapInPandas(project, "id string, d int, n long, deviation long, whitened array<double>, explained array<double>")


def identity_errors(whitened: DataFrame, found: dict[int, Whitening]) -> dict[int, float]:
    """By vector length, the largest absolute entry of the whitened rows' covariance less the identity, centred by means taken in the same pass; 0 where there is no component."""
    out = {}
    for d, w in found.items():
        k = w.projection.shape[1]
        if not k:
            out[d] = 0.0
            continue
        g = gramian(whitened.where(F.col("d") == d).select(F.concat("whitened", F.array(F.lit(1.0))).alias("v")), w.n, k + 1)
        out[d] = float(np.abs(g[:k, :k] - np.outer(g[:k, k], g[:k, k]) - np.eye(k)).max())
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row of df with a usable vector: the id, n, deviation (the sum of (n x - S)^2 over dimensions), arrays whitened and explained, and identity_error.

    Vectors that are null, or hold null, non-finite or huge numbers (2^46 and more) are left out. Vectors of each length have a
    whitening of their own. Repeated rows and rows without an id count and are told each; deviation is null where a long does
    not hold it. Equal eigenvalues leave the choice of axes to the solver. No usable vector, or vectors of no dimensions, give no rows.
    Other columns of df play no part, whatever their names.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), vector.alias("vector")).where(usable(F.col("vector"))).select("id", whole(F.col("vector")).alias("x"))
    found = fit(rows, components)
    out = transform(rows, found)
    errors = identity_errors(out, found)
    known = F.create_map(*[F.lit(v) for pair in errors.items() for v in pair])[F.col("d")] if errors else F.lit(None).cast("double")
    return out.select(F.col("id").cast(dict(df.dtypes)[id_col]).alias(id_col), "n", "deviation", "whitened", "explained", known.alias("identity_error"))


def by_component(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component, numbered from 1."""
    both = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "told")
    return whitened.select(id_col, "n", "deviation", "identity_error", both).select(id_col, (F.col("at") + 1).alias("component"), "n", "deviation", "told.whitened", "told.explained", "identity_error")
