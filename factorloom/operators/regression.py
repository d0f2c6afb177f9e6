"""Rolling regressions along an instrument with any number of regressors, and what is read off them: betas, residual moments, price delay.

Windows are of the calendar: window rows, or every stride-th row back from a row. Rows where y or a regressor is missing drop out.
Cross-products are summed window by window, not as differences of running sums, so a constant or repeated regressor is seen as
what it is; such windows take the solution of least norm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.operators import kernels
from factorloom.operators.series import ORDER

#: Numbers of a block of windows at once.
_BLOCK = 1 << 20
#: Below this part of the largest eigenvalue, at unit diagonal, a matrix has a dimension too few.
_SINGULAR = 1e-11


def least_norm(gram: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stacked normal equations: the solutions and the inverses; where a matrix is singular, those of least norm (Moore-Penrose).

    Whether it is singular is judged at unit diagonal, so the regressors' units don't count.
    """
    k = gram.shape[-1]
    size = np.sqrt(np.einsum("nii->ni", gram))
    none = size == 0  # a regressor that is nowhere has a coefficient of exactly 0
    size = np.where(none, 1.0, size)
    scaled = gram / size[:, :, None] / size[:, None, :]
    rank = (np.linalg.eigvalsh(scaled) > _SINGULAR).sum(axis=1)
    inverse = np.empty_like(gram)
    whole = rank == k
    inverse[whole] = np.linalg.inv(scaled[whole]) / size[whole][:, :, None] / size[whole][:, None, :]
    if not whole.all():
        values, vectors = np.linalg.eigh(gram[~whole])
        kept = np.arange(k)[None, :] >= k - rank[~whole][:, None]
        inverse[~whole] = np.einsum("nij,nj,nkj->nik", vectors, np.where(kept, 1.0 / np.where(kept, values, 1.0), 0.0), vectors)
    inverse[none] = 0.0
    inverse.transpose(0, 2, 1)[none] = 0.0
    return np.einsum("nij,nj->ni", inverse, right), inverse


def _windows(at: np.ndarray, columns: list[np.ndarray], window: int, stride: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Blocks of rows, with (rows, window, columns) of the values in each row's window, oldest first; where the calendar has no row, not-a-number."""
    place = at - at[0]
    reach = (window - 1) * stride
    dense = np.full((reach + int(place[-1]) + 1, len(columns)), np.nan)
    dense[reach + place] = np.column_stack(columns)
    back = np.arange(window) * stride - reach
    many = max(1, _BLOCK // (window * len(columns)))
    for a in range(0, len(at), many):
        rows = slice(a, min(a + many, len(at)))
        yield rows, dense[reach + place[rows][:, None] + back[None, :]]


def _fits(values: np.ndarray, least: int):
    """Of windows (rows, window, 1 + regressors): which values count, the design with a constant, y, the number of rows, the solution, and the inverse; windows of fewer rows than least are not solved."""
    known = np.isfinite(values).all(axis=2)
    n = known.sum(axis=1)
    design = np.concatenate([np.ones((*values.shape[:2], 1)), values[:, :, 1:]], axis=2)
    design = np.where(known[:, :, None], design, 0.0)
    y = np.where(known, values[:, :, 0], 0.0)
    beta = np.full((len(values), design.shape[2]), np.nan)
    inverse = np.full((len(values), design.shape[2], design.shape[2]), np.nan)
    fine = n >= least
    if fine.any():
        d = design[fine]
        beta[fine], inverse[fine] = least_norm(np.einsum("nwi,nwj->nij", d, d), np.einsum("nwi,nw->ni", d, y[fine]))
    return known, design, y, n, beta, inverse


def _divide(a, b):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / b, np.nan)


def rolling_ols(df: DataFrame, y: Column | str, xs: list[Column | str], window: int, least: int, *, stride: int = 1, since: int | None = None, slices: dict[str, tuple[int, int]] | None = None, prefix: str = "") -> DataFrame:
    """df with columns, each under the prefix: n (rows counted), b0 to bk (constant first), slopes (their sum without the constant), resid_std, resid_skew, coskew, and one for each slice.

    A window counts with least rows or more, and if it starts at since or later; without since, at any time. resid_std has n - k - 1
    degrees of freedom. coskew is the residuals' mean product with the squared deviation of the first regressor, over the
    residuals' deviation and that regressor's variance. A slice (first, last) of the window's positions gives the mean of its
    residuals over their sample deviation, if it has half of its rows. Residuals that are nothing but rounding have no moments.
    """
    slices = dict(slices or {})
    names = ["n", *[f"b{i}" for i in range(len(xs) + 1)], "slopes", "resid_std", "resid_skew", "coskew", *slices]
    inputs = {"y": y, **{f"x{i}": x for i, x in enumerate(xs)}}

    def along(columns: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
        out = {prefix + name: np.full(len(at), np.nan) for name in names}
        for rows, values in _windows(at, list(columns.values()), window, stride):
            known, design, target, n, beta, _ = _fits(values, least)
            k = design.shape[2]
            if since is not None:
                beta[at[rows] - (window - 1) * stride < since] = np.nan
            e = np.where(known, target - np.einsum("nwk,nk->nw", design, beta), 0.0)
            square, cube = (e**2).sum(axis=1), (e**3).sum(axis=1)
            real = square > 1e-14 * np.maximum((target**2).sum(axis=1), 1e-300)
            told = {"n": np.where(np.isnan(beta[:, 0]), np.nan, n), "slopes": beta[:, 1:].sum(axis=1), **{f"b{i}": beta[:, i] for i in range(k)}}
            told["resid_std"] = np.sqrt(_divide(square, np.where(n > k, n - k, 0)))
            told["resid_skew"] = _divide(_divide(cube, n), _divide(square, n) ** 1.5)
            if k > 1:
                apart = np.where(known, design[:, :, 1] - _divide(design[:, :, 1].sum(axis=1), n)[:, None], 0.0) ** 2
                told["coskew"] = _divide(_divide((e * apart).sum(axis=1), n), np.sqrt(_divide(square, n)) * _divide(apart.sum(axis=1), n))
            for name, (first, last) in slices.items():
                part, some = e[:, first:last], known[:, first:last]
                m = some.sum(axis=1)
                mean = _divide(part.sum(axis=1), m)
                spread = np.sqrt(_divide((np.where(some, part - mean[:, None], 0.0) ** 2).sum(axis=1), m - 1))
                told[name] = np.where(m >= (last - first) // 2, _divide(mean, spread), np.nan)
            for name, v in told.items():
                if name not in ("n", "slopes") and not name.startswith("b"):
                    v = np.where(real, v, np.nan)
                out[prefix + name][rows] = v
        return out

    return kernels.apply(df, [kernels.Kernel(kernels.SERIES, inputs, tuple(prefix + n for n in names), along)])


def dimson_beta(df: DataFrame, y: Column | str, market: Column | str, window: int, least: int, *, out: str = "dimson_beta") -> DataFrame:
    """df with the sum of the slopes on the market's return of the row before, the same row and the row after. A window that ends on a row needs the row after it, so its value stands on that one."""

    def along(columns: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
        place = at - at[0]
        n = int(place[-1]) + 1
        dense = np.full((n, 2), np.nan)
        dense[place] = np.column_stack([columns["y"], columns["m"]])
        m = np.concatenate([[np.nan], dense[:, 1], [np.nan]])
        sums = np.full(n, np.nan)
        for rows, values in _windows(np.arange(n), [dense[:, 0], m[:-2], m[1:-1], m[2:]], window, 1):
            sums[rows] = _fits(values, least)[4][:, 1:].sum(axis=1)
        return {out: np.concatenate([[np.nan], sums[:-1]])[place]}

    return kernels.apply(df, [kernels.Kernel(kernels.SERIES, {"y": y, "m": market}, (out,), along)])


def price_delay(df: DataFrame, y: Column | str, market: Column | str, window: int, least: int, *, lags: int = 4, prefix: str = "delay_") -> DataFrame:
    """df with rsq (1 less the part of the fit that the market's return of the same row explains alone), slope and tstat (lags weighted by their slopes, or slopes over standard errors, over the sum of all)."""

    def along(columns: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
        place = at - at[0]
        dense = np.full(int(place[-1]) + 1 + lags, np.nan)
        dense[lags + place] = columns["m"]
        shifted = [dense[lags + place - i] for i in range(lags + 1)]
        out = {prefix + name: np.full(len(at), np.nan) for name in ("rsq", "slope", "tstat")}
        for rows, values in _windows(at, [columns["y"], *shifted], window, 1):
            known, design, target, n, beta, inverse = _fits(values, least)
            alone = _fits(np.where(known[:, :, None], values[:, :, :2], np.nan), least)[4]
            mean = _divide(target.sum(axis=1), n)
            total = np.where(known, target - mean[:, None], 0.0)
            rest = np.where(known, target - np.einsum("nwk,nk->nw", design, beta), 0.0)
            rest1 = np.where(known, target - np.einsum("nwk,nk->nw", design[:, :, :2], alone), 0.0)
            total, rest, rest1 = ((v**2).sum(axis=1) for v in (total, rest, rest1))
            told = {"rsq": 1 - _divide(1 - _divide(rest1, total), 1 - _divide(rest, total))}
            weights = np.arange(lags + 1)
            told["slope"] = _divide(beta[:, 1:] @ weights, beta[:, 1:].sum(axis=1))
            error = np.sqrt(np.maximum(np.einsum("nii->ni", inverse)[:, 1:], 0.0) * _divide(rest, np.where(n > lags + 2, n - lags - 2, 0))[:, None])
            t = _divide(beta[:, 1:], error)
            told["tstat"] = _divide(t @ weights, t.sum(axis=1))
            for name, v in told.items():
                out[prefix + name][rows] = v
        return out

    return kernels.apply(df, [kernels.Kernel(kernels.SERIES, {"y": y, "m": market}, tuple(prefix + n for n in ("rsq", "slope", "tstat")), along)])


def calendar_start(df: DataFrame) -> int | None:
    """The first ordinal that any row has."""
    return df.agg(F.min(ORDER)).head()[0]


def downside_beta(y: Column, market: Column, d: int, least: int) -> Column:
    """Over the last d rows' frame: the covariance with the market over its variance, in the rows where the market lies below its mean of that frame."""
    from factorloom.operators.series import frame

    w = frame(d)
    rows = F.collect_list(F.struct(y.cast("double").alias("y"), market.cast("double").alias("m"))).over(w)
    mean = F.avg(market).over(w)
    none = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "y", "m", "ym", "mm")])

    def add(s: Column, r: Column) -> Column:
        apart = r["m"] - s["mean"]
        use = r["y"].isNotNull() & (apart < 0)
        more = {"n": F.lit(1.0), "y": r["y"], "m": apart, "ym": r["y"] * apart, "mm": apart * apart}
        return F.struct(s["mean"].alias("mean"), *[F.when(use, s[c] + v).otherwise(s[c]).alias(c) for c, v in more.items()])

    def told(s: Column) -> Column:
        return F.when(s["n"] >= least, F.try_divide(s["ym"] - s["y"] * s["m"] / s["n"], s["mm"] - s["m"] * s["m"] / s["n"]))

    return F.aggregate(rows, F.struct(mean.alias("mean"), *[none[c].alias(c) for c in ("n", "y", "m", "ym", "mm")]), add, told)


def frazzini_pedersen_beta(y: Column, market: Column, d: int, least: int) -> Column:
    """The correlation of three-row log returns, times the ratio of the one-row log returns' deviations, over the last d rows."""
    from factorloom.operators.series import frame, pair_correlation, ts_sum

    a, b = F.log1p(y), F.log1p(market)
    w = frame(d)
    both = F.when(a.isNotNull(), b)
    ratio = F.try_divide(F.stddev_samp(a).over(w), F.stddev_samp(both).over(w))
    enough = (F.count(a).over(w) >= least) & (F.count(both).over(w) >= least)
    return F.when(enough, pair_correlation(ts_sum(a, 3), ts_sum(b, 3), d, least) * ratio)
