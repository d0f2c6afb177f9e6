"""Formulas whose windows stand inside other windows: each window becomes a column of its own, level by level.

A level holds windows along instruments or cross-sections of weeks, never both. Levels that need no turn from one to the other between them are of one phase, and share a shuffle and a sort; between stages, rows stay in blocks of columns.
All of a level of a phase, with the values of one row before or after it, run in one stage of Arrow batches (`operators/batches.py`), which gets only the columns that are still read. Recursions stand in levels too, among the windows along instruments.
A step may run in a later phase than it could, where fewer columns are then shuffled between phases.
What feeds a window is rounded to 40 bits first: values that differ in their last bits only tie, in ranks, extremes and flat windows.
Division by zero is missing. Values of one row are written as columns, as arrays (missing is NaN) and as DuckDB SQL; windows as arrays and as SQL.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable
from functools import partial
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions import scalars as row
from factorloom.operators import batches
from factorloom.operators import cross_section as xs
from factorloom.operators import series as ts
from factorloom.plans.panel import _full, _lag, _w

C = F.col
ALONG, ACROSS = 0, 1
BITS = 40
_D = "OVER (PARTITION BY week_no)"
_PAST = "OVER (PARTITION BY instrument ORDER BY week_no ROWS UNBOUNDED PRECEDING)"


def snap_sql(x: str, bits: int = BITS) -> str:
    scale = f"power(2.0, {bits - 1} - floor(log2(abs({x}))))"
    return f"CASE WHEN abs({x}) < 1e-12 THEN 0.0 ELSE round_even({x} * {scale}, 0) / {scale} END"


Arrays = dict[str, np.ndarray]


class Term:
    """A value of every row: a column (made when a session is there), an array by those of the columns, its SQL, the level that it is known after, whether it needs no rounding, and the first phase that it can be known in."""

    def __init__(self, column: Callable[[], Column], array: Callable[[Arrays], np.ndarray], sql: str, level: float = -1, exact: bool = False, phase: int = 0):
        self.column, self.array, self.sql, self.level, self.exact, self.phase = column, array, sql, level, exact, phase

    def _with(self, other, how: Callable[[Column, Column], Column], sql: str, turned: bool = False, on: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Term:
        a, b = (constant(other), self) if turned else (self, constant(other))
        return Term(lambda: how(a.column(), b.column()), _on(on or how, a, b), sql.format(a.sql, b.sql), max(a.level, b.level), phase=max(a.phase, b.phase))

    def __add__(self, other):
        return self._with(other, lambda a, b: a + b, "({} + {})")

    def __radd__(self, other):
        return self._with(other, lambda a, b: a + b, "({} + {})", True)

    def __sub__(self, other):
        return self._with(other, lambda a, b: a - b, "({} - {})")

    def __rsub__(self, other):
        return self._with(other, lambda a, b: a - b, "({} - {})", True)

    def __mul__(self, other):
        return self._with(other, lambda a, b: a * b, "({} * {})")

    def __rmul__(self, other):
        return self._with(other, lambda a, b: a * b, "({} * {})", True)

    def __truediv__(self, other):
        return self._with(other, F.try_divide, "({} / nullif({}, 0))", on=_divided)

    def __rtruediv__(self, other):
        return self._with(other, F.try_divide, "({} / nullif({}, 0))", True, _divided)

    def __neg__(self):
        return Term(lambda: -self.column(), _on(np.negative, self), f"(-{self.sql})", self.level, phase=self.phase)

    def __lt__(self, other):
        return self._with(other, lambda a, b: row.told(a < b), "coalesce({} < {}, false)", on=np.less)

    def __gt__(self, other):
        return self._with(other, lambda a, b: row.told(a > b), "coalesce({} > {}, false)", on=np.greater)

    def __le__(self, other):
        return self._with(other, lambda a, b: row.told(a <= b), "coalesce({} <= {}, false)", on=np.less_equal)

    def __ge__(self, other):
        return self._with(other, lambda a, b: row.told(a >= b), "coalesce({} >= {}, false)", on=np.greater_equal)

    def __and__(self, other):
        return self._with(other, lambda a, b: a & b, "({} AND {})")

    def __or__(self, other):
        return self._with(other, lambda a, b: a | b, "({} OR {})")

    def __invert__(self):
        return Term(lambda: ~self.column(), _on(np.logical_not, self), f"(NOT {self.sql})", self.level, phase=self.phase)


def _on(how: Callable[..., np.ndarray], *terms: Term) -> Callable[[Arrays], np.ndarray]:
    """A function of the terms' arrays; it holds no columns, as tasks get it."""
    parts = [x.array for x in terms]
    return lambda arrays: how(*(f(arrays) for f in parts))


def named(name: str, exact: bool = False) -> Term:
    """A column of the table, as a number."""
    return Term(lambda: C(name), lambda arrays: arrays[name], name, exact=exact)


def _divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.where(b == 0, np.nan, b)


def _filled(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), y, x)


def snapped(x: np.ndarray, bits: int = BITS, zero: float = 1e-12) -> np.ndarray:
    """As `scalars.snap`."""
    wide = x * float(2 ** (53 - bits) + 1)
    return _filled(wide - (wide - x), x) * (np.abs(x) >= zero) + 0.0


def _powers(x: np.ndarray, e: np.ndarray) -> np.ndarray:
    told = np.power(x, e)
    return np.where((x > 0) & ~np.isnan(e) & np.isfinite(told), told, np.nan)  # NumPy has 1 for 1 to a missing power and for a missing value to the power of 0


def _names(x: Term) -> set[str]:
    """Columns that a term may read, by its SQL."""
    return set(re.findall(r"\w+", x.sql))


def week() -> Term:
    """The row's week, as a number."""
    return Term(lambda: C(ts.ORDER).cast("double"), named(ts.ORDER).array, "week_no::DOUBLE", exact=True)


def constant(x) -> Term:
    if isinstance(x, Term):
        return x
    value = np.float64(x)
    return Term(lambda: F.lit(float(x)), lambda arrays: value, f"{float(x)!r}::DOUBLE", exact=True)


def _same(x: Term, how: Callable[[Column], Column], sql: str, on: Callable[[np.ndarray], np.ndarray]) -> Term:
    return Term(lambda: how(x.column()), _on(on, x), sql.format(x=x.sql), x.level, phase=x.phase)


def smoothed(arrays: dict[str, np.ndarray], at: np.ndarray, alpha: float, group: np.ndarray | None = None) -> np.ndarray:
    """y = alpha x + (1 - alpha) y before; a missing value or calendar row has no y, and the next x starts anew, as does each group."""
    x = arrays["x"]
    if not len(x):
        return np.zeros(0)
    anew = np.isnan(x) | np.r_[True, np.isnan(x[:-1]) | (np.diff(at) != 1)]
    if group is not None:
        anew |= np.r_[True, np.diff(group) != 0]
    return averaged(x, np.flatnonzero(anew), alpha)


def averaged(x: np.ndarray, starts: np.ndarray, alpha: float) -> np.ndarray:
    """The exponential averages of many runs at once, place by place from each run's start; pandas' grouped averages take their time for every run, and each missing value is one."""
    lengths = np.diff(np.r_[starts, len(x)])
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    out, y = x.copy(), x[starts]
    for k in range(1, int(lengths[0])):
        at = starts[: np.searchsorted(-lengths, -k, side="left")] + k
        y, v = y[: len(at)], x[at]
        y = np.where(y == v, y, ((1 - alpha) * y + alpha * v) / ((1 - alpha) + alpha))
        out[at] = y
    return out


def held_slope(arrays: dict[str, np.ndarray], d: int) -> np.ndarray:
    """The slope of y on x over the last d rows that the flag holds on, however far back; it stays until the next such row. A constant x has none."""
    y, x = arrays["y"], arrays["x"]
    use = np.flatnonzero((arrays["flag"] == 1) & ~np.isnan(x) & ~np.isnan(y))
    if len(use) < d:
        return np.full(len(y), np.nan)
    ys, xs_ = (np.lib.stride_tricks.sliding_window_view(v[use], d) for v in (y, x))
    off = xs_ - xs_.mean(axis=1, keepdims=True)
    spread = (off**2).sum(axis=1)
    told = np.where(spread * d > 1e-8, (off * ys).sum(axis=1) / np.where(spread > 0, spread, 1), np.nan)
    latest = np.searchsorted(use[d - 1 :], np.arange(len(y)), side="right") - 1
    return np.where(latest >= 0, told[latest], np.nan)


def carried(arrays: dict[str, np.ndarray], at: np.ndarray, alpha: float, group: np.ndarray | None = None) -> np.ndarray:
    """The exponential average from the first value on; over missing values it stays, and what came before loses weight. Rows without an ordinal are no part of it."""
    out, own = np.full(len(at), np.nan), ~np.isnan(at.astype(float))
    group = np.zeros(len(at), int) if group is None else group
    if own.any():
        out[own] = pd.Series(arrays["x"][own]).groupby(group[own]).ewm(alpha=alpha, adjust=False, ignore_na=False).mean().to_numpy(float)
    return out


def blended(arrays: dict[str, np.ndarray]) -> np.ndarray:
    """y = w x + (1 - w) y before, with a weight of each row; the first y is x, and y stays where a value is missing."""
    y, told = np.nan, []
    for x, w in zip(arrays["x"].tolist(), arrays["w"].tolist(), strict=True):
        if x == x and w == w:
            y = x if y != y else w * x + (1 - w) * y
        told.append(y)
    return np.array(told, dtype=float)


def unbeaten_rows(arrays: dict[str, np.ndarray]) -> np.ndarray:
    """Rows directly before that are not above this one. What a later row reaches can't bound one after it, so each row is looked at twice at most."""
    highs: list[int] = []
    x, told = arrays["x"], np.full(len(arrays["x"]), np.nan)
    for i in np.flatnonzero(~np.isnan(x)).tolist():
        while highs and x[highs[-1]] <= x[i]:
            highs.pop()
        told[i] = i - 1 - (highs[-1] if highs else -1)
        highs.append(i)
    return told


def _run_of(how: batches.Window | None, inputs: list[Callable[[Arrays], np.ndarray]], names: list[str]) -> batches.Window:
    """What a stage runs for a step: a window of its inputs, or (None) the one input itself, from the arrays of names."""

    def run(g: batches.Groups, *arrays: np.ndarray) -> np.ndarray:
        known = dict(zip(names, arrays, strict=True))
        told = [np.broadcast_to(np.asarray(f(known), dtype=float), len(g.at)) for f in inputs]
        return told[0] if how is None else how(g, *told)

    return run


class Panel:
    """Collects the steps of some formulas; equal steps are made once."""

    def __init__(self) -> None:
        self.steps: dict[str, tuple[str, Term]] = {}
        self.windows: dict[str, tuple[batches.Window, list[Term]]] = {}
        self.rounded: set[str] = set()

    def _step(self, column: Callable[[], Column] | None, array: Callable[[Arrays], np.ndarray] | None, sql: str, level: float, exact: bool = False, phase: int = 0) -> Term:
        if sql not in self.steps:
            name = f"step_{len(self.steps)}"
            self.steps[sql] = (name, Term(column, array, sql, level, exact, phase))
        name, made = self.steps[sql]
        return Term(lambda: C(name), named(name).array, name, made.level, made.exact, made.phase)

    def _fixed(self, x) -> Term:
        """Rounded, as a column of its own."""
        x = constant(x)
        if x.exact:
            return x
        made = self._step(lambda: row.snap(x.column()), _on(snapped, x), snap_sql(x.sql), (x.level + floor(x.level) + 1) / 2, True, x.phase)
        if any(name in self.windows and not told.exact for name, told in self.steps.values() if name in _names(x)):
            self.rounded.add(made.sql)  # ranks are shorter than what is made of them
        return made

    def _window(self, kind: int, how: batches.Window, sql: Callable[..., str], *inputs, exact: bool = False, beside: tuple[str, ...] = ()) -> Term:
        """A function of the groups, the rounded inputs and the columns beside them."""
        fixed = [self._fixed(x) for x in inputs]
        level = int(max(x.level for x in fixed) + 1)
        level += level % 2 != kind
        phase = max(x.phase for x in fixed)
        phase += phase % 2 != kind
        made = self._step(None, None, sql(*[x.sql for x in fixed]), level, exact, phase)
        self.windows[made.sql] = (how, [*fixed, *(named(c) for c in beside)])
        return made

    def _across(self, how: Callable[..., np.ndarray], sql: Callable[..., str], x, exact: bool = False, beside: tuple[str, ...] = ()) -> Term:
        """A function of one week's rows."""
        return self._window(ACROSS, lambda g, *arrays: g.each(how, *arrays), sql, x, exact=exact, beside=beside)

    def _recursion(self, function: Callable[[dict[str, np.ndarray], batches.Groups], np.ndarray], sql: Callable[..., str], **inputs) -> Term:
        names = list(inputs)
        return self._window(ALONG, lambda g, *arrays: function(dict(zip(names, arrays, strict=True)), g), sql, *inputs.values())

    def _each(self, function: Callable[[dict[str, np.ndarray]], np.ndarray], sql: Callable[..., str], **inputs) -> Term:
        """A recursion of one history."""
        names = list(inputs)
        return self._recursion(lambda arrays, g: g.each(lambda *own: function(dict(zip(names, own, strict=True))), *arrays.values()), sql, **inputs)

    # along an instrument
    def delay(self, x, d):
        return self._window(ALONG, lambda g, a: batches.delay(g, a, d), lambda a: _lag(a, d), x, exact=True)

    def delta(self, x, d=1):
        return x - self.delay(x, d)

    def sum(self, x, d):
        return self._window(ALONG, lambda g, a: batches.weighted(g, a, [1.0] * d), lambda a: _full(d, f"sum({a})", a), x)

    def mean(self, x, d):
        return self._window(ALONG, lambda g, a: batches.weighted(g, a, [1.0] * d) / d, lambda a: _full(d, f"avg({a})", a), x)

    def product(self, x, d):
        return self._window(ALONG, lambda g, a: batches.product(g, a, d), lambda a: _full(d, f"product({a})", a), x)

    def ts_min(self, x, d):
        return self._window(ALONG, lambda g, a: batches.extreme(g, a, d, True), lambda a: _full(d, f"min({a})", a), x, exact=True)

    def ts_max(self, x, d):
        return self._window(ALONG, lambda g, a: batches.extreme(g, a, d, False), lambda a: _full(d, f"max({a})", a), x, exact=True)

    def std(self, x, d):
        return self._window(ALONG, lambda g, a: batches.deviation(g, a, d), lambda a: f"CASE WHEN min({a}) {_w(d)} = max({a}) {_w(d)} AND count({a}) {_w(d)} = {d} THEN 0.0 ELSE {_full(d, f'stddev_samp({a})', a)} END", x)

    def cov(self, x, y, d):
        return self._window(ALONG, lambda g, a, b: batches.covariance(g, a, b, d), lambda a, b: _full(d, f"covar_samp({a}, {b})", a, b), x, y)

    def corr(self, x, y, d):
        def sql(a: str, b: str) -> str:
            flat = f"min({a}) {_w(d)} = max({a}) {_w(d)} OR min({b}) {_w(d)} = max({b}) {_w(d)}"
            return f"CASE WHEN count({a}) {_w(d)} = {d} AND count({b}) {_w(d)} = {d} THEN CASE WHEN {flat} THEN 0.0 ELSE greatest(-1.0, least(1.0, corr({a}, {b}) {_w(d)})) END END"

        return self._window(ALONG, lambda g, a, b: batches.correlation(g, a, b, d), sql, x, y)

    def ts_rank(self, x, d):
        places = "(len(list_filter({v}, lambda y: y < {a})) + (len(list_filter({v}, lambda y: y = {a})) + 1) / 2) / {d}"
        return self._window(ALONG, lambda g, a: batches.place_in_window(g, a, d), lambda a: f"CASE WHEN count({a}) {_w(d)} = {d} THEN " + places.format(v=f"(list({a}) {_w(d)})", a=a, d=d) + " END", x, exact=True)

    def argmax(self, x, d):
        return self._window(ALONG, lambda g, a: batches.first_place(g, a, d, False), lambda a: f"CASE WHEN count({a}) {_w(d)} = {d} THEN list_position(list({a}) {_w(d)}, max({a}) {_w(d)})::DOUBLE END", x, exact=True)

    def argmin(self, x, d):
        return self._window(ALONG, lambda g, a: batches.first_place(g, a, d, True), lambda a: f"CASE WHEN count({a}) {_w(d)} = {d} THEN list_position(list({a}) {_w(d)}, min({a}) {_w(d)})::DOUBLE END", x, exact=True)

    def decay(self, x, d):
        """Weights 1 to d, the newest heaviest."""
        return self._window(
            ALONG,
            lambda g, a: batches.weighted(g, a, [k + 1.0 for k in range(d)]) / (d * (d + 1) / 2),
            lambda a: f"CASE WHEN count({a}) {_w(d)} = {d} THEN list_sum(list_transform(list({a}) {_w(d)}, lambda y, i: y * i)) / {d * (d + 1) / 2!r} END",
            x,
        )

    def wma(self, x, d):
        """Weights 0.9 to the power of the age."""
        whole = sum(0.9**k for k in range(d))
        return self._window(
            ALONG,
            lambda g, a: batches.weighted(g, a, [0.9 ** (d - 1 - k) for k in range(d)]) / whole,
            lambda a: f"CASE WHEN count({a}) {_w(d)} = {d} THEN list_sum(list_transform(list({a}) {_w(d)}, lambda y, i: y * power(0.9, {d} - i))) / {whole!r} END",
            x,
        )

    def trend(self, x, d):
        """The slope of the line through d rows, by row."""
        middle, whole = (d - 1) / 2, d * (d * d - 1) / 12
        return self._window(
            ALONG,
            lambda g, a: batches.weighted(g, a, [k - middle for k in range(d)]) / whole,
            lambda a: _full(d, f"regr_slope({a}, week_no::DOUBLE)", a),
            x,
        )

    def _rows_since(self, x, d, least: bool, sql: str):
        return self._window(ALONG, lambda g, a: d - batches.first_place(g, a, d, least, latest=True), lambda a: f"CASE WHEN count({a}) {_w(d)} = {d} THEN (list_position(list_reverse(list({a}) {_w(d)}), {sql}({a}) {_w(d)}) - 1)::DOUBLE END", x, exact=True)

    def highday(self, x, d):
        """Rows back to the latest maximum; 0 is this row."""
        return self._rows_since(x, d, False, "max")

    def lowday(self, x, d):
        return self._rows_since(x, d, True, "min")

    def climbed(self, x):
        """The product of 1 + x over all rows so far where x is positive."""
        past = "OVER (PARTITION BY instrument ORDER BY week_no ROWS UNBOUNDED PRECEDING)"
        return self._window(ALONG, lambda g, a: g.each(np.cumprod, np.where(a > 0, 1 + a, 1.0)), lambda a: f"exp(sum(CASE WHEN {a} > 0 THEN ln(1 + {a}) ELSE 0.0 END) {past})", x)

    def sma(self, x, n, m):
        """y = (m x + (n - m) y before) / n, anew after each missing value."""
        step = f"CASE WHEN v IS NULL THEN NULL WHEN y IS NULL THEN v ELSE (v * {float(m)!r} + y * {float(n - m)!r}) / {float(n)!r} END"
        return self._recursion(
            lambda arrays, g: smoothed(arrays, g.at, m / n, g.group),
            lambda a: f"list_reduce(list({a}) OVER (PARTITION BY instrument ORDER BY week_no ROWS UNBOUNDED PRECEDING), lambda y, v: {step})",
            x=x,
        )

    def slope_where(self, y, x, condition: Term, d):
        """Of y on x over the last d rows that meet the condition, held until the next such row."""

        def sql(b: str, a: str, c: str) -> str:
            rows = f"list({{'y': {b}, 'x': {a}, 'c': {c}}}) OVER (PARTITION BY instrument ORDER BY week_no ROWS UNBOUNDED PRECEDING)"
            add = lambda e: f"list_sum(list_transform(w, lambda s: {e}))"
            spread = f"({d} * {add('s.x * s.x')} - {add('s.x')} * {add('s.x')})"
            told = f"CASE WHEN len(w) = {d} AND {spread} > 1e-8 THEN ({d} * {add('s.x * s.y')} - {add('s.x')} * {add('s.y')}) / {spread} END"
            return f"list_transform([list_filter({rows}, lambda s: s.c = 1 AND s.x IS NOT NULL AND s.y IS NOT NULL)[-{d}:]], lambda w: {told})[1]"

        return self._each(partial(held_slope, d=d), sql, y=y, x=x, flag=self.where(condition, 1, 0))

    def ewm(self, x, alpha):
        """The exponential average that carries its value over missing rows."""
        f = 1 - alpha
        step = f"CASE WHEN y.y IS NULL THEN v WHEN v.y IS NULL THEN {{'y': y.y, 'w': y.w * {f!r}}} ELSE {{'y': (y.w * {f!r} * y.y + {alpha!r} * v.y) / (y.w * {f!r} + {alpha!r}), 'w': 1.0::DOUBLE}} END"
        return self._recursion(
            lambda arrays, g: carried(arrays, g.at, alpha, g.group),
            lambda a: f"list_reduce(list({{'y': {a}, 'w': 1.0::DOUBLE}}) {_PAST}, lambda y, v: {step}).y",
            x=x,
        )

    def blend(self, x, w):
        step = "CASE WHEN v.y IS NULL OR v.w IS NULL THEN y WHEN y.y IS NULL THEN v ELSE {'y': v.w * v.y + (1 - v.w) * y.y, 'w': v.w} END"
        first = "CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {{'y': {a}, 'w': {b}}} ELSE {{'y': NULL::DOUBLE, 'w': NULL::DOUBLE}} END"
        return self._each(blended, lambda a, b: f"list_reduce(list({first.format(a=a, b=b)}) {_PAST}, lambda y, v: {step}).y", x=x, w=w)

    def unbeaten(self, x, up=True):
        """Rows directly before that are not above this one, or not below it."""
        return self._each(
            lambda arrays: unbeaten_rows(arrays if up else {"x": -arrays["x"]}),
            lambda a: f"CASE WHEN {a} IS NOT NULL THEN coalesce(list_position(list_reverse(list_transform(list({a}) {_PAST}, lambda y: y {'>' if up else '<'} {a})), true) - 2, len(list({a}) {_PAST}) - 1)::DOUBLE END",
            x=x,
        )

    def streak(self, condition: Term):
        """Rows up to this one that meet the condition without a break."""
        place = week()
        broken = self._window(ALONG, lambda g, a: g.each(np.fmax.accumulate, a), lambda a: f"max({a}) {_PAST}", self.mask(place, ~condition), exact=True)
        first = self._window(ALONG, lambda g, a: g.each(np.fmin.accumulate, a), lambda a: f"min({a}) {_PAST}", place, exact=True)
        return place - self.fill_with(broken, first - 1)

    def scatter(self, x, d):
        """The mean absolute deviation from the window's mean."""
        return self._window(ALONG, lambda g, a: batches.scatter(g, a, d), lambda a: f"CASE WHEN count({a}) {_w(d)} = {d} THEN list_avg(list_transform(list({a}) {_w(d)}, lambda y: abs(y - avg({a}) {_w(d)}))) END", x)

    # across a week
    def market(self, x):
        """The week's mean, the same for all its rows."""
        return self._across(batches.mean_present, lambda a: f"avg({a}) {_D}", x)

    def rank(self, x):
        return self._across(batches.rank_present, lambda a: f"CASE WHEN {a} IS NOT NULL THEN (rank() OVER (PARTITION BY week_no ORDER BY {a} NULLS LAST) + (count(*) OVER (PARTITION BY week_no, {a}) - 1) / 2) / count({a}) {_D} END", x, exact=True)

    def scale(self, x):
        return self._across(batches.share, lambda a: f"{a} / nullif(sum(abs({a})) {_D}, 0)", x)

    def neutral(self, x, group: str):
        return self._across(batches.off_mean, lambda a: f"{a} - avg({a}) OVER (PARTITION BY week_no, {group})", x, beside=(group,))

    # of one row
    def where(self, condition: Term, a, b) -> Term:
        a, b = constant(a), constant(b)
        return Term(lambda: F.when(condition.column(), a.column()).otherwise(b.column()), _on(np.where, condition, a, b), f"CASE WHEN {condition.sql} THEN {a.sql} ELSE {b.sql} END", max(condition.level, a.level, b.level), phase=max(condition.phase, a.phase, b.phase))

    def mask(self, x, condition: Term) -> Term:
        """Missing where the condition does not hold."""
        x = constant(x)
        return Term(lambda: F.when(condition.column(), x.column()), _on(lambda c, a: np.where(c, a, np.nan), condition, x), f"CASE WHEN {condition.sql} THEN {x.sql} END", max(condition.level, x.level), phase=max(condition.phase, x.phase))

    def valid(self, *inputs: Term) -> Term:
        def column() -> Column:
            told = F.lit(True)
            for x in inputs:
                told = told & x.column().isNotNull()
            return told

        there = lambda *arrays: np.logical_and.reduce(np.broadcast_arrays(*(~np.isnan(a) for a in arrays)))
        return Term(column, _on(there, *inputs), "(" + " AND ".join(f"{x.sql} IS NOT NULL" for x in inputs) + ")", max(x.level for x in inputs), phase=max(x.phase for x in inputs))

    def root(self, x):
        return _same(x, lambda a: F.when(a >= 0, F.sqrt(a)), "CASE WHEN {x} >= 0 THEN sqrt({x}) END", np.sqrt)

    def fill_with(self, x, y) -> Term:
        return x._with(y, lambda a, b: F.coalesce(a, b), "coalesce({}, {})", on=_filled)

    def fill(self, x, value=0.0):
        return _same(x, lambda a: F.coalesce(a, F.lit(float(value))), f"coalesce({{x}}, {float(value)!r})", lambda a: _filled(a, value))

    def abs(self, x):
        return _same(x, F.abs, "abs({x})", np.abs)

    def sign(self, x):
        """Of the rounded value, so that differences of equal values are 0."""
        return _same(self._fixed(x), F.signum, "sign({x})::DOUBLE", np.sign)

    def log(self, x):
        return _same(x, row.log, "CASE WHEN {x} > 0 THEN ln({x}) END", lambda a: np.log(np.where(a > 0, a, np.nan)))

    def power(self, x, e):
        """Of a positive base; missing where the result is infinite."""
        e = constant(e)
        return x._with(e, lambda a, b: row.replace_inf(F.when(a > 0, F.pow(a, b))), f"CASE WHEN {x.sql} > 0 AND isfinite(power({x.sql}, {e.sql})) THEN power({x.sql}, {e.sql}) END", on=_powers)

    def lesser(self, x, y):
        return x._with(y, row.element_min, f"CASE WHEN {x.sql} IS NOT NULL AND {y.sql} IS NOT NULL THEN least({x.sql}, {y.sql}) END", on=np.minimum)

    def greater(self, x, y):
        return x._with(y, row.element_max, f"CASE WHEN {x.sql} IS NOT NULL AND {y.sql} IS NOT NULL THEN greatest({x.sql}, {y.sql}) END", on=np.maximum)

    def names(self) -> dict[str, object]:
        """What formulas may say."""
        base = {x: named(x, True) for x in ("open", "high", "low", "close", "volume", "amount", "vwap", "cap")}
        ops = ("delay", "delta", "sum", "mean", "product", "ts_min", "ts_max", "std", "cov", "corr", "ts_rank", "argmax", "argmin", "decay", "rank", "scale", "neutral", "where", "fill", "abs", "sign", "log", "power", "lesser", "greater", "wma", "trend", "highday", "lowday", "climbed", "sma", "slope_where", "ewm", "blend", "unbeaten", "streak", "scatter", "market", "mask", "valid", "root")
        return base | {x: getattr(self, x) for x in ops} | {"ret": base["close"] / self.delay(base["close"], 1) - 1, "flag": lambda c: self.where(c, 1, 0), "adv": lambda d: self.mean(base["volume"], d)}

    def _levels(self) -> list[list[tuple[str, Term]]]:
        levels = sorted({made.level for _, made in self.steps.values()})
        return [[x for x in self.steps.values() if x[1].level == level] for level in levels]

    def _phases(self, steps: list[tuple[str, Term]], read: dict[str, set[str]], end: int) -> dict[str, int]:
        """The phase that each step runs in: its first one, or a later one up to its readers', so that few columns are shuffled at the starts of phases, and rounded ones rather than others, as they compress better."""
        readers: dict[str, list[str]] = {}
        for name, _ in steps:
            for c in read[name]:
                readers.setdefault(c, []).append(name)

        def shuffled(phase: dict[str, int]) -> int:
            last = {c: max(phase[n] for n in names) for c, names in readers.items()} | {n: end for n, _ in steps if n not in readers}
            return sum(last[c] - phase.get(c, 0) for c in last)

        def options(name: str, made: Term, phase: dict[str, int]) -> range:
            until = min((phase[n] for n in readers.get(name, ())), default=end)
            return range(made.phase, until + 1, 2 if name in self.windows else 1)

        first = {name: made.phase for name, made in steps}
        late: dict[str, int] = {}
        for name, made in reversed(steps):
            late[name] = options(name, made, late)[-1]
        for phase in (first, late):
            for name, made in [*reversed(steps), *steps]:
                lowest = max((phase.get(c, 0) for c in read[name]), default=0)
                phase[name] = min((k for k in options(name, made, phase) if k >= lowest), key=lambda k: (shuffled(phase | {name: k}), k if name in self.rounded else -k))
        return min(first, late, key=shuffled)

    def apply(self, rows: DataFrame, outputs: Iterable[Term] | None = None, keep: Iterable[str] = (), laid: int | None = None) -> DataFrame:
        """The rows with a column for each step. If the outputs are named, a stage passes on no column that nothing after it reads and keep doesn't name, as Spark does not see into a stage. laid tells that the rows lie in whole histories by week (ALONG) already."""
        steps = [x for level in self._levels() for x in level]
        return self._run(rows, steps, {name: made.phase for name, made in steps}, None if outputs is None else {*keep}.union(*(_names(x) for x in outputs)), laid)

    def table(self, rows: DataFrame, terms: dict[str, Term], keep: Iterable[str], laid: int | None = None) -> DataFrame:
        """The columns of keep and those of the terms, by name, each made as soon as that makes rows narrower."""
        steps = [x for level in self._levels() for x in level]
        steps += [(name, Term(x.column, x.array, x.sql, (x.level + floor(x.level) + 1) / 2, phase=x.phase)) for name, x in terms.items()]
        steps.sort(key=lambda x: x[1].level)
        own = {name for name, _ in steps}
        known = {*rows.columns, *own}
        read = {name: {x.sql for x in self.windows[name][1] if x.sql in known} if name in self.windows else _names(made) & known for name, made in steps}
        phases = self._phases(steps, read, max(made.phase for _, made in steps))
        return self._run(rows, steps, phases, {*keep, *terms}, laid).select(*keep, *terms)

    def _run(self, rows: DataFrame, steps: list[tuple[str, Term]], phases: dict[str, int], last: set[str] | None, laid: int | None) -> DataFrame:
        """All steps by phase and level; last names the columns that are read at the end (None: all)."""
        reads = {name: set().union(*(_names(x) for x in self.windows[name][1])) if name in self.windows else _names(made) for name, made in steps}
        plans = [self._stages(steps, phases, eager) for eager in (False, True)]

        def sent(plan: list[tuple[int, list[tuple[str, Term]]]]) -> int:
            """Columns that pass from stage to stage."""
            later = [set(last or ()).union(*(reads[name] for _, after in plan[k + 1 :] for name, _ in after)) for k in range(len(plan))]
            return sum(len(later[k] & {*rows.columns, *(name for _, before in plan[: k + 1] for name, _ in before)}) for k in range(len(plan)))

        plan = min(plans, key=sent)
        windowed = [k for k, (_, now) in enumerate(plan) if any(name in self.windows for name, _ in now)]
        start, end = (windowed[0], windowed[-1] + 1) if windowed else (len(plan), len(plan))
        rows = self._columns(rows, plan[:start])
        known, parts = {*rows.columns}, []
        for k in range(start, end):
            phase, now = plan[k]
            read = None if last is None else {ts.KEY, ts.ORDER, *last}.union(*(reads[name] for _, later in plan[k + 1 :] for name, _ in later))
            known |= {name for name, _ in now}
            runs = {}
            for name, made in now:
                how, inputs = self.windows.get(name, (None, [made]))
                names = sorted(reads[name] & known)
                runs[name] = (_run_of(how, [x.array for x in inputs], names), names)
            kind = phase % 2 == ALONG if k in windowed else parts[-1].along
            parts.append(batches.Part(kind, runs, None if read is None else frozenset(read), frozenset(n for n in runs if n not in self.windows), frozenset(n for n in runs if read is not None and n not in read)))
        if len(parts) > 1:
            rows = batches.stages(rows, ts.KEY, xs.DATE, parts, laid == ALONG)
        elif parts:
            by = (ts.KEY, ts.ORDER) if parts[0].along else (xs.DATE, ts.KEY)
            rows = batches.stage(rows, *by, parts[0].runs, parts[0].keep, parts[0].along and laid == ALONG, parts[0].infinite, parts[0].inner)
        return self._columns(rows, plan[end:])

    def _columns(self, rows: DataFrame, plan: list[tuple[int, list[tuple[str, Term]]]]) -> DataFrame:
        """Values of one row before the first and after the last window."""
        for _, now in plan:
            for level in sorted({made.level for _, made in now}):
                rows = rows.withColumns({name: made.column() for name, made in now if made.level == level})
        return rows

    def _stages(self, steps: list[tuple[str, Term]], phases: dict[str, int], eager: bool) -> list[tuple[int, list[tuple[str, Term]]]]:
        """The steps by phase, one stage for each level of windows in it. Values of one row go with the windows before them (eager) or with those that read them; a phase without windows is one stage."""
        out = []
        for phase in sorted({*phases.values()}):
            now = [x for x in steps if phases[x[0]] == phase]
            levels = sorted({made.level for name, made in now if name in self.windows})
            parts: list[list[tuple[str, Term]]] = [[] for _ in levels or [0]]
            for name, made in now:
                at = bisect_left(levels, made.level)
                parts[at if name in self.windows else max(at - 1, 0) if eager else min(at, len(parts) - 1)].append((name, made))
            out += [(phase, part) for part in parts]
        return out

    def sql(self, source: str) -> tuple[str, str]:
        """Further WITH items that add the steps to the source, and the last one's name."""
        items, last = [], source
        for k, level in enumerate(self._levels()):
            items.append(f"level_{k} AS (SELECT *, " + ", ".join(f"{made.sql} AS {name}" for name, made in level) + f" FROM {last})")
            last = f"level_{k}"
        return "".join(f",\n{x}" for x in items), last
