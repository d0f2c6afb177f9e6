"""Operators along one instrument's calendar. Frames are ranges of the calendar's ordinal, so a missing row leaves a gap without a dense grid.

Every window of d rows is null unless all d values are there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

KEY, ORDER = "instrument", "week_no"


def frame(d: int, until: int = 0):
    """The last d calendar rows, ending so many rows ago."""
    return Window.partitionBy(KEY).orderBy(ORDER).rangeBetween(-(d - 1) - until, -until)


def full(d: int, value: Callable[[], Column], *inputs: Column) -> Column:
    """The aggregate over d rows if each input is there in all of them."""
    whole = F.lit(True)
    for x in inputs:
        whole = whole & (F.count(x).over(frame(d)) == d)
    return F.when(whole, value().over(frame(d)))


def delay(x: Column, d: int) -> Column:
    return F.max(x).over(frame(1, d))


def delta(x: Column, d: int) -> Column:
    return x - delay(x, d)


def returns(x: Column, d: int = 1) -> Column:
    return x / delay(x, d) - 1


def ts_sum(x: Column, d: int) -> Column:
    return full(d, lambda: F.sum(x), x)


def ts_mean(x: Column, d: int) -> Column:
    return full(d, lambda: F.avg(x), x)


def ts_min(x: Column, d: int) -> Column:
    return full(d, lambda: F.min(x), x)


def ts_max(x: Column, d: int) -> Column:
    return full(d, lambda: F.max(x), x)


def stddev(x: Column, d: int) -> Column:
    """Sample deviation; exactly 0 on a constant window."""
    return F.when(ts_min(x, d) == ts_max(x, d), F.lit(0.0)).otherwise(full(d, lambda: F.stddev_samp(x), x))


def covariance(x: Column, y: Column, d: int) -> Column:
    return full(d, lambda: F.covar_samp(x, y), x, y)


def correlation(x: Column, y: Column, d: int) -> Column:
    """Pearson, 0 if a side is constant, within -1 and 1."""
    flat = (ts_min(x, d) == ts_max(x, d)) | (ts_min(y, d) == ts_max(y, d))
    r = F.try_divide(covariance(x, y, d), stddev(x, d) * stddev(y, d))
    return F.when(flat, F.lit(0.0)).when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def decay_linear(x: Column, d: int) -> Column:
    """Weights 1 to d, the newest heaviest."""
    return sum(((d - k) * (x if k == 0 else delay(x, k)) for k in range(d)), F.lit(0.0)) / (d * (d + 1) / 2)


def wma(x: Column, d: int) -> Column:
    """Weights 0.9 to the power of the age."""
    return sum((0.9**k * (x if k == 0 else delay(x, k)) for k in range(d)), F.lit(0.0)) / sum(0.9**k for k in range(d))


def values(x: Column, d: int) -> Column:
    """The window's values, oldest first."""
    return full(d, lambda: F.collect_list(x), x)


def ts_rank(x: Column, d: int) -> Column:
    """The newest value's percentile, ties averaged."""
    v = values(x, d)
    return (F.size(F.filter(v, lambda y: y < x)) + (F.size(F.filter(v, lambda y: y == x)) + 1) / 2) / d


def days_since_max(x: Column, d: int) -> Column:
    """Rows back to the latest maximum; 0 is today."""
    v = values(x, d)
    return F.array_position(F.reverse(v), F.array_max(v)) - 1


def quantile(x: Column, q: float, d: int) -> Column:
    return full(d, lambda: F.percentile(x, F.lit(q)), x)


def slope(x: Column, d: int) -> Column:
    """Of the least-squares line over the rows 1 to d."""
    return full(d, lambda: F.regr_slope(x, F.col(ORDER).cast("double")), x)


def count_if(condition: Column, x: Column, d: int) -> Column:
    return full(d, lambda: F.sum(F.when(condition, 1.0).otherwise(0.0)), x)


def sum_if(condition: Column, x: Column, d: int) -> Column:
    return full(d, lambda: F.sum(F.when(condition, x).otherwise(0.0)), x)


def stddev_pop(x: Column, d: int) -> Column:
    return full(d, lambda: F.stddev_pop(x), x)


def product(x: Column, d: int) -> Column:
    return full(d, lambda: F.product(x), x)


def momentum(x: Column, end: int, start: int) -> Column:
    """The change from start rows ago to end rows ago."""
    return delay(x, end) / delay(x, start) - 1


def days_since_min(x: Column, d: int) -> Column:
    """Rows back to the latest minimum; 0 is today."""
    v = values(x, d)
    return F.array_position(F.reverse(v), F.array_min(v)) - 1


def argmax(x: Column, d: int) -> Column:
    """The first maximum's place, from 1 at the oldest row."""
    v = values(x, d)
    return F.array_position(v, F.array_max(v))


def top_mean(x: Column, k: int, d: int) -> Column:
    """The mean of the k largest values."""
    return F.aggregate(F.slice(F.sort_array(values(x, d), False), 1, k), F.lit(0.0), lambda s, y: s + y) / k


def argmin(x: Column, d: int) -> Column:
    """The first minimum's place, from 1 at the oldest row."""
    v = values(x, d)
    return F.array_position(v, F.array_min(v))


def aroon(x: Column, d: int) -> Column:
    """The latest maximum's place over the window's rows."""
    return (d - days_since_max(x, d)) / d


def ffill(x: Column) -> Column:
    """The last value at or before the row."""
    return F.last(x, ignorenulls=True).over(Window.partitionBy(KEY).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0))


def trailing(x: Column, d: int, least: int, how: Callable[[Column], Column], stride: int = 1) -> Column:
    """An aggregate of the values there are among the last d calendar rows, or each stride-th of them, if at least so many are there."""
    own = [KEY, F.pmod(F.col(ORDER), F.lit(stride))] if stride > 1 else [KEY]
    w = Window.partitionBy(*own).orderBy(ORDER).rangeBetween(-(d - 1), 0)
    return F.when(F.count(x).over(w) >= least, how(x).over(w))


def trailing_moment(x: Column, d: int, least: int, order: int) -> Column:
    """Skewness (3) or excess kurtosis (4), corrected for the sample's size; 0 on a constant window."""
    w = frame(d)
    n, fixed = F.count(x).over(w), F.min(x).over(w) == F.max(x).over(w)
    if order == 3:
        value = F.skewness(x).over(w) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    else:
        value = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * F.kurtosis(x).over(w) + 6)
    return F.when(n >= max(least, order), F.when(fixed, F.lit(0.0)).otherwise(value))


def pair_correlation(x: Column, y: Column, d: int, least: int) -> Column:
    """Over the rows that have both, if at least so many do; missing where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b, w = F.when(both, x), F.when(both, y), frame(d)
    varies = (F.min(a).over(w) < F.max(a).over(w)) & (F.min(b).over(w) < F.max(b).over(w))
    return F.when((F.count(a).over(w) >= least) & varies, F.try_divide(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)))


def ols2(y: Column, a: Column, b: Column, d: int) -> tuple[Column, Column, Column]:
    """Slopes on two regressors over full windows, and the residuals' sample deviation (d - 3 degrees); missing where the regressors are collinear."""
    w = frame(d)
    whole = (F.count(y).over(w) == d) & (F.count(a).over(w) == d) & (F.count(b).over(w) == d)
    s = lambda x, z: F.covar_pop(x, z).over(w)
    det = s(a, a) * s(b, b) - s(a, b) * s(a, b)
    fine = whole & (det > F.lit(1e-9) * s(a, a) * s(b, b))
    first = F.when(fine, (s(b, b) * s(a, y) - s(a, b) * s(b, y)) / det)
    second = F.when(fine, (s(a, a) * s(b, y) - s(a, b) * s(a, y)) / det)
    rest = F.greatest(F.lit(0.0), s(y, y) - first * s(a, y) - second * s(b, y))
    return first, second, F.when(fine, F.sqrt(rest * d / (d - 3)))


def coskewness(x: Column, m: Column, d: int) -> Column:
    """The mean of x's deviation by the square of m's, over the deviation of x and the variance of m."""
    w = frame(d)
    e = lambda v: F.avg(v).over(w)
    top = e(x * m * m) - 2 * e(m) * e(x * m) - e(x) * e(m * m) + 2 * e(x) * e(m) * e(m)
    return F.when((F.count(x).over(w) == d) & (F.count(m).over(w) == d), F.try_divide(top, F.stddev_pop(x).over(w) * F.var_pop(m).over(w)))


def weighted_sum(x: Column, weights: list[float]) -> Column:
    """Weights of the newest row first; missing if one of the rows is."""
    return sum((w * (x if k == 0 else delay(x, k)) for k, w in enumerate(weights)), F.lit(0.0))


def decayed(x: Column, d: int, decay: float) -> Column:
    """The sum of the last d rows, each weighted by decay to the power of its age; missing rows count 0."""
    return sum((decay**k * F.coalesce(x if k == 0 else delay(x, k), F.lit(0.0)) for k in range(d)), F.lit(0.0))


def decayed_fit(y: Column, x: Column, d: int, decay: float, least: int) -> tuple[Column, Column]:
    """Slope and intercept of y on x over the last d rows with weights that decay by age, from rows that have both. Ages count from the frame's own row, so any calendar will do; values are told from that row's, so that sums don't cancel."""
    y, x = y.cast("double"), x.cast("double")
    x0, y0 = F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))
    rows = F.collect_list(F.struct(F.col(ORDER).alias("at"), x.alias("x"), y.alias("y"))).over(frame(d))
    sums = ("n", "w", "wx", "wy", "wxx", "wxy")

    def add(s: Column, r: Column) -> Column:
        u, v, w = r["x"] - s["x0"], r["y"] - s["y0"], F.pow(F.lit(decay), (s["now"] - r["at"]).cast("double"))
        more = dict(zip(sums, (F.lit(1.0), w, w * u, w * v, w * u * u, w * u * v), strict=True))
        use = r["x"].isNotNull() & r["y"].isNotNull()
        return F.struct(s["now"].alias("now"), s["x0"].alias("x0"), s["y0"].alias("y0"), *[F.when(use, s[c] + m).otherwise(s[c]).alias(c) for c, m in more.items()])

    def told(s: Column) -> Column:
        b = F.try_divide(s["wxy"] - s["wx"] * s["wy"] / s["w"], s["wxx"] - s["wx"] * s["wx"] / s["w"])
        return F.when(s["n"] >= least, F.struct(b.alias("b"), (s["y0"] + s["wy"] / s["w"] - b * (s["x0"] + s["wx"] / s["w"])).alias("a")))

    start = F.struct(F.col(ORDER).alias("now"), x0.alias("x0"), y0.alias("y0"), *[F.lit(0.0).alias(c) for c in sums])
    fit = F.aggregate(rows, start, add, told)
    return fit["b"], fit["a"]


def spread_high_low(high: Column, low: Column) -> Column:
    """The bid-ask spread that two rows' highs and lows suggest; negative ones are 0."""
    h1, l1, k = delay(high, 1), delay(low, 1), 3 - 2 * 2**0.5
    beta = F.pow(F.ln(high / low), 2) + F.pow(F.ln(h1 / l1), 2)
    top, bottom = F.when(h1.isNotNull(), F.greatest(high, h1)), F.when(l1.isNotNull(), F.least(low, l1))
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(F.pow(F.ln(top / bottom), 2) / k)
    return F.when(alpha.isNotNull(), F.greatest(F.lit(0.0), 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))))


def cumulative_gain(r: Column) -> Column:
    """The product of 1 + r over the rows with a positive r so far; 1 before the first."""
    w = Window.partitionBy(KEY).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return F.exp(F.sum(F.when(r > 0, F.log1p(r)).otherwise(F.lit(0.0))).over(w))
