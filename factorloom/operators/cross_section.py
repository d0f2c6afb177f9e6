"""Operators over the instruments of one date. A date's rows form one window partition: as many as there are instruments, at any length of history."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

DATE = "week_no"


def _day(*groups: str):
    return Window.partitionBy(DATE, *groups)


def rank(x: Column, *groups: str) -> Column:
    """Percentile among the present values, ties averaged; also inside groups."""
    day = _day(*groups)
    has = x.isNotNull()
    ordered = Window.partitionBy(DATE, *groups, has).orderBy(x)
    ties = F.count(F.lit(1)).over(Window.partitionBy(DATE, *groups, x))
    return F.when(has, (F.rank().over(ordered) + (ties - 1) / 2) / F.count(x).over(day))


def bucket(x: Column, k: int, *groups: str) -> Column:
    """The rank's k-th, from 1 to k."""
    return F.when(x.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(k), F.ceil(rank(x, *groups) * k).cast("int"))))


def scale(x: Column) -> Column:
    """Shares of the date's sum of absolute values; null where that is 0."""
    return F.try_divide(x, F.sum(F.abs(x)).over(_day()))


def zscore(x: Column, limit: float = 3.0) -> Column:
    """Standardised by the date's mean and sample deviation, clipped."""
    z = F.try_divide(x - F.avg(x).over(_day()), F.stddev_samp(x).over(_day()))
    return F.when(z.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), z)))


def neutralize(x: Column, group: str) -> Column:
    """Less the group's mean."""
    return x - F.avg(x).over(_day(group))


def weighted_mean(x: Column, weight: Column, group: str) -> Column:
    """Over the group's rows with a value and a positive weight."""
    use = x.isNotNull() & (weight > 0)
    return F.sum(F.when(use, x * weight)).over(_day(group)) / F.sum(F.when(use, weight)).over(_day(group))


def residual(y: Column, x: Column) -> Column:
    """Of the date's least-squares line of y on x."""
    both = y.isNotNull() & x.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    beta = F.covar_samp(b, a).over(_day()) / F.var_samp(a).over(_day())
    return F.when(both, y - F.avg(b).over(_day()) - beta * (x - F.avg(a).over(_day())))


def correlation(x: Column, y: Column) -> Column:
    """An aggregate: Pearson over the rows that have both; missing where a side is constant or there are fewer than two."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def rank_zscore(x: Column) -> Column:
    """Ranks less their mean, by the deviation of 1 to n."""
    n = F.count(x).over(_day())
    return F.try_divide(rank(x) * n - (n + 1) / 2, F.sqrt(n * (n + 1) / 12))


def group_median(x: Column, group: str) -> Column:
    return F.median(x).over(_day(group))


def group_count(x: Column, group: str) -> Column:
    return F.count(x).over(_day(group))


def weight(x: Column) -> Column:
    """Shares of the date's sum."""
    return F.try_divide(x, F.sum(x).over(_day()))


def rank_members(x: Column, member: Column) -> Column:
    """The percentile among members; missing for others."""
    return rank(F.when(member, x))


def group_mean(x: Column, group: str) -> Column:
    return F.avg(x).over(_day(group))


def group_stddev(x: Column, group: str) -> Column:
    return F.stddev_samp(x).over(_day(group))


def zscore_members(x: Column, member: Column, limit: float = 3.0) -> Column:
    """Every value by the members' mean and deviation, clipped."""
    own = F.when(member, x)
    z = F.try_divide(x - F.avg(own).over(_day()), F.stddev_samp(own).over(_day()))
    return F.when(z.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), z)))


def fill_infinite(x: Column) -> Column:
    """Infinite values become the date's mean of the finite ones."""
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return F.when(F.abs(x) == float("inf"), F.avg(finite).over(_day())).otherwise(x)


def herfindahl(x: Column, group: str) -> Column:
    """The sum of squared shares in the group."""
    total = F.sum(x).over(_day(group))
    return F.try_divide(F.sum(x * x).over(_day(group)), total * total)


def combine(parts: list[tuple[float, Column]]) -> Column:
    """The weighted mean of those that are there."""
    weights = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for w, x in parts), F.lit(0.0))
    return F.try_divide(sum((F.coalesce(w * x, F.lit(0.0)) for w, x in parts), F.lit(0.0)), weights)


def winsorised(x: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """Clipped at the date's quantiles."""
    q = lambda p: F.percentile(x, F.lit(p)).over(_day())
    return F.when(x.isNotNull(), F.greatest(q(low), F.least(q(high), x)))
