"""Rolling training, validation and test windows by calendar years, with a purge of the dates whose labels reach past a boundary.

A row's windows follow from its own year, so rows are repeated for the few windows that they serve and nothing is joined by ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.names import free


@dataclass(frozen=True)
class Plan:
    """A window for each year from first to last: train_years before it, the last validation_months of those for validation. purge: calendar dates that are left out before a boundary."""

    first: int
    last: int
    train_years: int = 3
    validation_months: int = 6
    purge: int = 1

    def __post_init__(self):
        if self.train_years < 1 or not 1 <= self.validation_months < 12 * self.train_years:
            raise ValueError("validation has at least a month and is shorter than the years of training")
        if self.last < self.first or self.purge < 0:
            raise ValueError("the last year is not before the first, and a purge not negative")


def _month(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def roles(df: DataFrame, date: str, plan: Plan, year: str = "window", role: str = "role", refit: str = "refit") -> DataFrame:
    """df's rows once for each window that they serve: the window's year, the role (train, validation or test) and whether the refit before the test may use the row (null for test rows).

    Training rows stop `purge` dates before validation, and validation rows and the refit as many before the test. Dates are those
    that df has; they are numbered in one task, one row each. A null date serves no window. Names that df has already are an error.
    """
    if {year, role, refit} & set(df.columns):
        raise ValueError(f"columns are there already: {sorted({year, role, refit} & set(df.columns))}")
    d, at, w, month = F.col(f"`{date}`"), free(df, "position"), F.col(year), free(df, "month")
    dates = df.select(d.cast("date").alias("day")).where("day is not null").distinct().withColumn("nth", F.row_number().over(Window.orderBy("day")))
    months = dates.groupBy(_month(F.col("day")).alias("since")).agg(F.min("nth").alias("nth"), F.max("nth").alias("latest"))
    upto = F.coalesce(F.lead("since").over(Window.orderBy("since")), F.col("since") + 12 * plan.train_years + 13) - 1
    opens = months.withColumn("upto", upto).withColumn("m", F.explode(F.sequence("since", "upto")))  # months without dates open with the next date there is
    opens = opens.select("m", F.when(F.col("m") == F.col("since"), F.col("nth")).otherwise(F.col("latest") + 1).alias("first_at"))

    day = free(df, "day")
    rows = df.join(dates.select(F.col("day").alias(day), F.col("nth").alias(at)), d.cast("date") == F.col(day))
    own = F.year(d)
    served = F.filter(F.sequence(own, own + plan.train_years), lambda y: (y >= plan.first) & (y <= plan.last))
    rows = rows.withColumn(year, F.explode(served)).withColumn(month, _month(d))
    validation = w * 12 - plan.validation_months
    v, t = (tuple(free(df, f"{name}_{x}") for x in ("month", "at")) for name in ("validation", "test"))
    for names, boundary in ((v, validation), (t, w * 12)):
        rows = rows.join(opens.select(F.col("m").alias(names[0]), F.col("first_at").alias(names[1])), F.col(names[0]) == boundary, "left")
    to_validation = F.col(at) < F.col(v[1]) - plan.purge
    to_test = F.col(at) < F.col(t[1]) - plan.purge
    told = F.when(own == w, "test").when(F.col(month) >= validation, F.when(to_test, "validation")).when(to_validation, "train")
    out = rows.withColumn(role, told).withColumn(refit, F.when(own < w, to_test))
    return out.where(F.col(role).isNotNull() | F.col(refit)).select(*[F.col(f"`{c}`") for c in df.columns], year, role, refit)
