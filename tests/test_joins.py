"""Joins along time on ties, nulls and repeated rows, and the work that they take."""

from factorloom.operators import joins
from factorloom.plans.study import QUERIES


def test_asof_takes_the_greatest_value_of_a_time(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (1, 9), (2, 4), (2, None)], "k int, at int")
    right = spark.createDataFrame([(1, 5, 3.0), (1, 5, 7.0), (1, 5, None), (1, 2, 9.0), (1, 8, None), (2, 4, None), (2, 4, None)], "k int, since int, v double")
    got = {(r.k, r.at): r.v for r in joins.asof_backward(left, right, "k", "at", "since", "v").collect()}
    assert got == {(1, 1): None, (1, 5): 7.0, (1, 9): None, (2, 4): None, (2, None): None}


def test_spans_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, w) for w in (3, 3, 4, 4, 4, 6, 7, 7, 9)] + [(2, 1)], "k int, w int")
    got = sorted(tuple(r) for r in joins.collapse(rows, "k", "w").collect())
    assert got == [(1, 3, 4), (1, 6, 7), (1, 9, 9), (2, 1, 1)]


def test_interval_join_aggregates_spans_only(spark, sf_dir):
    """Before, a task of the spans held two hash tables of all busy rows and a sort for an aggregate of the spans, besides its window's sort."""
    plan = QUERIES["interval_join"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 3  # of the bars, twice, and of the spans
