"""The store by year: whole years swap in, readers prune, what is broken is told."""

import os

import pytest

from factorloom.sources import store as st


def rows(spark, *years, n=20, shift=0):
    return spark.createDataFrame([(y, i, None if i % 7 == 3 else i + shift + 0.5, f"t{i}") for y in years for i in range(n)], "y int, instrument int, value double, own string").repartition(3)


def content(df):
    return sorted((tuple(r) for r in df.select("y", "instrument", "value", "own", "year").collect()), key=str)


def test_years_swap_in_whole(spark, tmp_path):
    s = st.Store(spark, f"{tmp_path}/s")
    with pytest.raises(st.StoreError):
        s.read()
    s.write(rows(spark, 2001, 2002, 2003), "y")
    old = s.read()
    m = s.write(rows(spark, 2002, 2010, n=5, shift=100), "y")
    assert m["number"] == 2 and list(m["years"]) == ["2001", "2002", "2003", "2010"] and [m["years"][y]["rows"] for y in m["years"]] == [20, 5, 20, 5]
    want = rows(spark, 2001, 2003).union(rows(spark, 2002, 2010, n=5, shift=100))
    assert content(s.read()) == content(want.selectExpr("*", "y AS year"))
    assert old.count() == 60  # a reader keeps the manifest it began with
    assert s.verify() == [] and s.vacuum() == 1 and s.verify() == []
    assert content(s.read(2002, 2003)) == content(want.where("y in (2002, 2003)").selectExpr("*", "y AS year"))
    assert s.read(1990, 1999).count() == 0 and s.read(1990, 1999).columns == s.read().columns


def test_reads_prune(spark, tmp_path):
    s = st.Store(spark, f"{tmp_path}/s")
    s.write(rows(spark, *range(2000, 2010)), "y")
    plan = s.read().where("year = 2004 and instrument > 3").select("value")
    told = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in told and "GreaterThan(instrument,3)" in told and "own" not in told.split("ReadSchema")[1].split("\n")[0]
    assert len(s.read(2003, 2004).inputFiles()) < len(s.read().inputFiles()) and all("year=2003" in f or "year=2004" in f for f in s.read(2003, 2004).inputFiles())


def test_what_is_wrong_is_told(spark, tmp_path):
    s = st.Store(spark, f"{tmp_path}/s")
    s.write(rows(spark, 2001), "y")
    for bad in (rows(spark, 2002).selectExpr("y", "instrument"), rows(spark, 2002).selectExpr("*", "1 AS version"), rows(spark, 2002).selectExpr("*", "1 AS year"), rows(spark, 2002).selectExpr("IF(instrument = 1, NULL, y) AS y", "instrument", "value", "own")):
        with pytest.raises(st.StoreError):
            s.write(bad, "y")
    assert list(s.manifest()["years"]) == ["2001"] and not [n for n in os.listdir(f"{tmp_path}/s") if n.startswith("_")]
    meanwhile = s.manifest()
    s.write(rows(spark, 2002), "y")
    with pytest.raises(st.StoreError, match="another write"):
        s._commit(s._files, meanwhile | {"number": 2})
    at = s.manifest()["years"]["2002"]["version"]
    rows(spark, 2002, shift=1).write.mode("overwrite").parquet(f"{tmp_path}/s/year=2002/version={at}")
    assert s.verify() == [2002]
    s.write(rows(spark).limit(0), "y")
    assert list(s.manifest()["years"]) == ["2001", "2002"]


def test_results_and_files_from_outside(spark, tmp_path):
    df = rows(spark, 2001)
    for kind in ("csv", "parquet"):
        at = f"{tmp_path}/result.{kind}"
        st.write_result(df, at, kind)
        with pytest.raises(st.StoreError):
            st.write_result(df, at, kind)
        again = st.read_external(spark, at, "instrument int, value double, own string")
        assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, df.select("instrument", "value", "own").collect()), key=str)
        with pytest.raises(st.StoreError, match="lacks"):
            st.read_external(spark, at, "nothing int")
    with pytest.raises(st.StoreError):
        st.write_result(df, f"{tmp_path}/x", "xlsx")
    assert not [n for n in os.listdir(tmp_path) if "staged" in n]
