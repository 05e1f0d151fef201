"""Series statistics in arrays against the Window chain; ranks and moments of dates; plans without wide shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import cross, features as ft, models
from crosspanel.plans.assembly import build_features
from crosspanel.session import stage


def test_features_in_arrays_are_those_of_the_window_chain(walk):
    _, df = walk
    # short series, a series that begins without prices, and one without a ticker
    df = df.withColumn("ticker", F.when(F.col("ticker") < 3, F.col("ticker"))).unionByName(df.where("ticker = 1").limit(30).withColumn("ticker", F.lit(9).cast("long")))
    df = df.withColumn("volume", F.when(F.dayofyear("date") != 77, F.col("volume")))
    a, b = [ft.ticker_features(df, in_arrays=x).select("ticker", "date", *ft.TICKER_FEATURES) for x in (True, False)]
    assert a.schema == b.schema and a.count() == df.count()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert "MapInArrow" in ft.ticker_features(df, in_arrays=True)._jdf.queryExecution().executedPlan().toString()


def test_a_gap_inside_a_series_is_refused_in_arrays(walk):
    _, df = walk
    gap = df.withColumn("close", F.when(F.dayofyear("date") != 77, F.col("close")))
    with pytest.raises(Exception, match="a value is missing inside the series"):
        ft.ticker_features(gap, in_arrays=True).write.format("noop").mode("overwrite").save()


def rows(spark):
    nan = float("nan")
    return spark.createDataFrame([(d, t, x, y) for d in (1, 2, 3) for t, x, y in [(1, 2.0, 1.0), (2, 2.0, None), (3, -1.0, nan), (4, nan, 5.0), (5, None, nan)]] + [(4, 1, 7.0, None), (None, 2, 1.0, 1.0)],
                                 "date int, ticker long, x double, y double")


def test_ranks_of_whole_dates_are_those_of_segments(spark):
    df = rows(spark)
    want = sorted(map(str, cross.percentile_ranks(df, ["x", "y"]).collect()))
    assert sorted(map(str, cross.percentile_ranks(df, ["x", "y"], source=stage(df)).collect())) == want
    # dates of more rows than a task may rank
    assert sorted(map(str, cross.percentile_ranks(df, ["x", "y"], source=stage(df), most=3).collect())) == want


def test_moments_in_arrays(spark):
    df = rows(spark).repartition(5)
    some = df.replace(float("nan"), 3.5)
    got, want = [{r["date"]: r for r in f(some, ["x", "y"]).where("date is not null").collect()} for f in (cross.moments_in_arrays, cross.moments)]
    assert set(got) == set(want)
    for d in want:
        for c in ("_m_x", "_s_x", "_m_y", "_s_y"):
            assert got[d][c] == want[d][c] or abs(got[d][c] - want[d][c]) < 1e-12


def test_feature_table_shuffles_no_wide_rows(spark, walk):
    _, df = walk
    table, names = build_features(df)
    plan = table._jdf.queryExecution().executedPlan().toString()
    # a shuffle of features would have their columns below it; bars, ranks and what goes along are narrow
    assert len(names) > 45 and "Exchange hashpartitioning(ticker" in plan
    for below in re.split(r"Exchange hashpartitioning", plan)[1:]:
        assert "MapInArrow" not in below


def test_rows_of_folds_are_staged_once_and_without_what_their_vector_holds(spark):
    df = spark.createDataFrame([(d, t, float(t), float(d * t), float(t), 1.0) for d in range(40) for t in range(5)], "date int, ticker long, a double, b double, target double, weight double")
    folds = spark.createDataFrame([(d, k, "train" if d < 10 * k + 10 else "test") for k in range(3) for d in range(10 * k + 20)], "date int, fold int, role string")
    v, table, ids = models._folded(df.unionByName(df.limit(1).withColumn("date", F.lit(None).cast("int"))), folds, ["a", "b"])
    assert v.count() == 200 and ids == [0, 1, 2] and set(v.columns) == {"date", "ticker", "target", "weight", "features"}
    assert models.fold_rows(v, table.where("fold = 2")).groupBy("role").count().orderBy("role").collect() == [("test", 50), ("train", 150)]
