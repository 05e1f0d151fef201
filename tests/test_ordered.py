"""Skewed groups: one group and one value hold a third of the rows or more."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.functions.ordered import average_rank_in, cumulative_counts, quantiles_in, row_number_in, running_sum_in
from crosspanel.operators.metrics import spearman


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 6000
    g = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 40, n))
    v = np.where(rng.random(n) < 0.35, 1.5, np.round(rng.normal(0, 10, n), 1))
    pdf = pd.DataFrame({"g": g, "id": np.arange(n), "v": v, "w": rng.normal(0, 1, n)})
    pdf.loc[rng.random(n) < 0.2, "v"] = np.nan
    df = spark.createDataFrame(pdf, "g long, id long, v double, w double").withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(5)
    return pdf, df.cache()


@pytest.mark.parametrize("k", [4, 16, 256])
def test_average_rank(skewed, k):
    pdf, df = skewed
    out = average_rank_in(df, ["g"], "v", "r", "n", k=k).toPandas().set_index("id").sort_index()
    want = pdf.groupby("g")["v"].rank()
    np.testing.assert_allclose(out["r"].to_numpy(float), want.to_numpy(float), equal_nan=True)
    assert len(out) == len(pdf)
    whole = average_rank_in(df, [], "v", "r", k=k).toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(whole["r"].to_numpy(float), pdf["v"].rank().to_numpy(float), equal_nan=True)


def test_row_number_and_running_sum(skewed):
    pdf, df = skewed
    full = pdf.dropna().sort_values(["g", "v", "id"])
    full["rn"] = full.groupby("g").cumcount() + 1
    full["n"] = full.groupby("g")["id"].transform("size")
    out = row_number_in(df, ["g"], "v", "id").toPandas().set_index("id").sort_index()
    want = full.set_index("id").sort_index()
    assert (out["rn"] == want["rn"]).all() and (out["n"] == want["n"]).all()
    full["s"] = full.groupby("g")["w"].cumsum()
    got = running_sum_in(df.where(F.col("v").isNotNull()), ["g"], "v", "id", "w", "s").toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(got["s"], full.set_index("id").sort_index()["s"], atol=1e-9)
    total = running_sum_in(df, [], "id", "id", "w", "s", k=64).toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(total["s"], pdf["w"].cumsum(), atol=1e-9)


def test_cumulative_counts_and_quantiles(skewed):
    pdf, df = skewed
    c = cumulative_counts(df, ["g"], "v", {"c": F.count(F.lit(1))}).toPandas()
    assert c["c"].sum() == pdf["v"].notna().sum()
    want = pdf.dropna().groupby("g")["v"].apply(lambda s: (s <= 1.5).sum())
    got = c[c["v"] == 1.5].set_index("g")["cum_c"].sort_index()
    assert (got == want[got.index]).all()
    probs = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    q = quantiles_in(df, ["g"], "v", probs).toPandas().set_index(["g", "prob"])["q"].sort_index()
    ref = pdf.dropna().groupby("g")["v"].quantile(probs).sort_index()
    np.testing.assert_allclose(q.to_numpy(), ref.to_numpy(), atol=1e-9)


def test_spearman(skewed):
    pdf, df = skewed
    got = spearman(df, "v", "w", ["g"]).toPandas().set_index("g")["ic"].sort_index()
    want = pdf.dropna().groupby("g").apply(lambda d: d["v"].rank().corr(d["w"].rank()), include_groups=False).sort_index()
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), atol=1e-9, equal_nan=True)
    one = spearman(df, "v", "w").first()
    assert abs(one.ic - pdf.dropna()["v"].rank().corr(pdf.dropna()["w"].rank())) < 1e-9


def test_a_constant_column_has_no_correlation(spark):
    d = spark.range(40).select((F.col("id") * 0 + 1.0).alias("a"), F.col("id").cast("double").alias("b"))
    assert spearman(d, "a", "b").first().ic is None


def test_segments_bound_the_largest_window(skewed):
    """Half of all rows share one group, a third one value: no (group, segment, salt) keeps more than a fraction of it."""
    from crosspanel.functions.ordered import add_segments

    _, df = skewed
    s = add_segments(df.where(F.col("v").isNotNull()), ["g"], "v", "id", k=16)
    big = s.where("g = 0").groupBy("_b1", "_b2").count().agg(F.max("count")).first()[0]
    assert big < 0.15 * s.where("g = 0").count()


def test_string_ties_inside_a_hot_value(skewed):
    pdf, df = skewed
    d = df.where(F.col("v").isNotNull()).withColumn("name", F.concat(F.lit("T"), F.lpad((F.col("id") * 7919 % 6007).cast("string"), 5, "0")))
    p = d.toPandas().sort_values(["g", "v", "name"])
    p["rn_w"] = p.groupby("g").cumcount() + 1
    got = row_number_in(d, ["g"], "v", "name").toPandas().merge(p[["id", "rn_w"]], on="id")
    assert len(got) == len(p) and (got.rn == got.rn_w).all()


def test_string_ties_with_a_common_beginning_are_cut(spark):
    from crosspanel.functions.ordered import add_segments

    df = spark.range(4000).select(F.lit(0).alias("g"), F.lit(1.0).alias("v"), F.format_string("Customer#%09d", F.col("id")).alias("name"))
    cut = add_segments(df, ["g"], "v", "name").groupBy("_b1", "_b2").count().collect()
    assert len(cut) > 4 and max(r["count"] for r in cut) < 2000
    got = row_number_in(df, ["g"], "v", "name").collect()
    assert [r.rn for r in sorted(got, key=lambda r: r.name)] == list(range(1, 4001))
