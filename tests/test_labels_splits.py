import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import cross, labels, splits


def test_last_h_labels_are_null_and_grid_equals_single(walk):
    _, df = walk
    g = labels.forward_return_grid(df, [5, 21]).withColumn("one", labels.forward_log_return(5))
    c = g.groupBy("ticker").agg(F.count_if(F.col("fwd_ret_5").isNull()).alias("a"), F.count_if(F.col("fwd_ret_21").isNull()).alias("b")).collect()
    assert {(r.a, r.b) for r in c} == {(5, 21)}
    assert g.where(~F.col("one").eqNullSafe(F.col("fwd_ret_5"))).count() == 0


@pytest.mark.parametrize("h", [5, 30])
def test_triple_barrier_equals_a_plain_loop(walk, h):
    pdf, df = walk
    got = labels.triple_barrier(df, h).toPandas().sort_values(["ticker", "date"])
    for t, p in pdf.sort_values("date").groupby("ticker"):
        c, hi, lo = (p[x].to_numpy() for x in ("close", "high", "low"))
        tr = np.maximum(hi[1:] - lo[1:], np.maximum(abs(hi[1:] - c[:-1]), abs(lo[1:] - c[:-1])))
        tr = np.r_[tr[0], tr]
        atr = [tr[0]]
        for x in tr[1:]:
            atr.append(2 / 15 * x + 13 / 15 * atr[-1])
        want = []
        for i in range(len(c) - h):
            up = next((j for j in range(1, h + 1) if hi[i + j] >= c[i] + 2 * atr[i]), None)
            dn = next((j for j in range(1, h + 1) if lo[i + j] <= c[i] - 2 * atr[i]), None)
            want.append((0, h) if up is None and dn is None else (1, up) if dn is None or (up is not None and up <= dn) else (-1, dn))
        g = got[got.ticker == t]
        assert g.tb_label.isna().sum() == h
        assert [(int(a), int(b)) for a, b in zip(g.tb_label.dropna(), g.tb_first_passage_time.dropna())] == want


def test_bars_beyond_the_horizon_do_not_matter(walk):
    _, df = walk
    cut = F.lit("2017-06-01").cast("date")
    a = labels.triple_barrier(df, 5).where(F.col("date") < F.date_sub(cut, 6)).select("ticker", "date", "tb_label")
    bumped = df.withColumn("high", F.when(F.col("date") >= cut, F.col("high") * 5).otherwise(F.col("high")))
    b = labels.triple_barrier(bumped, 5).select("ticker", "date", F.col("tb_label").alias("b"))
    assert a.join(b, ["ticker", "date"]).where(F.col("tb_label") != F.col("b")).count() == 0


def test_relevance_grades(spark):
    rows = [("2024-01-01", t, float(t)) for t in range(30)] + [("2024-01-02", t, float(-t)) for t in range(3)] + [("2024-01-03", 1, None), ("2024-01-03", 2, 0.5)]
    df = spark.createDataFrame(rows, "date string, ticker long, fwd_ret double").withColumn("date", F.to_date("date"))
    out = cross.relevance_grades(df).toPandas()
    big = out[out.date.astype(str) == "2024-01-01"].sort_values("fwd_ret")
    assert big.rank_rel.is_monotonic_increasing and big.rank_rel.min() == 0 and big.rank_rel.max() == 7
    last = out[out.date.astype(str) == "2024-01-03"].set_index("ticker").rank_rel
    assert np.isnan(last[1]) and last[2] == 0


def test_uniqueness_weights(walk):
    pdf, df = walk
    h = 5
    w = labels.uniqueness_weights(df.withColumn("target", labels.forward_log_return(h)), h).where("ticker = 1").toPandas().sort_values("date")
    n = 1300 - h
    conc = np.ones(n)
    for d in range(1, h):
        conc[d:] += (h - d) / h
        conc[: n - d] += (h - d) / h
    want = (1 / conc) / (1 / conc).mean()
    np.testing.assert_allclose(w.w_unique.to_numpy()[:n], want)
    assert (w.w_unique.to_numpy()[n:] == 1.0).all()


def test_folds_never_overlap_and_keep_the_gap(walk):
    _, df = walk
    folds = splits.purged_folds(df, n_splits=4)
    c = splits.leakage_check(df, folds).collect()
    assert len(c) == 4 and all(r.ordered and r.gap_ok for r in c)
    assert splits.purged_folds(df.where("date < '2015-06-01'")).count() == 0


def test_schedule_cutoffs_precede_the_test_date(walk):
    _, df = walk
    s = splits.rebalance_schedule(df, every=50)
    assert s.where((F.col("train_cutoff") >= F.col("test_date")) | (F.col("val_cutoff") > F.col("train_cutoff"))).count() == 0 and s.count() > 10
