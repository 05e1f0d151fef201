"""Plans that must not grow: sorts of wide rows, shuffles of pairs."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from crosspanel.functions.windows import ewm
from crosspanel.operators import features as ft


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exponential_means_need_no_sort_of_their_own(walk):
    _, df = walk
    for made in (ft.macd(df), ft.adx(df), ft.ticker_features(df)):
        assert executed(made).count("Sort [") == 1


def test_ewm_of_a_series_that_decays_below_any_double(spark):
    # 3,000 rows: one early value, then zeros; the ratio of two decayed means stays what it was
    pdf = pd.DataFrame({"ticker": 1, "date": np.arange(3000), "x": [None, 8.0] + [0.0] * 2998, "y": [None, 2.0] + [0.0] * 2998})
    out = ewm(spark.createDataFrame(pdf, "ticker int, date int, x double, y double").replace(float("nan"), None), {"a": ("x", 0.2), "b": ("y", 0.2)}).orderBy("date").toPandas()
    assert np.isnan(out.a[0]) and out.a[1] == 8.0
    np.testing.assert_allclose(out.a[1:].to_numpy(), 8.0 * 0.8 ** np.arange(2999), rtol=1e-9, atol=1e-300)
    assert (out.a[1:2500] / out.b[1:2500]).round(9).eq(4.0).all()


def test_spells_count_users_without_shuffling_pairs(spark, tmp_path):
    from crosspanel.queries import QUERIES

    rows = [(1, "08:00:00", 7, "error", 60.0), (2, "08:10:00", 7, "view", 1.0), (3, "08:20:00", 8, "view", 1.0), (4, "08:20:00", 8, "view", 1.0),
            (5, "08:30:00", None, "click", 1.0), (6, "07:59:00", 8, "view", 1.0), (7, "09:00:00", 9, "error", 0.5), (8, "09:00:30", 9, "view", 1.0)]
    # a spell that is there twice, and two spells of one id that meet the same user
    rows += [(10, "12:00:00", 3, "error", 2.0)] * 2 + [(11, "12:01:00", 4, "view", 1.0)] + [(12, "15:00:00", 5, "error", 2.0), (12, "15:01:00", 5, "error", 2.0), (13, "15:01:30", 6, "view", 1.0)]
    e = spark.createDataFrame([(i, f"2024-01-01 {t}", u, k, v) for i, t, u, k, v in rows], "event_id long, ts string, user_id long, event_type string, value double")
    e.withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["events_in_spells"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(1, 6, 1, 7, 3), (7, 2, 7, 8, 1), (10, 6, 10, 11, 2), (12, 5, 12, 13, 2)]
    # what is grouped with the spell is a user of spells of several times only
    keys = [line.split("functions=")[0] for line in executed(out).splitlines() if "HashAggregate(keys=[spell_id" in line and "begins" not in line.split("functions=")[0]]
    assert keys and all("user_id" not in k or "several" in k for k in keys)


def test_days_are_ordered_whole_and_large_ones_in_segments(spark, monkeypatch):
    from crosspanel.functions import ordered

    rng = np.random.default_rng(7)
    rows = [(None if d == 3 else d, int(i), None if rng.random() < 0.1 else float(rng.integers(0, 9))) for d in range(4) for i in range(40 + 60 * (d == 2))]
    df = spark.createDataFrame(rows, "day int, id long, v double")
    number = lambda: ordered.row_number_in(df, ["day"], "v", "id", bounded=True)
    whole = number()
    plan = executed(whole)
    assert "percentile_approx" not in plan and "Join" not in plan
    want = []
    for d in range(3):
        day = sorted((v, i) for x, i, v in rows if x == d and v is not None)
        want += [(d, i, v, k + 1, len(day)) for k, (v, i) in enumerate(day)]
    assert sorted(map(tuple, whole.collect())) == sorted(want) and whole.dtypes[-2:] == [("rn", "bigint"), ("n", "bigint")]
    monkeypatch.setattr(ordered, "GROUP_ROWS", 50)
    assert sorted(map(tuple, number().collect())) == sorted(want)


def test_pairs_of_a_group_are_ranked_in_one_shuffle(spark, monkeypatch):
    from crosspanel.operators import metrics

    rng = np.random.default_rng(9)
    rows = [(None if g == 3 else g, float(rng.integers(0, 12)), float(rng.normal())) for g in range(4) for _ in range(30 + 100 * (g == 1))]
    rows += [(5, 1.0, 2.0), (6, 1.0, 2.0), (6, 1.0, 3.0), (7, None, 1.0)] + [(2, float("nan"), 1.0), (2, -0.0, 1.5), (2, 0.0, 2.5)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    found = metrics.spearman(df, "a", "b", ["g"])
    plan = executed(found)
    assert plan.count("Exchange") == 1 and "percentile_approx" not in plan
    got = {r.g: (r.ic, r.n) for r in found.collect()}
    for g in (0, 1, 2):
        x, y = (pd.Series([r[c] for r in rows if r[0] == g]).fillna(1e9).rank() for c in (1, 2))
        assert abs(got[g][0] - x.corr(y)) < 1e-12 and got[g][1] == len(x)
    assert got[None] == (None, 30) and got[5] == (None, 1) and got[6] == (None, 2) and 7 not in got
    monkeypatch.setattr(metrics, "PAIR_ROWS", 29)
    cut = {r.g: (r.ic, r.n) for r in metrics.spearman(df, "a", "b", ["g"]).collect()}
    assert set(cut) == set(got) and all(cut[g][1] == got[g][1] for g in got)
    assert all((cut[g][0] is None) == (got[g][0] is None) and (got[g][0] is None or abs(cut[g][0] - got[g][0]) < 1e-12) for g in got)


def test_sample_weights_of_model_rows_read_labels_from_files(walk, monkeypatch):
    from crosspanel.plans import end_to_end

    _, df = walk
    seen = []

    def build(bars, index_bars, along):
        seen.append(along(bars) if callable(along) else along)
        return bars.withColumn("_marked", F.lit(False)).withColumns({c: F.lit(0.0) for c in ("fwd_ret", "target", "weight")}), ["close"]

    monkeypatch.setattr(end_to_end, "build_features", build)
    end_to_end.model_rows(df, None, "regression")
    assert "lead(" not in executed(seen[0]) and seen[0].where("weight is null").count() == 0 and seen[0].count() == 3 * 1300
