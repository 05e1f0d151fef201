import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import costs, cross, metrics, portfolio
from crosspanel.operators.portfolio import Rules


@pytest.mark.parametrize("k", [2, 3, 4, 5, 8, 10])
def test_quantile_bucket_equals_qcut(spark, k):
    ns = list(range(2 * k, 120, 7))
    rows = [(n, r) for n in ns for r in range(1, n + 1)]
    df = spark.createDataFrame(rows, "n long, rn long")
    got = df.withColumn("q", cross.quantile_bucket(F.col("rn"), F.col("n"), k)).toPandas()
    for n, g in got.sort_values(["n", "rn"]).groupby("n"):
        want = pd.qcut(pd.Series(np.arange(1, n + 1, dtype=float)), k, labels=False)
        assert (g.q.to_numpy() == want.to_numpy()).all()
    top = got.groupby("n").q.agg(lambda q: (q == k - 1).sum())
    if True:
        sizes = spark.createDataFrame([(n,) for n in ns], "n long").select("n", cross.basket_size(F.col("n"), k).alias("m")).toPandas().set_index("n").m
        assert (sizes == top).all()


def frame(spark, days=4, names=20, regime=0.05):
    rows = [(dt.date(2024, 1, d + 1), t, float((t * 7 + d * 3) % names), 0.01 * ((t * 5 + d) % 7 - 3), regime) for d in range(days) for t in range(names)]
    return spark.createDataFrame(rows, "date date, ticker long, pred double, fwd_ret double, g double")


def loop(pdf, k, rt, conviction=True, mode="long_only"):
    out, prev, prev_s = [], set(), set()
    for d, day in pdf.groupby("date"):
        day = day.sort_values(["pred", "ticker"]).reset_index(drop=True)
        q = pd.qcut(pd.Series(np.arange(1, len(day) + 1, dtype=float)), k, labels=False)
        lo, sh = day[q == k - 1], day[q == 0][::-1]
        w = lambda b: (np.arange(1, len(b) + 1) / np.arange(1, len(b) + 1).sum()) if conviction else np.full(len(b), 1 / len(b))
        r, ls, ss = float((w(lo) * lo.fwd_ret).sum()), set(lo.ticker), set(sh.ticker)
        turn = 1 - len(ls & prev) / len(ls)
        if mode == "long_short":
            r -= float((w(sh) * sh.fwd_ret).sum())
            turn = (turn + 1 - len(ss & prev_s) / len(ss)) / 2
        out.append(r - rt * turn)
        prev, prev_s = ls, ss
    return out


@pytest.mark.parametrize("mode,conviction", [("long_only", True), ("long_only", False), ("long_short", True)])
def test_period_table_equals_a_plain_loop(spark, mode, conviction):
    df = frame(spark, days=6)
    rules = Rules(mode=mode, conviction=conviction, rt_cost=0.004)
    got = [r.ret for r in portfolio.period_table(df, rules).orderBy("date").collect()]
    np.testing.assert_allclose(got, loop(df.toPandas(), 5, 0.004, conviction, mode), atol=1e-12)


def test_risk_off_is_flat_and_pays_to_close(spark):
    df = frame(spark).withColumn("g", F.when(F.dayofmonth("date") == 3, -0.05).otherwise(F.col("g")))
    t = portfolio.period_table(df, Rules(regime="g", rt_cost=0.004)).orderBy("date").collect()
    assert t[2].flat and abs(t[2].ret + 0.004) < 1e-12 and t[3].turnover == 1.0
    first = portfolio.period_table(df.where(F.dayofmonth("date") == 3), Rules(regime="g")).first()
    assert first.ret == 0.0
    assert not portfolio.period_table(df, Rules()).where("flat").count()


def test_thin_dates_are_skipped_and_not_previous(spark):
    df = frame(spark).where((F.dayofmonth("date") != 2) | (F.col("ticker") < 5))
    t = portfolio.period_table(df, Rules(rt_cost=0.004)).orderBy("date").collect()
    full = df.toPandas()
    full = full[full.groupby("date")["ticker"].transform("size") >= 10]
    assert [r.period for r in t] == [1, 2, 3]
    np.testing.assert_allclose([r.ret for r in t], loop(full, 5, 0.004), atol=1e-12)


def test_sleeves_are_the_average_of_the_books(spark):
    df = frame(spark, names=40).withColumn("horizon_star", F.when(F.dayofmonth("date") <= 2, 5).otherwise(21))
    s = {r.date: r.ret for r in portfolio.sleeve_returns(df).collect()}
    for h in (5, 21):
        for r in portfolio.period_table(df.where(F.col("horizon_star") == h), Rules()).collect():
            assert abs(s[r.date] - r.ret / 2) < 1e-12


def test_costs_only_lower_the_result(spark):
    g = {r.cost_mult: r.Sharpe for r in portfolio.cost_sensitivity(frame(spark, 12), Rules()).collect()}
    assert list(g) and g[0.5] >= g[1.0] >= g[1.5] >= g[2.0]


def test_charges(spark):
    df = spark.createDataFrame([(0.0,), (10_000.0,), (100_000.0,)], "v double")
    for r in df.select("v", costs.buy_charges(F.col("v")).alias("b"), costs.sell_charges(F.col("v")).alias("s"), costs.round_trip_cost(F.col("v"), F.col("v")).alias("rt")).collect():
        assert abs(r.b.total + r.s.total - r.rt) < 1e-9 and r.s.stamp == 0 and r.b.dp_charge == 0 and r.s.dp_charge == 13
        assert abs(sum(r.b[i] for i in ("brokerage", "stt", "exchange", "sebi", "stamp", "gst", "dp_charge")) - r.b.total) < 1e-9
    one = df.where("v = 100000").select(costs.cost_fraction(F.col("v")).alias("f")).first().f
    assert abs(one - costs.typical_cost_fraction()) < 1e-12 and abs(one - 0.0043525) < 1e-6


def bars(spark, bump=None, n=8, drop=()):
    rows = []
    for i in range(n):
        if i in drop:
            continue
        hi, lo, c = 101.0, 99.0, 100.0
        if bump and bump[0] == i:
            hi, lo = bump[1], bump[2]
        rows.append((1, dt.date(2024, 1, 1) + dt.timedelta(days=i), hi, lo, c))
    return spark.createDataFrame(rows, "ticker long, date date, high double, low double, close double")


def one_exit(spark, b):
    t = spark.createDataFrame([(1, dt.date(2024, 1, 1), 95.0, 110.0, 5)], "ticker long, entry_date date, stop_loss double, target_price double, horizon_days int")
    return portfolio.exit_trades(t, b).first()


def test_exit_bound_comes_from_the_trades(spark):
    b = spark.createDataFrame([(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), 112.0 if i == 8 else 101.0, 99.0, 100.0) for i in range(14)], "ticker long, date date, high double, low double, close double")
    t = spark.createDataFrame([(1, dt.date(2024, 1, 1), 95.0, 110.0, 10), (1, dt.date(2024, 1, 2), 95.0, 110.0, 5)], "ticker long, entry_date date, stop_loss double, target_price double, horizon_days int")
    got = {r.horizon_days: (r.exit_reason, r.exit_bar) for r in portfolio.exit_trades(t, b).collect()}
    assert got == {10: ("target", 8), 5: ("expired", 5)}


def test_exits_for_the_right_reason(spark):
    assert one_exit(spark, bars(spark, (3, 112.0, 99.0))).exit_reason == "target"
    assert one_exit(spark, bars(spark, (3, 101.0, 90.0))).exit_reason == "stop"
    assert one_exit(spark, bars(spark, (3, 112.0, 90.0))).exit_reason == "target"
    e = one_exit(spark, bars(spark))
    assert e.exit_reason == "expired" and e.exit_bar == 5 and e.exit_price == 100.0
    assert one_exit(spark, bars(spark, drop=(2, 3))).exit_date == dt.date(2024, 1, 8)
    assert one_exit(spark, bars(spark, n=3)).exit_reason is None


def test_return_statistics(spark):
    r = [0.02, -0.01, 0.03, -0.02, 0.01]
    df = spark.createDataFrame([("s", dt.date(2024, 1, i + 1), x) for i, x in enumerate(r)], "strategy string, date date, ret double")
    s = metrics.return_stats(df, ["strategy"]).first()
    a = np.array(r)
    eq = (1 + a).cumprod()
    peak = np.maximum.accumulate(eq)
    assert abs(s.Sharpe - a.mean() / a.std() * 252**0.5) < 1e-9 and abs(s.max_drawdown - ((eq - peak) / (peak + 1e-9)).min()) < 1e-9
    assert abs(s.Sortino - a.mean() / a[a < 0].std() * 252**0.5) < 1e-9 and abs(s.final_equity - eq[-1]) < 1e-12
    assert abs(s.CAGR - (eq[-1] ** (252 / 5) - 1)) < 1e-6 and abs(s.profit_factor - 0.06 / 0.03) < 1e-9
    neg = df.withColumn("ret", F.when(F.dayofmonth("date") == 2, -1.5).otherwise(F.col("ret")))
    e = [x.equity for x in metrics.equity_curve(neg, ["strategy"]).orderBy("date").collect()]
    np.testing.assert_allclose(e, (1 + np.array([0.02, -1.5, 0.03, -0.02, 0.01])).cumprod())


def test_bootstrap_brackets_the_point_estimate(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("s", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x)) for i, x in enumerate(rng.normal(0.002, 0.01, 120))], "strategy string, date date, ret double")
    b, s = metrics.block_bootstrap(df, ["strategy"], n_boot=80).first(), metrics.return_stats(df, ["strategy"]).first()
    assert b.sharpe_p05 < b.sharpe_p50 < b.sharpe_p95 and b.sharpe_p05 < s.Sharpe < b.sharpe_p95 and b.n_boot == 80
    assert metrics.block_bootstrap(df.limit(30), ["strategy"]).count() == 0


def test_deflated_sharpe(spark):
    from statistics import NormalDist

    df = spark.createDataFrame([("a", 1.5, 250), ("b", 0.1, 250), ("c", 1.0, 2)], "strategy string, Sharpe double, n_periods long")
    d = {r.strategy: r for r in metrics.deflated_sharpe(df, 20).collect()}
    assert d["a"].deflated_sharpe > d["b"].deflated_sharpe and d["c"].deflated_sharpe is None
    assert abs(d["a"].deflated_sharpe - NormalDist().cdf(d["a"].dsr_z)) < 1e-12
    assert metrics.deflated_sharpe(df, 1).first().deflated_sharpe is None


def test_calibration_bins(spark):
    df = spark.createDataFrame([(0.3, 1.0), (1.0, 1.0), (0.05, 0.0)], "p double, y double")
    assert abs(metrics.calibration_error(df, "p", "y").first().ece - (0.7 + 0.05) / 3) < 1e-12
    assert metrics.calibration_drift(df.withColumnRenamed("y", "r"), "p", "r").first().ece is None
