import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import accounting, calendar, gates, outcomes, runs, signals
from crosspanel.sources import tables

D = dt.date


@pytest.fixture(scope="module")
def trades(spark):
    rows = [(1, 7, 1, D(2024, 1, 1), 2500.0, 10, 2400.0, 2600.0, 5, "open", None, None), (2, 8, 1, D(2024, 1, 1), 100.0, 20, 95.0, 110.0, 5, "closed", D(2024, 1, 4), 108.0)]
    return spark.createDataFrame(rows, "trade_id long, ticker long, account long, entry_date date, ref_price double, shares long, stop_loss double, target_price double, horizon_days int, status string, exit_date date, exit_ref_price double")


def test_ledger_reconciles_to_cash(trades):
    led = accounting.trade_ledger(trades)
    assert led.count() == 6
    bal = accounting.running_balance(led.withColumn("seq", F.col("trade_id") * 10 + F.col("leg")), 10_000.0)
    last = bal.orderBy(F.col("ts").desc(), F.col("seq").desc()).first().running_balance
    assert abs(last - (10_000.0 + led.agg(F.sum("amount")).first()[0])) < 1e-6


def test_net_pnl_is_gross_minus_both_charges(trades):
    c = accounting.close_trades(accounting.open_fills(trades).where("status = 'closed'")).first()
    assert abs(c.pnl - (c.gross_pnl - c.entry_charges - c.exit_charges)) < 0.02 and c.breakeven_price > c.entry_price


@pytest.mark.parametrize("close,day,reason", [(2650.0, 2, "target"), (2300.0, 2, "stop"), (2500.0, 9, "expired"), (2500.0, 2, None)])
def test_settlement(spark, trades, close, day, reason):
    b = spark.createDataFrame([(7, D(2024, 1, day), close), (9, D(2024, 1, 1), 5.0)], "ticker long, date date, close double")
    o = accounting.open_fills(trades).where("status = 'open'").drop("exit_date", "exit_ref_price")
    got = [r.exit_reason for r in accounting.settle_exits(o, b).collect()]
    assert got == ([reason] if reason else [])


def test_marks_are_null_without_a_price(spark, trades):
    prices = spark.createDataFrame([(99, 1.0)], "ticker long, last_price double")
    assert accounting.mark_to_market(accounting.open_fills(trades), prices).where("unrealized_pnl IS NOT NULL").count() == 0


def test_gates(spark):
    ok = spark.createDataFrame([(1, D(2024, 1, d), 10.0, 11.0, 9.0, 10.0, 5.0) for d in (1, 2, 12)], "ticker long, date date, open double, high double, low double, close double, volume double")
    gates.check_ohlcv(ok)
    assert gates.date_gaps(ok).first().worst_gap == 10
    with pytest.raises(gates.DataQualityError):
        gates.check_ohlcv(ok.withColumn("high", F.lit(1.0)))
    with pytest.raises(gates.DataQualityError):
        gates.check_freshness(ok, "2024-03-01")
    with pytest.raises(gates.DataQualityError):
        gates.check_no_future_leak(ok.where("date < '2024-01-05'"), ok.withColumn("fwd_ret", F.lit(1.0)))
    assert gates.spike_flags(ok).where("spike_flag = 1").count() == 0


def test_calendar(spark):
    hol = spark.createDataFrame([(D(2024, 1, 26),)], "date date")
    days = [r.date for r in calendar.trading_days(spark, "2024-01-25", "2024-01-30", hol).orderBy("date").collect()]
    assert days == [D(2024, 1, 25), D(2024, 1, 29), D(2024, 1, 30)]
    n = calendar.next_trading_day(spark.createDataFrame([(D(2024, 1, 25),)], "date date"), hol).first()
    assert n.next_trading_day == D(2024, 1, 29)
    closed = spark.range(14).select(F.date_add(F.lit("2024-02-01").cast("date"), F.col("id").cast("int")).alias("date"))
    assert calendar.next_trading_day(spark.createDataFrame([(D(2024, 2, 1),)], "date date"), closed).first().next_trading_day == D(2024, 2, 2)
    ts = spark.sql("SELECT timestamp'2024-01-25 03:45:00' AS a, timestamp'2024-01-25 10:00:00' AS b, timestamp'2024-01-25 10:00:00.5' AS c, timestamp'2024-01-26 12:00:00' AS d")
    r = ts.select(*[calendar.market_open(c).alias(c) for c in "abc"], F.date_format(calendar.next_market_open("d"), "yyyy-MM-dd HH:mm").alias("n")).first()
    assert (r.a, r.b, r.c, r.n) == (True, True, False, "2024-01-29 09:15")


def test_forward_asof_and_idempotent_resolution(spark):
    b = spark.createDataFrame([(1, D(2024, 1, 1), 100.0), (1, D(2024, 1, 12), 104.0), (1, D(2024, 3, 1), 90.0)], "ticker long, date date, close double")
    p = spark.createDataFrame([("r", D(2024, 1, 1), 1, "LONG", 0.7, 100.0, 97.0, 103.0, 5), ("r", D(2024, 2, 1), 1, "LONG", 0.7, 100.0, 97.0, 103.0, 5), ("r", D(2024, 1, 1), 2, "LONG", 0.7, 100.0, 97.0, 103.0, None)],
                              "run_id string, signal_date date, ticker long, signal string, prob_up double, entry_price double, stop_loss double, target_price double, horizon_days int").withColumn("outcome_resolved", F.lit(False))
    r = outcomes.resolve(p, b, "2024-06-01").collect()
    assert len(r) == 1 and r[0].exit_reason == "target" and r[0].is_correct and r[0].actual_close == 104.0 and r[0].outcome_date == D(2024, 1, 8)
    p1, o1, n1 = outcomes.resolve_and_merge(p, spark.createDataFrame([], outcomes.resolve(p, b, "2024-06-01").schema), b, "2024-06-01")
    p2, o2, n2 = outcomes.resolve_and_merge(p1, o1, b, "2024-06-01")
    assert (n1, n2) == (1, 0) and p2.columns == p1.columns
    key = lambda r: (r.signal_date, r.ticker)
    assert sorted(p1.collect(), key=key) == sorted(p2.collect(), key=key) and o1.collect() == o2.collect()
    assert o1.count() == o2.count() == 1 and p2.where("outcome_resolved").count() == 1


def test_merges_keep_one_row_a_key(spark):
    old = spark.createDataFrame([(1, None, 1.0)], "ticker long, date date, close double")
    new = spark.createDataFrame([(1, None, 2.0), (1, None, 3.0), (2, D(2024, 1, 1), 5.0), (2, D(2024, 1, 1), 4.0)], old.schema)
    got = tables.merge_rows(old, new, ["ticker", "date"], [-F.col("close")]).collect()
    assert sorted((r.ticker, r.close) for r in got) == [(1, 3.0), (2, 5.0)]
    assert tables.new_rows(old, new, ["ticker", "date"]).count() == 1
    raw = spark.createDataFrame([("a", "2024-01-01", "NaN", "5"), ("a", "2024-01-02", "x", "NaN"), ("a", "2024-01-03", "inf", "7")], "ticker string, date string, open string, close string")
    assert [(r.open, r.close) for r in tables.clean_bars(raw).orderBy("date").collect()] == [(None, 5.0), (None, 7.0)]


def test_landing_append_touches_only_its_months(spark, tmp_path):
    import os

    path = str(tmp_path / "landing")
    tables.write_landing(spark.createDataFrame([(1, D(2024, 1, 1), 1.0), (1, D(2024, 2, 1), 1.0)], "ticker long, date date, close double"), path)
    before = {f for f in os.listdir(f"{path}/year=2024/month=1") if f.endswith(".parquet")}
    tables.append_landing(spark, path, spark.createDataFrame([(1, D(2024, 2, 1), 9.0), (1, D(2024, 3, 1), 2.0)], "ticker long, date date, close double"))
    assert {f for f in os.listdir(f"{path}/year=2024/month=1") if f.endswith(".parquet")} == before
    assert sorted((r.month, r.close) for r in spark.read.parquet(path).collect()) == [(1, 1.0), (2, 9.0), (3, 2.0)]


def test_journal_reader_falls_back_to_an_empty_table(spark, tmp_path):
    assert tables.read_journal(spark, str(tmp_path / "none.json"), tables.SIGNAL_SCHEMA).count() == 0
    (tmp_path / "p.json").write_text(json.dumps({"initial_capital": 5.0, "trades": [{"trade_id": "a", "ticker": "X", "shares": 3, "other": 1}], "ledger": [{"id": "1", "amount": 2.5}]}))
    p = tables.read_journal(spark, str(tmp_path / "p.json"), tables.PORTFOLIO_SCHEMA)
    assert tables.portfolio_trades(p).first().shares == 3 and tables.portfolio_ledger(p).first().amount == 2.5
    h = tables.portfolio_header(p).first()
    assert (h.initial_capital, h.cash, h.position_size_pct) == (5.0, 5.0, 0.05)


def test_dynamic_levels(spark):
    lv = spark.createDataFrame([("A", 2.0, 100.0), ("B", 0.0, 100.0)], "ticker string, atr14 double, close double")
    s = spark.createDataFrame([("A", "LONG", -0.02, 0.05), ("B", "LONG", -1e-9, 50.0), ("C", "LONG", None, None)], "ticker string, signal string, q10_star double, q90_star double")
    r = {x.ticker: x for x in signals.enrich_dynamic(s, lv).collect()}
    assert r["A"].risk_reward == 2.5 and r["A"].stop_loss == 98.0 and r["A"].target_price == 105.0
    assert r["C"].entry_price == 0.0 and r["C"].horizon_days == 5


def test_promotion(spark):
    cols = "ch_sharpe double, ch_ic double, ch_calib double, cp_sharpe double, cp_ic double, has_champion boolean, drift_alarm boolean"
    rows = [(1.2, None, None, 1.0, None, True, False), (1.05, None, None, 1.0, None, True, False), (2.0, None, 0.5, 1.0, None, True, False), (2.0, None, None, 1.0, None, True, True),
            (None, None, None, None, None, False, False), (None, 0.05, None, None, 0.03, True, False)]
    got = [r.promote for r in runs.promotion(spark.createDataFrame(rows, cols)).collect()]
    assert got == [True, False, False, False, True, True]
