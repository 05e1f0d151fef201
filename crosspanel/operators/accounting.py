"""Trade and account tables: fills, closes, marks, ledger, account statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio, rnd
from ..functions.ordered import running_sum_in
from .costs import buy_charges, sell_charges


def open_fills(trades: DataFrame, slippage_bps: float = 10.0) -> DataFrame:
    """Entry side of each trade from ref_price and shares."""
    fill = F.col("ref_price") * (1 + slippage_bps / 1e4)
    gross = fill * F.col("shares")
    charges = buy_charges(gross)["total"]
    breakeven = (gross + charges + sell_charges(gross)["total"]) / F.greatest(F.col("shares"), F.lit(1))
    return trades.select("*", rnd(fill, 2).alias("entry_price"), rnd(charges, 2).alias("entry_charges"),
                         rnd((fill - F.col("ref_price")) * F.col("shares"), 2).alias("entry_slippage"), rnd(breakeven, 2).alias("breakeven_price"))


def close_columns(ref: Column, slippage_bps: float = 10.0) -> dict[str, Column]:
    """Exit side at reference price `ref`; the cost basis is the rounded entry price."""
    fill = ref * (1 - slippage_bps / 1e4)
    shares, basis = F.col("shares"), F.col("shares") * F.col("entry_price")
    proceeds = fill * shares
    charges = sell_charges(proceeds)["total"]
    gross = proceeds - basis
    net = gross - charges - F.col("entry_charges")
    floor = F.greatest(basis, F.lit(1e-9))
    return {"exit_price": rnd(fill, 2), "exit_charges": rnd(charges, 2), "exit_slippage": rnd((ref - fill) * shares, 2), "gross_pnl": rnd(gross, 2),
            "gross_pnl_pct": rnd(gross / floor * 100, 2), "pnl": rnd(net, 2), "pnl_pct": rnd(net / floor * 100, 2)}


def close_trades(opened: DataFrame, ref: str = "exit_ref_price", slippage_bps: float = 10.0) -> DataFrame:
    return opened.select("*", *[c.alias(n) for n, c in close_columns(F.col(ref), slippage_bps).items()])


def latest_prices(bars: DataFrame) -> DataFrame:
    """Closes of the table's newest date only."""
    newest = bars.select(F.max("date")).scalar()
    return bars.where(F.col("date") == newest).select("ticker", F.col("close").alias("last_price"), F.col("date").alias("as_of"))


def settle_exits(open_trades: DataFrame, bars: DataFrame, slippage_bps: float = 10.0) -> DataFrame:
    """Trades that leave at the newest close: target, then stop, then calendar-day expiry."""
    j = open_trades.join(latest_prices(bars), "ticker")
    days = F.datediff("as_of", "entry_date")
    p = F.col("last_price")
    reason = F.when(p >= F.col("target_price"), "target").when(p <= F.col("stop_loss"), "stop").when(days >= F.col("horizon_days"), "expired")
    j = j.withColumn("days_held", days).withColumn("exit_reason", reason).where(F.col("exit_reason").isNotNull()).withColumn("exit_date", F.col("as_of"))
    return j.select("*", *[c.alias(n) for n, c in close_columns(p, slippage_bps).items()])


def mark_to_market(open_trades: DataFrame, prices: DataFrame) -> DataFrame:
    """Net unrealised P&L after entry charges and estimated exit charges; NULL without a price."""
    j = open_trades.join(prices.select("ticker", "last_price"), "ticker", "left")
    p, shares = F.col("last_price"), F.col("shares")
    pnl = shares * (p - F.col("entry_price")) - F.col("entry_charges") - sell_charges(shares * p)["total"]
    cost = shares * F.col("entry_price")
    pct = F.when(p.isNotNull(), F.coalesce(ratio(pnl, cost), F.lit(0.0)) * 100)
    return j.select("*", rnd(p, 2).alias("current_price"), rnd(pnl, 2).alias("unrealized_pnl"), rnd(pct, 2).alias("unrealized_pnl_pct"))


def portfolio_value(open_trades: DataFrame, prices: DataFrame, cash: DataFrame, by: str = "account") -> DataFrame:
    """cash(account, cash) + open shares at the last price, else at entry."""
    j = open_trades.join(prices.select("ticker", "last_price"), "ticker", "left")
    inv = j.groupBy(by).agg(F.sum(F.col("shares") * F.coalesce("last_price", "entry_price")).alias("invested"))
    return cash.join(inv, by, "left").na.fill({"invested": 0.0}).withColumn("portfolio_value", F.col("cash") + F.col("invested"))


def trade_ledger(closed: DataFrame, slippage_bps: float = 10.0) -> DataFrame:
    """BUY, CHARGE, SELL, CHARGE rows of each trade (exit rows only once closed)."""
    buy, sell = F.col("ref_price") * (1 + slippage_bps / 1e4), F.col("exit_ref_price") * (1 - slippage_bps / 1e4)
    shares = F.col("shares")

    def row(leg: int, day: str, kind: str, price: Column, amount: Column) -> Column:
        return F.struct(F.col(day).alias("ts"), F.lit(leg).alias("leg"), F.lit(kind).alias("type"), rnd(price, 2).alias("price"), rnd(amount, 2).alias("amount"))

    entry = [row(0, "entry_date", "BUY", buy, -buy * shares), row(1, "entry_date", "CHARGE", buy, -buy_charges(buy * shares)["total"])]
    leave = [row(2, "exit_date", "SELL", sell, sell * shares), row(3, "exit_date", "CHARGE", sell, -sell_charges(sell * shares)["total"])]
    rows = F.when(F.col("status") == "closed", F.array(*entry, *leave)).otherwise(F.array(*entry))
    return closed.select("account", "trade_id", "ticker", F.col("shares").alias("qty"), F.explode(rows).alias("r")).select("account", "trade_id", "ticker", "qty", "r.*")


def running_balance(ledger: DataFrame, opening: float = 0.0) -> DataFrame:
    """Balance after every movement of an account in (ts, seq) order; hot accounts are cut into segments."""
    df = ledger.withColumn("_ts", F.unix_date("ts"))
    return running_sum_in(df, ["account"], "_ts", "seq", "amount", "running_balance").withColumn("running_balance", F.col("running_balance") + opening).drop("_ts")


def account_balance(ledger: DataFrame, opening: float = 0.0) -> DataFrame:
    return ledger.groupBy("account").agg((F.sum("amount") + opening).alias("cash"), F.count(F.lit(1)).alias("n_rows"))


def account_kpis(ledger: DataFrame) -> DataFrame:
    """Charges, turnover, their ratio in percent and net cash per account."""
    g = ledger.groupBy("account").agg(
        (-F.coalesce(F.sum(F.when(F.col("type") == "CHARGE", F.col("amount"))), F.lit(0.0))).alias("charges"),
        F.coalesce(F.sum(F.when(F.col("type").isin("BUY", "SELL"), F.abs("amount"))), F.lit(0.0)).alias("turnover"), F.sum("amount").alias("cash"))
    return g.withColumn("charges_pct", ratio(F.col("charges") * 100, "turnover"))


def deployed(open_trades: DataFrame, by: str = "account") -> DataFrame:
    return open_trades.groupBy(by).agg(F.sum(F.col("shares") * F.col("entry_price")).alias("deployed"), F.count(F.lit(1)).alias("n_open"))


def trade_kpis(closed: DataFrame, by: list[str]) -> DataFrame:
    """Win rate, gross/net P&L, cost drag, average/best/worst trade and profit factor (loss floored at 1)."""
    g = closed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_closed"), F.count_if(F.col("pnl") > 0).alias("n_win"), F.sum("gross_pnl").alias("gross_pnl"), F.sum("pnl").alias("net_pnl"),
        (F.sum("entry_charges") + F.sum("exit_charges")).alias("charges"), F.avg("pnl_pct").alias("avg_pct"), F.max("pnl_pct").alias("best_pct"), F.min("pnl_pct").alias("worst_pct"),
        F.coalesce(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.lit(0.0)).alias("_win"), F.coalesce(F.abs(F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))), F.lit(0.0)).alias("_loss"))
    return g.select(*by, "n_closed", "n_win", (F.col("n_win") / F.greatest(F.col("n_closed"), F.lit(1)) * 100).alias("win_rate"), "gross_pnl", "net_pnl", "charges",
                    F.coalesce(ratio(F.col("charges") * 100, F.abs("gross_pnl")), F.lit(0.0)).alias("cost_drag_pct"), "avg_pct", "best_pct", "worst_pct",
                    (F.col("_win") / F.greatest(F.col("_loss"), F.lit(1.0))).alias("profit_factor"))


def realised_equity(closed: DataFrame, capital: float = 1_000_000.0) -> DataFrame:
    """capital + cumulative P&L by exit date (ties by trade id), over the whole table."""
    df = closed.select("trade_id", "exit_date", F.coalesce("pnl", F.lit(0.0)).alias("pnl"), F.unix_date("exit_date").alias("_d"))
    return running_sum_in(df, [], "_d", "trade_id", "pnl", "cum_pnl", k=256).withColumn("equity", capital + F.col("cum_pnl")).drop("_d")


def pnl_histogram(closed: DataFrame, bins: int = 20, value: str = "pnl_pct") -> DataFrame:
    """Equal-width histogram over the observed range."""
    lim = closed.select(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    d = closed.where(F.col(value).isNotNull()).withColumn("_l", lim)
    pos = F.coalesce(ratio((F.col(value) - F.col("_l.lo")) * bins, F.col("_l.hi") - F.col("_l.lo")), F.lit(0.0))
    d = d.withColumn("bin", F.least(F.floor(pos), F.lit(bins - 1)).cast("int"))
    return d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def size_orders(signals: DataFrame, open_tickers: DataFrame, cash: float, pct: float = 0.05) -> DataFrame:
    """Best-scored LONG row per ticker with the default share count and an already-open flag."""
    best = signals.where(F.col("signal") == "LONG").groupBy("ticker").agg(F.max(F.struct("prob_up", "entry_price")).alias("b")).select("ticker", "b.*")
    held = open_tickers.select("ticker").distinct().withColumn("already_open", F.lit(True))
    shares = F.greatest(F.lit(1), F.floor(cash * pct / F.col("entry_price"))).cast("long")
    return best.join(held, "ticker", "left").select("ticker", "prob_up", "entry_price", shares.alias("default_shares"), F.coalesce("already_open", F.lit(False)).alias("already_open"))
