"""Set-based evaluation of a per-date quantile portfolio with turnover costs.

Row work (ranking, weights, membership) is split by the ordered helpers; the
period logic runs on the per-date table, one row per calendar day and book.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import clip, ratio, rnd
from ..functions.windows import lag, series
from ..session import stage
from .costs import typical_cost_fraction
from .cross import basket_size, bucketed, conviction_weight
from .features import true_range
from .metrics import return_stats, summarise
from .passage import BLOCK_BARS, extreme_tree, first_in_block, first_touch, numbered


@dataclass(frozen=True)
class Rules:
    k: int = 5
    mode: str = "long_only"
    conviction: bool = True
    regime: str | None = None
    rt_cost: float = typical_cost_fraction()
    rebalance_every: int = 5
    by: tuple[str, ...] = ()

    @property
    def ppy(self) -> float:
        return 252.0 / self.rebalance_every


def eligible(preds: DataFrame, rules: Rules) -> DataFrame:
    """Ranked complete rows of dates with at least 2k of them: adds rn, n and bucket q."""
    full = preds.where(F.col("pred").isNotNull() & F.col("fwd_ret").isNotNull())
    return bucketed(full, "pred", rules.k, [*rules.by, "date"]).where(F.col("n") >= 2 * rules.k)


def members(ranked: DataFrame, rules: Rules) -> DataFrame:
    """Basket members with side (1 long, -1 short) and weight; flat dates hold nothing."""
    if rules.regime:
        ranked = ranked.where(~F.coalesce(F.col(rules.regime) < 0, F.lit(False)))
    n, rn, k = F.col("n"), F.col("rn"), rules.k
    m_top, m_low = basket_size(n, k), basket_size(n, k, top=False)
    long = F.col("q") == k - 1
    side = F.when(long, 1)
    if rules.mode == "long_short":
        side = side.when(F.col("q") == 0, -1)
    size = F.when(long, m_top).otherwise(m_low)
    pos = F.when(long, rn - (n - m_top)).otherwise(m_low - rn + 1)
    weight = conviction_weight(pos, size) if rules.conviction else ratio(F.lit(1.0), size)
    out = ranked.select(*rules.by, "date", "ticker", "fwd_ret", side.cast("int").alias("side"), weight.alias("weight"))
    return out.where(F.col("side").isNotNull())


def periods(ranked: DataFrame, rules: Rules) -> DataFrame:
    """Eligible dates in order; `period` counts flat dates too."""
    flat = F.max(F.coalesce(F.col(rules.regime) < 0, F.lit(False))) if rules.regime else F.lit(False)
    d = ranked.groupBy(*rules.by, "date").agg(F.max("n").alias("n"), flat.alias("flat"))
    part = list(rules.by) or [F.lit(0)]
    return d.withColumn("period", F.row_number().over(W.partitionBy(*part).orderBy("date")))


def basket_returns(book: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted return and size per date and side."""
    return book.groupBy(*by, "date").agg(
        F.coalesce(F.sum(F.when(F.col("side") == 1, F.col("weight") * F.col("fwd_ret"))), F.lit(0.0)).alias("long_ret"),
        F.coalesce(F.sum(F.when(F.col("side") == -1, F.col("weight") * F.col("fwd_ret"))), F.lit(0.0)).alias("short_ret"),
        F.count_if(F.col("side") == 1).alias("n_long"), F.count_if(F.col("side") == -1).alias("n_short"))


def turnover(book: DataFrame, dates: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Members kept from the previous eligible period, per date and side.

    A member is kept when its own previous membership is the previous period:
    one window over (book, side, ticker), at most a row per calendar day.
    """
    m = book.join(F.broadcast(dates.select(*by, "date", "period")), [*by, "date"])
    prev = F.lag("period").over(W.partitionBy(*by, "side", "ticker").orderBy("period"))
    kept = m.withColumn("_kept", (F.col("period") - prev == 1))
    return kept.groupBy(*by, "date").agg(F.count_if(F.col("_kept") & (F.col("side") == 1)).alias("kept_long"), F.count_if(F.col("_kept") & (F.col("side") == -1)).alias("kept_short"))


def period_table(preds: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per eligible date: returns, turnover, cost and net return."""
    ranked = eligible(preds, rules)
    dates, book = periods(ranked, rules), members(ranked, rules)
    key = [*rules.by, "date"]
    t = dates.join(basket_returns(book, rules.by), key, "left").join(turnover(book, dates, rules.by), key, "left")
    zero = {c: 0 for c in ("n_long", "n_short", "kept_long", "kept_short")}
    t = t.na.fill(zero).na.fill({"long_ret": 0.0, "short_ret": 0.0})
    t_long = 1 - F.col("kept_long") / F.greatest(F.col("n_long"), F.lit(1))
    t_short = 1 - F.col("kept_short") / F.greatest(F.col("n_short"), F.lit(1))
    part = list(rules.by) or [F.lit(0)]
    held = F.coalesce(F.lag("n_long").over(W.partitionBy(*part).orderBy("date")), F.lit(0)) > 0
    both = (F.lit(rules.mode) == "long_short") & (F.col("n_short") > 0)
    turn = F.when(F.col("flat"), held.cast("double")).when(both, (t_long + t_short) / 2).otherwise(t_long)
    gross = F.when(F.col("flat"), 0.0).otherwise(F.col("long_ret") - F.col("short_ret"))
    t = t.select(*rules.by, "date", "period", "n", "flat", "n_long", "n_short", gross.alias("gross"), turn.alias("turnover"))
    return t.withColumn("cost", rules.rt_cost * F.col("turnover")).withColumn("ret", F.col("gross") - F.col("cost"))


def backtest(preds: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Summary statistics of the period returns, one row per book."""
    t = period_table(preds, rules)
    if not rules.by:
        t = t.withColumn("book", F.lit(rules.mode))
    return summarise(t, list(rules.by) or ["book"], ppy=rules.ppy)


def cost_sensitivity(preds: DataFrame, rules: Rules = Rules(), multipliers: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0)) -> DataFrame:
    """Costs scaled by each multiplier: one period table, the multiplier is a key column."""
    t = period_table(preds, rules).withColumn("cost_mult", F.explode(F.array(*[F.lit(m) for m in multipliers])))
    t = t.withColumn("ret", F.col("gross") - F.col("cost") * F.col("cost_mult"))
    return summarise(t, ["cost_mult"], ppy=rules.ppy).select("cost_mult", "Sharpe", "CAGR", "max_drawdown")


def sleeve_returns(preds: DataFrame, rules: Rules = Rules(), sleeve: str = "horizon_star") -> DataFrame:
    """Equal-capital mix of one book per horizon: absent periods count as 0."""
    r = Rules(rules.k, rules.mode, rules.conviction, rules.regime, rules.rt_cost, rules.rebalance_every, (sleeve,))
    t = period_table(preds.where(F.col(sleeve).isNotNull()), r)
    n = t.select(F.count_distinct(sleeve)).scalar()
    return t.groupBy("date").agg(F.sum("ret").alias("_s"), F.count(F.lit(1)).alias("n_active")).select("date", (F.col("_s") / n).alias("ret"), "n_active")


def flat_cost_backtest(preds: DataFrame, rules: Rules, cost_bps: float = 10.0) -> DataFrame:
    """Equal weights, flat cost per side, sample-std Sharpe, drawdown against the running peak."""
    import math

    r = Rules(rules.k, rules.mode, False, None, 2 * cost_bps / 1e4, rules.rebalance_every)
    t = period_table(preds, r).withColumn("book", F.lit(r.mode))
    s = return_stats(t, ["book"], ppy=r.ppy).select("book", "n_periods", "CAGR", "hit_rate", "avg_period_ret", "final_equity")
    from .metrics import equity_curve

    w = W.partitionBy("book").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    dd = equity_curve(t, ["book"]).withColumn("_d", ratio("equity", F.max("equity").over(w)) - 1).groupBy("book").agg(
        F.min("_d").alias("max_drawdown"), (F.avg("ret") / (F.stddev_samp("ret") + 1e-9) * math.sqrt(r.ppy)).alias("Sharpe"))
    return s.join(dd, "book")


# --- per-trade exits -------------------------------------------------------
def trailing_atr(bars: DataFrame, out: str = "atr20") -> DataFrame:
    """Mean of the true ranges of the last 20 bars (19 of them); needs two bars."""
    tr = F.when(lag("close").isNotNull(), true_range())
    return bars.withColumn("_tr", tr).withColumn(out, F.avg("_tr").over(series().rowsBetween(-18, 0))).drop("_tr")


def dynamic_multiples(q10: Column, q90: Column, price: Column, atr: Column, k: float = 1.0, stop_clamp=(0.8, 3.0), target_clamp=(1.0, 6.0)) -> tuple[Column, Column]:
    """Stop and target distances in ATRs from the predicted quantiles, clamped."""
    stop = clip(ratio(k * F.abs(q10) * price, atr), *stop_clamp)
    target = clip(ratio(k * F.greatest(q90, F.lit(0.0)) * price, atr), *target_clamp)
    return stop, target


def exit_trades(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """First exit of each trade(ticker, entry_date, stop_loss, target_price, horizon_days).

    From the bar after entry: target on high, then stop on low, then the close of
    the horizon-th available bar; trades without enough bars stay open, trades
    without a bar at entry are left out. Paths of up to BLOCK_BARS bars are met
    in one join with blocks of bars. With a longer one the first touch comes from
    trees of block extremes, so a long horizon costs a few more levels and no longer rows.
    """
    span = trades.agg(F.min("horizon_days").alias("least"), F.max("horizon_days").alias("most")).first()
    near = (span.least or 0) >= 0 and (span.most or 1) <= BLOCK_BARS
    levels = [numbered(bars)] if near else extreme_tree(bars, span.most or 1)
    path = levels[0].select("ticker", F.col("date").alias("entry_date"), F.col("at").alias("_at"))
    t = trades.join(path, ["ticker", "entry_date"])
    if near:
        t = first_in_block(t, levels[0], span.most or 1).withColumn("_exit", F.coalesce("_hit", "_last"))
        touched, end = F.col("_hit").isNotNull(), F.col("_exit.at")
    else:
        t = stage(t.withColumn("_id", F.monotonically_increasing_id()))
        asked = t.select("_id", "ticker", (F.col("_at") + 1).alias("first"), (F.col("_at") + F.col("horizon_days")).cast("bigint").alias("last"), "target_price", "stop_loss")
        t = t.join(first_touch(asked, levels, "_id"), "_id", "left").withColumn("_end", F.coalesce("hit_at", F.col("_at") + F.col("horizon_days")))
        bar = levels[0].select(F.col("ticker").alias("_ticker"), F.col("at").alias("_bar"), F.struct("date", "high", "close").alias("_exit"))
        t = t.join(bar, (F.col("ticker") == F.col("_ticker")) & (F.col("_end") == F.col("_bar")), "left")
        touched, end = F.col("hit_at").isNotNull(), F.col("_end")
    at = F.col("_exit")
    reason = F.when(at.isNull(), None).when(~touched, "expired").when(at["high"] >= F.col("target_price"), "target").otherwise("stop")
    t = t.withColumn("exit_reason", reason).withColumn("exit_bar", F.when(at.isNotNull(), end - F.col("_at")).cast("int"))
    price = F.when(F.col("exit_reason") == "target", F.col("target_price")).when(F.col("exit_reason") == "stop", F.col("stop_loss")).otherwise(at["close"])
    return t.withColumn("exit_date", at["date"]).withColumn("exit_price", price).select(*trades.columns, "exit_reason", "exit_bar", "exit_date", "exit_price")


def exit_counts(exits: DataFrame) -> DataFrame:
    return exits.groupBy("exit_reason").agg(F.count(F.lit(1)).alias("n"))


