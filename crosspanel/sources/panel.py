"""Panel adapters: the star-schema tables seen as bars, indices, ledgers and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .tables import table

INDEX, VIX = "INDEX", "VIX"


def bars(spark: SparkSession, root: str) -> DataFrame:
    """One bar per (supplier, ship day): open/close are the first/last unit price.

    Plain hash aggregation with map-side partials, so a supplier holding a third
    of all line items is reduced before the shuffle. The order inside a day is
    (order key, line number); the low 16 bits settle repeated pairs.
    """
    li = table(spark, root, "lineitem")
    px = ratio("l_extendedprice", "l_quantity")
    order = F.shiftleft(F.col("l_orderkey") * 8 + F.col("l_linenumber"), 16) + F.pmod(
        F.xxhash64("l_partkey", "l_extendedprice", "l_quantity"), F.lit(65536))
    return li.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by(px, order).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"),
        F.max_by(px, order).alias("close"), F.sum("l_quantity").alias("volume"))


def index_bars(spark: SparkSession, root: str) -> DataFrame:
    """Two pseudo-tickers per day over all line items: mean unit price and its spread."""
    li = table(spark, root, "lineitem")
    px = ratio("l_extendedprice", "l_quantity")
    day = li.groupBy(F.to_date("l_shipdate").alias("date")).agg(F.avg(px).alias("a"), F.stddev_samp(px).alias("s"))
    both = F.array(F.struct(F.lit(INDEX).alias("ticker"), F.col("a").alias("close")), F.struct(F.lit(VIX).alias("ticker"), F.col("s").alias("close")))
    return day.select("date", F.explode(both).alias("r")).select("r.ticker", "date", "r.close").where(F.col("close").isNotNull())


def membership(spark: SparkSession, root: str) -> DataFrame:
    """Point-in-time membership: each supplier joins on a day of 1995 and may leave in 1999."""
    s = table(spark, root, "supplier")
    return s.select(F.col("s_suppkey").alias("ticker"),
                    F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") % 365).cast("int")).alias("start_date"),
                    F.when(F.col("s_nationkey") < 12, F.date_add(F.lit("1999-01-01").cast("date"), (F.col("s_nationkey") * 30).cast("int"))).alias("end_date"))


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """Funds statement: account = customer, one signed cash movement per order."""
    o = table(spark, root, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "DEPOSIT").when(F.col("o_orderpriority") == "5-LOW", "CHARGE").when(
        F.col("o_orderstatus") == "O", "BUY").otherwise("SELL")
    amount = F.when(kind == "CHARGE", -F.col("o_totalprice") * 0.001).when(kind == "BUY", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return o.select(F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"),
                    kind.alias("type"), amount.alias("amount"))


def trades(spark: SparkSession, root: str) -> DataFrame:
    """Fills: one trade per bar, keyed by (ticker, day); odd share counts are closed within a week."""
    b = bars(spark, root)
    shares, close = F.col("volume").cast("long"), F.col("close")
    closed = shares % 2 == 1
    return b.select(
        (F.col("ticker") * 100000 + F.unix_date("date")).alias("trade_id"), "ticker", (F.col("ticker") % 97).alias("account"),
        F.col("date").alias("entry_date"), close.alias("ref_price"), shares.alias("shares"), (close * 0.97).alias("stop_loss"), (close * 1.04).alias("target_price"),
        (5 + shares % 7 * 2).cast("int").alias("horizon_days"), (0.5 + (shares % 10) / 100.0).alias("prob_up"),
        F.when(closed, "closed").otherwise("open").alias("status"),
        F.when(closed, F.date_add("date", (1 + shares % 7).cast("int"))).alias("exit_date"),
        F.when(closed, close * (1.0 + (shares % 21 - 10) / 100.0)).alias("exit_ref_price"),
        F.when(closed, F.when(shares % 3 == 0, "stop").when(shares % 3 == 1, "target").otherwise("expired")).alias("exit_reason"))


def model_runs(spark: SparkSession, root: str) -> DataFrame:
    """One run per order month with metrics aggregated from that month's orders."""
    o = table(spark, root, "orders")
    m = o.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("run_date")).agg(
        (F.avg("o_totalprice") / 100000.0 - 2.0).alias("sharpe_net"),
        ((F.avg(F.col("o_orderkey") % 100) - 49.5) / 50.0).alias("oof_ic"),
        F.avg((F.col("o_orderkey") % 10) / 50.0).alias("calib_err"),
        F.count(F.lit(1)).alias("n_trials"))
    return m.select(F.concat(F.lit("run-"), F.date_format("run_date", "yyyyMM")).alias("run_id"), "run_date", "sharpe_net", "oof_ic", "calib_err", "n_trials",
                    (F.month("run_date") % 4 == 0).alias("is_deployed"))


def strategy_returns(spark: SparkSession, root: str) -> DataFrame:
    """(strategy, date, ret): monthly change of the mean order value per priority."""
    from ..functions.windows import lag

    o = table(spark, root, "orders")
    m = o.groupBy(F.col("o_orderpriority").alias("strategy"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(F.avg("o_totalprice").alias("v"))
    return m.select("strategy", "date", (ratio("v", lag("v", 1, by="strategy")) - 1.0).alias("ret")).where(F.col("ret").isNotNull())


def error_stream(spark: SparkSession, root: str) -> DataFrame:
    """Scored events as a prediction-error stream per event type."""
    e = table(spark, root, "events")
    return e.select(F.col("event_type").alias("stream"), "event_id", "ts", "user_id", (F.col("value") / 100.0).alias("err"))
