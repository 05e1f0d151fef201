"""Queries of the source, sink, gate and calendar operators, and of the plain relational steps."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..functions.ordered import row_number_in
from ..operators import calendar, gates
from ..session import stage, staging_root, track
from ..sources import panel, tables
from .base import BARS, INDEX, TRADES, lagq, leadq, query, r, roll, rounded, rs

OHLCV = ["open", "high", "low", "close", "volume"]
KEYS = ["ticker", "date"]


# --- scans -----------------------------------------------------------------
@query(f"WITH {BARS} SELECT ticker, date, {rs(OHLCV, 4)} FROM bars WHERE ticker IN (1, 2, 3, 5, 8) AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def load_prices(spark, root):
    """Symbol list and date range; the symbols reach the scan below the bars' aggregate."""
    return rounded(tables.load_prices(panel.bars(spark, root), [1, 2, 3, 5, 8], "1996-01-01", "1998-12-31"), KEYS, OHLCV, 4)


@query(f"WITH {INDEX} SELECT 'INDEX' AS ticker, date, {r('nifty_close', 4)} AS close FROM idx0 UNION ALL SELECT 'VIX' AS ticker, date, {r('vix', 4)} AS close FROM vix0")
def load_index(spark, root):
    return rounded(panel.index_bars(spark, root), KEYS, ["close"], 4)


_SPLIT = "DATE '1999-01-01'"


def _batches(spark, root):
    """A stored table (before 2000) and a re-delivered batch (from 1999, prices shifted)."""
    b = panel.bars(spark, root).select(*KEYS, "close", "volume")
    old = b.where(F.col("date") < F.lit("2000-01-01").cast("date"))
    new = b.where(F.col("date") >= F.lit("1999-01-01").cast("date")).withColumn("close", F.col("close") + 1.0)
    return old, new


_MERGED = f"{BARS}, mg AS (SELECT ticker, date, CASE WHEN date >= {_SPLIT} THEN close + 1.0 ELSE close END AS close, volume FROM bars)"


@query(f"WITH {_MERGED} SELECT ticker, date, {rs(['close', 'volume'], 4)} FROM mg")
def upsert_prices(spark, root):
    old, new = _batches(spark, root)
    return rounded(tables.merge_rows(old, new, KEYS), KEYS, ["close", "volume"], 4)


@query(f"WITH {BARS} SELECT count(*) AS n_new FROM bars WHERE date >= DATE '2000-01-01'")
def upsert_new_count(spark, root):
    old, new = _batches(spark, root)
    return tables.new_rows(old, new, KEYS).agg(F.count(F.lit(1)).alias("n_new"))


@query(f"WITH {_MERGED} SELECT ticker, CAST(year(date) AS INTEGER) AS year, count(*) AS n, {r('sum(close)', 2)} AS close_sum FROM mg GROUP BY 1, 2")
def landing_append(spark, root):
    """Write a landing table, append a batch, read the partitioned result back."""
    old, new = _batches(spark, root)
    base = f"{staging_root(spark)}/landing-{uuid.uuid4().hex}"
    tables.write_landing(old, base)
    tables.append_landing(spark, base, new)
    return spark.read.parquet(base).groupBy("ticker", "year").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("close"), 2).alias("close_sum"))


@query(f"SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS ticker, {r('min(o_totalprice)', 2)} AS close FROM orders GROUP BY 1, 2")
def wide_feed_reshape(spark, root):
    """A wide feed (one Close column per symbol) back to long, cleaned rows."""
    o = tables.table(spark, root, "orders")
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = o.groupBy(F.to_date("o_orderdate").alias("Date")).pivot("o_orderpriority", names).agg(F.min("o_totalprice"))
    wide = wide.withColumnsRenamed({n: f"Close|{n}" for n in names})
    long = tables.clean_bars(tables.wide_to_long(wide))
    return long.select("date", "ticker", rnd("close", 2).alias("close"))


@query("SELECT event_type AS ticker, CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) > 0 GROUP BY 1, 2")
def clean_feed(spark, root):
    """Text prices: unreadable, missing and non-positive closes are dropped."""
    e = tables.table(spark, root, "events")
    raw = e.select(F.col("event_type").alias("ticker"), F.col("ts").alias("date"), F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("close"))
    return tables.clean_bars(raw).groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS ticker FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def missing_tickers(spark, root):
    requested = tables.table(spark, root, "customer").select(F.col("c_custkey").alias("ticker"))
    return tables.missing_tickers(requested, tables.table(spark, root, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("ticker")))


@query(f"WITH {BARS}, s AS (SELECT DISTINCT ticker FROM bars), a AS (SELECT s_nationkey AS canonical, min(s_suppkey) AS ticker FROM supplier JOIN s ON s_suppkey = ticker GROUP BY 1) SELECT CAST(canonical AS BIGINT) AS ticker, date, {r('close', 4)} AS close FROM bars JOIN a USING (ticker)")
def alias_resolution(spark, root):
    """Each nation is a canonical symbol, its suppliers the candidates in key order."""
    a = tables.table(spark, root, "supplier").select(F.col("s_nationkey").cast("bigint").alias("canonical"), F.col("s_suppkey").alias("candidate"), F.col("s_suppkey").alias("priority"))
    return rounded(tables.resolve_aliases(a, panel.bars(spark, root)), KEYS, ["close"], 4)


@query(f"SELECT o_orderkey, o_custkey, {r('o_totalprice', 2)} AS o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def fetch_rows(spark, root):
    d = tables.fetch_rows(tables.table(spark, root, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, ["-o_totalprice", "o_orderkey"], 100)
    return d.select("o_orderkey", "o_custkey", rnd("o_totalprice", 2).alias("o_totalprice"))


_RUNS = """m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS run_date, avg(o_totalprice)/100000.0 - 2.0 AS sharpe_net, (avg(o_orderkey % 100) - 49.5)/50.0 AS oof_ic, avg((o_orderkey % 10)/50.0) AS calib_err, count(*) AS n_trials FROM orders GROUP BY 1),
runs AS (SELECT 'run-' || strftime(run_date, '%Y%m') AS run_id, *, month(run_date) % 4 = 0 AS is_deployed FROM m)"""
_RC = {"sharpe_net": 6, "oof_ic": 6, "calib_err": 6}


@query(f"WITH {_RUNS} SELECT run_id, run_date, n_trials, CASE WHEN run_id = 'run-199605' THEN 0.5 ELSE {r('oof_ic')} END AS oof_ic, CASE WHEN run_id = 'run-199605' THEN true ELSE is_deployed END AS is_deployed FROM runs")
def update_matching_rows(spark, root):
    u = tables.update_rows(panel.model_runs(spark, root), {"oof_ic": 0.5, "is_deployed": True}, {"run_id": "run-199605"})
    return u.select("run_id", "run_date", "n_trials", rnd("oof_ic", 6).alias("oof_ic"), "is_deployed")


@query(f"WITH {_RUNS} SELECT run_id, run_date, n_trials + CASE WHEN run_date >= DATE '1998-01-01' THEN 1000 ELSE 0 END AS n_trials, {r('sharpe_net')} AS bt_sharpe FROM runs")
def run_metadata_upsert(spark, root):
    """Statistics renamed to the stored columns and merged on run_id."""
    runs = panel.model_runs(spark, root).select("run_id", "run_date", "n_trials", F.col("sharpe_net").alias("Sharpe"))
    stored = tables.run_metadata(runs)
    batch = tables.run_metadata(runs.where(F.col("run_date") >= F.lit("1998-01-01").cast("date")).withColumn("n_trials", F.col("n_trials") + 1000))
    m = tables.merge_rows(stored, batch, ["run_id"])
    return m.select("run_id", "run_date", "n_trials", rnd("bt_sharpe", 6).alias("bt_sharpe"))


@query(f"WITH {_RUNS} SELECT run_id, run_date, {r('oof_ic')} AS oof_ic FROM runs ORDER BY run_date DESC, run_id LIMIT 10")
def newest_runs(spark, root):
    return tables.newest_runs(panel.model_runs(spark, root), 10).select("run_id", "run_date", rnd("oof_ic", 6).alias("oof_ic"))


@query("SELECT CAST(o_orderdate AS DATE) AS signal_date, 'r' || (o_orderkey % 5) AS run_id, o_orderkey AS ticker, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '2000-01-01' THEN 2 ELSE 1 END AS version FROM orders "
       "WHERE CAST(o_orderdate AS DATE) < DATE '2000-01-01' OR o_orderstatus <> 'F' OR NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderstatus <> 'F' AND CAST(b.o_orderdate AS DATE) = CAST(orders.o_orderdate AS DATE) AND b.o_orderkey % 5 = orders.o_orderkey % 5)"
       .replace("CASE WHEN CAST(o_orderdate AS DATE) >= DATE '2000-01-01' THEN 2 ELSE 1 END", "CASE WHEN CAST(o_orderdate AS DATE) >= DATE '2000-01-01' AND o_orderstatus <> 'F' THEN 2 ELSE 1 END"))
def journal_write(spark, root):
    """Rows of a re-delivered (signal_date, run_id) replace every stored row of that slice."""
    o = tables.table(spark, root, "orders")
    j = o.select(F.to_date("o_orderdate").alias("signal_date"), F.concat(F.lit("r"), F.col("o_orderkey") % 5).alias("run_id"), F.col("o_orderkey").alias("ticker"), "o_orderstatus", F.lit(1).alias("version"))
    batch = j.where((F.col("signal_date") >= F.lit("2000-01-01").cast("date")) & (F.col("o_orderstatus") != "F")).withColumn("version", F.lit(2))
    return tables.replace_slice(j, batch, ["signal_date", "run_id"]).drop("o_orderstatus")


@query(f"WITH {TRADES} SELECT trade_id, ticker, CASE WHEN status = 'closed' THEN 'run-b' ELSE 'run-a' END AS run_id, count(*) AS n FROM trades GROUP BY 1, 2, 3")
def sync_trades(spark, root):
    """Idempotent by trade_id: a second sync of the closed trades restamps them only."""
    t = panel.trades(spark, root).select("trade_id", "ticker", "status")
    first = tables.stamp_run(t, "run-a")
    again = tables.stamp_run(t.where(F.col("status") == "closed"), "run-b")
    m = tables.merge_rows(tables.merge_rows(first, again, ["trade_id"]), again, ["trade_id"])
    return m.groupBy("trade_id", "ticker", "run_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d') AS DATE) AS day, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, root):
    e = tables.table(spark, root, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy(F.to_date(F.substring(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), 1, 10)).alias("day"), "event_type", F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


DOCUMENT_ROWS = 2000


def _portfolio_files(spark, rows, row, name):
    """Portfolio documents of an account written as JSON: each holds some DOCUMENT_ROWS rows, however large the account."""
    slices = F.greatest(F.ceil(F.count(F.lit(1)) / DOCUMENT_ROWS), F.lit(1))
    sizes = rows.groupBy("account").agg(slices.alias("slices"))
    cut = rows.join(sizes, "account").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")))
    docs = cut.groupBy("account", "slice").agg(F.collect_list(row).alias(name), F.first(F.col("account") * 1000.0).alias("initial_capital"))
    docs = docs.withColumn("cash", F.when(F.col("account") % 2 == 0, F.col("account") * 10.0))
    path = f"{staging_root(spark)}/portfolio-{uuid.uuid4().hex}"
    docs.write.mode("overwrite").json(path)
    return spark.read.schema(tables.PORTFOLIO_SCHEMA).json(path)


@query(f"WITH {TRADES} SELECT CAST(trade_id AS VARCHAR) AS trade_id, CAST(ticker AS VARCHAR) AS ticker, shares FROM trades")
def portfolio_trades(spark, root):
    """Nested portfolio files written as JSON and exploded back to trades."""
    t = panel.trades(spark, root).withColumn("id", F.col("trade_id"))
    row = F.struct(F.col("trade_id").cast("string").alias("trade_id"), F.col("ticker").cast("string").alias("ticker"), F.col("shares"), F.lit("x").alias("unknown_field"))
    return tables.portfolio_trades(_portfolio_files(spark, t, row, "trades")).select("trade_id", "ticker", "shares")


def _funds(spark, root):
    """Orders as entries of an append-only statement."""
    o = tables.table(spark, root, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("account"), F.col("o_orderstatus").alias("type"), F.col("o_totalprice").alias("amount"))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS type, {r('o_totalprice', 2)} AS amount FROM orders")
def portfolio_ledger(spark, root):
    """The same files' ledger entries."""
    row = F.struct(F.col("id").cast("string").alias("id"), "type", "amount")
    return tables.portfolio_ledger(_portfolio_files(spark, _funds(spark, root), row, "ledger")).select("id", "type", rnd("amount", 2).alias("amount"))


@query("SELECT DISTINCT o_custkey % 7 * 1000.0 AS initial_capital, CASE WHEN o_custkey % 7 % 2 = 0 THEN o_custkey % 7 * 10.0 ELSE o_custkey % 7 * 1000.0 END AS cash, 0.05 AS position_size_pct FROM orders"
       .replace("o_custkey % 7 * 1000.0", "CAST(o_custkey % 7 * 1000 AS DOUBLE)").replace("o_custkey % 7 * 10.0", "CAST(o_custkey % 7 * 10 AS DOUBLE)").replace("0.05 AS", "CAST(0.05 AS DOUBLE) AS"))
def portfolio_header(spark, root):
    """Header fields of portfolio files, with their defaults."""
    row = F.struct(F.col("id").cast("string").alias("id"), "type", "amount")
    return tables.portfolio_header(_portfolio_files(spark, _funds(spark, root), row, "ledger")).distinct()


@query("WITH o AS (SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN 'broken' WHEN o_orderkey % 17 = 0 THEN 'broken' WHEN o_orderkey % 19 = 0 THEN 'missing ticker' ELSE 'kept' END AS reason FROM orders) "
       f"SELECT reason, count(*) AS n, {r('sum(CASE WHEN reason = ' + chr(39) + 'kept' + chr(39) + ' THEN o_totalprice END)', 2)} AS total FROM o GROUP BY 1")
def hostile_journal(spark, root):
    """A journal with cut lines, values of another type and missing keys: what is kept, and why the rest is not."""
    o = tables.table(spark, root, "orders")
    key = F.col("o_orderkey")
    whole = F.to_json(F.struct(F.when(key % 19 != 0, key.cast("string")).alias("ticker"), F.to_date("o_orderdate").cast("string").alias("signal_date"), F.col("o_totalprice").alias("entry_price"), F.lit(1).alias("unknown")))
    text = F.when(key % 13 == 0, F.expr("substring(j, 1, length(j) - 5)")).when(key % 17 == 0, F.regexp_replace("j", '"entry_price":', '"entry_price":"n/a","x":')).otherwise(F.col("j"))
    path = f"{staging_root(spark)}/hostile-{uuid.uuid4().hex}"
    track(spark, path)
    o.withColumn("j", whole).select("o_orderkey", "j").select(text.alias("value")).write.text(path)
    rows, quarantine = tables.read_hostile(spark, path, tables.SIGNAL_SCHEMA, ["ticker"])
    kept = rows.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n"), rnd(F.sum("entry_price"), 2).alias("total"))
    return kept.unionByName(quarantine.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("total")))


@query(f"WITH {BARS} SELECT ticker, date, {r(f'{roll("avg", "close", 5)}')} AS sma5, count(*) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS n FROM bars")
def bucketed_panel(spark, root):
    """The panel stored in buckets by ticker in two parts; its windows then run where the rows lie."""
    b = stage(panel.bars(spark, root))
    name = f"panel_{uuid.uuid4().hex}"
    cut = F.lit("1996-01-01").cast("date")
    tables.write_panel(b.where(F.col("date") < cut), name, 8)
    t = tables.write_panel(b.where(F.col("date") >= cut), name, 8, mode="append")
    w = W.partitionBy("ticker").orderBy("date")
    five = w.rowsBetween(-4, 0)
    out = t.select("ticker", "date", rnd(F.when(F.count("close").over(five) == 5, F.avg("close").over(five)), 6).alias("sma5"), F.count(F.lit(1)).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("n"))
    out = stage(out)
    spark.sql(f"DROP TABLE {name}")
    return out


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'run-b' ELSE 'run-a' END AS run_id, {r('CASE WHEN o_orderstatus = ' + chr(39) + 'F' + chr(39) + ' THEN o_totalprice + 1 ELSE o_totalprice END', 2)} AS amount, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def sync_ledger(spark, root):
    """Idempotent by id: entries synced again replace their older row, and a repeated sync changes nothing."""
    e = _funds(spark, root)
    first = tables.stamp_run(e, "run-a")
    again = tables.stamp_run(e.where(F.col("type") == "F").withColumn("amount", F.col("amount") + 1), "run-b")
    m = tables.merge_rows(tables.merge_rows(first, again, ["id"]), again.unionByName(again), ["id"])
    return m.groupBy("id", "run_id", rnd("amount", 2).alias("amount")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority AS signal, count(*) AS n, " + r("sum(o_totalprice)", 2) + " AS total FROM orders GROUP BY 1")
def export_csv_json(spark, root):
    """Rows exported as CSV and JSON, read back with a fixed schema; both files must agree."""
    o = tables.table(spark, root, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("signal"), F.col("o_totalprice").alias("v"))
    path = f"{staging_root(spark)}/export-{uuid.uuid4().hex}"
    tables.write_outcomes(o, path)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("signal", T.StringType()), T.StructField("v", T.DoubleType())])
    a = tables.read_journal(spark, f"{path}/csv", schema, "csv")
    b = spark.read.schema(schema).json(f"{path}/json")
    return a.join(b.select("id", F.col("v").alias("w")), "id").groupBy("signal").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum((F.col("v") + F.col("w")) / 2), 2).alias("total"))


# --- gates -----------------------------------------------------------------
_V = "count(*) FILTER (close <= 0) AS bad_close, count(*) FILTER (high < greatest(open, close) - 1e-6) AS bad_high, count(*) FILTER (low > least(open, close) + 1e-6) AS bad_low, count(*) FILTER (volume < 0) AS bad_volume, count(*) FILTER (high IS NULL OR low IS NULL OR close IS NULL) AS missing, count(*) AS n_rows"


def _dirty(b):
    """Every rule broken somewhere, by price cents and volume."""
    return b.withColumn("high", F.when(F.col("volume") == 7, F.col("low")).otherwise(F.col("high"))).withColumn("volume", F.when(F.col("volume") == 11, -1.0).otherwise(F.col("volume")))


_DIRTY = f"{BARS}, dirty AS (SELECT ticker, date, open, CASE WHEN volume = 7 THEN low ELSE high END AS high, low, close, CASE WHEN volume = 11 THEN -1.0 ELSE volume END AS volume FROM bars)"


@query(f"WITH {_DIRTY} SELECT {_V} FROM dirty")
def ohlcv_report(spark, root):
    return gates.ohlcv_report(_dirty(panel.bars(spark, root)))


@query(f"WITH {_DIRTY} SELECT ticker, date, concat_ws('|', CASE WHEN close <= 0 THEN 'bad_close' END, CASE WHEN high < greatest(open, close) - 1e-6 THEN 'bad_high' END, CASE WHEN low > least(open, close) + 1e-6 THEN 'bad_low' END, CASE WHEN volume < 0 THEN 'bad_volume' END) AS broken FROM dirty "
       "WHERE close <= 0 OR high < greatest(open, close) - 1e-6 OR low > least(open, close) + 1e-6 OR volume < 0")
def ohlcv_violations(spark, root):
    return gates.ohlcv_violations(_dirty(panel.bars(spark, root))).select(*KEYS, F.concat_ws("|", "broken").alias("broken"))


@query(f"WITH {BARS}, g AS (SELECT ticker, date - {lagq('date')} AS gap FROM bars) SELECT ticker, CAST(max(gap) AS INTEGER) AS worst_gap, count(*) AS n_gaps FROM g WHERE gap > 5 GROUP BY ticker")
def date_gaps(spark, root):
    return gates.date_gaps(panel.bars(spark, root))


@query(f"WITH {BARS}, l AS (SELECT date, ln({leadq('close', 5)}/close) AS fwd_ret FROM bars) SELECT max(date) AS max_feature_date, max(date) FILTER (fwd_ret IS NOT NULL) AS max_label_date, false AS leak FROM l")
def future_leak(spark, root):
    from ..operators.labels import forward_log_return

    b = panel.bars(spark, root)
    return gates.future_leak(b, b.withColumn("fwd_ret", forward_log_return(5)))


@query(f"WITH {BARS} SELECT max(date) AS latest, CAST(DATE '2001-12-01' - max(date) AS INTEGER) AS lag_days, DATE '2001-12-01' - max(date) > 5 AS stale FROM bars")
def freshness(spark, root):
    return gates.freshness(panel.bars(spark, root), "2001-12-01")


@query(f"WITH {BARS}, l AS (SELECT ticker, date, ln(close/{lagq('close')}) AS lr FROM bars) SELECT ticker, date, CAST(coalesce(abs(lr - avg(lr) OVER ()) > 3.0*stddev_samp(lr) OVER (), false) AS INTEGER) AS spike_flag FROM l")
def spike_flags(spark, root):
    return gates.spike_flags(panel.bars(spark, root), n_sigma=3.0).select(*KEYS, "spike_flag")


@query(f"WITH {BARS}, l AS (SELECT ticker, date, ln(close/{lagq('close')}) AS lr FROM bars), f AS (SELECT ticker, coalesce(abs(lr - avg(lr) OVER ()) > 10.0*stddev_samp(lr) OVER (), false) AS s FROM l) SELECT ticker, count(*) AS n_rows, count(*) FILTER (s) AS n_spikes FROM f GROUP BY ticker")
def run_gates(spark, root):
    checked, _ = gates.run_gates(stage(panel.bars(spark, root)), end="2001-11-05")
    return checked.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("spike_flag") == 1).alias("n_spikes"))


# --- calendar (days with at most four orders stand in for the holiday list) ---
_HOL = "hol AS (SELECT CAST(o_orderdate AS DATE) AS date FROM orders GROUP BY 1 HAVING count(*) <= 4)"


def _holidays(spark, root):
    o = tables.table(spark, root, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return o.where(F.col("n") <= 4).select("date")


@query(f"WITH {_HOL} SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT date FROM hol)")
def trading_days(spark, root):
    return calendar.trading_days(spark, "1995-01-01", "2001-12-31", _holidays(spark, root))


@query(f"WITH {_HOL}, d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders), u AS (SELECT DISTINCT date FROM d), c AS (SELECT date, CAST(unnest(generate_series(date + 1, date + 11, INTERVAL 1 DAY)) AS DATE) AS x FROM u), "
       "k AS (SELECT date, min(x) AS nx FROM c WHERE isodow(x) < 6 AND x NOT IN (SELECT date FROM hol) GROUP BY date) SELECT o_orderkey, d.date, isodow(d.date) < 6 AND d.date NOT IN (SELECT date FROM hol) AS is_trading_day, coalesce(nx, d.date + 1) AS next_trading_day FROM d LEFT JOIN k USING (date)")
def next_trading_day(spark, root):
    o = tables.table(spark, root, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    h = _holidays(spark, root)
    return calendar.next_trading_day(calendar.is_trading_day(o, h), h)


_LOCAL = "e AS (SELECT event_id, ts + INTERVAL 330 MINUTE AS t FROM events)"


@query(f"WITH {_LOCAL} SELECT event_id, isodow(t) < 6 AND CAST(t AS TIME) >= TIME '09:15:00' AND CAST(t AS TIME) <= TIME '15:30:00' AS is_open FROM e")
def market_open(spark, root):
    return tables.table(spark, root, "events").select("event_id", calendar.market_open("ts").alias("is_open"))


@query(f"WITH {_LOCAL}, d AS (SELECT event_id, CAST(t AS DATE) + CASE WHEN CAST(t AS TIME) < TIME '09:15:00' THEN 0 ELSE 1 END AS d FROM e), w AS (SELECT event_id, d + CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS d FROM d) SELECT event_id, strftime(d, '%Y-%m-%d') || ' 09:15:00' AS next_open FROM w")
def next_market_open(spark, root):
    return tables.table(spark, root, "events").select("event_id", F.date_format(calendar.next_market_open("ts"), "yyyy-MM-dd HH:mm:ss").alias("next_open"))


# --- relational steps ------------------------------------------------------
@query(f"WITH {BARS} SELECT b.ticker, count(*) AS n_member, min(date) AS first_date, max(date) AS last_date FROM bars b JOIN supplier s ON s_suppkey = b.ticker WHERE date >= DATE '1995-01-01' + CAST(s_suppkey % 365 AS INTEGER) AND (s_nationkey >= 12 OR date < DATE '1999-01-01' + CAST(s_nationkey*30 AS INTEGER)) GROUP BY 1")
def interval_membership(spark, root):
    """start <= date < end per ticker: an equality join with a range condition."""
    b, m = panel.bars(spark, root), panel.membership(spark, root)
    j = b.join(m, "ticker").where((F.col("date") >= F.col("start_date")) & (F.col("end_date").isNull() | (F.col("date") < F.col("end_date"))))
    return j.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_member"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1, 2")
def dedupe_keep_last(spark, root):
    """Keep-first and keep-last rows per (customer, day)."""
    o = tables.table(spark, root, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey")
    first = tables.dedupe(o, ["o_custkey", "day"], [F.col("o_orderkey")]).withColumnRenamed("o_orderkey", "first_key")
    last = tables.dedupe(o, ["o_custkey", "day"], [-F.col("o_orderkey")]).withColumnRenamed("o_orderkey", "last_key")
    return first.join(last, ["o_custkey", "day"])


@query("SELECT a.ticker, 'both' AS kind FROM (SELECT DISTINCT l_suppkey AS ticker FROM lineitem WHERE l_returnflag = 'R') a JOIN (SELECT DISTINCT l_suppkey AS ticker FROM lineitem WHERE l_quantity >= 50) b USING (ticker) "
       "UNION ALL (SELECT DISTINCT s_suppkey AS ticker, 'none' AS kind FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50))")
def set_operations(spark, root):
    """Semi, anti and union: tickers in both sets, and suppliers outside the second."""
    li = tables.table(spark, root, "lineitem").withColumnRenamed("l_suppkey", "ticker")
    a = li.where(F.col("l_returnflag") == "R").select("ticker").distinct()
    b = li.where(F.col("l_quantity") >= 50).select("ticker").distinct()
    s = tables.table(spark, root, "supplier").select(F.col("s_suppkey").alias("ticker"))
    return a.join(b, "ticker", "left_semi").withColumn("kind", F.lit("both")).unionByName(s.join(b, "ticker", "left_anti").withColumn("kind", F.lit("none")))


@query("SELECT ticker, mode_flag FROM (SELECT l_suppkey AS ticker, l_returnflag AS mode_flag, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1")
def group_mode(spark, root):
    """Most frequent value per group, ties to the smallest: counts first, then the best struct."""
    c = tables.table(spark, root, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.col("l_returnflag").alias("f")).agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("ticker").agg(F.min(F.struct((-F.col("c")).alias("o"), F.col("f"))).alias("m")).select("ticker", F.col("m.f").alias("mode_flag"))


@query("SELECT l_suppkey AS ticker, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey*8 + l_linenumber) AS k FROM lineitem) WHERE k <= 3")
def top_rows_per_ticker(spark, root):
    """Top 3 lines per supplier; a hot supplier is cut into ordered segments."""
    li = tables.table(spark, root, "lineitem").select(F.col("l_suppkey").alias("ticker"), "l_orderkey", "l_linenumber", (-F.col("l_extendedprice")).alias("o"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    return row_number_in(li, ["ticker"], "o", "id").where(F.col("rn") <= 3).select("ticker", "l_orderkey", "l_linenumber")


@query("SELECT event_id, event_type, value FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 500")
def sample_rows(spark, root):
    """500 rows in the order of a seeded digest of their id (a sampling operator)."""
    e = tables.table(spark, root, "events").select("event_id", "event_type", "value")
    return e.orderBy(F.md5(F.concat_ws("|", F.lit("42"), "event_id")), "event_id").limit(500)


@query("SELECT upper(c_mktsegment) AS segment, left(c_name, 8) AS prefix, starts_with(c_name, 'Customer#0000') AS low, left(sha256(concat_ws('|', c_name, c_mktsegment)), 16) AS digest, printf('%s / %d', c_mktsegment, c_custkey) AS label FROM customer")
def string_functions(spark, root):
    c = tables.table(spark, root, "customer")
    return c.select(F.upper("c_mktsegment").alias("segment"), F.substring("c_name", 1, 8).alias("prefix"), F.col("c_name").startswith("Customer#0000").alias("low"),
                    F.substring(F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256), 1, 16).alias("digest"), F.format_string("%s / %d", "c_mktsegment", "c_custkey").alias("label"))


@query("SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, CAST(max(CAST(o_orderdate AS DATE)) - min(CAST(o_orderdate AS DATE)) AS INTEGER) AS span FROM orders GROUP BY 1, 2")
def date_functions(spark, root):
    o = tables.table(spark, root, "orders").select(F.to_date("o_orderdate").alias("d"))
    return o.groupBy(F.to_date(F.date_trunc("week", "d")).alias("week"), F.date_format("d", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.datediff(F.max("d"), F.min("d")).alias("span"))
