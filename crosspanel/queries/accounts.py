"""Queries of the trade, ledger, signal and outcome operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import accounting, costs, outcomes, runs, signals
from ..plans.assembly import journal_predictions, momentum_predictions
from ..session import stage, staging_root
from ..sources import panel, tables
from .base import PREDS, TRADES, query, r, rounded, rs, spearman_sql
from .evaluation import _leg
from .labels import ATR
from .tables import _RUNS

# --- trades ----------------------------------------------------------------
_FILL, _GROSS = "(ref_price*1.001)", "(ref_price*1.001*shares)"
OPENED = f"""{TRADES}, op AS (SELECT *, {r(_FILL, 2)} AS entry_price, {r(_leg(_GROSS, 'buy'), 2)} AS entry_charges, {r(f'({_FILL} - ref_price)*shares', 2)} AS entry_slippage,
  {r(f"({_GROSS} + {_leg(_GROSS, 'buy')} + {_leg(_GROSS, 'sell')})/greatest(shares, 1)", 2)} AS breakeven_price FROM trades)"""


def _close_sql(ref: str) -> str:
    fill, proceeds = f"({ref}*0.999)", f"({ref}*0.999*shares)"
    gross = f"({proceeds} - shares*entry_price)"
    net = f"({gross} - {_leg(proceeds, 'sell')} - entry_charges)"
    base = "greatest(shares*entry_price, 1e-9)"
    e = {"exit_price": fill, "exit_charges": _leg(proceeds, "sell"), "exit_slippage": f"({ref} - {fill})*shares", "gross_pnl": gross, "gross_pnl_pct": f"{gross}/{base}*100", "pnl": net, "pnl_pct": f"{net}/{base}*100"}
    return ", ".join(f"{r(x, 2)} AS {k}" for k, x in e.items())


CLOSED = f"{OPENED}, cl AS (SELECT *, {_close_sql('exit_ref_price')} FROM op WHERE status = 'closed')"


def _opened(spark, root):
    return accounting.open_fills(panel.trades(spark, root))


def _closed(spark, root):
    return accounting.close_trades(_opened(spark, root).where(F.col("status") == "closed"))


_EN = ["entry_price", "entry_charges", "entry_slippage", "breakeven_price"]
_EX = ["exit_price", "exit_charges", "exit_slippage", "gross_pnl", "gross_pnl_pct", "pnl", "pnl_pct"]


@query(f"WITH {OPENED} SELECT trade_id, {', '.join(_EN)} FROM op")
def entry_fills(spark, root):
    return _opened(spark, root).select("trade_id", *_EN)


def _preview_sql():
    b = {"fill_price": _FILL, "gross_cost": _GROSS, "charges": _leg(_GROSS, "buy"), "total_debit": f"({_GROSS} + {_leg(_GROSS, 'buy')})"}
    p = "(ref_price*0.999*shares)"
    s = {"sell_fill": "(ref_price*0.999)", "proceeds": p, "net_credit": f"({p} - {_leg(p, 'sell')})"}
    return ", ".join(f"{r(x, 2)} AS {k}" for k, x in {**b, **s}.items())


@query(f"WITH {TRADES} SELECT trade_id, {_preview_sql()} FROM trades")
def order_previews(spark, root):
    t = panel.trades(spark, root)
    b, s = costs.buy_preview(F.col("ref_price"), F.col("shares")), costs.sell_preview(F.col("ref_price"), F.col("shares"))
    return t.select("trade_id", *[b[c].alias(c) for c in ("fill_price", "gross_cost", "charges", "total_debit")], s["fill_price"].alias("sell_fill"), s["proceeds"].alias("proceeds"), s["net_credit"].alias("net_credit"))


@query(f"WITH {CLOSED} SELECT trade_id, {', '.join(_EX)} FROM cl")
def closed_trade_pnl(spark, root):
    return _closed(spark, root).select("trade_id", *_EX)


LATEST = "lp AS (SELECT ticker, close AS last_price, date AS as_of FROM bars WHERE date = (SELECT max(date) FROM bars))"
_SETTLE = "CASE WHEN last_price >= target_price THEN 'target' WHEN last_price <= stop_loss THEN 'stop' WHEN as_of - entry_date >= horizon_days THEN 'expired' END"


@query(f"WITH {OPENED}, {LATEST}, j AS (SELECT op.* EXCLUDE (exit_reason, exit_date), lp.last_price, as_of, {_SETTLE} AS exit_reason FROM op JOIN lp USING (ticker) WHERE status = 'open') "
       f"SELECT trade_id, exit_reason, as_of AS exit_date, CAST(as_of - entry_date AS INTEGER) AS days_held, {_close_sql('last_price')} FROM j WHERE exit_reason IS NOT NULL")
def settle_exits(spark, root):
    o = _opened(spark, root).where(F.col("status") == "open").drop("exit_date", "exit_reason")
    return accounting.settle_exits(o, panel.bars(spark, root)).select("trade_id", "exit_reason", "exit_date", "days_held", *_EX)


@query(f"WITH {OPENED}, {LATEST}, j AS (SELECT op.*, lp.last_price FROM op LEFT JOIN lp USING (ticker) WHERE status = 'open') SELECT trade_id, {r('last_price', 2)} AS current_price, "
       f"{r('shares*(last_price - entry_price) - entry_charges - ' + _leg('(shares*last_price)', 'sell'), 2)} AS unrealized_pnl, {r('(shares*(last_price - entry_price) - entry_charges - ' + _leg('(shares*last_price)', 'sell') + ')/(shares*entry_price)*100', 2)} AS unrealized_pnl_pct FROM j")
def mark_to_market(spark, root):
    o = _opened(spark, root).where(F.col("status") == "open")
    m = accounting.mark_to_market(o, accounting.latest_prices(panel.bars(spark, root)))
    return m.select("trade_id", "current_price", "unrealized_pnl", "unrealized_pnl_pct")


LEDGER = """kd AS (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 'DEPOSIT' WHEN o_orderpriority = '5-LOW' THEN 'CHARGE' WHEN o_orderstatus = 'O' THEN 'BUY' ELSE 'SELL' END AS type FROM orders),
ledger AS (SELECT o_custkey AS account, CAST(o_orderdate AS DATE) AS ts, o_orderkey AS seq, type, CASE type WHEN 'CHARGE' THEN -o_totalprice*0.001 WHEN 'BUY' THEN -o_totalprice ELSE o_totalprice END AS amount FROM kd)"""


@query(f"WITH {OPENED}, {LATEST}, {LEDGER}, iv AS (SELECT account, sum(shares*coalesce(last_price, entry_price)) AS invested FROM op LEFT JOIN lp USING (ticker) WHERE status = 'open' GROUP BY account), c AS (SELECT account, sum(amount) AS cash FROM ledger GROUP BY account) "
       f"SELECT c.account, {r('cash', 2)} AS cash, {r('coalesce(invested, 0.0)', 2)} AS invested, {r('cash + coalesce(invested, 0.0)', 2)} AS portfolio_value FROM c LEFT JOIN iv USING (account)")
def portfolio_value(spark, root):
    o = _opened(spark, root).where(F.col("status") == "open")
    v = accounting.portfolio_value(o, accounting.latest_prices(panel.bars(spark, root)), accounting.account_balance(panel.ledger(spark, root)).drop("n_rows"))
    return rounded(v, ["account"], ["cash", "invested", "portfolio_value"], 2)


_ROWS = [("0", "entry_date", "BUY", _FILL, f"-{_FILL}*shares"), ("1", "entry_date", "CHARGE", _FILL, "-" + _leg(f"({_FILL}*shares)", "buy")),
         ("2", "exit_date", "SELL", "(exit_ref_price*0.999)", "(exit_ref_price*0.999)*shares"), ("3", "exit_date", "CHARGE", "(exit_ref_price*0.999)", "-" + _leg("(exit_ref_price*0.999*shares)", "sell"))]


@query(f"WITH {TRADES} " + " UNION ALL ".join(f"SELECT trade_id, CAST({n} AS INTEGER) AS leg, {d} AS ts, '{k}' AS type, {r(p, 2)} AS price, {r(a, 2)} AS amount FROM trades{'' if n in '01' else chr(32) + 'WHERE status = ' + chr(39) + 'closed' + chr(39)}" for n, d, k, p, a in _ROWS))
def trade_ledger(spark, root):
    return accounting.trade_ledger(panel.trades(spark, root)).select("trade_id", "leg", "ts", "type", "price", "amount")


@query(f"WITH {LEDGER} SELECT account, ts, seq, {r('sum(amount) OVER (PARTITION BY account ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)', 2)} AS running_balance FROM ledger")
def running_balance(spark, root):
    return rounded(accounting.running_balance(panel.ledger(spark, root)), ["account", "ts", "seq"], ["running_balance"], 2)


@query(f"WITH {LEDGER}, g AS (SELECT account, -coalesce(sum(amount) FILTER (type = 'CHARGE'), 0.0) AS charges, coalesce(sum(abs(amount)) FILTER (type IN ('BUY', 'SELL')), 0.0) AS turnover, sum(amount) AS cash FROM ledger GROUP BY account) "
       f"SELECT account, {rs(['charges', 'turnover', 'cash'], 2)}, {r('charges*100/nullif(turnover, 0)', 6)} AS charges_pct FROM g")
def account_kpis(spark, root):
    return rounded(accounting.account_kpis(panel.ledger(spark, root)), ["account"], {"charges": 2, "turnover": 2, "cash": 2, "charges_pct": 6})


@query(f"WITH {OPENED} SELECT account, {r('sum(shares*entry_price)', 2)} AS deployed, count(*) AS n_open FROM op WHERE status = 'open' GROUP BY account")
def deployed_capital(spark, root):
    return rounded(accounting.deployed(_opened(spark, root).where(F.col("status") == "open")), ["account", "n_open"], ["deployed"], 2)


_KP = {"win_rate": 5, "gross_pnl": 2, "net_pnl": 2, "charges": 2, "cost_drag_pct": 4, "avg_pct": 5, "best_pct": 2, "worst_pct": 2, "profit_factor": 5}


@query(f"""WITH {CLOSED}, g AS (SELECT account, count(*) AS n_closed, count(*) FILTER (pnl > 0) AS n_win, sum(gross_pnl) AS gross_pnl, sum(pnl) AS net_pnl, sum(entry_charges) + sum(exit_charges) AS charges, avg(pnl_pct) AS avg_pct, max(pnl_pct) AS best_pct, min(pnl_pct) AS worst_pct,
  coalesce(sum(pnl) FILTER (pnl > 0), 0.0) AS w, coalesce(abs(sum(pnl) FILTER (pnl < 0)), 0.0) AS l FROM cl GROUP BY account),
k AS (SELECT *, n_win/greatest(n_closed, 1)*100 AS win_rate, coalesce(charges*100/nullif(abs(gross_pnl), 0), 0.0) AS cost_drag_pct, w/greatest(l, 1.0) AS profit_factor FROM g) SELECT account, n_closed, n_win, {rs(_KP)} FROM k""")
def trade_kpis(spark, root):
    return rounded(accounting.trade_kpis(_closed(spark, root), ["account"]), ["account", "n_closed", "n_win"], _KP)


@query(f"WITH {CLOSED} SELECT trade_id, exit_date, {r('1000000.0 + sum(pnl) OVER (ORDER BY exit_date, trade_id ROWS UNBOUNDED PRECEDING)', 2)} AS equity FROM cl")
def realised_equity(spark, root):
    return accounting.realised_equity(stage(_closed(spark, root))).select("trade_id", "exit_date", rnd("equity", 2).alias("equity"))


@query(f"WITH {CLOSED}, m AS (SELECT min(pnl_pct) AS lo, max(pnl_pct) AS hi FROM cl), b AS (SELECT pnl_pct, CAST(least(floor(coalesce((pnl_pct - lo)*20/nullif(hi - lo, 0), 0.0)), 19) AS INTEGER) AS bin FROM cl, m) SELECT bin, count(*) AS n, min(pnl_pct) AS min_value, max(pnl_pct) AS max_value FROM b GROUP BY bin")
def pnl_histogram(spark, root):
    return accounting.pnl_histogram(stage(_closed(spark, root)))


# --- latest signals --------------------------------------------------------
LEVELS = f"{ATR}, lv AS (SELECT ticker, arg_max(atr, date) AS atr14, arg_max(close, date) AS close FROM atrs GROUP BY ticker HAVING count(*) >= 15)"


@query(f"WITH {LEVELS} SELECT ticker, {r('atr14', 3)} AS atr14, {r('close', 4)} AS close FROM lv")
def latest_levels(spark, root):
    return rounded(signals.latest_levels(panel.bars(spark, root)), ["ticker"], {"atr14": 3, "close": 4})


# one signal row per supplier: score from the account balance, quantiles from the balance and key
SIG = """sg AS (SELECT s_suppkey AS ticker, CASE WHEN s_acctbal > 5000 THEN 'LONG' ELSE 'NEUTRAL' END AS signal, (s_acctbal + 1000)/12000 AS prob_up,
  CASE WHEN s_nationkey <> 3 THEN -0.001*(s_suppkey % 50) END AS q10_star, CASE WHEN s_nationkey <> 4 THEN 0.002*(s_suppkey % 40) - 0.01 END AS q90_star, CASE WHEN s_nationkey % 2 = 0 THEN 21 END AS horizon_days FROM supplier)"""


def _signals(spark, root):
    s = tables.table(spark, root, "supplier")
    return s.select(F.col("s_suppkey").alias("ticker"), F.when(F.col("s_acctbal") > 5000, "LONG").otherwise("NEUTRAL").alias("signal"), ((F.col("s_acctbal") + 1000) / 12000).alias("prob_up"),
                    F.when(F.col("s_nationkey") != 3, -0.001 * (F.col("s_suppkey") % 50)).alias("q10_star"), F.when(F.col("s_nationkey") != 4, 0.002 * (F.col("s_suppkey") % 40) - 0.01).alias("q90_star"),
                    F.when(F.col("s_nationkey") % 2 == 0, 21).alias("horizon_days"))


_LVJ = f"{LEVELS}, {SIG}, j AS (SELECT sg.*, coalesce(close, 0.0) AS e, coalesce(atr14, coalesce(close, 0.0)*0.015) AS a FROM sg LEFT JOIN lv USING (ticker))"
_OUT = ["ticker", "signal", "entry_price", "atr14", "stop_loss", "target_price", "risk_reward", "horizon_days", "signal_date"]


@query(f"WITH {_LVJ}, k AS (SELECT *, {r('e - 1.5*a', 2)} AS stop_loss, {r('e + 3.0*a', 2)} AS target_price FROM j) SELECT ticker, signal, {r('e', 2)} AS entry_price, {r('a', 2)} AS atr14, stop_loss, target_price, {r('(target_price - e)/nullif(e - stop_loss, 0)', 2)} AS risk_reward, 5 AS horizon_days, (SELECT max(date) FROM bars) AS signal_date FROM k")
def enrich_signals(spark, root):
    s, bars = _signals(spark, root).drop("horizon_days"), panel.bars(spark, root)
    return signals.enrich_fixed(s, signals.latest_levels(bars), signal_date=bars.select(F.max("date")).scalar()).select(*_OUT)


@query(f"WITH {_LVJ}, k AS (SELECT *, coalesce(CASE WHEN abs(q10_star)*e/nullif(a, 0) IS NOT NULL THEN least(greatest(abs(q10_star)*e/nullif(a, 0), 0.8), 3.0) END, 0.8) AS sm, coalesce(CASE WHEN q90_star*e/nullif(a, 0) IS NOT NULL THEN least(greatest(greatest(q90_star, 0.0)*e/nullif(a, 0), 1.0), 6.0) END, 6.0) AS tm FROM j) "
       f"SELECT ticker, signal, {r('e', 2)} AS entry_price, {r('a', 2)} AS atr14, {r('e - sm*a', 2)} AS stop_loss, {r('e + tm*a', 2)} AS target_price, {r('(CASE WHEN q90_star IS NOT NULL THEN greatest(q90_star, 0.0) END)/nullif(abs(q10_star), 0)', 2)} AS risk_reward, CAST(coalesce(horizon_days, 5) AS INTEGER) AS horizon_days, (SELECT max(date) FROM bars) AS signal_date FROM k")
def enrich_signals_dynamic(spark, root):
    bars = panel.bars(spark, root)
    return signals.enrich_dynamic(_signals(spark, root), signals.latest_levels(bars), signal_date=bars.select(F.max("date")).scalar()).select(*_OUT)


@query(f"WITH {SIG} SELECT count(*) AS n_signals, count(*) FILTER (signal = 'LONG') AS n_long, count(*) FILTER (signal = 'NEUTRAL') AS n_neutral, {r('avg(prob_up) FILTER (signal = ' + chr(39) + 'LONG' + chr(39) + ')')} AS avg_long_confidence FROM sg")
def signal_counters(spark, root):
    return rounded(signals.signal_counters(_signals(spark, root)), ["n_signals", "n_long", "n_neutral"], ["avg_long_confidence"])


@query(f"WITH {SIG} SELECT count(*) AS signal_count, count(*) FILTER (signal = 'LONG') AS long_count FROM sg")
def signal_envelope(spark, root):
    """Signals written as JSON and CSV with their envelope, which is read back."""
    path = f"{staging_root(spark)}/signals-{uuid.uuid4().hex}"
    tables.write_signals(_signals(spark, root), path)
    return spark.read.schema("signal_count bigint, long_count bigint").json(f"{path}/envelope")


@query(f"WITH {SIG}, {OPENED}, {LATEST} SELECT sg.ticker, {r('max(prob_up)')} AS prob_up, CAST(max(greatest(1, floor(50000000.0*0.05/(1000.0 + sg.ticker)))) AS BIGINT) AS default_shares, bool_or(sg.ticker IN (SELECT ticker FROM op WHERE status = 'open')) AS already_open FROM sg WHERE signal = 'LONG' GROUP BY 1".replace("SELECT sg.ticker, " + r("max(prob_up)"), "SELECT sg.ticker, " + r("max(sg.prob_up)")))
def size_orders(spark, root):
    s = _signals(spark, root).withColumn("entry_price", 1000.0 + F.col("ticker"))
    twice = s.unionByName(s.withColumn("prob_up", F.col("prob_up") - 0.01))
    held = _opened(spark, root).where(F.col("status") == "open")
    return accounting.size_orders(twice, held, 50_000_000.0).select("ticker", rnd("prob_up", 6).alias("prob_up"), "default_shares", "already_open")


# --- outcomes --------------------------------------------------------------
AS_OF = "2001-06-30"
JOURNAL = f"""{PREDS}, tl AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker) AS rn, count(*) OVER (PARTITION BY date) AS n, min(pred) OVER (PARTITION BY date) AS lo, max(pred) OVER (PARTITION BY date) AS hi FROM preds WHERE pred IS NOT NULL),
journal AS MATERIALIZED (SELECT 'run-' || year(date) AS run_id, date AS signal_date, ticker, CASE WHEN rn <= greatest(1, n // 5) THEN 'LONG' ELSE 'NEUTRAL' END AS signal, CASE WHEN hi > lo THEN (pred - lo)/(hi - lo) ELSE 0.5 END AS prob_up,
  {r('close', 2)} AS entry_price, {r('close*0.97', 2)} AS stop_loss, {r('close*1.04', 2)} AS target_price, CASE rn % 3 WHEN 0 THEN 21 WHEN 1 THEN 5 END AS horizon_days FROM tl)"""
DUE = f"{JOURNAL}, due AS (SELECT *, signal_date + CAST(coalesce(horizon_days, 5) + 2 AS INTEGER) AS target_date FROM journal WHERE signal_date <= DATE '{AS_OF}' - CAST(coalesce(horizon_days, 5) + 2 AS INTEGER))"
OUTC = f"""{DUE}, fw AS MATERIALIZED (SELECT d.run_id, d.signal_date, d.ticker, b.close AS actual FROM due d ASOF JOIN bars b ON b.ticker = d.ticker AND b.date >= d.target_date WHERE b.date <= d.target_date + 5),
oc AS (SELECT d.run_id, d.signal_date, d.ticker, d.signal, CASE WHEN prob_up = 0 OR prob_up IS NULL THEN 0.5 ELSE prob_up END AS prob_up, target_date AS outcome_date, {r('actual', 2)} AS actual_close, {r('CASE WHEN entry_price > 0 THEN ln(actual/entry_price) ELSE 0.0 END', 6)} AS actual_fwd_ret,
  actual >= target_price AND target_price > 0 AS hit_target, actual <= stop_loss AND stop_loss > 0 AS hit_stop, CASE WHEN actual > entry_price THEN 1 ELSE -1 END AS label_direction, (signal = 'LONG' AND actual > entry_price) OR (signal = 'NEUTRAL' AND actual <= entry_price) AS is_correct
  FROM due d JOIN fw f ON f.run_id = d.run_id AND f.signal_date = d.signal_date AND f.ticker = d.ticker),
outcomes AS (SELECT *, CASE WHEN hit_target THEN 'target' WHEN hit_stop THEN 'stop' ELSE 'expired' END AS exit_reason FROM oc)"""
_K = ["run_id", "signal_date", "ticker"]


def _closes(spark, root):
    """The closes that the journal is made from and resolved by, worked out once."""
    return stage(panel.bars(spark, root).select("ticker", "date", "close"))


def _journal(spark, root, bars=None):
    return stage(journal_predictions(momentum_predictions(spark, root, bars=bars, only=["date", "ticker", "close", "pred"])))


def _outcomes(spark, root):
    b = _closes(spark, root)
    return outcomes.resolve(_journal(spark, root, b), b, AS_OF)


@query(f"WITH {JOURNAL} SELECT run_id, signal_date, ticker, signal, {r('prob_up')} AS prob_up, entry_price, stop_loss, target_price, CAST(horizon_days AS INTEGER) AS horizon_days FROM journal")
def journal_predictions_table(spark, root):
    return journal_predictions(momentum_predictions(spark, root)).select(*_K, "signal", rnd("prob_up", 6).alias("prob_up"), "entry_price", "stop_loss", "target_price", "horizon_days")


@query(f"WITH {DUE} SELECT run_id, signal_date, ticker FROM due")
def due_predictions(spark, root):
    return outcomes.due(_journal(spark, root), AS_OF).select(*_K)


@query(f"WITH {DUE} SELECT d.run_id, d.signal_date, d.ticker, b.date AS close_date, {r('b.close', 4)} AS actual_close FROM due d ASOF JOIN bars b ON b.ticker = d.ticker AND b.date >= d.target_date WHERE b.date <= d.target_date + 5")
def asof_forward_join(spark, root):
    b = _closes(spark, root)
    d = outcomes.due(_journal(spark, root, b), AS_OF).withColumn("target_date", F.date_add("signal_date", (outcomes.horizon_of(5) + 2).cast("int")))
    return rounded(outcomes.asof_forward(d.select(*_K, "target_date"), b), [*_K, "close_date"], ["actual_close"], 4)


_OC = ["signal", "outcome_date", "actual_close", "actual_fwd_ret", "hit_target", "hit_stop", "label_direction", "is_correct", "exit_reason"]


@query(f"WITH {OUTC} SELECT run_id, signal_date, ticker, {r('prob_up')} AS prob_up, {', '.join(_OC)} FROM outcomes")
def resolve_outcomes(spark, root):
    return _outcomes(spark, root).select(*_K, rnd("prob_up", 6).alias("prob_up"), *_OC)


@query(f"WITH {OUTC} SELECT j.run_id, j.signal_date, j.ticker, o.ticker IS NOT NULL AS outcome_resolved, o.outcome_date, o.actual_fwd_ret, o.is_correct FROM journal j LEFT JOIN outcomes o ON o.run_id = j.run_id AND o.signal_date = j.signal_date AND o.ticker = j.ticker")
def merge_resolution(spark, root):
    """Resolved twice: the second pass finds nothing due and leaves the table as it is."""
    b = _closes(spark, root)
    j = _journal(spark, root, b)
    empty = spark.createDataFrame([], outcomes.resolve(j, b, AS_OF).schema)
    p1, o1, _ = outcomes.resolve_and_merge(j, empty, b, AS_OF)
    p2, _, _ = outcomes.resolve_and_merge(stage(p1), stage(o1), b, AS_OF)
    return p2.select(*_K, "outcome_resolved", "outcome_date", "actual_fwd_ret", "is_correct")


@query(f"WITH {OUTC}, q AS ({spearman_sql(f'(SELECT * FROM outcomes WHERE signal_date >= DATE {chr(39)}{AS_OF}{chr(39)} - 364) z', 'prob_up', 'actual_fwd_ret')}) SELECT {r('CASE WHEN n >= 5 THEN ic END', 5)} AS ic, n FROM q")
def recent_ic(spark, root):
    return outcomes.recent_ic(stage(_outcomes(spark, root)), AS_OF, weeks=52).select(rnd("ic", 5).alias("ic"), "n")


WEEKLY = f"""{OUTC}, wk AS (SELECT *, CAST(date_trunc('week', signal_date) AS DATE) AS week_start FROM outcomes), wi AS ({spearman_sql('wk', 'prob_up', 'actual_fwd_ret', 'week_start')}),
weekly AS (SELECT wi.week_start, {r('ic', 4)} AS ic, n AS n_obs, dir_accuracy FROM wi JOIN (SELECT week_start, {r('avg(is_correct::INT)', 3)} AS dir_accuracy FROM wk WHERE prob_up IS NOT NULL AND actual_fwd_ret IS NOT NULL GROUP BY 1) a USING (week_start) WHERE n >= 3)"""


@query(f"WITH {WEEKLY} SELECT week_start, ic, n_obs, dir_accuracy FROM weekly")
def weekly_ic(spark, root):
    return outcomes.weekly_ic(stage(_outcomes(spark, root)))


@query(f"WITH {WEEKLY}, w AS (SELECT ic, row_number() OVER (ORDER BY week_start DESC) AS d FROM weekly WHERE ic IS NOT NULL), g AS (SELECT max(CASE WHEN d = 1 THEN ic END) AS last_ic, count(*) FILTER (d <= 3 AND ic < 0) AS n_bad, count(*) FILTER (d <= 3 AND ic < 0.01) AS n_warn, count(*) FILTER (ic < 0.01) AS weeks_below_target, "
       "count(*) FILTER (ic < 0) AS weeks_below_warn, count(*) FILTER (ic < -0.01) AS weeks_below_critical, count(*) AS n_weeks, coalesce(min(CASE WHEN ic >= 0 THEN d END), count(*) + 1) - 1 AS negative_streak FROM w) "
       "SELECT *, CASE WHEN n_weeks = 0 THEN 'UNKNOWN' WHEN n_bad >= 2 THEN 'CRITICAL' WHEN last_ic < 0 THEN 'WARNING' WHEN n_warn >= 2 THEN 'CAUTION' ELSE 'HEALTHY' END AS status FROM g")
def model_health(spark, root):
    h = outcomes.health(outcomes.weekly_ic(stage(_outcomes(spark, root))))
    return h.withColumn("negative_streak", F.col("negative_streak").cast("bigint"))


@query(f"WITH {JOURNAL} SELECT run_id, ticker, signal FROM journal WHERE signal_date = (SELECT max(signal_date) FROM journal) AND run_id = (SELECT max(run_id) FROM journal WHERE signal_date = (SELECT max(signal_date) FROM journal))")
def latest_snapshot(spark, root):
    return outcomes.latest_snapshot(_journal(spark, root)).select("run_id", "ticker", "signal")


_SC = "count(*) AS n_total, count(*) FILTER (NOT outcome_resolved) AS n_pending, count(*) FILTER (outcome_resolved) AS n_resolved"
JR = f"{OUTC}, jr AS (SELECT j.*, o.ticker IS NOT NULL AS outcome_resolved, o.is_correct, o.actual_fwd_ret FROM journal j LEFT JOIN outcomes o ON o.run_id = j.run_id AND o.signal_date = j.signal_date AND o.ticker = j.ticker)"


@query(f"WITH {JR} SELECT {_SC}, {r('avg(CASE WHEN outcome_resolved THEN is_correct::INT END)')} AS hit_rate, {r('avg(CASE WHEN signal = ' + chr(39) + 'LONG' + chr(39) + ' THEN actual_fwd_ret END)')} AS mean_ret_long, {r('avg(CASE WHEN signal = ' + chr(39) + 'NEUTRAL' + chr(39) + ' THEN actual_fwd_ret END)')} AS mean_ret_neutral FROM jr")
def journal_scorecard(spark, root):
    b = _closes(spark, root)
    j = _journal(spark, root, b)
    p, _, _ = outcomes.resolve_and_merge(j, spark.createDataFrame([], outcomes.resolve(j, b, AS_OF).schema), b, AS_OF)
    return rounded(outcomes.scorecard(p), ["n_total", "n_pending", "n_resolved"], ["hit_rate", "mean_ret_long", "mean_ret_neutral"])


@query(f"WITH {JR} SELECT run_id, signal_date, ticker FROM jr WHERE outcome_resolved AND signal = 'LONG' AND is_correct = true")
def journal_filter(spark, root):
    b = _closes(spark, root)
    j = _journal(spark, root, b)
    p = outcomes.merge_resolution(j, outcomes.resolve(j, b, AS_OF))
    return outcomes.filter_journal(p, "Resolved", signal="LONG", correct=True).select(*_K)


@query(f"WITH {JOURNAL}, t0 AS (SELECT count(*) AS n_open FROM bars WHERE CAST(volume AS BIGINT) % 2 = 0) SELECT count(*) AS n_pending, max(signal_date) AS signal_date, count(*) FILTER (signal_date = (SELECT max(signal_date) FROM journal) AND signal = 'LONG') AS n_long, "
       "CAST(DATE '2001-12-01' - max(signal_date) AS INTEGER) AS days_old, DATE '2001-12-01' - max(signal_date) > 7 AS stale, (SELECT n_open FROM t0) AS n_open FROM journal")
def home_tiles(spark, root):
    return outcomes.home_tiles(_journal(spark, root), panel.trades(spark, root), "2001-12-01")


# --- runs ------------------------------------------------------------------
@query(f"WITH {_RUNS} SELECT arg_max(run_id, run_date) AS run_id, {r('arg_max(oof_ic, run_date)')} AS oof_ic, max(run_date) AS run_date FROM runs WHERE is_deployed")
def deployed_run(spark, root):
    return runs.deployed_run(panel.model_runs(spark, root)).select("run_id", rnd("oof_ic", 6).alias("oof_ic"), "run_date")


@query(f"WITH {_RUNS} SELECT run_id, CASE WHEN run_id = 'run-199912' THEN true WHEN run_id = 'run-199904' THEN false ELSE is_deployed END AS is_deployed FROM runs")
def mark_deployed(spark, root):
    return runs.mark_deployed(panel.model_runs(spark, root), "run-199912", "run-199904").select("run_id", "is_deployed")


PAIRS = """pr AS (SELECT a.run_id, CASE WHEN month(a.run_date) % 5 <> 0 THEN a.sharpe_net END AS ch_sharpe, a.oof_ic AS ch_ic, CASE WHEN month(a.run_date) % 3 <> 0 THEN a.calib_err END AS ch_calib, b.sharpe_net AS cp_sharpe, b.oof_ic AS cp_ic, b.run_id IS NOT NULL AS has_champion, month(a.run_date) = 7 AS drift_alarm
  FROM runs a LEFT JOIN runs b ON b.run_date = a.run_date - INTERVAL 1 MONTH)"""


@query(f"""WITH {_RUNS}, {PAIRS}, d AS (SELECT *, ch_sharpe IS NOT NULL AND cp_sharpe IS NOT NULL AS bs, ch_ic IS NOT NULL AND cp_ic IS NOT NULL AS bi FROM pr),
e AS (SELECT *, CASE WHEN bs THEN ch_sharpe >= cp_sharpe + 0.1 WHEN bi THEN ch_ic >= cp_ic + 0.005 ELSE false END AS perf, coalesce(ch_calib <= 0.1, true) AS cal FROM d)
SELECT run_id, CASE WHEN NOT has_champion THEN NOT drift_alarm ELSE perf AND cal AND NOT drift_alarm END AS promote,
CASE WHEN NOT has_champion THEN CASE WHEN drift_alarm THEN 'drift_first_model' ELSE 'first_model' END ELSE concat_ws('|', CASE WHEN NOT perf AND bs THEN 'sharpe' END, CASE WHEN NOT perf AND NOT bs AND bi THEN 'ic' END, CASE WHEN NOT bs AND NOT bi THEN 'no_metric' END,
 CASE WHEN NOT cal THEN 'calibration' END, CASE WHEN drift_alarm THEN 'drift' END, CASE WHEN perf AND cal AND NOT drift_alarm THEN 'beats_champion' END) END AS reasons FROM e""")
def promotion_gate(spark, root):
    """Each month's run challenges the month before."""
    m = panel.model_runs(spark, root)
    b = m.select(F.add_months("run_date", 1).alias("run_date"), F.col("sharpe_net").alias("cp_sharpe"), F.col("oof_ic").alias("cp_ic"), F.lit(True).alias("_c"))
    mon = F.month("run_date")
    p = m.join(b, "run_date", "left").select("run_id", F.when(mon % 5 != 0, F.col("sharpe_net")).alias("ch_sharpe"), F.col("oof_ic").alias("ch_ic"), F.when(mon % 3 != 0, F.col("calib_err")).alias("ch_calib"),
                                             "cp_sharpe", "cp_ic", F.coalesce("_c", F.lit(False)).alias("has_champion"), (mon == 7).alias("drift_alarm"))
    return runs.promotion(p).select("run_id", "promote", F.concat_ws("|", "reasons").alias("reasons"))


@query(f"WITH {_RUNS}, l AS (SELECT run_id, oof_ic, lag(oof_ic) OVER (ORDER BY run_date) AS prev FROM runs) SELECT run_id, CASE WHEN prev IS NULL THEN true ELSE oof_ic >= prev + 0.005 END AS deploy, CASE WHEN oof_ic < -0.01 THEN 'retrain' WHEN oof_ic < 0.01 THEN 'watch' ELSE 'healthy' END AS state FROM l")
def ic_rules(spark, root):
    from pyspark.sql import Window as W

    m = panel.model_runs(spark, root).withColumn("prev", F.lag("oof_ic").over(W.partitionBy(F.lit(0)).orderBy("run_date")))
    return m.select("run_id", runs.ic_deploys(F.col("oof_ic"), F.col("prev")).alias("deploy"), runs.retrain_state(F.col("oof_ic")).alias("state"))


@query(f"WITH {_RUNS}, fi AS (SELECT 'run-' || strftime(o_orderdate, '%Y%m') AS run_id, 'f' || (o_custkey % 40) AS feature_name, sum(o_totalprice)/1e6 AS s FROM orders GROUP BY 1, 2) SELECT run_id, feature_name, {r('s')} AS importance_score FROM fi WHERE run_id = (SELECT arg_max(run_id, run_date) FROM runs WHERE is_deployed) ORDER BY s DESC, feature_name LIMIT 30")
def latest_importance(spark, root):
    o = tables.table(spark, root, "orders")
    fi = o.groupBy(F.concat(F.lit("run-"), F.date_format("o_orderdate", "yyyyMM")).alias("run_id"), F.concat(F.lit("f"), F.col("o_custkey") % 40).alias("feature_name")).agg((F.sum("o_totalprice") / 1e6).alias("importance_score"))
    return runs.latest_importance(fi, panel.model_runs(spark, root), deployed_only=True).select("run_id", "feature_name", rnd("importance_score", 6).alias("importance_score"))
