"""Registry of queries and the SQL fragments their reference statements share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rnd

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with its SQL when it has one."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return add


def rounded(df: DataFrame, keys: list[str], cols: dict[str, int] | list[str], digits: int = 6) -> DataFrame:
    """Keys plus rounded double columns."""
    spec = cols if isinstance(cols, dict) else dict.fromkeys(cols, digits)
    return df.select(*keys, *[rnd(F.col(c).cast("double"), d).alias(c) for c, d in spec.items()])


# --- SQL helpers -----------------------------------------------------------
def r(x: str, n: int = 6) -> str:
    return f"(round_even(({x})*1e{n},0)/1e{n} + 0.0)"


def rs(cols: dict[str, int] | list[str], n: int = 6, prefix: str = "") -> str:
    spec = cols if isinstance(cols, dict) else dict.fromkeys(cols, n)
    return ", ".join(f"{r(f'CAST({prefix}{c} AS DOUBLE)', d)} AS {c}" for c, d in spec.items())


def over(n: int, by: str = "ticker", order: str = "date") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(fn: str, x: str, n: int, by: str = "ticker") -> str:
    return f"(CASE WHEN count({x}) {over(n, by)} = {n} THEN {fn}({x}) {over(n, by)} END)"


def lagq(x: str, n: int = 1, by: str = "ticker", order: str = "date") -> str:
    return f"(lag({x}, {n}) OVER (PARTITION BY {by} ORDER BY {order}))"


def leadq(x: str, n: int = 1, by: str = "ticker", order: str = "date") -> str:
    return f"(lead({x}, {n}) OVER (PARTITION BY {by} ORDER BY {order}))"


def ewmq(x: str, a: float, i: str) -> str:
    """Closed form of the exponential mean; i = index from the first value."""
    q = repr(1.0 - a)
    return f"(CASE WHEN {i} >= 0 THEN pow({q}, {i}) * sum(CASE WHEN {i} = 0 THEN {x} WHEN {i} > 0 THEN {a!r} * {x} * pow({q}, -({i})) END) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) END)"


ORD = "ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice"
BARS = f"""bars AS MATERIALIZED (SELECT CAST(l_suppkey AS BIGINT) AS ticker, CAST(l_shipdate AS DATE) AS date,
  first(l_extendedprice/l_quantity {ORD}) AS open, max(l_extendedprice/l_quantity) AS high, min(l_extendedprice/l_quantity) AS low,
  last(l_extendedprice/l_quantity {ORD}) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""

TRADES = f"""{BARS}, tr0 AS (SELECT *, CAST(volume AS BIGINT) AS shares FROM bars),
trades AS (SELECT ticker*100000 + (date - DATE '1970-01-01') AS trade_id, ticker, ticker % 97 AS account, date AS entry_date, close AS ref_price, shares, close*0.97 AS stop_loss, close*1.04 AS target_price,
  CAST(5 + shares % 7*2 AS INTEGER) AS horizon_days, 0.5 + (shares % 10)/100.0 AS prob_up, CASE WHEN shares % 2 = 1 THEN 'closed' ELSE 'open' END AS status,
  CASE WHEN shares % 2 = 1 THEN date + CAST(1 + shares % 7 AS INTEGER) END AS exit_date, CASE WHEN shares % 2 = 1 THEN close*(1.0 + (shares % 21 - 10)/100.0) END AS exit_ref_price,
  CASE WHEN shares % 2 = 1 THEN CASE shares % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'target' ELSE 'expired' END END AS exit_reason FROM tr0)"""

INDEX = """idx0 AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice/l_quantity) AS nifty_close, stddev_samp(l_extendedprice/l_quantity) AS vix
  FROM lineitem GROUP BY 1), vix0 AS (SELECT date, vix FROM idx0 WHERE vix IS NOT NULL)"""


def _ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def zq(x: str, n: int, by: str = "ticker") -> str:
    return f"(({x} - {roll('avg', x, n, by)}) / ({roll('stddev_samp', x, n, by)} + 1e-9))"


_S1 = {
    **{f"ret_{n}d": f"ln(close/{lagq('close', n)})" for n in (1, 2, 3, 5, 10, 21)},
    **{f"cum_ret_{n}d": f"close/{lagq('close', n)} - 1.0" for n in (5, 10, 21, 63)},
    **{f"dist_sma{n}": f"close/({roll('avg', 'close', n)} + 1e-9) - 1.0" for n in (5, 10, 20, 50, 200)},
    **{f"price_pos_{n}d": f"(close - {roll('min', 'close', n)})/({roll('max', 'close', n)} - {roll('min', 'close', n)} + 1e-9)" for n in (10, 21, 63)},
    "stoch_k": f"100.0*((close - {roll('min', 'low', 14)})/({roll('max', 'high', 14)} - {roll('min', 'low', 14)} + 1e-9))",
    "bb_mid": roll("avg", "close", 20), "bb_sd": roll("stddev_samp", "close", 20),
    "park_sq": "pow(ln(high/low), 2.0)/(4.0*ln(CAST(2.0 AS DOUBLE)))",
    "v_mean": roll("avg", "volume", 20), "vol_z20": zq("volume", 20),
    "vwap": f"{roll('sum', '((open + high + low + close)/4.0*volume)', 20)}/({roll('sum', 'volume', 20)} + 1e-9)",
    **{f"volume_roc_{n}d": f"ln((volume + 1.0)/({lagq('volume', n)} + 1.0))" for n in (5, 21)},
    "dollar_vol_20d": f"ln(1.0 + {roll('avg', '(close*volume)', 20)})",
    "weak_breakout_21d": f"CAST(coalesce(close >= {roll('max', 'close', 21)} AND volume < {roll('avg', 'volume', 20)}, false) AS INTEGER)",
    "day_of_week": "CAST(isodow(date) - 1 AS INTEGER)", "day_of_month": "CAST(day(date) AS INTEGER)", "month": "CAST(month(date) AS INTEGER)",
    "is_expiry_week": "CAST(isodow(date) = 4 AND day(date) >= 24 AS INTEGER)",
    "dlt": f"close - {lagq('close')}", "prevc": lagq("close"), "prevh": lagq("high"), "prevl": lagq("low"),
    "rn": "row_number() OVER (PARTITION BY ticker ORDER BY date) - 1",
}
_TR = "greatest(high - low, abs(high - prevc), abs(low - prevc))"
_CORR = "(CASE WHEN count(CASE WHEN ret_1d IS NOT NULL AND vol_z20 IS NOT NULL THEN 1 END) {o} = 21 THEN corr(ret_1d, vol_z20) {o} END)".format(o=over(21))
FEATS = f"""{BARS},
s1 AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in _S1.items())} FROM bars),
s1b AS (SELECT *, CASE WHEN prevc IS NULL THEN high - low ELSE {_TR} END AS tr, greatest(dlt, 0.0) AS up, greatest(-dlt, 0.0) AS dn, sign(dlt)*volume AS sv FROM s1),
s2 AS (SELECT *, {roll('avg', 'stoch_k', 3)} AS stoch_d, {', '.join(f"{roll('stddev_samp', 'ret_1d', n)} AS rvol_{n}d" for n in (10, 21, 63))},
  sqrt({roll('avg', 'park_sq', 21)}) AS park_vol_21, {_CORR} AS ret_vol_corr_21d,
  sum(sv) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv,
  {ewmq('up', 1 / 14, '(rn-1)')} AS eu, {ewmq('dn', 1 / 14, '(rn-1)')} AS ed, {ewmq('tr', 1 / 14, 'rn')} AS atr,
  {ewmq('close', 2 / 13, 'rn')} - {ewmq('close', 2 / 27, 'rn')} AS macd,
  (close - (bb_mid - 2*bb_sd))/((bb_mid + 2*bb_sd) - (bb_mid - 2*bb_sd) + 1e-9) AS bb_pctb, ((bb_mid + 2*bb_sd) - (bb_mid - 2*bb_sd))/(bb_mid + 1e-9) AS bb_width,
  close/(vwap + 1e-9) - 1.0 AS vwap_dev FROM s1b),
s3 AS (SELECT *, {zq('obv', 20)} AS obv_z20, 100.0 - 100.0/(1.0 + eu/(ed + 1e-9)) AS rsi_14, atr/(close + 1e-9) AS atr_norm, {ewmq('macd', 2 / 10, 'rn')} AS macd_signal FROM s2),
feats AS (SELECT *, macd - macd_signal AS macd_hist FROM s3)"""

REGIME = f"""{INDEX}, idx AS (SELECT date, nifty_close, {', '.join(f"nifty_close/{roll('avg', 'nifty_close', n, '1')} - 1.0 AS nifty_dist_sma{n}" for n in (50, 200))},
  {', '.join(f"ln(nifty_close/{lagq('nifty_close', n, '1')}) AS nifty_ret_{n}d" for n in (5, 21))} FROM idx0),
vx AS (SELECT date, vix, vix/{lagq('vix', 5, '1')} - 1.0 AS vix_change_5d, {zq('vix', 20, '1')} AS vix_z20 FROM vix0),
regime AS (SELECT coalesce(i.date, v.date) AS date, nifty_close, nifty_dist_sma50, nifty_dist_sma200, nifty_ret_5d, nifty_ret_21d, vix, vix_change_5d, vix_z20
  FROM idx i FULL OUTER JOIN vx v ON i.date = v.date)"""

# prediction frame: z-score of the 5-day return, 5-day forward return, index regime
PREDS = f"""{BARS}, {REGIME},
p0 AS (SELECT ticker, date, close, ln(close/{lagq('close', 5)}) AS ret_5d, ln({leadq('close', 5)}/close) AS fwd_ret FROM bars),
preds AS (SELECT p0.*, (ret_5d - avg(ret_5d) OVER (PARTITION BY p0.date))/(stddev_samp(ret_5d) OVER (PARTITION BY p0.date) + 1e-9) AS pred, g.nifty_dist_sma200
  FROM p0 LEFT JOIN regime g ON p0.date = g.date)"""


def avg_rank(x: str, by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    tie = f"PARTITION BY {by}, {x}" if by else f"PARTITION BY {x}"
    return f"(rank() OVER ({part}ORDER BY {x}) + (count(*) OVER ({tie}) - 1)/2.0)"


def spearman_sql(source: str, a: str, b: str, by: str = "") -> str:
    """SELECT [by,] ic, n over complete pairs of `source`."""
    g = f"{by}, " if by else ""
    return f"""SELECT {g}CASE WHEN count(*) >= 2 AND stddev_pop(ra)*stddev_pop(rb) > 0 THEN corr(ra, rb) END AS ic, count(*) AS n
  FROM (SELECT {g}CAST({avg_rank(a, by)} AS DOUBLE) AS ra, CAST({avg_rank(b, by)} AS DOUBLE) AS rb FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) q
  {'GROUP BY ' + by if by else ''}"""
