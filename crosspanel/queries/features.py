"""Queries of the feature, regime and cross-section operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import cross, regime
from ..operators import features as ft
from ..plans.assembly import build_features, momentum_predictions
from ..sources import panel
from .base import BARS, FEATS, PREDS, REGIME, avg_rank, lagq, query, r, roll, rounded, rs, zq

KEYS = ["ticker", "date"]


def _sql(cols, n=6):
    return f"WITH {FEATS} SELECT ticker, date, {rs(cols, n)} FROM feats"


LAGGED = [f"ret_{n}d" for n in (1, 2, 3, 5, 10, 21)]


def _register_simple():
    # column expressions need an active session, so names are listed here
    columns = {
        "log_returns": (ft.log_returns, LAGGED, 6), "cumulative_returns": (ft.cumulative_returns, [f"cum_ret_{n}d" for n in (5, 10, 21, 63)], 6),
        "volume_roc": (ft.volume_roc, ["volume_roc_5d", "volume_roc_21d"], 6),
    }
    frames = {
        **{n: (lambda b, make=make: ft.with_columns(b, make()), names, d) for n, (make, names, d) in columns.items()},
        "sma_distance": (ft.sma_distance, [f"dist_sma{n}" for n in (5, 10, 20, 50, 200)], 6), "range_position": (ft.range_position, [f"price_pos_{n}d" for n in (10, 21, 63)], 6),
        "bollinger": (ft.bollinger, ["bb_pctb", "bb_width"], 6), "parkinson_vol": (ft.parkinson_vol, ["park_vol_21"], 6), "volume_zscore": (ft.volume_zscore, ["vol_z20"], 6),
        "vwap_deviation": (ft.vwap_deviation, ["vwap_dev"], 6), "dollar_volume": (ft.dollar_volume, ["dollar_vol_20d"], 6), "weak_breakout": (ft.weak_breakout, ["weak_breakout_21d"], 0),
        "stochastic": (ft.stochastic, ["stoch_k", "stoch_d"], 5), "rsi_wilder": (ft.rsi_wilder, ["rsi_14"], 5), "macd": (ft.macd, ["macd", "macd_signal", "macd_hist"], 4),
        "atr_wilder": (ft.atr_wilder, ["atr_norm"], 6), "obv_zscore": (ft.obv_zscore, ["obv_z20"], 5),
        "realised_vol": (lambda b: ft.realised_vol(ft.with_columns(b, ft.log_returns((1,)))), ["rvol_10d", "rvol_21d", "rvol_63d"], 6),
        "return_volume_corr": (lambda b: ft.return_volume_corr(ft.volume_zscore(ft.with_columns(b, ft.log_returns((1,))))), ["ret_vol_corr_21d"], 6),
    }
    for name, (make, names, digits) in frames.items():
        def run(spark, root, make=make, names=names, digits=digits):
            return rounded(make(panel.bars(spark, root)), KEYS, names, digits)
        query(_sql(names, digits), name)(run)


_register_simple()


@query(f"WITH {BARS} SELECT ticker, date, {rs(['open', 'high', 'low', 'close', 'volume'], 4)} FROM bars")
def bars(spark, root):
    return rounded(panel.bars(spark, root), KEYS, ["open", "high", "low", "close", "volume"], 4)


@query(f"WITH {BARS}, d AS (SELECT *, close - {lagq('close')} AS dlt FROM bars), m AS (SELECT *, greatest(dlt, 0.0) AS up, greatest(-dlt, 0.0) AS dn FROM d WHERE true), "
       f"m2 AS (SELECT ticker, date, CASE WHEN dlt IS NOT NULL THEN up END AS up, CASE WHEN dlt IS NOT NULL THEN dn END AS dn FROM m) "
       f"SELECT ticker, date, {r('100.0 - 100.0/(1.0 + ' + roll('avg', 'up', 14) + '/(' + roll('avg', 'dn', 14) + ' + 1e-9))', 5)} AS rsi_14 FROM m2")
def rsi_simple(spark, root):
    return rounded(ft.rsi_simple(panel.bars(spark, root)), KEYS, ["rsi_14"], 5)


_ADX = f"""WITH {FEATS}, a AS (SELECT *, high - prevh AS um, prevl - low AS dm, CASE WHEN prevc IS NOT NULL THEN tr END AS t1 FROM feats),
b AS (SELECT *, CASE WHEN um IS NOT NULL THEN CASE WHEN um > dm AND um > 0 THEN um ELSE 0.0 END END AS pdm, CASE WHEN um IS NOT NULL THEN CASE WHEN dm > um AND dm > 0 THEN dm ELSE 0.0 END END AS ndm FROM a),
c AS (SELECT *, {{etr}} AS etr, {{ep}} AS ep, {{en}} AS en FROM b),
d AS (SELECT *, CASE WHEN etr IS NOT NULL THEN coalesce(100.0*(abs(100.0*(ep/nullif(etr,0)) - 100.0*(en/nullif(etr,0)))/nullif(100.0*(ep/nullif(etr,0)) + 100.0*(en/nullif(etr,0)), 0)), 0.0) END AS dx FROM c)
SELECT ticker, date, {{adx}} AS adx FROM d"""


def _adx_sql():
    from .base import ewmq

    a = 1 / 14
    return _ADX.format(etr=ewmq("t1", a, "(rn-1)"), ep=ewmq("pdm", a, "(rn-1)"), en=ewmq("ndm", a, "(rn-1)"), adx=r(ewmq("dx", a, "(rn-1)"), 4))


@query(_adx_sql())
def adx(spark, root):
    return rounded(ft.adx(panel.bars(spark, root)), KEYS, ["adx"], 4)


@query(f"WITH {FEATS} SELECT ticker, date, day_of_week, day_of_month, month, is_expiry_week FROM feats")
def calendar_features(spark, root):
    return ft.with_columns(panel.bars(spark, root), ft.calendar_features()).select(*KEYS, *ft.CALENDAR)


_SRF = ["ret_5", "ret_10", "ret_21", "ret_63", "vol_21", "rsi_14", "dist_sma20", "dist_sma50"]


@query(f"WITH {BARS}, d AS (SELECT *, close - {lagq('close')} AS dlt, close/{lagq('close')} - 1.0 AS r1 FROM bars), "
       f"m AS (SELECT *, CASE WHEN dlt IS NOT NULL THEN greatest(dlt, 0.0) END AS up, CASE WHEN dlt IS NOT NULL THEN greatest(-dlt, 0.0) END AS dn FROM d), "
       f"f AS (SELECT ticker, date, {', '.join(f'close/' + lagq('close', n) + f' - 1.0 AS ret_{n}' for n in (5, 10, 21, 63))}, {roll('stddev_samp', 'r1', 21)} AS vol_21, "
       f"100.0 - 100.0/(1.0 + {roll('avg', 'up', 14)}/({roll('avg', 'dn', 14)} + 1e-9)) AS rsi_14, {', '.join(f'close/' + roll('avg', 'close', n) + f' - 1.0 AS dist_sma{n}' for n in (20, 50))} FROM m) "
       f"SELECT ticker, date, {rs(_SRF, 5)} FROM f")
def simple_return_features(spark, root):
    return rounded(ft.simple_return_features(panel.bars(spark, root)), KEYS, _SRF, 5)


_TF = {c: (0 if c in ft.CALENDAR or c.startswith("weak") else 4) for c in ft.TICKER_FEATURES}


@query(f"WITH {FEATS} SELECT ticker, date, {rs(_TF)} FROM feats")
def ticker_features(spark, root):
    return rounded(ft.ticker_features(panel.bars(spark, root)), KEYS, _TF)


# --- regime ----------------------------------------------------------------
@query(f"WITH {REGIME} SELECT date, {r('nifty_close', 5)} AS nifty_close, {r('vix0.vix', 5)} AS vix FROM idx0 JOIN vix0 USING (date)")
def index_split(spark, root):
    i, v = regime.split_index(panel.index_bars(spark, root))
    return rounded(i.join(v, "date"), ["date"], ["nifty_close", "vix"], 5)


_IDX = ["nifty_dist_sma50", "nifty_dist_sma200", "nifty_ret_5d", "nifty_ret_21d"]


@query(f"WITH {REGIME} SELECT date, {rs(_IDX)} FROM idx")
def index_features(spark, root):
    i, _ = regime.split_index(panel.index_bars(spark, root))
    return rounded(regime.index_features(i), ["date"], _IDX)


@query(f"WITH {REGIME} SELECT date, {rs(['vix', 'vix_change_5d', 'vix_z20'], 5)} FROM vx")
def vix_features(spark, root):
    _, v = regime.split_index(panel.index_bars(spark, root))
    return rounded(regime.vix_features(v), ["date"], ["vix", "vix_change_5d", "vix_z20"], 5)


_REG = ["nifty_dist_sma200", "nifty_ret_5d", "vix", "vix_z20"]


@query(f"WITH {BARS}, {REGIME} SELECT b.ticker, b.date, {rs(_REG, 5, 'g.')} FROM bars b LEFT JOIN regime g ON b.date = g.date")
def regime_join(spark, root):
    p = regime.attach_regime(panel.bars(spark, root), regime.regime_table(panel.index_bars(spark, root)))
    return rounded(p, KEYS, _REG, 5)


def _w63(fn, cond, x):
    o = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count(CASE WHEN {cond} THEN 1 END) {o} = 63 THEN {fn}({x}) {o} END)"


REL = f"""rel0 AS (SELECT f.*, g.* EXCLUDE (date, nifty_close) FROM feats f LEFT JOIN regime g ON f.date = g.date),
rel1 AS (SELECT *, {_w63('covar_samp', 'ret_5d IS NOT NULL AND nifty_ret_5d IS NOT NULL', 'ret_5d, nifty_ret_5d')}/({_w63('var_samp', 'nifty_ret_5d IS NOT NULL', 'nifty_ret_5d')} + 1e-9) AS beta_63d FROM rel0),
rel AS (SELECT *, ret_5d - beta_63d*nifty_ret_5d AS alpha_5d FROM rel1)"""


@query(f"WITH {FEATS}, {REGIME}, {REL} SELECT ticker, date, {rs(['beta_63d', 'alpha_5d'], 5)} FROM rel")
def relative_strength(spark, root):
    p = ft.with_columns(panel.bars(spark, root), ft.log_returns((5,)))
    p = regime.attach_regime(p, regime.regime_table(panel.index_bars(spark, root)))
    return rounded(regime.relative_features(p), KEYS, ["beta_63d", "alpha_5d"], 5)


_ALL = [*ft.TICKER_FEATURES, *regime.REGIME, "beta_63d", "alpha_5d"]
_CS = cross.zscore_columns(_ALL)
_RK = [f"{c}_rank" for c in ft.RANKED]


def _z(c):
    return f"({c} - avg({c}) OVER (PARTITION BY date))/(stddev_samp({c}) OVER (PARTITION BY date) + 1e-9)" if c in _CS else c


def _pct(c):
    return f"CASE WHEN {c} IS NOT NULL THEN {avg_rank(c, 'date')}/count({c}) OVER (PARTITION BY date) END"


_FT = {**{c: (0 if c in ft.CALENDAR else 2 if c == "rsi_14" else 4) for c in _ALL}, **dict.fromkeys(_RK, 6)}


ALL_FEATURES = [*_ALL, *_RK]
RAW_FEATURES = _ALL
RAW_TABLE = f"{FEATS}, {REGIME}, {REL}"
# every feature of the table, standardised where the table is
Z_TABLE = f"{FEATS}, {REGIME}, {REL}, z0 AS (SELECT ticker, date, {', '.join(f'{_z(c)} AS {c}' for c in _ALL)} FROM rel), z AS (SELECT *, {', '.join(f'{_pct(c)} AS {c}_rank' for c in ft.RANKED)} FROM z0)"


@query(f"WITH {Z_TABLE} SELECT ticker, date, {rs(_FT)} FROM z")
def feature_table(spark, root):
    df, names = build_features(panel.bars(spark, root), panel.index_bars(spark, root))
    assert names == [*_ALL, *_RK]
    return rounded(df, KEYS, _FT)


# --- cross-section ---------------------------------------------------------
def _preds(spark, root):
    return momentum_predictions(spark, root)


@query(f"WITH {PREDS} SELECT ticker, date, {r('pred', 6)} AS pred FROM preds")
def cross_zscore(spark, root):
    return rounded(_preds(spark, root), KEYS, ["pred"])


@query(f"WITH {BARS}, f AS (SELECT ticker, date, close, volume FROM bars) SELECT ticker, date, {r(_pct('close'), 6)} AS close_rank, {r(_pct('volume'), 6)} AS volume_rank FROM f")
def cross_percentile_rank(spark, root):
    b = panel.bars(spark, root).select("ticker", "date", "close", "volume")
    return rounded(cross.percentile_ranks(b, ["close", "volume"]), KEYS, ["close_rank", "volume_rank"])


@query(f"WITH {PREDS}, v AS (SELECT ticker, date, row_number() OVER (PARTITION BY date ORDER BY fwd_ret, ticker) AS rn, count(*) OVER (PARTITION BY date) AS n FROM preds WHERE fwd_ret IS NOT NULL) "
       "SELECT p.ticker, p.date, CASE WHEN n < 2 THEN 0 ELSE CAST(least(floor((rn - 1)/n*8), 7) AS INTEGER) END AS rank_rel FROM preds p LEFT JOIN v USING (ticker, date)"
       .replace("CASE WHEN n < 2", "CASE WHEN n IS NULL THEN NULL WHEN n < 2"))
def relevance_grades(spark, root):
    return cross.relevance_grades(_preds(spark, root)).select(*KEYS, "rank_rel")


RANKED = f"""{PREDS}, rk AS (SELECT ticker, date, pred, fwd_ret, nifty_dist_sma200, row_number() OVER (PARTITION BY date ORDER BY pred, ticker) AS rn, count(*) OVER (PARTITION BY date) AS n
  FROM preds WHERE pred IS NOT NULL AND fwd_ret IS NOT NULL),
bk AS (SELECT *, CAST(greatest(ceil((rn - 1)*5.0/(n - 1)), 1) - 1 AS INTEGER) AS q FROM rk WHERE n >= 10)"""


@query(f"WITH {RANKED} SELECT ticker, date, CAST(rn AS BIGINT) AS rn, n, q FROM bk")
def quantile_buckets(spark, root):
    p = _preds(spark, root).where(F.col("pred").isNotNull() & F.col("fwd_ret").isNotNull())
    return cross.bucketed(p, "pred", 5).where(F.col("n") >= 10).select(*KEYS, F.col("rn").cast("bigint").alias("rn"), "n", "q")


@query(f"WITH {RANKED}, l AS (SELECT ticker, date, row_number() OVER (PARTITION BY date ORDER BY pred, ticker) AS pos FROM bk WHERE q = 4), "
       "s AS (SELECT ticker, date, row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker DESC) AS pos FROM bk WHERE q = 0) "
       f"SELECT ticker, date, 1 AS side, {r('pos/CAST(sum(pos) OVER (PARTITION BY date) AS DOUBLE)')} AS weight FROM l UNION ALL "
       f"SELECT ticker, date, -1 AS side, {r('pos/CAST(sum(pos) OVER (PARTITION BY date) AS DOUBLE)')} AS weight FROM s")
def conviction_weights(spark, root):
    from ..operators.portfolio import Rules, eligible, members

    rules = Rules(mode="long_short")
    return members(eligible(_preds(spark, root), rules), rules).select(*KEYS, "side", rnd("weight", 6).alias("weight"))


TOP = f"""{PREDS}, tl AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker) AS rn, count(*) OVER (PARTITION BY date) AS n FROM preds WHERE pred IS NOT NULL),
top AS (SELECT *, CASE WHEN rn <= greatest(1, n // 5) THEN 'LONG' ELSE 'NEUTRAL' END AS signal FROM tl)"""


@query(f"WITH {TOP} SELECT ticker, date, signal FROM top")
def top_long(spark, root):
    return cross.top_long(_preds(spark, root).where(F.col("pred").isNotNull()), "pred", 5).select(*KEYS, "signal")


@query(f"WITH {PREDS} SELECT ticker, date, {r('CASE WHEN pred IS NOT NULL THEN CASE WHEN max(pred) OVER (PARTITION BY date) > min(pred) OVER (PARTITION BY date) THEN (pred - min(pred) OVER (PARTITION BY date))/(max(pred) OVER (PARTITION BY date) - min(pred) OVER (PARTITION BY date)) ELSE 0.5 END END')} AS prob_up FROM preds")
def minmax_score(spark, root):
    return rounded(cross.minmax_by_date(_preds(spark, root), "pred"), KEYS, ["prob_up"])


@query(f"WITH {TOP} SELECT ticker, date, CASE WHEN coalesce(nifty_dist_sma200 < 0, false) THEN 'NEUTRAL' ELSE signal END AS signal FROM top")
def regime_overlay(spark, root):
    t = cross.top_long(_preds(spark, root).where(F.col("pred").isNotNull()), "pred", 5)
    return cross.regime_overlay(t, "nifty_dist_sma200").select(*KEYS, "signal")
