"""Queries of the metric, portfolio and cost operators."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import costs, cross, horizon, metrics, portfolio
from ..operators.labels import forward_return_grid
from ..plans.assembly import backtest_report, momentum_predictions
from ..session import stage
from ..sources import panel
from ..sources.tables import table
from .base import BARS, PREDS, lagq, leadq, query, r, rounded, rs, spearman_sql
from .features import RANKED

RT = repr(costs.typical_cost_fraction())
REGIME_COL = "nifty_dist_sma200"


def _preds(spark, root):
    return momentum_predictions(spark, root)


# --- rank correlation ------------------------------------------------------
@query(f"WITH {PREDS}, q AS ({spearman_sql('preds', 'pred', 'fwd_ret')}) SELECT {r('ic')} AS ic, n FROM q")
def pooled_ic(spark, root):
    return metrics.pooled_ic(_preds(spark, root)).select(rnd("ic", 6).alias("ic"), "n")


DAILY = f"{PREDS}, dic AS ({spearman_sql('preds', 'pred', 'fwd_ret', 'date')})"


@query(f"WITH {DAILY} SELECT date, {r('ic')} AS ic, n FROM dic WHERE ic IS NOT NULL")
def daily_ic(spark, root):
    return metrics.daily_ic(_preds(spark, root)).select("date", rnd("ic", 6).alias("ic"), "n")


@query(f"WITH {DAILY}, s AS (SELECT avg(ic) AS m, stddev_samp(ic) AS sd, count(ic) AS n_days FROM dic) SELECT {r('m')} AS mean_ic, {r('m/sd')} AS ic_ir, {r('m/sd*sqrt(n_days)', 5)} AS t_stat, n_days FROM s")
def ic_summary(spark, root):
    return rounded(metrics.ic_summary(metrics.daily_ic(_preds(spark, root))), ["n_days"], {"mean_ic": 6, "ic_ir": 6, "t_stat": 5})


@query(f"WITH {PREDS} SELECT ticker, {r('avg((sign(pred) = sign(fwd_ret))::INT)')} AS dir_acc, count(*) AS n FROM preds WHERE pred IS NOT NULL AND fwd_ret IS NOT NULL GROUP BY ticker")
def directional_accuracy(spark, root):
    return metrics.directional_accuracy(_preds(spark, root), by=["ticker"]).select("ticker", rnd("dir_acc", 6).alias("dir_acc"), "n")


# --- calibration -----------------------------------------------------------
PROBS = f"""{PREDS}, mm AS (SELECT ticker, date, fwd_ret, CASE WHEN max(pred) OVER (PARTITION BY date) > min(pred) OVER (PARTITION BY date) THEN (pred - min(pred) OVER (PARTITION BY date))/(max(pred) OVER (PARTITION BY date) - min(pred) OVER (PARTITION BY date)) ELSE 0.5 END AS p0, pred FROM preds),
probs AS (SELECT ticker, date, round_even(p0*1e4, 0)/1e4 AS p, fwd_ret, CAST(fwd_ret > 0 AS DOUBLE) AS y FROM mm WHERE pred IS NOT NULL AND fwd_ret IS NOT NULL)"""
_BIN = "(" + " + ".join(f"(p >= CAST({i * 0.1!r} AS DOUBLE))::INT" for i in range(1, 10)) + ")"


def _probs(spark, root):
    p = cross.minmax_by_date(_preds(spark, root), "pred", "p").where(F.col("p").isNotNull() & F.col("fwd_ret").isNotNull())
    return p.select("ticker", "date", rnd("p", 4).alias("p"), "fwd_ret", (F.col("fwd_ret") > 0).cast("double").alias("y"))


@query(f"WITH {PROBS}, b AS (SELECT CASE WHEN p >= 0 AND p < 1 THEN {_BIN} ELSE -1 END AS bin, count(*) AS c, avg(p) AS mp, avg(y) AS my FROM probs GROUP BY 1) SELECT {r('sum(CASE WHEN bin >= 0 THEN c*abs(mp - my) ELSE 0 END)/sum(c)', 5)} AS ece, CAST(sum(c) AS BIGINT) AS n FROM b")
def calibration_error(spark, root):
    return metrics.calibration_error(_probs(spark, root), "p", "y").select(rnd("ece", 5).alias("ece"), "n")


@query(f"WITH {PROBS}, b AS (SELECT year(date) AS yr, {_BIN} AS bin, count(*) AS c, avg(p) AS mp, avg(y) AS my FROM probs GROUP BY 1, 2), e AS (SELECT yr, sum(c*abs(mp - my))/sum(c) AS ece, sum(c) AS n FROM b GROUP BY yr) "
       f"SELECT CAST(yr AS INTEGER) AS year, CASE WHEN n >= 10 THEN {r('ece', 4)} END AS ece, CAST(n AS BIGINT) AS n FROM e")
def calibration_drift(spark, root):
    p = _probs(spark, root).withColumn("year", F.year("date"))
    return metrics.calibration_drift(p, "p", "fwd_ret", by=["year"])


# --- return series ---------------------------------------------------------
SERIES = f"""m0 AS (SELECT o_orderpriority AS strategy, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2),
m1 AS (SELECT strategy, date, v/{lagq('v', 1, 'strategy')} - 1.0 AS ret FROM m0), rets AS (SELECT * FROM m1 WHERE ret IS NOT NULL),
eq AS (SELECT *, exp(sum(ln(1.0 + ret)) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM rets),
dd AS (SELECT *, (equity - max(equity) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING))/(max(equity) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) + 1e-9) AS drawdown FROM eq)"""


def _stats_sql(src: str, by: str, ppy: float) -> str:
    k = repr(ppy ** 0.5)
    return f"""st0 AS (SELECT {by}, count(*) AS n_periods, CASE WHEN count(*) < 2 OR stddev_pop(ret) = 0 THEN 0.0 ELSE avg(ret)/stddev_pop(ret)*{k} END AS Sharpe,
  CASE WHEN stddev_pop(CASE WHEN ret < 0 THEN ret END) > 0 THEN avg(ret)/stddev_pop(CASE WHEN ret < 0 THEN ret END)*{k} END AS Sortino, min(drawdown) AS max_drawdown, avg((ret > 0)::INT) AS hit_rate,
  CASE WHEN abs(sum(CASE WHEN ret < 0 THEN ret END)) > 0 THEN coalesce(sum(CASE WHEN ret > 0 THEN ret END), 0.0)/abs(sum(CASE WHEN ret < 0 THEN ret END)) END AS profit_factor,
  avg(ret) AS avg_period_ret, arg_max(equity, date) AS final_equity FROM {src} GROUP BY {by}),
st1 AS (SELECT *, CASE WHEN final_equity > 0 THEN exp(ln(final_equity)*({ppy!r}/n_periods)) WHEN final_equity = 0 THEN 0.0 END - 1.0 AS CAGR FROM (SELECT * REPLACE (CASE WHEN final_equity > 0 THEN final_equity ELSE final_equity END AS final_equity) FROM st0)),
st AS (SELECT *, CAGR/nullif(abs(max_drawdown), 0) AS Calmar FROM st1)"""


@query(f"WITH {SERIES} SELECT strategy, date, {r('equity')} AS equity FROM eq")
def equity_curve(spark, root):
    return rounded(metrics.equity_curve(panel.strategy_returns(spark, root), ["strategy"]), ["strategy", "date"], ["equity"])


@query(f"WITH {SERIES} SELECT strategy, date, {r('drawdown')} AS drawdown FROM dd")
def drawdown(spark, root):
    return rounded(metrics.drawdown(metrics.equity_curve(panel.strategy_returns(spark, root), ["strategy"]), ["strategy"]), ["strategy", "date"], ["drawdown"])


_SUM = dict(metrics.SUMMARY_DIGITS)


@query(f"WITH {SERIES}, {_stats_sql('dd', 'strategy', 12.0)} SELECT strategy, n_periods, {rs(_SUM)} FROM st")
def return_summary(spark, root):
    return metrics.summarise(panel.strategy_returns(spark, root), ["strategy"], ppy=12.0)


@query(f"WITH {SERIES}, {_stats_sql('dd', 'strategy', 12.0)} SELECT strategy, {rs(['Sharpe', 'Sortino', 'max_drawdown', 'CAGR', 'Calmar', 'profit_factor', 'hit_rate'], 6)} FROM st")
def risk_ratios(spark, root):
    return rounded(metrics.return_stats(panel.strategy_returns(spark, root), ["strategy"], ppy=12.0), ["strategy"], ["Sharpe", "Sortino", "max_drawdown", "CAGR", "Calmar", "profit_factor", "hit_rate"])


_HURDLE = (1 - metrics.EULER_GAMMA) * NormalDist().inv_cdf(1 - 1 / 50) + metrics.EULER_GAMMA * NormalDist().inv_cdf(1 - 1 / (50 * math.e))


@query(f"WITH {SERIES}, {_stats_sql('dd', 'strategy', 12.0)}, z AS (SELECT strategy, n_periods, Sharpe/{12 ** 0.5!r} AS sr FROM st) SELECT strategy, n_periods, {r(f'sr/sqrt((1 + 0.5*sr*sr)/(n_periods - 1)) - {_HURDLE!r}', 5)} AS dsr_z FROM z")
def deflated_sharpe_score(spark, root):
    """Normal score of the deflated Sharpe; its probability is the next query's."""
    s = metrics.return_stats(panel.strategy_returns(spark, root), ["strategy"], ppy=12.0)
    return rounded(metrics.deflated_sharpe(s, 50, ppy=12.0), ["strategy", "n_periods"], ["dsr_z"], 5)


def _cdf(z: str) -> str:
    x = f"abs({z})"
    poly = lambda cs: "(" + " + ".join(f"{c!r}*pow({x}, {len(cs) - 1 - i})" for i, c in enumerate(cs)) + ")"
    far = f"({x} + 0.65)"
    for k in (4, 3, 2, 1):
        far = f"({x} + {k}/{far})"
    tail = f"(exp(-{x}*{x}/2.0)*CASE WHEN {x} < {metrics.CDF_FAR!r} THEN {poly(metrics.CDF_N)}/{poly(metrics.CDF_D)} ELSE 1.0/{far}/{math.sqrt(2.0 * math.pi)!r} END)"
    return f"(CASE WHEN {z} > 0 THEN 1.0 - {tail} ELSE {tail} END)"


@query(f"WITH {SERIES}, {_stats_sql('dd', 'strategy', 12.0)}, z AS (SELECT strategy, n_periods, Sharpe/{12 ** 0.5!r} AS sr FROM st), y AS (SELECT strategy, n_periods, sr/sqrt((1 + 0.5*sr*sr)/(n_periods - 1)) - {_HURDLE!r} AS z FROM z) "
       f"SELECT strategy, n_periods, {r('z')} AS dsr_z, {r(_cdf('z'))} AS deflated_sharpe FROM y")
def deflated_sharpe(spark, root):
    s = metrics.return_stats(panel.strategy_returns(spark, root), ["strategy"], ppy=12.0)
    return rounded(metrics.deflated_sharpe(s, 50, ppy=12.0), ["strategy", "n_periods"], ["dsr_z", "deflated_sharpe"])


_DRAWN = "PARTITION BY strategy, boot ORDER BY date ROWS UNBOUNDED PRECEDING"
BOOT = f"""{SERIES}, sr AS (SELECT strategy, ret, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n FROM rets),
b0 AS (SELECT strategy, n, unnest(range(1000)) AS boot FROM (SELECT DISTINCT strategy, n FROM sr WHERE n >= 40)),
b1 AS (SELECT *, unnest(range(CAST(ceil(n/20.0) AS BIGINT))) AS blk FROM b0),
b2 AS (SELECT *, CAST('0x' || substr(md5('42|' || strategy || '|' || boot || '|' || blk), 1, 8) AS BIGINT) % (n - 19) AS s, unnest(range(20)) AS o FROM b1),
b3 AS (SELECT b2.strategy, boot, blk*20 + o AS date, sr.ret FROM b2 JOIN sr ON sr.strategy = b2.strategy AND sr.i = b2.s + b2.o WHERE blk*20 + o < b2.n),
b4 AS (SELECT *, exp(sum(ln(1.0 + ret)) OVER ({_DRAWN})) AS equity FROM b3),
b5 AS (SELECT *, (equity - max(equity) OVER ({_DRAWN}))/(max(equity) OVER ({_DRAWN}) + 1e-9) AS drawdown FROM b4), {_stats_sql('b5', 'strategy, boot', 12.0)}"""


@query(f"WITH {BOOT} SELECT strategy, count(*) AS n_boot, " + ", ".join(f"{r(f'quantile_cont({c}, {p / 100})')} AS {n}_p{p:02d}" for n, c in (("sharpe", "Sharpe"), ("cagr", "CAGR"), ("max_drawdown", "max_drawdown")) for p in (5, 50, 95)) + " FROM st GROUP BY 1")
def block_bootstrap(spark, root):
    b = metrics.block_bootstrap(panel.strategy_returns(spark, root), ["strategy"], ppy=12.0)
    return rounded(b, ["strategy", "n_boot"], [c for c in b.columns if c not in ("strategy", "n_boot")])


# quantile surface: empirical quantiles of a ticker's forward returns per year stand in for a model
GRID = [5, 21, 63]
_SURF = ", ".join(f"quantile_cont(fwd_ret_{h}, {t}) AS q{int(t * 100)}_{h}" for h in GRID for t in (0.1, 0.5, 0.9))
SURFACE = f"""{BARS}, g0 AS (SELECT ticker, date, year(date) AS yr, {', '.join(f"ln({leadq('close', h)}/close) AS fwd_ret_{h}" for h in GRID)} FROM bars),
sq AS (SELECT ticker, yr, {_SURF} FROM g0 GROUP BY 1, 2),
sw AS ({' UNION ALL '.join(f"SELECT ticker, yr, {h} AS h, {i} AS pos, q10_{h} AS q10, q50_{h} AS q50, q90_{h} AS q90 FROM sq" for i, h in enumerate(GRID))}),
ss AS (SELECT *, CASE WHEN q90 - q10 > 1e-9 THEN (q50 - 0.0005*h)/(q90 - q10) END AS score FROM sw),
chosen AS (SELECT ticker, yr, h AS horizon_star, score AS score_star, q10 AS q10_star, q50 AS q50_star, q90 AS q90_star FROM (SELECT *, row_number() OVER (PARTITION BY ticker, yr ORDER BY coalesce(score, -1e300) DESC, pos) AS k FROM ss) WHERE k = 1)"""


def surface(spark, root):
    """(ticker, year, h, tau, q): quantiles per ticker-year (at most 366 rows a group)."""
    g = forward_return_grid(panel.bars(spark, root), GRID).withColumn("year", F.year("date"))
    taus = F.array(*[F.lit(t) for t in horizon.TAUS])
    q = g.groupBy("ticker", "year").agg(*[F.percentile(f"fwd_ret_{h}", taus).alias(f"q{h}") for h in GRID])
    rows = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(t).alias("tau"), F.get(f"q{h}", F.lit(i)).alias("q")) for h in GRID for i, t in enumerate(horizon.TAUS)])
    return q.select("ticker", "year", F.explode(rows).alias("r")).select("ticker", "year", "r.*")


def chosen(spark, root):
    return horizon.select_horizon(horizon.surface_wide(surface(spark, root), ["ticker", "year"]), ["ticker", "year"], GRID)


_ST = ["score_star", "q10_star", "q50_star", "q90_star"]


@query(f"WITH {SURFACE} SELECT ticker, CAST(yr AS INTEGER) AS year, CAST(horizon_star AS INTEGER) AS horizon_star, {rs(_ST)} FROM chosen")
def select_horizon(spark, root):
    return rounded(chosen(spark, root), ["ticker", "year", "horizon_star"], _ST)


SURF_ROWS = f"{SURFACE}, sr AS (SELECT g.ticker, g.date, c.*  EXCLUDE (ticker, yr), CASE horizon_star WHEN 5 THEN fwd_ret_5 WHEN 21 THEN fwd_ret_21 WHEN 63 THEN fwd_ret_63 END AS fwd_ret FROM g0 g JOIN chosen c ON g.ticker = c.ticker AND g.yr = c.yr)"


def surface_rows(spark, root):
    g = forward_return_grid(panel.bars(spark, root), GRID).withColumn("year", F.year("date"))
    return horizon.realised_at(g.join(chosen(spark, root), ["ticker", "year"]), GRID)


@query(f"WITH {SURF_ROWS} SELECT ticker, date, CAST(horizon_star AS INTEGER) AS horizon_star, {r('fwd_ret')} AS fwd_ret FROM sr")
def realised_at_horizon(spark, root):
    return rounded(surface_rows(spark, root), ["ticker", "date", "horizon_star"], ["fwd_ret"])


@query(f"WITH {SURFACE}, n AS (SELECT count(*) AS n FROM chosen), c AS (SELECT CAST(h AS INTEGER) AS h, (SELECT count(*) FROM chosen WHERE horizon_star = h) AS n_rows FROM (SELECT unnest([5, 21, 63]) AS h)) "
       f"SELECT h, n_rows, {r('n_rows/n')} AS fraction, max(n_rows/n) OVER () >= 0.95 AS collapsed, bool_and(abs(n_rows/n - 1/3) <= 0.10) OVER () AS looks_uniform FROM c, n")
def horizon_distribution(spark, root):
    d = horizon.horizon_distribution(chosen(spark, root), GRID)
    return d.select("h", "n_rows", rnd("fraction", 6).alias("fraction"), "collapsed", "looks_uniform")


@query(f"WITH {SURFACE}, s AS (SELECT ticker, min(horizon_star) AS a, max(horizon_star) AS b, count(*) AS k FROM chosen GROUP BY ticker) SELECT {r('avg((a = b)::INT)', 4)} AS mode_agreement_rate, {r('avg(b - a)', 2)} AS mean_abs_seed_spread, max(k) AS n_seeds, count(*) AS n_rows FROM s")
def horizon_stability(spark, root):
    """Years play the role of seeds: agreement of a ticker's horizon across refits."""
    return horizon.horizon_stability(chosen(spark, root), ["ticker"])


@query(f"WITH {SURF_ROWS}, u AS (SELECT 0.1 AS tau, fwd_ret, q10_star AS q FROM sr UNION ALL SELECT 0.5, fwd_ret, q50_star FROM sr UNION ALL SELECT 0.9, fwd_ret, q90_star FROM sr) "
       f"SELECT CAST(tau AS DOUBLE) AS tau, CAST(tau AS DOUBLE) AS nominal_rate, {r('avg((fwd_ret < q)::INT)', 4)} AS realised_rate, count(*) AS n, {r('abs(avg((fwd_ret < q)::INT) - CAST(tau AS DOUBLE))', 4)} AS abs_gap FROM u WHERE fwd_ret IS NOT NULL AND q IS NOT NULL GROUP BY tau")
def quantile_calibration(spark, root):
    return metrics.quantile_calibration(surface_rows(spark, root), {0.1: "q10_star", 0.5: "q50_star", 0.9: "q90_star"})


@query(f"WITH {PREDS}, d AS (SELECT date, max({REGIME_COL}) AS g FROM preds GROUP BY date HAVING max({REGIME_COL}) IS NOT NULL) SELECT count(*) AS n_dates, count(*) FILTER (g < 0) AS n_flat, {r('avg((g < 0)::INT)')} AS flat_fraction FROM d")
def regime_stats(spark, root):
    s = metrics.regime_stats(_preds(spark, root), REGIME_COL)
    return s.select("n_dates", "n_flat", rnd("flat_fraction", 6).alias("flat_fraction"))


@query(f"WITH {BARS} SELECT count(DISTINCT ticker) AS n_tickers, count(*) AS n_rows, min(date) AS date_min, max(date) AS date_max FROM bars")
def coverage(spark, root):
    return metrics.coverage(panel.bars(spark, root))


# --- portfolio -------------------------------------------------------------
def _book(mode: str = "long_only", regime: bool = False, conviction: bool = True, rt: str = RT, extra: str = "", src: str = "bk") -> str:
    """Period table in SQL: per date n, flat, gross, turnover, cost, ret (extra = sleeve column with comma)."""
    part = f"PARTITION BY {extra.rstrip(', ')}" if extra else ""
    lw = "pos/CAST(sum(pos) OVER (PARTITION BY " + extra + "date) AS DOUBLE)" if conviction else "1.0/count(*) OVER (PARTITION BY " + extra + "date)"
    on = "risk_on AND " if regime else ""
    flat = f"bool_or(coalesce({REGIME_COL} < 0, false))" if regime else "false"
    legs = []
    for side, q, order in ((1, 4, "pred, ticker"), (-1, 0, "pred DESC, ticker DESC")):
        if side == -1 and mode == "long_only":
            continue
        inner = f"SELECT {extra}date, ticker, fwd_ret, row_number() OVER (PARTITION BY {extra}date ORDER BY {order}) AS pos FROM (SELECT *, NOT coalesce({REGIME_COL} < 0, false) AS risk_on FROM {src}) z WHERE {on}q = {q}"
        legs.append(f"SELECT {extra}date, ticker, fwd_ret, {side} AS side, {lw} AS w FROM ({inner}) i")
    using = f"({extra}date)"
    return f"""pd AS (SELECT {extra}date, max(n) AS n, {flat} AS flat FROM {src} GROUP BY {extra}date),
per AS (SELECT *, row_number() OVER ({part} ORDER BY date) AS period FROM pd),
mem AS ({' UNION ALL '.join(legs)}),
mp AS (SELECT mem.*, period, period - lag(period) OVER (PARTITION BY {extra}side, ticker ORDER BY period) = 1 AS kept FROM mem JOIN per USING {using}),
ag AS (SELECT {extra}date, coalesce(sum(w*fwd_ret) FILTER (side = 1), 0.0) AS lr, coalesce(sum(w*fwd_ret) FILTER (side = -1), 0.0) AS sr, count(*) FILTER (side = 1) AS nl, count(*) FILTER (side = -1) AS ns,
  count(*) FILTER (side = 1 AND kept) AS kl, count(*) FILTER (side = -1 AND kept) AS ks FROM mp GROUP BY {extra}date),
pt0 AS (SELECT {extra}per.date, period, n, flat, coalesce(nl, 0) AS n_long, coalesce(ns, 0) AS n_short, coalesce(lr, 0.0) AS lr, coalesce(sr, 0.0) AS sr, 1 - coalesce(kl, 0)/greatest(coalesce(nl, 0), 1) AS tl, 1 - coalesce(ks, 0)/greatest(coalesce(ns, 0), 1) AS ts FROM per LEFT JOIN ag USING {using}),
pt1 AS (SELECT *, CASE WHEN flat THEN CASE WHEN coalesce(lag(n_long) OVER ({part} ORDER BY date), 0) > 0 THEN 1.0 ELSE 0.0 END WHEN n_short > 0 THEN (tl + ts)/2 ELSE tl END AS turnover, CASE WHEN flat THEN 0.0 ELSE lr - sr END AS gross FROM pt0),
pt AS (SELECT *, {rt}*turnover AS cost, gross - {rt}*turnover AS ret FROM pt1)"""


def _curve(src: str, by: str) -> str:
    o = f"OVER (PARTITION BY {by} ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"""cv0 AS (SELECT *, CASE WHEN count(*) FILTER (1 + ret = 0) {o} > 0 THEN 0.0 ELSE CASE WHEN count(*) FILTER (1 + ret < 0) {o} % 2 = 0 THEN 1.0 ELSE -1.0 END*exp(coalesce(sum(CASE WHEN 1 + ret <> 0 THEN ln(abs(1 + ret)) END) {o}, 0.0)) END AS equity FROM {src}),
cv AS (SELECT *, (equity - max(equity) {o})/(max(equity) {o} + 1e-9) AS drawdown FROM cv0)"""


_PT = ["gross", "turnover", "cost", "ret"]
_PK = ["date", "period", "n", "flat", "n_long", "n_short"]


def _pt_query(name: str, rules_of, sql: str):
    def run(spark, root):
        t = portfolio.period_table(_preds(spark, root), rules_of())
        return rounded(t.withColumn("period", F.col("period").cast("bigint")), _PK, _PT)
    query(f"WITH {RANKED}, {sql} SELECT date, CAST(period AS BIGINT) AS period, n, flat, n_long, n_short, {rs(_PT)} FROM pt", name)(run)


_pt_query("period_returns", lambda: portfolio.Rules(), _book())
_pt_query("period_returns_long_short", lambda: portfolio.Rules(mode="long_short"), _book("long_short"))
_pt_query("period_returns_regime", lambda: portfolio.Rules(regime=REGIME_COL), _book(regime=True))
_pt_query("period_returns_equal_weight", lambda: portfolio.Rules(conviction=False), _book(conviction=False))

# final equity and Calmar span many magnitudes on this panel; compare the scale-free part
_BT = {k: v for k, v in _SUM.items() if k not in ("final_equity", "Calmar", "max_drawdown")}


@query(f"WITH {RANKED}, {_book()}, bt AS (SELECT *, 'long_only' AS book FROM pt), {_curve('bt', 'book')}, {_stats_sql('cv', 'book', 50.4)} SELECT book, n_periods, {rs(_BT)} FROM st")
def backtest(spark, root):
    return portfolio.backtest(_preds(spark, root)).select("book", "n_periods", *_BT)


@query(f"WITH {RANKED}, {_book()}, cm AS (SELECT date, m AS cost_mult, gross - cost*m AS ret FROM pt, (SELECT unnest([0.5, 1.0, 1.5, 2.0]::DOUBLE[]) AS m)), {_curve('cm', 'cost_mult')}, {_stats_sql('cv', 'cost_mult', 50.4)} SELECT cost_mult, {rs({'Sharpe': 3, 'CAGR': 4})} FROM st")
def cost_sensitivity(spark, root):
    return portfolio.cost_sensitivity(_preds(spark, root)).select("cost_mult", "Sharpe", "CAGR")


SLEEVES = f"""{RANKED.split(', rk AS')[0]}, sv AS (SELECT *, CASE WHEN ticker % 2 = 0 THEN 5 ELSE 21 END AS horizon_star FROM preds WHERE pred IS NOT NULL AND fwd_ret IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY horizon_star, date ORDER BY pred, ticker) AS rn, count(*) OVER (PARTITION BY horizon_star, date) AS n FROM sv),
bk AS (SELECT *, CAST(greatest(ceil((rn - 1)*5.0/(n - 1)), 1) - 1 AS INTEGER) AS q FROM rk WHERE n >= 10)"""


@query(f"WITH {SLEEVES}, {_book(extra='horizon_star, ')} SELECT date, {r('sum(ret)/(SELECT count(DISTINCT horizon_star) FROM pt)')} AS ret, count(*) AS n_active FROM pt GROUP BY date")
def horizon_sleeves(spark, root):
    p = _preds(spark, root).withColumn("horizon_star", F.when(F.col("ticker") % 2 == 0, 5).otherwise(21))
    return rounded(portfolio.sleeve_returns(p), ["date", "n_active"], ["ret"])


@query(f"WITH {RANKED}, {_book(conviction=False, rt='0.002')}, bt AS (SELECT *, 'long_only' AS book FROM pt), {_curve('bt', 'book')} SELECT book, count(*) AS n_periods, {r('avg((ret > 0)::INT)')} AS hit_rate, {r('avg(ret)')} AS avg_period_ret, {r('avg(ret)/(stddev_samp(ret) + 1e-9)*sqrt(50.4)', 5)} AS Sharpe FROM cv GROUP BY book")
def flat_cost_backtest(spark, root):
    s = portfolio.flat_cost_backtest(_preds(spark, root), portfolio.Rules())
    return rounded(s, ["book", "n_periods"], {"hit_rate": 6, "avg_period_ret": 6, "Sharpe": 5})


@query(f"WITH {RANKED} SELECT n_tickers, n_rows, n_dates, n_flat FROM (SELECT count(DISTINCT ticker) AS n_tickers, count(*) AS n_rows FROM bars), (SELECT count(*) AS n_dates, count(*) FILTER (g < 0) AS n_flat FROM (SELECT date, max({REGIME_COL}) AS g FROM preds GROUP BY date HAVING max({REGIME_COL}) IS NOT NULL))")
def backtest_report_counts(spark, root):
    """Nested report row; its counts are checked here, its parts by their own queries."""
    rep = backtest_report(stage(_preds(spark, root)), panel.bars(spark, root), portfolio.Rules(regime=REGIME_COL))
    return rep.select("coverage.n_tickers", "coverage.n_rows", "regime.n_dates", "regime.n_flat")


# --- per-trade exits -------------------------------------------------------
@query(f"WITH {BARS}, a AS (SELECT *, {lagq('close')} AS pc FROM bars), b AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM a) SELECT ticker, date, {r('avg(tr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 18 PRECEDING AND CURRENT ROW)', 3)} AS atr20 FROM b")
def trailing_atr(spark, root):
    return rounded(portfolio.trailing_atr(panel.bars(spark, root)), ["ticker", "date"], ["atr20"], 3)


H_EXIT = 17
_H = "CAST(5 + CAST(volume AS BIGINT) % 7*2 AS INTEGER)"
_PATH_UP = ", ".join(f"CASE WHEN {j} <= {_H} AND {leadq('high', j)} >= close*1.04 THEN {j} END" for j in range(1, H_EXIT + 1))
_PATH_DN = ", ".join(f"CASE WHEN {j} <= {_H} AND {leadq('low', j)} <= close*0.97 THEN {j} END" for j in range(1, H_EXIT + 1))
EXITS = f"""{BARS}, x0 AS (SELECT ticker, date AS entry_date, close, coalesce({_PATH_UP}) AS u, coalesce({_PATH_DN}) AS d, {_H} AS h, CASE {_H} {' '.join(f"WHEN {j} THEN {leadq('close', j)}" for j in range(5, H_EXIT + 1, 2))} END AS lastc, {', '.join(f"{leadq('date', j)} AS d{j}" for j in range(1, H_EXIT + 1))} FROM bars),
x1 AS (SELECT *, CASE WHEN u <= coalesce(d, 1000) THEN 'target' WHEN d IS NOT NULL THEN 'stop' WHEN lastc IS NOT NULL THEN 'expired' END AS exit_reason FROM x0),
exits AS (SELECT *, CASE exit_reason WHEN 'target' THEN u WHEN 'stop' THEN d WHEN 'expired' THEN h END AS exit_bar FROM x1)"""


def _exits(spark, root):
    b = panel.bars(spark, root)
    t = b.select("ticker", F.col("date").alias("entry_date"), (F.col("close") * 0.97).alias("stop_loss"), (F.col("close") * 1.04).alias("target_price"), (5 + F.col("volume").cast("bigint") % 7 * 2).cast("int").alias("horizon_days"))
    return portfolio.exit_trades(t, b)


@query(f"WITH {EXITS} SELECT ticker, entry_date, exit_reason, CAST(exit_bar AS INTEGER) AS exit_bar, CASE exit_bar {' '.join(f'WHEN {j} THEN d{j}' for j in range(1, H_EXIT + 1))} END AS exit_date, "
       f"{r('''CASE exit_reason WHEN 'target' THEN close*1.04 WHEN 'stop' THEN close*0.97 WHEN 'expired' THEN lastc END''', 4)} AS exit_price FROM exits")
def trade_exits(spark, root):
    return rounded(_exits(spark, root), ["ticker", "entry_date", "exit_reason", "exit_bar", "exit_date"], ["exit_price"], 4)


@query(f"WITH {EXITS} SELECT exit_reason, count(*) AS n FROM exits GROUP BY 1")
def exit_reason_counts(spark, root):
    return portfolio.exit_counts(_exits(spark, root))


@query(f"WITH {SURF_ROWS}, a AS (SELECT *, {lagq('close')} AS pc FROM bars), b AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM a), "
       "c AS (SELECT ticker, date, close, avg(tr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS atr FROM b), j AS (SELECT c.*, q10_star, q90_star FROM c JOIN sr USING (ticker, date)) "
       f"SELECT ticker, date, {r('CASE WHEN abs(q10_star)*close/nullif(atr, 0) IS NOT NULL THEN least(greatest(abs(q10_star)*close/nullif(atr, 0), 0.8), 3.0) END', 5)} AS stop_mult, {r('CASE WHEN greatest(q90_star, 0.0)*close/nullif(atr, 0) IS NOT NULL THEN least(greatest(greatest(q90_star, 0.0)*close/nullif(atr, 0), 1.0), 6.0) END', 5)} AS target_mult FROM j")
def dynamic_multiples(spark, root):
    b = portfolio.trailing_atr(panel.bars(spark, root)).withColumn("year", F.year("date")).join(chosen(spark, root), ["ticker", "year"])
    s, t = portfolio.dynamic_multiples(F.col("q10_star"), F.col("q90_star"), F.col("close"), F.col("atr20"))
    return rounded(b.select("ticker", "date", s.alias("stop_mult"), t.alias("target_mult")), ["ticker", "date"], ["stop_mult", "target_mult"], 5)


# --- costs -----------------------------------------------------------------
def _leg(v: str, side: str) -> str:
    stamp = f"0.00015*{v}" if side == "buy" else f"0.0*{v}"
    dp = "0.0" if side == "buy" else "13.0"
    gst = f"0.18*(0.0*{v} + 0.0000297*{v} + 0.000001*{v})"
    return f"(0.0*{v} + 0.001*{v} + 0.0000297*{v} + 0.000001*{v} + {stamp} + {gst} + {dp})"


_ITEMS = ["stt", "exchange", "sebi", "stamp", "gst", "dp_charge", "total"]


def _items(v: str, side: str) -> str:
    e = {"stt": f"0.001*{v}", "exchange": f"0.0000297*{v}", "sebi": f"0.000001*{v}", "stamp": f"0.00015*{v}" if side == "buy" else "0.0", "gst": f"0.18*(0.0000297*{v} + 0.000001*{v})", "dp_charge": "0.0" if side == "buy" else "13.0", "total": _leg(v, side)}
    return ", ".join(f"{r(x)} AS {k}" for k, x in e.items())


@query(f"SELECT o_orderkey, {_items('o_totalprice', 'buy')} FROM orders")
def buy_charges(spark, root):
    o = table(spark, root, "orders")
    return rounded(o.select("o_orderkey", costs.buy_charges(F.col("o_totalprice")).alias("c")).select("o_orderkey", "c.*"), ["o_orderkey"], _ITEMS)


@query(f"SELECT o_orderkey, {_items('o_totalprice', 'sell')} FROM orders")
def sell_charges(spark, root):
    o = table(spark, root, "orders")
    return rounded(o.select("o_orderkey", costs.sell_charges(F.col("o_totalprice")).alias("c")).select("o_orderkey", "c.*"), ["o_orderkey"], _ITEMS)


_RTQ = f"({_leg('o_totalprice', 'buy')} + {_leg('o_totalprice', 'sell')})"


@query(f"SELECT o_orderkey, {r(_RTQ, 5)} AS round_trip, {r(f'({_RTQ} + 2*10.0/1e4*o_totalprice)/(o_totalprice + 1e-9)', 8)} AS fraction FROM orders")
def round_trip_costs(spark, root):
    v = F.col("o_totalprice")
    o = table(spark, root, "orders").select("o_orderkey", costs.round_trip_cost(v, v).alias("round_trip"), costs.cost_fraction(v).alias("fraction"))
    return rounded(o, ["o_orderkey"], {"round_trip": 5, "fraction": 8})


