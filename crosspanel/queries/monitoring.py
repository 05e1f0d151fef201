"""Queries of the drift operators and the model jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..functions.ordered import quantiles_in
from ..operators import drift, features as ft, horizon, isotonic, labels, metrics, models, profiles, splits, surface
from ..plans import end_to_end
from ..plans.assembly import momentum_predictions, raw_features
from ..session import stage
from ..sources import panel
from .accounts import AS_OF, OUTC, _outcomes
from .base import FEATS, PREDS, leadq, query, r, rounded, spearman_sql
from .features import ALL_FEATURES, RAW_FEATURES, RAW_TABLE, Z_TABLE

FEATURES = ["ret_1d", "ret_5d", "dist_sma20", "vol_z20", "volume"]
SAMPLES = f"""{FEATS}, d0 AS (SELECT DISTINCT date FROM feats), di AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM d0),
hv AS (SELECT f.*, CASE WHEN idx < n // 2 THEN 'ref' ELSE 'cur' END AS sample FROM feats f JOIN di USING (date)),
smp AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, sample, CAST({c} AS DOUBLE) AS v FROM hv WHERE {c} IS NOT NULL" for c in FEATURES)})"""


# all features of the feature table, before any cross-sectional step
ALL_SAMPLES = f"""{RAW_TABLE}, d0 AS (SELECT DISTINCT date FROM bars), di AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM d0),
hv AS MATERIALIZED (SELECT f.*, CASE WHEN idx < n // 2 THEN 'ref' ELSE 'cur' END AS sample FROM rel f JOIN di USING (date)),
smp AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, sample, CAST({c} AS DOUBLE) AS v FROM hv WHERE {c} IS NOT NULL" for c in RAW_FEATURES)}) WHERE NOT isnan(v))"""


def _halves(spark, root):
    """The wide table of both samples, and the stored profile that places its bins."""
    bars = stage(panel.bars(spark, root))
    df = raw_features(bars, panel.index_bars(spark, root)).select("date", *RAW_FEATURES)
    df = stage(drift.halves(df, bars))
    return df, stage(profiles.profile(df, RAW_FEATURES))


def _samples(spark, root):
    df = ft.with_columns(panel.bars(spark, root), ft.log_returns((1, 5)))
    df = ft.volume_zscore(ft.sma_distance(df, (20,)))
    return stage(drift.long_samples(drift.halves(df.select("ticker", "date", *FEATURES)), FEATURES))


@query(f"WITH {SAMPLES} SELECT sample, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM hv GROUP BY 1")
def reference_current_split(spark, root):
    h = drift.halves(panel.bars(spark, root))
    return h.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(f"WITH {SAMPLES} SELECT feature, sample, prob, {r('quantile_cont(v, prob)', 4)} AS q FROM smp, (SELECT unnest([0.0, 0.05, 0.5, 0.95, 1.0]::DOUBLE[]) AS prob) GROUP BY 1, 2, 3".replace("quantile_cont(v, prob)", "CASE prob WHEN 0.0 THEN quantile_cont(v, 0.0) WHEN 0.05 THEN quantile_cont(v, 0.05) WHEN 0.5 THEN quantile_cont(v, 0.5) WHEN 0.95 THEN quantile_cont(v, 0.95) ELSE quantile_cont(v, 1.0) END"))
def exact_quantiles(spark, root):
    return rounded(quantiles_in(_samples(spark, root), ["feature", "sample"], "v", [0.0, 0.05, 0.5, 0.95, 1.0], k=64, bounded=True), ["feature", "sample", "prob"], ["q"], 4)


_EDGES = "[" + ", ".join(f"quantile_cont(v, {i / 10})" for i in range(11)) + "]"
PSI = f"""{ALL_SAMPLES}, eg AS (SELECT feature, list_sort(list_distinct({_EDGES})) AS e FROM smp WHERE sample = 'ref' GROUP BY feature),
bk AS (SELECT s.feature, len(list_filter(e[2:len(e) - 1], lambda x: x <= v)) AS b, count(*) FILTER (sample = 'ref') AS rr, count(*) FILTER (sample = 'cur') AS cc FROM smp s JOIN eg USING (feature) GROUP BY 1, 2),
tt AS (SELECT feature, sum(rr) AS nr, sum(cc) AS nc FROM bk GROUP BY 1), gr AS (SELECT feature, unnest(range(0, CAST(len(e) - 1 AS BIGINT))) AS b FROM eg),
pp AS (SELECT feature, greatest(coalesce(rr, 0)/nr, 1e-6) AS pr, greatest(coalesce(cc, 0)/nc, 1e-6) AS pc FROM gr LEFT JOIN bk USING (feature, b) JOIN tt USING (feature)),
psi AS (SELECT feature, sum((pc - pr)*ln(pc/pr)) AS psi FROM pp GROUP BY 1)"""
KS = """vc AS (SELECT feature, v, count(*) FILTER (sample = 'ref') AS cr, count(*) FILTER (sample = 'cur') AS cc FROM smp GROUP BY 1, 2),
cu AS (SELECT feature, sum(cr) OVER (PARTITION BY feature ORDER BY v)/sum(cr) OVER (PARTITION BY feature) AS fr, sum(cc) OVER (PARTITION BY feature ORDER BY v)/sum(cc) OVER (PARTITION BY feature) AS fc FROM vc),
ks AS (SELECT feature, max(abs(fr - fc)) AS ks FROM cu GROUP BY 1)"""


@query(f"WITH {PSI} SELECT feature, {r('psi', 5)} AS psi FROM psi")
def population_stability(spark, root):
    df, known = _halves(spark, root)
    return rounded(profiles.compare(df, RAW_FEATURES, known), ["feature"], ["psi"], 5)


@query(f"WITH {ALL_SAMPLES}, {KS} SELECT feature, {r('ks')} AS ks FROM ks")
def ks_statistic(spark, root):
    df, known = _halves(spark, root)
    return rounded(profiles.compare(df, RAW_FEATURES, known), ["feature"], ["ks"])


@query(f"WITH {PSI}, {KS} SELECT feature, {r('psi', 4)} AS psi, {r('ks', 4)} AS ks, CASE WHEN psi > 0.25 THEN 'RETRAIN' WHEN psi > 0.20 THEN 'WATCH' ELSE 'ok' END AS flag FROM psi JOIN ks USING (feature)")
def feature_drift(spark, root):
    df, known = _halves(spark, root)
    return profiles.feature_drift(df, RAW_FEATURES, known)


def _cusum_sql(src: str, by: str, order: str, threshold: float = 5.0) -> str:
    return f"""c0 AS (SELECT *, err - avg(err) OVER (PARTITION BY {by}) AS dv, avg(err) OVER (PARTITION BY {by}) AS mu FROM {src}), c1 AS (SELECT *, sum(dv) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS s FROM c0),
c2 AS (SELECT *, s - least(0.0, min(s) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING)) AS hi, greatest(0.0, max(s) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING)) - s AS lo FROM c1),
cs AS (SELECT {by}, max(greatest(hi, lo)) > {threshold} AS alarm, {r('max(greatest(hi, lo))', 4)} AS g_max, count(*) AS n, {r('max(mu)', 4)} AS mean_error FROM c2 GROUP BY {by})"""


@query(f"WITH es AS (SELECT event_type AS stream, event_id, value/100.0 AS err FROM events), {_cusum_sql('es', 'stream', 'event_id')} SELECT stream, alarm, g_max, n, mean_error FROM cs")
def cusum(spark, root):
    return drift.cusum(panel.error_stream(spark, root), ["stream"], "event_id", "event_id")


@query(f"WITH {OUTC}, oe AS (SELECT *, abs(prob_up - (actual_fwd_ret > 0)::INT) AS err FROM outcomes), {_cusum_sql('oe', 'run_id', 'signal_date, ticker')}, sp AS ({spearman_sql('oe', 'prob_up', 'actual_fwd_ret', 'run_id')}), h AS (SELECT run_id, avg(is_correct::INT) AS h FROM oe GROUP BY 1) "
       f"SELECT run_id, {r('ic', 4)} AS live_ic, {r('h', 4)} AS hit_rate, sp.n, alarm, g_max, {r('ic - 0.03', 4)} AS ic_gap FROM sp JOIN h USING (run_id) JOIN cs USING (run_id)")
def concept_drift(spark, root):
    return drift.concept_drift(stage(_outcomes(spark, root)), ["run_id"], backtest_ic=0.03)


@query(f"WITH {PSI}, es AS (SELECT event_type AS stream, event_id, value/100.0 AS err FROM events), {_cusum_sql('es', 'stream', 'event_id')} SELECT count(*) FILTER (psi > 0.25) > 0 OR (SELECT bool_or(alarm) FROM cs) AS retrain_recommended, count(*) FILTER (psi > 0.25) AS n_features_drifting, count(*) AS n_features, (SELECT bool_or(alarm) FROM cs) AS cusum_alarm FROM psi")
def drift_report(spark, root):
    from ..operators.metrics import calibration_error

    df, known = _halves(spark, root)
    f = profiles.feature_drift(df, RAW_FEATURES, known)
    c = drift.cusum(panel.error_stream(spark, root), ["stream"], "event_id", "event_id")
    e = panel.error_stream(spark, root).withColumn("y", F.lit(1.0))
    rep = drift.drift_report(f, c, calibration_error(e, "err", "y"))
    return rep.select("retrain_recommended", "n_features_drifting", "n_features", "cusum_alarm")


# --- model jobs ------------------------------------------------------------
# trees of one fit; seeds of a bag; rebalance dates that one refit scores (the reference step is 5 dates)
TREES = dict(maxIter=20, maxDepth=4)
SEEDS = 3
REFIT_EVERY = 5
WALK_TREES = dict(maxIter=5, maxDepth=4)
SURFACE_REFIT_EVERY = 25
# settings of the searches; a setting's rounds and depth are what the trees here have
GRID = [dict(maxIter=i, maxDepth=d, stepSize=s) for i in (2, 4) for d in (2, 3) for s in (0.1, 0.2, 0.4)]
HORIZONS = [5, 21, 63]


def _bins(spark, root, task: str = "classification"):
    """Binned rows of all features, and the bars they come from."""
    return end_to_end.model_bins(panel.bars(spark, root), panel.index_bars(spark, root), task)


def _rows(spark, root, task: str = "classification"):
    return end_to_end.model_rows(panel.bars(spark, root), panel.index_bars(spark, root), task)


# the rows a model sees: all features present
SEEN = f"""{Z_TABLE}, sf AS (SELECT ticker, date, {leadq('close', 5)} AS later, {leadq('close', 63)} IS NOT NULL AS far, close FROM bars),
sn AS (SELECT z.ticker, z.date, far, CASE WHEN later IS NOT NULL THEN ln(later/close) END AS fwd_ret, {' AND '.join(f'{c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))' for c in ALL_FEATURES)} AS seen FROM z JOIN sf USING (ticker, date)),
sd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))"""
# labelled rows up to each date: a refit needs MIN_ROWS of them
MIN_ROWS = 504
UPTO = f"""{SEEN}, up AS (SELECT idx, sum(count(*) FILTER (seen AND fwd_ret IS NOT NULL)) OVER (ORDER BY idx) AS upto, sum(count(*) FILTER (seen AND far)) OVER (ORDER BY idx) AS upto_far FROM sn JOIN sd USING (date) GROUP BY idx)"""
HELD = f"WITH {SEEN} SELECT date, ticker, true AS scored FROM sn JOIN sd USING (date) WHERE seen AND idx >= floor(n*(1.0 - 0.2))"


def _held_out(bars):
    """Dates to learn from and dates to score."""
    days = splits.final_holdout(bars).collect()
    return [[d.date for d in days if d.role == role] for role in ("train", "test")]


@query(HELD)
def train_classifier(spark, root):
    """Final fit with a date holdout, then scores of the test dates: every row gets a probability."""
    v, bars = _bins(spark, root)
    train, test = _held_out(bars)
    m = models.fit(v, weight="weight", learn=train, **TREES)
    return models.score(m, v, ["date", "ticker"], test).select("date", "ticker", F.col("pred").between(0, 1).alias("scored"))


@query(HELD)
def train_regressor(spark, root):
    v, bars = _bins(spark, root, "regression")
    train, test = _held_out(bars)
    m = models.fit(v, "regression", weight="weight", learn=train, **TREES)
    return models.score(m, v, ["date", "ticker"], test).select("date", "ticker", (F.abs("pred") < 100).alias("scored"))


@query(f"WITH {SEEN} SELECT date, ticker, true AS scored FROM sn WHERE seen")
def bagged_scores(spark, root):
    """Mean over seeds; members without score dispersion are dropped."""
    v, _ = _bins(spark, root)
    bag = models.fit_bag(v, SEEDS, weight="weight", **TREES)
    return models.score_bag(bag, v, ["date", "ticker"]).select("date", "ticker", (F.col("pred").between(0, 1) & F.col("n_members").between(1, SEEDS)).alias("scored"))


@query(f"WITH {UPTO} SELECT CAST((sd.idx - 504)//5 AS INTEGER) AS step, date, ticker, {r('fwd_ret')} AS fwd_ret, true AS scored FROM sn JOIN sd USING (date) JOIN up ON up.idx = 504 + (sd.idx - 504)//(5*{REFIT_EVERY})*5*{REFIT_EVERY} - 73 "
       f"WHERE seen AND sd.idx >= 504 AND sd.idx < n - 5 AND (sd.idx - 504) % 5 = 0 AND upto >= {MIN_ROWS}")
def walk_forward_scores(spark, root):
    """Every rebalance date scored out of fold; concurrent refits at every REFIT_EVERY-th date."""
    v, bars = _bins(spark, root)
    oof = models.walk_forward(v, splits.rebalance_schedule(bars), v.features, weight="weight", refit_every=REFIT_EVERY, min_rows=MIN_ROWS, **WALK_TREES)
    return oof.select("step", "date", "ticker", rnd("fwd_ret", 6).alias("fwd_ret"), F.col("pred").between(0, 1).alias("scored"))


@query("SELECT CAST(range AS INTEGER) AS grid_id, true AS in_range, CAST(8 AS BIGINT) AS n_folds FROM range(4)")
def grid_search(spark, root):
    """The first four settings on all folds."""
    v, bars = _bins(spark, root, "regression")
    g = models.grid_search(v, splits.purged_folds(bars), v.features, GRID[:4], weight="weight")
    return g.select("grid_id", F.col("mean_ic").between(-1, 1).alias("in_range"), "n_folds")


@query(f"SELECT CAST(rung AS INTEGER) AS rung, n_settings, n_folds, n_promoted, true AS best_first FROM (VALUES (0, 12::BIGINT, 2::BIGINT, 6::BIGINT), (1, 6, 4, 3), (2, 3, 8, 1)) t(rung, n_settings, n_folds, n_promoted)")
def halving_search(spark, root):
    """Twelve settings, halved as they meet more of the eight folds; a row a rung."""
    v, bars = _bins(spark, root, "regression")
    table, _ = models.halving_search(v, splits.purged_folds(bars), v.features, GRID, weight="weight")
    worst, best = F.min(F.when(F.col("promoted"), F.col("mean_ic"))), F.max(F.when(~F.col("promoted"), F.col("mean_ic")))
    return table.groupBy("rung").agg(F.count(F.lit(1)).alias("n_settings"), F.max("n_folds").alias("n_folds"), F.count_if("promoted").alias("n_promoted"), (worst >= best).alias("best_first"))


def _surface(spark, root):
    """Forest quantiles by horizon, the horizon chosen from them, and the return at it; names of the features."""
    rows, names = _rows(spark, root, "regression")
    grid = labels.forward_return_grid(panel.bars(spark, root), HORIZONS).select("ticker", "date", *[f"fwd_ret_{h}" for h in HORIZONS])
    rows = stage(rows.drop("fwd_ret").join(grid, ["ticker", "date"]))
    plan = splits.rebalance_schedule(rows, h=max(HORIZONS))
    s = stage(surface.walk_forward_surface(rows, plan, names, HORIZONS, weight="weight", refit_every=SURFACE_REFIT_EVERY, min_rows=MIN_ROWS))
    keys = ["step", "date", "ticker"]
    chosen = horizon.select_horizon(horizon.surface_wide(s, keys), keys, HORIZONS)
    return s, horizon.realised_at(chosen.join(grid, ["date", "ticker"]), HORIZONS)


@query(f"WITH {UPTO} SELECT CAST((sd.idx - 504)//5 AS INTEGER) AS step, date, ticker, h, true AS ordered FROM sn JOIN sd USING (date) JOIN up ON up.idx = 504 + (sd.idx - 504)//(5*{SURFACE_REFIT_EVERY})*5*{SURFACE_REFIT_EVERY} - 68, (SELECT unnest([5, 21, 63]) AS h) "
       f"WHERE seen AND sd.idx >= 504 AND sd.idx < n - 63 AND (sd.idx - 504) % 5 = 0 AND upto_far >= {MIN_ROWS}")
def quantile_surface(spark, root):
    """Out-of-fold 10, 50 and 90 % quantiles for every horizon, rebalance date and ticker; here, that they are in order."""
    s, _ = _surface(spark, root)
    w = horizon.surface_wide(s, ["step", "date", "ticker"])
    return w.select("step", "date", "ticker", "h", ((F.col("q10") <= F.col("q50")) & (F.col("q50") <= F.col("q90"))).alias("ordered"))


@query()
def surface_calibration(spark, root):
    """Coverage by tau, and the distribution of the horizons that the forests choose."""
    _, chosen = _surface(spark, root)
    chosen = stage(chosen)
    c = metrics.quantile_calibration(chosen, {0.1: "q10_star", 0.5: "q50_star", 0.9: "q90_star"}).select(F.concat(F.lit("tau "), F.col("tau")).alias("what"), F.col("realised_rate").alias("share"), F.col("n").alias("n_rows"))
    d = horizon.horizon_distribution(chosen, HORIZONS).select(F.concat(F.lit("horizon "), F.col("h")).alias("what"), rnd("fraction", 6).alias("share"), "n_rows")
    return c.unionByName(d)


# a score of few values: the return of five days in units of its date's spread, in tenths
ISO = f"""{PREDS}, i1 AS (SELECT ticker, date, round_even(greatest(least(pred, 4.0), -4.0)*20, 0)/20 + 0.0 AS p, (fwd_ret > 0)::INT AS y FROM preds WHERE pred IS NOT NULL AND fwd_ret IS NOT NULL),
idd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM i1)),
ih AS MATERIALIZED (SELECT i1.*, idx < floor(n/2) AS first_half FROM i1 JOIN idd USING (date)),
ix AS (SELECT p, sum(y) AS s, count(*) AS w, row_number() OVER (ORDER BY p) AS k FROM ih WHERE first_half GROUP BY p),
cu AS MATERIALIZED (SELECT k, p, sum(s) OVER (ORDER BY k) AS cs, sum(w) OVER (ORDER BY k) AS cw, s, w FROM ix),
mm AS (SELECT a.k AS a, b.k AS i, min((b.cs - a.cs + a.s)/(b.cw - a.cw + a.w)) OVER (PARTITION BY a.k ORDER BY b.k DESC) AS low FROM cu a JOIN cu b ON b.k >= a.k),
ft AS MATERIALIZED (SELECT i AS k, max(low) AS v FROM mm GROUP BY i), fx AS MATERIALIZED (SELECT p, v FROM ft JOIN cu USING (k)),
h2 AS (SELECT * FROM ih WHERE NOT first_half), lo AS (SELECT h2.*, fx.p AS p0, fx.v AS v0 FROM h2 ASOF LEFT JOIN fx ON h2.p >= fx.p),
up AS (SELECT lo.*, fx.p AS p1, fx.v AS v1 FROM lo ASOF LEFT JOIN fx ON lo.p <= fx.p)"""


@query(f"WITH {ISO} SELECT date, ticker, {r('p')} AS pred, {r('CASE WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL OR p1 = p0 THEN v0 ELSE v0 + (v1 - v0)*(p - p0)/(p1 - p0) END')} AS calibrated FROM up")
def isotonic_calibration(spark, root):
    """Calibrated on the older half of the dates, applied to the newer; in SQL by the max-min formula."""
    p = momentum_predictions(spark, root).where(F.col("pred").isNotNull() & F.col("fwd_ret").isNotNull())
    score = rnd(F.greatest(F.least("pred", F.lit(4.0)), F.lit(-4.0)) * 20, 0) / 20 + F.lit(0.0)
    half = stage(splits.half_split(p.select("date", "ticker", score.alias("pred"), (F.col("fwd_ret") > 0).cast("double").alias("label"))))
    iso = isotonic.fit_isotonic(half.where(F.col("half") == "first"))
    out = isotonic.apply_isotonic(iso, half.where(F.col("half") == "second"))
    return out.select("date", "ticker", rnd("pred", 6).alias("pred"), rnd("calibrated", 6).alias("calibrated"))


@query(f"SELECT 'run-1' AS run_id, unnest({ALL_FEATURES!r}) AS feature_name, true AS in_range, CAST({len(ALL_FEATURES)} AS BIGINT) AS n_ranks, true AS whole")
def feature_importance(spark, root):
    """One row a feature: its importance lies between 0 and 1, ranks are distinct, all add up to one."""
    v, _ = _bins(spark, root)
    m = models.fit(v, weight="weight", **TREES)
    f = stage(models.feature_importance(spark, m, v.features, "run-1", n=len(v.features)))
    whole = f.groupBy("run_id").agg(F.count_distinct("importance_rank").alias("n_ranks"), (F.abs(F.sum("importance_score") - 1) < 1e-6).alias("whole"))
    return f.join(whole, "run_id").select("run_id", "feature_name", F.col("importance_score").between(0, 1).alias("in_range"), "n_ranks", "whole")


@query(f"WITH {SEEN} SELECT date, ticker, true AS scored, greatest(1, count(*) OVER () // 5) AS n_long FROM sn JOIN sd USING (date) WHERE seen AND idx = n - 1")
def score_latest(spark, root):
    """Scores of the newest date by a model of all labelled rows; a fifth of them, one at least, is LONG."""
    v, bars = _bins(spark, root)
    s = stage(models.score_latest(v, bars.select(F.max("date")).first()[0], weight="weight", **TREES))
    n = s.groupBy("date").agg(F.count_if(F.col("signal") == "LONG").alias("n_long"))
    return s.join(F.broadcast(n), "date").select("date", "ticker", F.col("prob_up").between(0, 1).alias("scored"), "n_long")


END_REFIT = 20
_E2E = f"""{UPTO}, sc AS MATERIALIZED (SELECT date, ticker FROM sn JOIN sd USING (date) JOIN up ON up.idx = 504 + (sd.idx - 504)//(5*{END_REFIT})*5*{END_REFIT} - 73
  WHERE seen AND sd.idx >= 504 AND sd.idx < n - 5 AND (sd.idx - 504) % 5 = 0 AND upto >= {MIN_ROWS}),
lg AS (SELECT sum(greatest(1, c // 5)) AS n_long FROM (SELECT count(*) AS c FROM sc GROUP BY date)),
du AS (SELECT sc.ticker, sc.date, b.date AS met FROM sc ASOF JOIN bars b ON b.ticker = sc.ticker AND b.date >= sc.date + 7 WHERE b.date <= sc.date + 12 AND sc.date <= DATE '{AS_OF}' - 7)"""


@query(f"WITH {_E2E} SELECT 'bars' AS part, count(*) AS n, count(DISTINCT date) AS n_dates, count(DISTINCT ticker) AS n_tickers FROM bars UNION ALL SELECT 'scored', count(*), count(DISTINCT date), count(DISTINCT ticker) FROM sc "
       "UNION ALL SELECT 'journal', count(*), count(DISTINCT date), count(DISTINCT ticker) FROM sc UNION ALL SELECT 'long', CAST((SELECT n_long FROM lg) AS BIGINT), count(DISTINCT date), NULL FROM sc "
       "UNION ALL SELECT 'resolved', count(*), count(DISTINCT date), count(DISTINCT ticker) FROM du UNION ALL SELECT 'pending', (SELECT count(*) FROM sc) - (SELECT count(*) FROM du), NULL, NULL")
def panel_pipeline(spark, root):
    """Features, labels, walk-forward scores, portfolio, journal and outcomes as one plan; counts of every part."""
    done = end_to_end.run(panel.bars(spark, root), panel.index_bars(spark, root), AS_OF, END_REFIT, MIN_ROWS, **WALK_TREES)
    assert done.ic.first().n_days > 0 and done.book.first().n_periods > 0
    nothing = F.lit(None).cast("bigint")

    def part(name, df, day="date", tickers=True):
        return df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.count_distinct(day).alias("n_dates"), (F.count_distinct("ticker") if tickers else F.max(nothing)).alias("n_tickers"))

    journal = stage(done.journal)
    pending = journal.where(~F.col("outcome_resolved")).agg(F.lit("pending").alias("part"), F.count(F.lit(1)).alias("n"), F.max(nothing).alias("n_dates"), F.max(nothing).alias("n_tickers"))
    parts = [part("scored", done.scored), part("journal", journal, "signal_date"), part("long", journal.where("signal = 'LONG'"), "signal_date", False), part("resolved", done.outcomes, "signal_date"), pending]
    out = part("bars", done.bars)
    for p in parts:
        out = out.unionByName(p)
    return out
