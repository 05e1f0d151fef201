"""Queries of the label, weight and split operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cross, features as ft, labels, splits
from ..plans.assembly import momentum_predictions
from ..session import stage
from ..sources import panel
from .base import BARS, PREDS, ewmq, lagq, leadq, query, r, roll, rounded

KEYS = ["ticker", "date"]


def _lc(n: int) -> str:
    return lagq("close", n)


GRID = [5, 10, 21, 63]


@query(f"WITH {BARS} SELECT ticker, date, {r('ln(' + leadq('close', 5) + '/close)')} AS fwd_ret FROM bars")
def forward_log_return(spark, root):
    b = panel.bars(spark, root)
    return rounded(b.withColumn("fwd_ret", labels.forward_log_return(5)), KEYS, ["fwd_ret"])


@query(f"WITH {BARS} SELECT ticker, date, {', '.join(r('ln(' + leadq('close', h) + '/close)') + f' AS fwd_ret_{h}' for h in GRID)} FROM bars")
def forward_return_grid(spark, root):
    return rounded(labels.forward_return_grid(panel.bars(spark, root), GRID), KEYS, [f"fwd_ret_{h}" for h in GRID])


@query(f"WITH {BARS} SELECT ticker, date, {r(leadq('close', 5) + '/close - 1.0')} AS fwd_ret FROM bars")
def forward_simple_return(spark, root):
    return rounded(panel.bars(spark, root).withColumn("fwd_ret", labels.forward_simple_return(5)), KEYS, ["fwd_ret"])


ATR = f"""{BARS}, a0 AS (SELECT *, {lagq('close')} AS prevc, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS rn FROM bars),
a1 AS (SELECT *, CASE WHEN prevc IS NOT NULL THEN greatest(high - low, abs(high - prevc), abs(low - prevc)) END AS tr0 FROM a0),
a2 AS (SELECT *, coalesce(tr0, {leadq('tr0')}) AS tr FROM a1), atrs AS (SELECT *, {ewmq('tr', 2 / 15, 'rn')} AS atr FROM a2)"""


@query(f"WITH {ATR} SELECT ticker, date, {r('atr', 3)} AS atr FROM atrs")
def label_atr(spark, root):
    return rounded(labels.label_atr(panel.bars(spark, root)), KEYS, ["atr"], 3)


def _barrier_sql(h: int) -> str:
    up = ", ".join(f"CASE WHEN {leadq('high', j)} >= close + 2.0*atr THEN {j} END" for j in range(1, h + 1))
    dn = ", ".join(f"CASE WHEN {leadq('low', j)} <= close - 2.0*atr THEN {j} END" for j in range(1, h + 1))
    return f"""WITH {ATR}, t AS (SELECT ticker, date, coalesce({up}) AS tu, coalesce({dn}) AS td, {leadq('close', h)} AS last FROM atrs),
l AS (SELECT ticker, date, tu, td, CASE WHEN last IS NULL THEN NULL WHEN tu IS NOT NULL AND (td IS NULL OR tu <= td) THEN 1 WHEN td IS NOT NULL THEN -1 ELSE 0 END AS tb_label FROM t)
SELECT ticker, date, CAST(tb_label AS INTEGER) AS tb_label, CAST(CASE tb_label WHEN 1 THEN tu WHEN -1 THEN td WHEN 0 THEN {h} END AS INTEGER) AS tb_first_passage_time,
CASE tb_label WHEN 1 THEN 'up' WHEN -1 THEN 'down' WHEN 0 THEN 'vertical' END AS tb_barrier_hit FROM l"""


_TB = ["tb_label", "tb_first_passage_time", "tb_barrier_hit"]


@query(_barrier_sql(5))
def triple_barrier(spark, root):
    return labels.triple_barrier(panel.bars(spark, root), 5).select(*KEYS, *_TB)


@query(_barrier_sql(30))
def triple_barrier_long(spark, root):
    """Horizon beyond the unrolled limit: scans an array of the next 30 bars."""
    return labels.triple_barrier(panel.bars(spark, root), 30).select(*KEYS, *_TB)


def _vol_barrier_sql(h: int = 5) -> str:
    up = ", ".join(f"CASE WHEN {leadq('close', j)} >= close*(1.0 + 1.5*v) THEN {j} END" for j in range(1, h + 1))
    dn = ", ".join(f"CASE WHEN {leadq('close', j)} <= close*(1.0 - 1.5*v) THEN {j} END" for j in range(1, h + 1))
    return f"""WITH {BARS}, a AS (SELECT *, close/{lagq('close')} - 1.0 AS rr FROM bars), b AS (SELECT *, {roll('stddev_samp', 'rr', 21)} AS v FROM a),
t AS (SELECT ticker, date, coalesce({up}, 1000000) AS tu, coalesce({dn}, 1000000) AS td, {leadq('close', h)} AS last FROM b)
SELECT ticker, date, CAST(CASE WHEN last IS NULL THEN 0 WHEN tu < td THEN 1 WHEN td < tu THEN -1 ELSE 0 END AS INTEGER) AS tb_label FROM t"""


@query(_vol_barrier_sql())
def volatility_barrier(spark, root):
    return labels.volatility_barrier(panel.bars(spark, root), 5).select(*KEYS, F.col("tb_label").cast("int").alias("tb_label"))


@query(f"WITH {BARS} SELECT ticker, date, {r('ln(' + leadq('close', 5) + '/close)')} AS target FROM bars")
def label_dispatch(spark, root):
    return rounded(labels.add_labels(panel.bars(spark, root), 5, "forward_return"), KEYS, ["target"])


# --- weights ---------------------------------------------------------------
H = 5
_CONC = " + ".join(f"{(H - d) / H!r}*((rn > {d})::INT + (n - rn >= {d})::INT)" for d in range(1, H))
W1 = f"""{BARS}, t0 AS (SELECT ticker, date, ln({leadq('close', H)}/close) AS target FROM bars),
t1 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM t0 WHERE target IS NOT NULL),
t2 AS (SELECT *, 1.0/(1.0 + {_CONC}) AS u FROM t1), t3 AS (SELECT ticker, date, greatest(u/avg(u) OVER (PARTITION BY ticker), 0.01) AS u FROM t2),
w1 AS (SELECT t0.ticker, t0.date, target, coalesce(u, 1.0) AS w_unique FROM t0 LEFT JOIN t3 USING (ticker, date))"""
W3 = f"""{W1}, w2 AS (SELECT *, exp(-ln(CAST(2 AS DOUBLE))*(max(date) OVER () - date)/252.0) AS w_decay FROM w1),
w3 AS (SELECT *, w_unique*w_decay/(avg(w_unique*w_decay) OVER () + 1e-9) AS weight FROM w2)"""


def _targets(spark, root):
    return panel.bars(spark, root).select(*KEYS, labels.forward_log_return(H).alias("target"))


@query(f"WITH {W1} SELECT ticker, date, {r('w_unique')} AS w_unique FROM w1")
def uniqueness_weights(spark, root):
    return rounded(labels.uniqueness_weights(_targets(spark, root), H), KEYS, ["w_unique"])


@query(f"WITH {W3} SELECT ticker, date, {r('w_decay')} AS w_decay FROM w3")
def decay_weights(spark, root):
    return rounded(labels.decay_weights(_targets(spark, root)), KEYS, ["w_decay"])


@query(f"WITH {W3} SELECT ticker, date, {r('weight')} AS weight FROM w3")
def sample_weights(spark, root):
    return rounded(labels.sample_weights(_targets(spark, root), H), KEYS, ["weight"])


@query(f"WITH {W3} SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS qid, count(*) AS group_size, {r('avg(weight)')} AS group_weight FROM w3 GROUP BY date")
def group_weights(spark, root):
    return rounded(labels.group_weights(labels.sample_weights(_targets(spark, root), H)), ["date", "qid", "group_size"], ["group_weight"])


# --- splits ----------------------------------------------------------------
DATES = f"""{BARS}, d0 AS (SELECT date, count(*) AS n_rows FROM bars GROUP BY date), dts AS (SELECT date, n_rows, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM d0)"""
FOLDS = f"""{DATES}, fk AS (SELECT unnest(range(0, 8)) AS fold), fb AS (SELECT CAST(fold AS INTEGER) AS fold, 504 + fold*greatest(1, (n - 10 - 504) // 8) AS s, greatest(1, (n - 10 - 504) // 8) AS sz, n FROM fk, (SELECT max(n) AS n FROM dts) WHERE n - 10 > 504),
folds0 AS (SELECT d.date, d.n_rows, d.idx, fold, CASE WHEN idx < s - 10 THEN 'train' ELSE 'test' END AS role FROM dts d JOIN fb ON s + sz <= fb.n AND (idx < s - 10 OR (idx >= s AND idx < s + sz))),
folds AS (SELECT * FROM folds0 WHERE fold IN (SELECT fold FROM folds0 GROUP BY fold HAVING sum(CASE WHEN role = 'train' THEN n_rows ELSE 0 END) >= 504))"""


def _dates(spark, root):
    return panel.bars(spark, root).select(*KEYS)


@query(f"WITH {FOLDS} SELECT fold, role, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) AS n_dates, min(date) AS first_date, max(date) AS last_date FROM folds GROUP BY fold, role")
def purged_folds(spark, root):
    return splits.fold_summary(splits.purged_folds(_dates(spark, root)))


@query(f"WITH {FOLDS} SELECT b.ticker, fold, role, count(*) AS n, min(b.date) AS first_date, max(b.date) AS last_date FROM bars b JOIN folds f ON b.date = f.date GROUP BY ALL")
def fold_rows(spark, root):
    b = _dates(spark, root)
    return splits.fold_rows(b, splits.purged_folds(b)).groupBy("ticker", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(f"WITH {FOLDS} SELECT fold, max(CASE WHEN role = 'train' THEN idx END) AS last_train, min(CASE WHEN role = 'test' THEN idx END) AS first_test, true AS ordered, "
       "min(CASE WHEN role = 'test' THEN idx END) - max(CASE WHEN role = 'train' THEN idx END) >= 10 AS gap_ok FROM folds GROUP BY fold")
def leakage_check(spark, root):
    b = _dates(spark, root)
    c = splits.leakage_check(b, splits.purged_folds(b))
    return c.withColumn("last_train", F.col("last_train").cast("bigint")).withColumn("first_test", F.col("first_test").cast("bigint"))


@query(f"WITH {DATES} SELECT CASE WHEN idx >= floor(n*(1.0 - 0.2)) THEN 'test' ELSE 'train' END AS role, CAST(sum(n_rows) AS BIGINT) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM dts "
       "WHERE idx >= floor(n*(1.0 - 0.2)) OR idx <= greatest(0, floor(n*(1.0 - 0.2)) - 10) GROUP BY 1")
def final_holdout(spark, root):
    h = splits.final_holdout(_dates(spark, root))
    return h.groupBy("role").agg(F.sum("n_rows").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(f"WITH {DATES} SELECT CAST((d.idx - 504)//5 AS INTEGER) AS step, d.date AS test_date, c.date AS train_cutoff, v.date AS val_cutoff FROM dts d JOIN dts c ON c.idx = greatest(0, d.idx - 10) JOIN dts v ON v.idx = greatest(0, d.idx - 73) "
       "WHERE d.idx >= 504 AND d.idx < d.n - 5 AND (d.idx - 504) % 5 = 0")
def rebalance_schedule(spark, root):
    return splits.rebalance_schedule(_dates(spark, root))


@query(f"WITH {DATES}, c AS (SELECT *, coalesce(sum(n_rows) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM dts) "
       "SELECT CAST((d.idx - 504)//5 AS INTEGER) AS step, d.date AS test_date, c.date AS train_before, CAST(before AS BIGINT) AS n_train FROM dts d JOIN c ON c.idx = greatest(0, d.idx - 5) WHERE d.idx >= 504 AND (d.idx - 504) % 5 = 0 AND before >= 200")
def simple_schedule(spark, root):
    return splits.simple_schedule(_dates(spark, root))


@query(f"WITH {PREDS} SELECT ticker, count(*) AS n FROM preds WHERE pred IS NOT NULL AND fwd_ret IS NOT NULL GROUP BY ticker")
def complete_rows(spark, root):
    return splits.complete_rows(momentum_predictions(spark, root), ["pred", "fwd_ret"]).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DATES} SELECT b.ticker, CASE WHEN idx < n // 2 THEN 'first' ELSE 'second' END AS half, count(*) AS n_rows, min(b.date) AS first_date, max(b.date) AS last_date FROM bars b JOIN dts d ON b.date = d.date GROUP BY 1, 2")
def half_split(spark, root):
    return splits.half_split(_dates(spark, root)).groupBy("ticker", "half").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(f"WITH {BARS}, f AS (SELECT ticker, date, {', '.join(f'ln(close/{_lc(n)}) AS ret_{n}d' for n in (1, 5, 21))}, close/({roll('avg', 'close', 20)} + 1e-9) - 1.0 AS dist_sma20, ln({leadq('close', 5)}/close) AS fwd_ret FROM bars) "
       f"SELECT ticker, date, {', '.join(r(f'({c} - avg({c}) OVER (PARTITION BY date))/(stddev_samp({c}) OVER (PARTITION BY date) + 1e-9)', 5) + f' AS {c}' for c in ('ret_1d', 'ret_5d', 'ret_21d', 'dist_sma20'))}, {r('fwd_ret')} AS fwd_ret FROM f")
def labelled_features(spark, root):
    """Flagship slice: returns and moving-average distance, z-scored per date, with the forward label."""
    cols = ["ret_1d", "ret_5d", "ret_21d", "dist_sma20"]
    df = ft.with_columns(panel.bars(spark, root), {**ft.log_returns((1, 5, 21)), "fwd_ret": labels.forward_log_return(5)})
    df = ft.sma_distance(df, (20,)).select(*KEYS, *cols, "fwd_ret")
    return rounded(cross.zscore(stage(df), cols), KEYS, {**dict.fromkeys(cols, 5), "fwd_ret": 6})
