"""Evaluation statistics: rank correlation, calibration, return-series metrics."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.arrays import average_ranks
from ..functions.numeric import ratio, rnd
from ..functions.ordered import SEGMENTS, average_rank_in
from ..session import stage

EULER_GAMMA = 0.5772156649015329
POOLED_SEGMENTS = 1024
# pairs of a group that one task ranks, and groups of more whose segments are broadcast
PAIR_ROWS, FEW_GROUPS = 2_000_000, 10_000


# --- rank correlation ------------------------------------------------------
def spearman(df: DataFrame, a: str, b: str, by: list[str] | None = None, k: int | None = None, bounded: bool = False) -> DataFrame:
    """Spearman correlation of complete pairs per group (whole table when `by` is empty).

    The pairs are written once. A group of up to PAIR_ROWS pairs is ranked and
    correlated whole, in one task. Pairs of a larger one meet the segments of the
    first column, then, with that rank, those of the second.
    """
    by = by or []
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    pairs = stage(pairs.withColumn("_id", F.monotonically_increasing_id()))
    if not by:
        return _spearman_by_segment(pairs, by, k or POOLED_SEGMENTS, True)
    sizes = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > PAIR_ROWS).select(*by)
    met = sizes.agg(F.count_if(F.col("_n") > PAIR_ROWS).alias("n_large")).first()
    if not met.n_large:
        return _spearman_whole(pairs, by)
    # groups of PAIR_ROWS are few, and a table of them small, unless pairs are more than a cluster holds
    few = bounded or met.n_large <= FEW_GROUPS
    large = F.broadcast(large) if few else large
    same = reduce(and_, [F.col(f"p.{c}").eqNullSafe(F.col(f"l.{c}")) for c in by])
    split = lambda how: pairs.alias("p").join(large.alias("l"), same, how)
    return _spearman_whole(split("left_anti"), by).unionByName(_spearman_by_segment(split("left_semi"), by, k or SEGMENTS, few))


def _spearman_whole(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Groups that fit one task; one with a NULL key has no correlation."""
    schema = StructType([*pairs.select(*by).schema.fields, StructField("ic", DoubleType()), StructField("n", LongType())])

    def correlate(group: pa.Table) -> pa.Table:
        x, y = (average_ranks(group.column(c).to_numpy()) for c in ("_a", "_b"))
        x, y = x - x.mean(), y - y.mean()
        under = math.sqrt((x * x).mean()) * math.sqrt((y * y).mean())
        known = len(x) >= 2 and under > 0 and all(group.column(c)[0].is_valid for c in by)
        return pa.Table.from_arrays([*[group.column(c).slice(0, 1) for c in by], pa.array([float((x * y).mean() / under) if known else None], pa.float64()), pa.array([len(x)], pa.int64())], names=schema.names)

    return pairs.drop("_id").groupBy(*by).applyInArrow(correlate, schema)


def _spearman_by_segment(pairs: DataFrame, by: list[str], k: int, bounded: bool) -> DataFrame:
    r = average_rank_in(pairs, by, "_a", "_ra", k=k, bounded=bounded).select(*by, "_id", "_b", "_ra")
    r = average_rank_in(r, by, "_b", "_rb", k=k, bounded=bounded, source=pairs)
    corr = ratio(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb"))
    return r.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= 2, corr).alias("ic"), F.count(F.lit(1)).alias("n"))


def pooled_ic(preds: DataFrame, pred: str = "pred", target: str = "fwd_ret") -> DataFrame:
    return spearman(preds, pred, target)


def daily_ic(preds: DataFrame, pred: str = "pred", target: str = "fwd_ret", by: str = "date") -> DataFrame:
    """Cross-sectional rank correlation per date; dates without one are dropped."""
    return spearman(preds, pred, target, [by], bounded=True).where(F.col("ic").isNotNull())


def ic_summary(ic: DataFrame, by: list[str] | None = None) -> DataFrame:
    g = ic.where(F.col("ic").isNotNull()).groupBy(*(by or [])).agg(F.avg("ic").alias("_m"), F.stddev_samp("ic").alias("_s"), F.count("ic").alias("n_days"))
    mean = F.when(F.col("n_days") >= 2, F.col("_m"))
    ir = F.when(F.col("n_days") >= 2, F.when(F.col("_s") > 0, ratio("_m", "_s")))
    return g.select(*(by or []), mean.alias("mean_ic"), ir.alias("ic_ir"), (ir * F.sqrt("n_days")).alias("t_stat"), "n_days")


def directional_accuracy(df: DataFrame, a: str = "pred", b: str = "fwd_ret", by: list[str] | None = None) -> DataFrame:
    ok = (F.signum(a) == F.signum(b)).cast("double")
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*(by or [])).agg(F.avg(ok).alias("dir_acc"), F.count(F.lit(1)).alias("n"))


# --- calibration -----------------------------------------------------------
def _bin(p: Column, bins: int) -> Column:
    """Number of inner edges <= p; the edges are i * (1/bins) as array spacing gives them."""
    total = F.lit(0)
    for i in range(1, bins):
        total = total + (p >= F.lit(i * (1.0 / bins))).cast("int")
    return total


def _ece(df: DataFrame, p: str, y: str, bins: int, by: list[str]) -> DataFrame:
    # `_n` counts all rows, `_in` tells whether the row falls into a bin
    g = df.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.avg(p).alias("_p"), F.avg(y).alias("_y"))
    gap = F.when(F.col("_bin") >= 0, F.col("_n") * F.abs(F.col("_p") - F.col("_y"))).otherwise(0.0)
    return g.groupBy(*by).agg(ratio(F.sum(gap), F.sum("_n")).alias("ece"), F.sum("_n").alias("n"))


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Expected calibration error over half-open bins; p = 1 belongs to no bin."""
    inside = (F.col(p) >= 0) & (F.col(p) < 1)
    return _ece(df.withColumn("_bin", F.when(inside, _bin(F.col(p), bins)).otherwise(-1)), p, y, bins, by or [])


def calibration_drift(df: DataFrame, p: str = "prob_up", ret: str = "actual_fwd_ret", bins: int = 10, by: list[str] | None = None, min_rows: int = 10) -> DataFrame:
    """Calibration error with p clipped into the outer bins; NULL below min_rows rows."""
    d = df.where(F.col(p).isNotNull() & F.col(ret).isNotNull()).withColumn("_bin", _bin(F.col(p), bins)).withColumn("_y", (F.col(ret) > 0).cast("double"))
    return _ece(d, p, "_y", bins, by or []).withColumn("ece", F.when(F.col("n") >= min_rows, rnd("ece", 4)))


# --- return series ---------------------------------------------------------

def equity_curve(returns: DataFrame, by: list[str], ret: str = "ret", date: str = "date") -> DataFrame:
    """Add `equity` = running product of (1 + ret) as a signed log sum.

    One row per (series, calendar day), so a series window is calendar-bounded.
    """
    w = W.partitionBy(*by).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    g = 1.0 + F.col(ret)
    logs = F.sum(F.log(F.when(g != 0, F.abs(g)))).over(w)
    neg, zero = F.count_if(g < 0).over(w), F.count_if(g == 0).over(w)
    df = returns.select("*", logs.alias("_lg"), neg.alias("_ng"), zero.alias("_z"))
    eq = F.when(F.col("_z") > 0, 0.0).otherwise(F.when(F.col("_ng") % 2 == 0, 1.0).otherwise(-1.0) * F.exp(F.coalesce("_lg", F.lit(0.0))))
    return df.withColumn("equity", eq).drop("_lg", "_ng", "_z")


def drawdown(equity: DataFrame, by: list[str], date: str = "date") -> DataFrame:
    w = W.partitionBy(*by).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    peak = F.max("equity").over(w)
    return equity.withColumn("drawdown", (F.col("equity") - peak) / (peak + 1e-9))


def sharpe(r: str = "ret", ppy: float = 252.0) -> Column:
    sd = F.stddev_pop(r)
    return F.when((F.count(r) < 2) | (sd == 0), 0.0).otherwise(ratio(F.avg(r), sd) * math.sqrt(ppy))


def sortino(r: str = "ret", ppy: float = 252.0, mar: float = 0.0) -> Column:
    """NULL stands for the infinite case (no or constant downside)."""
    sd = F.stddev_pop(F.when(F.col(r) < mar, F.col(r)))
    return F.when(sd > 0, ratio(F.avg(r), sd) * math.sqrt(ppy))


def profit_factor(r: str = "ret") -> Column:
    loss = F.abs(F.sum(F.when(F.col(r) < 0, F.col(r))))
    return F.when(loss > 0, ratio(F.coalesce(F.sum(F.when(F.col(r) > 0, F.col(r))), F.lit(0.0)), loss))


def return_stats(returns: DataFrame, by: list[str], ret: str = "ret", date: str = "date", ppy: float = 252.0) -> DataFrame:
    """Unrounded A7-A12 statistics per series in one pass over the equity curve."""
    eq = drawdown(equity_curve(returns, by, ret, date), by, date)
    g = eq.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_periods"), sharpe(ret, ppy).alias("Sharpe"), sortino(ret, ppy).alias("Sortino"),
        F.min("drawdown").alias("max_drawdown"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"),
        profit_factor(ret).alias("profit_factor"), F.avg(ret).alias("avg_period_ret"), F.max_by("equity", date).alias("final_equity"))
    growth = F.when(F.col("final_equity") > 0, F.exp(F.log("final_equity") * (ppy / F.col("n_periods")))).otherwise(F.when(F.col("final_equity") == 0, 0.0))
    return g.withColumn("CAGR", growth - 1.0).withColumn("Calmar", ratio("CAGR", F.abs("max_drawdown")))


# Names and digits of the summary.
SUMMARY_DIGITS = {"CAGR": 4, "Sharpe": 3, "Sortino": 3, "Calmar": 3, "max_drawdown": 4, "hit_rate": 3, "profit_factor": 3, "avg_period_ret": 5, "final_equity": 4}


def summarise(returns: DataFrame, by: list[str], ret: str = "ret", date: str = "date", ppy: float = 252.0) -> DataFrame:
    s = return_stats(returns, by, ret, date, ppy)
    return s.select(*by, "n_periods", *[rnd(c, d).alias(c) for c, d in SUMMARY_DIGITS.items()])


# Hart's rational form of the normal tail, as published by G. West in 2005; from CDF_FAR on a continued fraction.
CDF_N = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_D = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CDF_FAR = 7.07106781186547


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, to double precision."""
    x = F.abs(z)
    top, bottom, far = F.lit(0.0), F.lit(0.0), x + 0.65
    for c in CDF_N:
        top = top * x + c
    for c in CDF_D:
        bottom = bottom * x + c
    for k in (4, 3, 2, 1):
        far = x + k / far
    tail = F.exp(-x * x / 2.0) * F.when(x < CDF_FAR, top / bottom).otherwise(1.0 / far / math.sqrt(2.0 * math.pi))
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def deflated_sharpe(stats: DataFrame, n_trials: int, ppy: float = 252.0, sr: str = "Sharpe", n: str = "n_periods", skew: Column | None = None, kurt: Column | None = None) -> DataFrame:
    """Probability that the true Sharpe is positive after picking the best of n_trials."""
    if n_trials <= 1:
        return stats.withColumn("dsr_z", F.lit(None).cast("double")).withColumn("deflated_sharpe", F.lit(None).cast("double"))
    inv = NormalDist().inv_cdf
    hurdle = (1 - EULER_GAMMA) * inv(1 - 1.0 / n_trials) + EULER_GAMMA * inv(1 - 1.0 / (n_trials * math.e))
    skew, kurt = skew if skew is not None else F.lit(0.0), kurt if kurt is not None else F.lit(3.0)
    per = F.col(sr) / math.sqrt(ppy)
    var = F.when(F.col(n) > 2, ratio(1 - skew * per + (kurt - 1) / 4.0 * per * per, F.col(n) - 1))
    z = F.when(var > 0, ratio(per, F.sqrt(var)) - hurdle)
    return stats.withColumn("dsr_z", z).withColumn("deflated_sharpe", normal_cdf(F.col("dsr_z")))


def block_bootstrap(returns: DataFrame, by: list[str], n_boot: int = 1000, block: int = 20, seed: int = 42, ret: str = "ret", date: str = "date", ppy: float = 252.0) -> DataFrame:
    """Percentiles 5/50/95 of Sharpe, CAGR and max drawdown over overlapping-block resamples.

    Block starts come from a digest of (seed, series, draw, block), so a recomputed
    task, and another engine, draws the same blocks. Each draw is its own series of at most n periods.
    """
    w = W.partitionBy(*by)
    r = returns.select(*by, ret, (F.row_number().over(w.orderBy(date)) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("_n")).where(F.col("_n") >= 2 * block)
    size = r.select(*by, "_n").distinct()
    draws = size.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn(
        "blk", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_n") / block) - 1).cast("int"))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *by, "boot", "blk"))
    start = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.col("_n") - block + 1)
    draws = draws.withColumn("_s", start).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    draws = draws.select(*by, "boot", (F.col("blk") * block + F.col("_o")).alias("pos"), (F.col("_s") + F.col("_o")).cast("int").alias("_i"), "_n").where(F.col("pos") < F.col("_n"))
    s = return_stats(draws.drop("_n").join(r.drop("_n"), [*by, "_i"]), [*by, "boot"], ret, "pos", ppy)
    aggs = [F.percentile(c, F.lit(p / 100.0)).alias(f"{n}_p{p:02d}") for n, c in (("sharpe", "Sharpe"), ("cagr", "CAGR"), ("max_drawdown", "max_drawdown")) for p in (5, 50, 95)]
    return s.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("n_boot"))


# --- quantile calibration and coverage -------------------------------------
def quantile_calibration(df: DataFrame, taus: dict[float, str], realised: str = "fwd_ret") -> DataFrame:
    """Per tau: share of realised values below the predicted quantile and its gap."""
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.col(c).alias("q")) for t, c in taus.items()])
    long = df.select(F.col(realised).alias("y"), F.explode(pairs).alias("p")).where(F.col("y").isNotNull() & F.col("p.q").isNotNull())
    g = long.groupBy(F.col("p.tau").alias("tau")).agg(F.avg((F.col("y") < F.col("p.q")).cast("double")).alias("_b"), F.count(F.lit(1)).alias("n"))
    return g.select("tau", F.col("tau").alias("nominal_rate"), rnd("_b", 4).alias("realised_rate"), "n", rnd(F.abs(F.col("_b") - F.col("tau")), 4).alias("abs_gap"))


def regime_stats(preds: DataFrame, regime: str) -> DataFrame:
    """Dates whose (per-date constant) regime is negative: count and fraction."""
    d = preds.groupBy("date").agg(F.max(regime).alias("_r")).where(F.col("_r").isNotNull())
    return d.agg(F.count(F.lit(1)).alias("n_dates"), F.count_if(F.col("_r") < 0).alias("n_flat"), F.avg((F.col("_r") < 0).cast("double")).alias("flat_fraction"))


def coverage(bars: DataFrame) -> DataFrame:
    """Distinct tickers from a per-ticker pre-aggregate, so no value set is held by one task."""
    g = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n"), F.min("date").alias("_a"), F.max("date").alias("_b"))
    return g.agg(F.count(F.lit(1)).alias("n_tickers"), F.sum("_n").alias("n_rows"), F.min("_a").alias("date_min"), F.max("_b").alias("date_max"))
