"""Latest-date signals with price levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, ratio, rnd
from .labels import label_atr

MIN_BARS = 15


def latest_levels(bars: DataFrame) -> DataFrame:
    """Newest span-14 ATR and close per ticker with at least 15 bars."""
    a = label_atr(bars, "atr")
    g = a.groupBy("ticker").agg(F.max_by("atr", "date").alias("atr14"), F.max_by("close", "date").alias("close"), F.count(F.lit(1)).alias("_n"))
    return g.where(F.col("_n") >= MIN_BARS).drop("_n")


def _with_levels(signals: DataFrame, levels: DataFrame) -> DataFrame:
    j = signals.join(levels, "ticker", "left").withColumn("entry_price", F.coalesce("close", F.lit(0.0)))
    return j.withColumn("atr14", F.coalesce("atr14", F.col("entry_price") * 0.015)).drop("close")


def enrich_fixed(signals: DataFrame, levels: DataFrame, horizon: int = 5, stop_mult: float = 1.5, target_mult: float = 3.0, signal_date: Column | None = None) -> DataFrame:
    """Stop and target at fixed ATR multiples; the reward/risk ratio uses the rounded levels. Dated today unless told."""
    j = _with_levels(signals, levels)
    e, a = F.col("entry_price"), F.col("atr14")
    j = j.withColumn("stop_loss", rnd(e - stop_mult * a, 2)).withColumn("target_price", rnd(e + target_mult * a, 2))
    j = j.withColumn("risk_reward", rnd(ratio(F.col("target_price") - e, e - F.col("stop_loss")), 2)).withColumn("horizon_days", F.lit(horizon))
    return _dated(j, signal_date)


def _dated(rows: DataFrame, signal_date: Column | None) -> DataFrame:
    rows = rows.withColumn("atr14", rnd("atr14", 2)).withColumn("entry_price", rnd("entry_price", 2))
    return rows.withColumn("signal_date", F.current_date() if signal_date is None else signal_date)


def enrich_dynamic(signals: DataFrame, levels: DataFrame, horizon: int = 5, k: float = 1.0, stop_clamp=(0.8, 3.0), target_clamp=(1.0, 6.0), signal_date: Column | None = None) -> DataFrame:
    """Stop and target from the predicted quantiles q10_star/q90_star, clamped in ATRs. Dated today unless told."""
    j = _with_levels(signals, levels)
    e, a, q10, q90 = F.col("entry_price"), F.col("atr14"), F.abs("q10_star"), F.when(F.col("q90_star").isNotNull(), F.greatest(F.col("q90_star"), F.lit(0.0)))
    stop = F.coalesce(clip(ratio(k * q10 * e, a), *stop_clamp), F.lit(float(stop_clamp[0])))
    target = F.coalesce(clip(ratio(k * q90 * e, a), *target_clamp), F.lit(float(target_clamp[1])))
    j = j.select("*", rnd(ratio(q90, q10), 2).alias("risk_reward"), rnd(e - stop * a, 2).alias("stop_loss"), rnd(e + target * a, 2).alias("target_price"))
    days = F.coalesce("horizon_days", F.lit(horizon)).cast("int") if "horizon_days" in signals.columns else F.lit(horizon)
    return _dated(j.withColumn("horizon_days", days), signal_date)


def signal_counters(signals: DataFrame) -> DataFrame:
    long = F.col("signal") == "LONG"
    return signals.agg(F.count(F.lit(1)).alias("n_signals"), F.count_if(long).alias("n_long"), F.count_if(F.col("signal") == "NEUTRAL").alias("n_neutral"),
                       F.avg(F.when(long, F.col("prob_up"))).alias("avg_long_confidence"))
