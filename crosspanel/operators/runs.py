"""Model-run table: deployment flags, promotion decisions, feature importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Margins of the promotion gate.
SHARPE_MARGIN, IC_MARGIN, CALIB_TOL = 0.10, 0.005, 0.10


def deployed_run(runs: DataFrame) -> DataFrame:
    """The newest deployed run and its IC."""
    return runs.where("is_deployed").agg(F.max_by("run_id", "run_date").alias("run_id"), F.max_by("oof_ic", "run_date").alias("oof_ic"), F.max("run_date").alias("run_date"))


def mark_deployed(runs: DataFrame, run_id: str, previous: str = "") -> DataFrame:
    hit = F.when(F.col("run_id") == run_id, True)
    if previous:
        hit = hit.when(F.col("run_id") == previous, False)
    return runs.withColumn("is_deployed", hit.otherwise(F.col("is_deployed")))


def promotion(pairs: DataFrame, sharpe_margin: float = SHARPE_MARGIN, ic_margin: float = IC_MARGIN, calib_tol: float = CALIB_TOL) -> DataFrame:
    """Decide per row whether the challenger replaces the champion.

    Columns: ch_sharpe, ch_ic, ch_calib, cp_sharpe, cp_ic, has_champion, drift_alarm.
    Sharpe decides when both sides have it, else IC; calibration and drift can block.
    """
    first = ~F.col("has_champion")
    by_sharpe = F.col("ch_sharpe").isNotNull() & F.col("cp_sharpe").isNotNull()
    by_ic = F.col("ch_ic").isNotNull() & F.col("cp_ic").isNotNull()
    perf = F.when(by_sharpe, F.col("ch_sharpe") >= F.col("cp_sharpe") + sharpe_margin).when(by_ic, F.col("ch_ic") >= F.col("cp_ic") + ic_margin).otherwise(F.lit(False))
    calib = F.coalesce(F.col("ch_calib") <= calib_tol, F.lit(True))
    alarm = F.coalesce("drift_alarm", F.lit(False))
    why = F.array_compact(F.array(
        F.when(first & alarm, "drift_first_model"), F.when(first & ~alarm, "first_model"),
        F.when(~first & ~perf & by_sharpe, "sharpe"), F.when(~first & ~perf & ~by_sharpe & by_ic, "ic"), F.when(~first & ~by_sharpe & ~by_ic, "no_metric"),
        F.when(~first & ~calib, "calibration"), F.when(~first & alarm, "drift"), F.when(~first & perf & calib & ~alarm, "beats_champion")))
    return pairs.withColumn("promote", F.when(first, ~alarm).otherwise(perf & calib & ~alarm)).withColumn("reasons", why)


def ic_deploys(new: Column, current: Column, min_gain: float = IC_MARGIN) -> Column:
    """Deploy when nothing is deployed, or the IC improves by at least min_gain."""
    return F.when(current.isNull(), True).when(new.isNull(), False).otherwise(new >= current + min_gain)


def retrain_state(ic: Column, threshold: float = -0.01, warn: float = 0.01) -> Column:
    return F.when(ic.isNull(), "unknown").when(ic < threshold, "retrain").when(ic < warn, "watch").otherwise("healthy")


def latest_importance(importance: DataFrame, runs: DataFrame, n: int = 30, deployed_only: bool = False) -> DataFrame:
    """Top-n features of the newest (or newest deployed) run."""
    r = runs.where("is_deployed") if deployed_only else runs
    run = r.select(F.max_by("run_id", "run_date")).scalar()
    return importance.where(F.col("run_id") == run).orderBy(F.col("importance_score").desc(), "feature_name").limit(n)
