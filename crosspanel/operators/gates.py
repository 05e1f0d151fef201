"""Data-quality gates: predicates that fail a load or flag rows."""

from __future__ import annotations

import uuid
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.numeric import finite, flag, log_ratio
from ..functions.windows import lag
from ..session import staging_root, track

TOL = 1e-6


class DataQualityError(RuntimeError):
    pass


def ohlcv_rules() -> dict[str, Column]:
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return {
        "bad_close": F.col("close") <= 0,
        "bad_high": F.col("high") < top - TOL,
        "bad_low": F.col("low") > bottom + TOL,
        "bad_volume": F.col("volume") < 0,
        # NaN is as good as missing, and passes every comparison above
        "missing": reduce(or_, [finite(F.col(c).cast("double")).isNull() for c in ("open", "high", "low", "close", "volume")]),
    }


def ohlcv_report(bars: DataFrame) -> DataFrame:
    """Violations per rule in one aggregate."""
    return bars.agg(*[F.count_if(c).alias(n) for n, c in ohlcv_rules().items()], F.count(F.lit(1)).alias("n_rows"))


def ohlcv_violations(bars: DataFrame) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in ohlcv_rules().items()]))
    return bars.withColumn("broken", broken).where(F.size("broken") > 0)


def check_ohlcv(bars: DataFrame) -> None:
    r = ohlcv_report(bars).first().asDict()
    bad = {k: v for k, v in r.items() if k != "n_rows" and v}
    if bad:
        raise DataQualityError(f"OHLCV check failed: {bad}")


def date_gaps(bars: DataFrame, max_gap: int = 5) -> DataFrame:
    """Worst calendar-day gap of every ticker that exceeds max_gap (a warning list)."""
    g = bars.select("ticker", F.datediff("date", lag("date")).alias("gap"))
    return g.where(F.col("gap") > max_gap).groupBy("ticker").agg(F.max("gap").alias("worst_gap"), F.count(F.lit(1)).alias("n_gaps"))


def future_leak(features: DataFrame, labels: DataFrame, label_col: str = "fwd_ret") -> DataFrame:
    """One row: last feature date, last labelled date, and whether labels run past features."""
    last = labels.where(F.col(label_col).isNotNull()).select(F.max("date")).scalar()
    out = features.agg(F.max("date").alias("max_feature_date")).withColumn("max_label_date", last)
    return out.withColumn("leak", F.coalesce(F.col("max_label_date") > F.col("max_feature_date"), F.lit(False)))


def check_no_future_leak(features: DataFrame, labels: DataFrame, label_col: str = "fwd_ret") -> None:
    if future_leak(features, labels, label_col).first().leak:
        raise DataQualityError("label exists beyond the last feature date")


def freshness(bars: DataFrame, end: date | str, max_lag: int = 5) -> DataFrame:
    r = bars.agg(F.max("date").alias("latest")).withColumn("lag_days", F.datediff(F.lit(end).cast("date"), "latest"))
    return r.withColumn("stale", F.col("lag_days") > max_lag)


def check_freshness(bars: DataFrame, end: date | str, max_lag: int = 5) -> None:
    r = freshness(bars, end, max_lag).first()
    if r.stale:
        raise DataQualityError(f"latest bar {r.latest} is {r.lag_days} days behind {end}")


def spike_flags(bars: DataFrame, price: str = "close", n_sigma: float = 10.0) -> DataFrame:
    """spike_flag = 1 where |log return - mean| > n_sigma * std, mean and std over the whole panel."""
    r = bars.withColumn("_lr", log_ratio(price, lag(price)))
    s = r.agg(F.struct(F.avg("_lr").alias("mu"), F.stddev_samp("_lr").alias("sd")).alias("s")).scalar()
    return r.withColumn("_s", s).withColumn("spike_flag", flag(F.abs(F.col("_lr") - F.col("_s.mu")) > n_sigma * F.col("_s.sd"))).drop("_lr", "_s")


def gated_write(bars: DataFrame, path: str, end: date | str | None = None, max_lag: int = 5) -> dict:
    """Write `bars` to `path` if all gates pass; returns the metrics of the write.

    Rule counts, the newest date, and mean and spread of log returns are observed
    while the rows are written, so gates cost no pass of their own. The write
    goes to a folder beside `path` that takes its name only when the gates have
    passed; a failed gate deletes it and raises. Rows also get `_lr` and `_gap`,
    the log return and the days since the ticker's bar before.
    """
    rows = bars.withColumn("_lr", log_ratio("close", lag("close"))).withColumn("_gap", F.datediff("date", lag("date")))
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(n) for n, c in ohlcv_rules().items()], F.max("date").alias("latest"), F.avg("_lr").alias("mu"), F.stddev_samp("_lr").alias("sd"))
    spark = bars.sparkSession
    here, there = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.unchecked-{uuid.uuid4().hex}", path))
    files = here.getFileSystem(spark._jsc.hadoopConfiguration())
    passed = False
    try:
        rows.write.parquet(here.toString())
        m = seen.get
        bad = {n: m[n] for n in ohlcv_rules() if m[n]}
        if bad:
            raise DataQualityError(f"OHLCV check failed: {bad}")
        if end is not None:
            last = date.fromisoformat(end) if isinstance(end, str) else end
            if m["latest"] is not None and (last - m["latest"]).days > max_lag:
                raise DataQualityError(f"latest bar {m['latest']} is {(last - m['latest']).days} days behind {end}")
        passed = True
    finally:
        if not passed:
            files.delete(here, True)
    if not files.rename(here, there):
        raise DataQualityError(f"{path} exists already")
    return m


def run_gates(bars: DataFrame, end: date | str | None = None, max_lag: int = 5, max_gap: int = 5, path: str | None = None, n_sigma: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """All gates in one write; returns (stored bars with spike_flag, gap warnings), read from `path` or a staged folder."""
    spark = bars.sparkSession
    if path is None:
        path = f"{staging_root(spark)}/gated-{uuid.uuid4().hex}"
        track(spark, path)
    m = gated_write(bars, path, end, max_lag)
    kept = spark.read.parquet(path)
    far = F.abs(F.col("_lr") - F.lit(m["mu"]).cast("double")) > n_sigma * F.lit(m["sd"]).cast("double")
    gaps = kept.where(F.col("_gap") > max_gap).groupBy("ticker").agg(F.max("_gap").alias("worst_gap"), F.count(F.lit(1)).alias("n_gaps"))
    return kept.withColumn("spike_flag", flag(far)).drop("_lr", "_gap"), gaps
