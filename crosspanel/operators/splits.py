"""Purged walk-forward splits on the date dimension.

Fold membership depends on the date only, so everything is worked out on the
per-date table (one row per calendar day) and joined to rows by date equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def date_index(df: DataFrame) -> DataFrame:
    """(date, n_rows, idx, n_dates): sorted unique dates with a 0-based index."""
    d = df.groupBy("date").agg(F.count(F.lit(1)).alias("n_rows"))
    return d.select("date", "n_rows", (F.row_number().over(W.orderBy("date")) - 1).alias("idx"), F.count(F.lit(1)).over(W.partitionBy(F.lit(0))).alias("n_dates"))


def purged_folds(df: DataFrame, n_splits: int = 8, embargo: int = 5, label_h: int = 5, min_train: int = 504) -> DataFrame:
    """(date, n_rows, fold, role): which dates train and test each fold."""
    gap = label_h + embargo
    size = F.greatest(F.lit(1), F.floor((F.col("n_dates") - gap - min_train) / n_splits))
    d = date_index(df).where(F.col("n_dates") - gap > min_train).withColumn("_size", size)
    folds = F.transform(F.sequence(F.lit(0), F.lit(n_splits - 1)), lambda k: F.struct(k.alias("fold"), (min_train + k * F.col("_size")).alias("start")))
    d = d.withColumn("_f", F.explode(F.filter(folds, lambda f: f["start"] + F.col("_size") <= F.col("n_dates"))))
    start = F.col("_f.start")
    role = F.when(F.col("idx") < start - gap, "train").when((F.col("idx") >= start) & (F.col("idx") < start + F.col("_size")), "test")
    d = d.select("date", "n_rows", F.col("_f.fold").alias("fold"), role.alias("role")).where(F.col("role").isNotNull())
    big = d.groupBy("fold").agg(F.sum(F.when(F.col("role") == "train", F.col("n_rows"))).alias("_tr"), F.count_if(F.col("role") == "test").alias("_te"))
    keep = big.where((F.coalesce("_tr", F.lit(0)) >= min_train) & (F.col("_te") > 0)).select("fold")
    return d.join(keep, "fold", "left_semi")


def fold_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with their fold and role; the fold table is dates x splits, hence broadcast."""
    return df.join(F.broadcast(folds.select("date", "fold", "role")), "date")


def fold_summary(folds: DataFrame) -> DataFrame:
    return folds.groupBy("fold", "role").agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def final_holdout(df: DataFrame, test_fraction: float = 0.2, embargo: int = 5, label_h: int = 5) -> DataFrame:
    """(date, n_rows, role): newest dates test; train ends at dates[split - gap], inclusive."""
    split = F.floor(F.col("n_dates") * (1.0 - test_fraction))
    role = F.when(F.col("idx") >= split, "test").when(F.col("idx") <= F.greatest(F.lit(0), split - label_h - embargo), "train")
    return date_index(df).select("date", "n_rows", role.alias("role")).where(F.col("role").isNotNull())


def rebalance_schedule(df: DataFrame, min_train: int = 504, h: int = 5, embargo: int = 5, every: int = 5, val_dates: int = 63) -> DataFrame:
    """One row per walk-forward step: test date, train cutoff and validation cutoff dates."""
    d = date_index(df)
    at = d.select(F.col("idx").alias("_i"), F.col("date").alias("_d"))
    steps = d.where((F.col("idx") >= min_train) & (F.col("idx") < F.col("n_dates") - h) & ((F.col("idx") - min_train) % every == 0))
    steps = steps.select(((F.col("idx") - min_train) / every).cast("int").alias("step"), F.col("date").alias("test_date"),
                         F.greatest(F.lit(0), F.col("idx") - embargo - h).alias("_c"), F.greatest(F.lit(0), F.col("idx") - embargo - h - val_dates).alias("_v"))
    steps = steps.join(at.withColumnsRenamed({"_i": "_c", "_d": "train_cutoff"}), "_c").join(at.withColumnsRenamed({"_i": "_v", "_d": "val_cutoff"}), "_v")
    return steps.select("step", "test_date", "train_cutoff", "val_cutoff")


def simple_schedule(df: DataFrame, min_train: int = 504, embargo: int = 5, every: int = 5, min_rows: int = 200) -> DataFrame:
    """Walk-forward where train is strictly before the cutoff and holds at least min_rows rows."""
    d = date_index(df)
    before = d.withColumn("_rows", F.coalesce(F.sum("n_rows").over(W.orderBy("date").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    at = before.select(F.col("idx").alias("_c"), F.col("date").alias("train_before"), F.col("_rows").alias("n_train"))
    steps = d.where((F.col("idx") >= min_train) & ((F.col("idx") - min_train) % every == 0))
    steps = steps.select(((F.col("idx") - min_train) / every).cast("int").alias("step"), F.col("date").alias("test_date"), F.greatest(F.lit(0), F.col("idx") - embargo).alias("_c"))
    return steps.join(at, "_c").where(F.col("n_train") >= min_rows).drop("_c")


def complete_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)


def half_split(df: DataFrame) -> DataFrame:
    """First half of the dates calibrates, second half is out of sample."""
    d = date_index(df).select("date", F.when(F.col("idx") < F.floor(F.col("n_dates") / 2), "first").otherwise("second").alias("half"))
    return df.join(F.broadcast(d), "date")


def leakage_check(df: DataFrame, folds: DataFrame, label_h: int = 5, embargo: int = 5) -> DataFrame:
    """Per fold: train ends before test starts, and the gap in dates is at least h + embargo."""
    idx = F.broadcast(date_index(df).select("date", "idx"))
    g = folds.join(idx, "date").groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("idx"))).alias("last_train"), F.min(F.when(F.col("role") == "test", F.col("idx"))).alias("first_test"))
    return g.withColumn("ordered", F.col("last_train") < F.col("first_test")).withColumn("gap_ok", F.col("first_test") - F.col("last_train") >= label_h + embargo)
