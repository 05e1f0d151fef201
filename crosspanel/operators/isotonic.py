"""Isotonic calibration without a driver-side pass: pooled adjacent violators in range shards, then over their blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .asof import asof_join

# distinct scores of a shard, about
SHARD_POINTS = 200_000
# blocks of a fit that scoring broadcasts at most, 24 bytes each; more are joined by order
BROADCAST_BLOCKS = 1_000_000

_BLOCK = "lo double, hi double, y double, w double"


def pool(blocks: Iterable[tuple[float, float, float, float]]) -> list[list[float]]:
    """Adjacent blocks (lo, hi, sum, weight) in order, merged until their means increase."""
    out: list[list[float]] = []
    for lo, hi, total, weight in blocks:
        new = [lo, hi, total, weight]
        while out and out[-1][2] * new[3] >= new[2] * out[-1][3]:
            last = out.pop()
            new = [last[0], new[1], last[2] + new[2], last[3] + new[3]]
        out.append(new)
    return out


def _pooled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One shard's rows in order, as blocks; only the stack is held."""

    def rows():
        for f in frames:
            yield from zip(f["lo"].tolist(), f["hi"].tolist(), f["y"].tolist(), f["w"].tolist())

    out = pool(rows())
    for i in range(0, len(out), 100_000):
        yield pd.DataFrame(out[i : i + 100_000], columns=["lo", "hi", "y", "w"])


def fit_isotonic(df: DataFrame, p: str = "pred", y: str = "label", shard_points: int = SHARD_POINTS) -> DataFrame:
    """(lo, hi, y, w): the steps of the non-decreasing fit of `y` on `p`, a row a block of scores, ascending.

    Equal scores are one weighted point. Range shards of the points are pooled by
    themselves; pooling the blocks of all shards in order gives the same fit as
    pooling all points. That last pass streams blocks through one task, which
    holds the fit itself and nothing else. Missing scores or labels are left out.
    """
    d = df.where(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")) & F.col(y).isNotNull()).groupBy(F.col(p).cast("double").alias("lo")).agg(F.sum(F.col(y).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    points = stage(d.select("lo", F.col("lo").alias("hi"), "y", "w"))
    shards = max(1, -(-points.count() // shard_points))
    local = stage(points.repartitionByRange(shards, "lo").sortWithinPartitions("lo").mapInPandas(_pooled, _BLOCK))
    # blocks are few beside points unless the points rise all along
    whole = local.repartition(1).sortWithinPartitions("lo").mapInPandas(_pooled, _BLOCK) if shards > 1 else local
    return stage(whole.withColumn("y", F.col("y") / F.col("w")))


def apply_isotonic(model: DataFrame, df: DataFrame, p: str = "pred", out: str = "calibrated", broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """Step inside a block, straight line between two, the first or last step outside. A missing score stays missing."""
    if model.count() <= broadcast_blocks:
        m = model.orderBy("lo").toPandas()
        x = np.column_stack([m["lo"], m["hi"]]).ravel()
        v = np.repeat(m["y"].to_numpy(), 2)

        @F.pandas_udf("double")
        def steps(s: pd.Series) -> pd.Series:
            return pd.Series(np.where(s.isna(), np.nan, np.interp(s, x, v))) if len(x) else pd.Series(np.full(len(s), np.nan))

        c = steps(F.col(p).cast("double"))
        return df.withColumn(out, F.when(F.col(p).isNotNull(), F.nanvl(c, F.lit(None).cast("double"))))
    known = model.select(F.lit(0).alias("_all"), F.col("lo").alias("_x"), F.struct("lo", "hi", "y").alias("_b"))
    rows = df.withColumn("_all", F.lit(0)).withColumn("_x", F.col(p).cast("double"))
    rows = asof_join(rows, known.withColumnRenamed("_b", "_under"), ["_all"], "_x")
    rows = asof_join(rows, known.withColumnRenamed("_b", "_over"), ["_all"], "_x", direction="forward")
    u, o, x = F.col("_under"), F.col("_over"), F.col("_x")
    line = u["y"] + (o["y"] - u["y"]) * (x - u["hi"]) / (o["lo"] - u["hi"])
    value = F.when(u.isNull(), o["y"]).when(o.isNull() | (x <= u["hi"]), u["y"]).otherwise(line)
    return rows.withColumn(out, value).drop("_all", "_x", "_under", "_over")
