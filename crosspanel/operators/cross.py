"""Cross-sectional operators: all entities of one date.

Moments go through a per-date aggregate (map-side partials) that is broadcast
back - one row per calendar day. Orderings go through `functions.ordered`, which
cuts a large date into segments, so no task ever holds a whole cross-section.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions.arrays import average_ranks
from ..functions.numeric import EPS, ratio
from ..functions.ordered import SEGMENTS, average_rank_in, row_number_in
from .features import CALENDAR

# rows of a date that one task may rank
DAY_ROWS = 500_000


def per_date(df: DataFrame, aggs: list[Column], by: str = "date") -> DataFrame:
    """Join per-date aggregates back onto the rows."""
    return df.join(F.broadcast(df.groupBy(by).agg(*aggs)), by, "left")


def moments(df: DataFrame, cols: list[str], by: str = "date") -> DataFrame:
    """Mean and sample standard deviation of the columns per date."""
    return df.groupBy(by).agg(*[a for c in cols for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])


def moments_in_arrays(df: DataFrame, cols: list[str], by: str = "date") -> DataFrame:
    """`moments` of many columns: tasks add up Arrow batches by date, one row a date and task is shuffled and merged."""
    state = StructType([df.select(by).schema[0], StructField("n", ArrayType(LongType())), StructField("mean", ArrayType(DoubleType())), StructField("m2", ArrayType(DoubleType()))])
    names = [f"_{k}_{c}" for c in cols for k in ("m", "s")]
    schema = StructType([df.select(by).schema[0], *[StructField(n, DoubleType()) for n in names]])

    def merge(a: tuple, b: tuple) -> tuple:
        n = a[0] + b[0]
        delta, share = b[1] - a[1], b[0] / np.maximum(n, 1)
        # a part without rows has mean 0, which is not to be met
        mean = np.where(a[0] == 0, b[1], np.where(b[0] == 0, a[1], a[1] + delta * share))
        return n, mean, np.where(a[0] == 0, b[2], np.where(b[0] == 0, a[2], a[2] + b[2] + delta * delta * a[0] * share))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        days: dict = {}
        total = tuple(np.zeros((len(cols), 0), t) for t in (np.int64, float, float))
        with np.errstate(all="ignore"):
            for batch in batches:
                batch = batch.filter(pc.is_valid(batch.column(0)))
                if not len(batch):
                    continue
                coded = pc.dictionary_encode(batch.column(0))
                place = np.array([days.setdefault(d, len(days)) for d in coded.dictionary.to_pylist()])
                row, size = coded.indices.to_numpy(), len(place)
                part = tuple(np.zeros((len(cols), len(days)), t) for t in (np.int64, float, float))
                for i in range(len(cols)):
                    x = batch.column(i + 1)
                    there = pc.is_valid(x).to_numpy(zero_copy_only=False)
                    at, v = row[there], pc.fill_null(x, 0.0).to_numpy()[there]
                    n = np.bincount(at, minlength=size)
                    mean = np.bincount(at, v, size) / np.maximum(n, 1)
                    for held, got in zip(part, (n, mean, np.bincount(at, (v - mean[at]) ** 2, size))):
                        held[i, place] = got
                more = len(days) - total[0].shape[1]
                total = merge(tuple(np.pad(t, ((0, 0), (0, more))) for t in total), part)
        if days:
            rows = [pa.array(list(t.T), pa.list_(pa.int64() if i == 0 else pa.float64())) for i, t in enumerate(total)]
            yield pa.RecordBatch.from_arrays([pa.array(list(days), pa_type), *rows], state.names)

    def finish(parts: pa.Table) -> pa.Table:
        rows = list(zip(*[[np.array(x) for x in parts.column(c).to_pylist()] for c in ("n", "mean", "m2")]))
        with np.errstate(all="ignore"):
            n, mean, m2 = reduce(merge, rows)
            sd = np.sqrt(m2 / (n - 1))
        values = [pa.array([float(x) if k >= least else None], pa.float64()) for i, k in enumerate(n) for x, least in ((mean[i], 1), (sd[i], 2))]
        return pa.Table.from_arrays([parts.column(0).slice(0, 1), *values], names=[by, *names])

    pa_type = to_arrow_type(state[0].dataType)
    src = df.select(by, *[F.col(c).cast("double").alias(c) for c in cols])
    return src.mapInArrow(add_up, state).groupBy(by).applyInArrow(finish, schema)


def zscore(df: DataFrame, cols: list[str], by: str = "date", known: DataFrame | None = None) -> DataFrame:
    """(x - mean) / (std + eps) per date, sample std, missing values skipped; `known` are the `moments` if worked out before."""
    j = df.join(F.broadcast(moments(df, cols, by) if known is None else known), by, "left")
    return j.select(*[ratio(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}") + EPS).alias(c) if c in cols else F.col(c) for c in df.columns])


def zscore_columns(columns: list[str]) -> list[str]:
    """Feature columns that are z-scored: not calendar, not index-wide."""
    return [c for c in columns if c not in CALENDAR and not c.startswith("vix") and not c.startswith("nifty")]


def percentile_ranks(df: DataFrame, cols: list[str], keys: tuple[str, str] = ("date", "ticker"), k: int = SEGMENTS, source: DataFrame | None = None, most: int = DAY_ROWS) -> DataFrame:
    """`<col>_rank`: average rank / non-null count per date.

    Ranks come from `source`, a staged table of keys and ranked columns, if it is
    given: a task ranks all columns of a date at once, and only dates of more than
    `most` rows take the long way. That way, the ranked columns are unpivoted into
    one narrow table so that all of them share the ranking shuffle, and a date is
    cut into segments. The wide rows move once, for the join back.
    """
    if source is None:
        return df.join(_ranks_by_segment(df, cols, keys, k), [*keys], "left")
    day = keys[0]
    src = source.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).where(F.col(day).isNotNull())
    large = F.broadcast(src.groupBy(day).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(day))
    ranks = _ranks_by_date(src.join(large, day, "left_anti"), cols, keys)
    if large.limit(1).count():
        ranks = ranks.unionByName(_ranks_by_segment(src.join(large, day, "left_semi"), cols, keys, k))
    return df.join(ranks.groupBy(*keys).agg(*[F.max(f"{c}_rank").alias(f"{c}_rank") for c in cols]), [*keys], "left")


def _average_ranks(v: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Average rank over count of the values that are there."""
    out = np.zeros(len(v))
    out[there] = average_ranks(v[there]) / max(int(there.sum()), 1)
    return out


def _ranks_by_date(src: DataFrame, cols: list[str], keys: tuple[str, str]) -> DataFrame:
    """(day, ticker, ranks): a date's rows are ranked together."""
    schema = StructType([*src.select(*keys).schema.fields, *[StructField(f"{c}_rank", DoubleType()) for c in cols]])

    def rank(day: pa.Table) -> pa.Table:
        there = {c: pc.is_valid(day.column(c)).to_numpy() for c in cols}
        made = [pa.array(_average_ranks(pc.fill_null(day.column(c), 0.0).to_numpy(), there[c]), mask=~there[c]) for c in cols]
        return pa.Table.from_arrays([*[day.column(c) for c in keys], *made], names=[*keys, *[f"{c}_rank" for c in cols]])

    return src.groupBy(keys[0]).applyInArrow(rank, schema)


def _ranks_by_segment(df: DataFrame, cols: list[str], keys: tuple[str, str], k: int) -> DataFrame:
    day, ticker = keys
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])
    long = df.select(day, ticker, F.explode(pairs).alias("p")).select(day, ticker, F.col("p.i").alias("i"), F.col("p.v").alias("v")).where(F.col("v").isNotNull())
    r = average_rank_in(long, [day, "i"], "v", "r", "n", k, bounded=True)
    return r.groupBy(day, ticker).agg(*[F.max(F.when(F.col("i") == i, F.col("r") / F.col("n"))).alias(f"{c}_rank") for i, c in enumerate(cols)])


def relevance_grades(df: DataFrame, ret: str = "fwd_ret", bins: int = 8, out: str = "rank_rel", k: int = SEGMENTS) -> DataFrame:
    """Integer grade per date from the return order; NULL return keeps a NULL grade."""
    r = row_number_in(df.where(F.col(ret).isNotNull()).select("date", "ticker", ret), ["date"], ret, "ticker", k=k, bounded=True)
    g = F.when(F.col("n") < 2, F.lit(0)).otherwise(F.least(F.floor((F.col("rn") - 1) / F.col("n") * bins), F.lit(bins - 1))).cast("int")
    return df.join(r.select("date", "ticker", g.alias(out)), ["date", "ticker"], "left")


def quantile_bucket(rank: Column, n: Column, k: int) -> Column:
    """Bucket 0..k-1 of equal-probability cuts on ranks 1..n (linear-interpolated edges).

    Edge i sits at rank 1 + (n-1)*i/k, interpolated like array quantiles do; a
    rank on an edge belongs to the lower bucket. Not ntile: sizes differ.
    """
    total = F.lit(0)
    for i in range(1, k):
        total = total + (rank > _bucket_edge(n, i, k)).cast("int")
    return total


def _bucket_edge(n: Column, i: int, k: int) -> Column:
    q = i * (1.0 / k) * 100.0 / 100.0
    v = F.lit(q) * (n - 1)
    p = F.floor(v).cast("double")
    t = v - p
    return F.when(t < 0.5, p + 1.0 + t).otherwise(p + 2.0 - (1.0 - t))


def bucketed(df: DataFrame, score: str, k: int, by: list[str] | None = None, segments: int = SEGMENTS) -> DataFrame:
    """Add rn, n and bucket q of the score order inside each group (default: date)."""
    r = row_number_in(df, by or ["date"], score, "ticker", k=segments, bounded=True)
    return r.withColumn("q", quantile_bucket(F.col("rn"), F.col("n"), k))


def basket_size(n: Column, k: int, top: bool = True) -> Column:
    """Number of names in the top (or bottom) bucket: the ranks beyond the very edge that cuts it."""
    edge = F.floor(_bucket_edge(n, k - 1 if top else 1, k))
    return n - edge if top else edge


def conviction_weight(position: Column, size: Column) -> Column:
    """Rank inside the basket over the sum of ranks."""
    return ratio(position, size * (size + 1) / 2.0)


def top_long(df: DataFrame, score: str, k: int, by: str = "date", segments: int = SEGMENTS) -> DataFrame:
    """signal = LONG for the first max(1, n div k) names by score, else NEUTRAL."""
    r = row_number_in(df.withColumn("_neg", -F.col(score)), [by], "_neg", "ticker", k=segments, bounded=True)
    n_long = F.greatest(F.lit(1), F.floor(F.col("n") / k))
    return r.withColumn("signal", F.when(F.col("rn") <= n_long, "LONG").otherwise("NEUTRAL")).drop("_neg")


def minmax_by_date(df: DataFrame, score: str, out: str = "prob_up") -> DataFrame:
    """Min-max rescale inside a date; 0.5 when the scores are constant."""
    j = per_date(df, [F.min(score).alias("_lo"), F.max(score).alias("_hi")])
    return j.withColumn(out, F.when(F.col(score).isNotNull(), F.when(F.col("_hi") > F.col("_lo"), ratio(F.col(score) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).otherwise(0.5))).drop("_lo", "_hi")


def regime_overlay(df: DataFrame, regime: str) -> DataFrame:
    """No longs on dates whose index regime is negative."""
    return df.withColumn("signal", F.when(F.coalesce(F.col(regime) < 0, F.lit(False)), "NEUTRAL").otherwise(F.col("signal")))

