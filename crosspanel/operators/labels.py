"""Forward-looking labels and sample weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import log_ratio, ratio
from ..functions.windows import ewm, lag, lead, rolling, series
from .features import true_range

LEAD_LIMIT = 21


def forward_log_return(h: int, price: str = "close") -> Column:
    return log_ratio(lead(price, h), price)


def forward_return_grid(df: DataFrame, grid: list[int], price: str = "close") -> DataFrame:
    return df.select("*", *[forward_log_return(h, price).alias(f"fwd_ret_{h}") for h in grid])


def forward_simple_return(h: int, price: str = "close") -> Column:
    return ratio(lead(price, h), price) - 1.0


def label_atr(bars: DataFrame, out: str = "atr") -> DataFrame:
    """Span-14 exponential mean of the true range whose first element repeats the second."""
    df = bars.withColumn("_tr0", F.when(lag("close").isNotNull(), true_range()))
    df = df.withColumn("_tr", F.coalesce("_tr0", lead("_tr0", 1)))
    return ewm(df, {out: ("_tr", 2.0 / 15.0)}).drop("_tr", "_tr0")


def first_touch(h: int, up: Column, dn: Column, high: str, low: str) -> tuple[Column, Column]:
    """Bars (1..h) until high >= up and until low <= dn; NULL when never.

    Short horizons unroll into lead pairs inside code generation; long ones scan
    an array of the next h bars, so the plan does not grow with h.
    """
    if h <= LEAD_LIMIT:
        t_up = F.coalesce(*[F.when(lead(high, j) >= up, F.lit(j)) for j in range(1, h + 1)])
        t_dn = F.coalesce(*[F.when(lead(low, j) <= dn, F.lit(j)) for j in range(1, h + 1)])
        return t_up, t_dn
    nxt = F.collect_list(F.struct(F.col(high).alias("h"), F.col(low).alias("l"))).over(series().rowsBetween(1, h))
    pos_up = F.array_position(F.transform(nxt, lambda b: b["h"] >= up), True)
    pos_dn = F.array_position(F.transform(nxt, lambda b: b["l"] <= dn), True)
    return F.when(pos_up > 0, pos_up.cast("int")), F.when(pos_dn > 0, pos_dn.cast("int"))


def triple_barrier(bars: DataFrame, h: int, up_mult: float = 2.0, dn_mult: float = 2.0, first_passage: bool = True) -> DataFrame:
    """tb_label in {+1,-1,0}: which ATR barrier the next h bars touch first (same bar: up wins)."""
    df = label_atr(bars)
    df = df.withColumn("_up", F.col("close") + up_mult * F.col("atr")).withColumn("_dn", F.col("close") - dn_mult * F.col("atr"))
    t_up, t_dn = first_touch(h, F.col("_up"), F.col("_dn"), "high", "low")
    df = df.select("*", t_up.alias("_tu"), t_dn.alias("_td"), lead("close", h).isNotNull().alias("_ok"), forward_log_return(h).alias("fwd_ret"))
    up_first = F.col("_tu").isNotNull() & (F.col("_td").isNull() | (F.col("_tu") <= F.col("_td")))
    df = df.withColumn("tb_label", F.when(F.col("_ok"), F.when(up_first, 1).when(F.col("_td").isNotNull(), -1).otherwise(0)))
    if first_passage:
        df = df.withColumn("tb_first_passage_time", F.when(F.col("_ok"), F.when(up_first, F.col("_tu")).otherwise(F.coalesce("_td", F.lit(h)))))
        df = df.withColumn("tb_barrier_hit", F.when(F.col("tb_label") == 1, "up").when(F.col("tb_label") == -1, "down").when(F.col("tb_label") == 0, "vertical"))
    return df.drop("_up", "_dn", "_tu", "_td", "_ok")


def volatility_barrier(bars: DataFrame, h: int, mult: float = 1.5) -> DataFrame:
    """Close-only barriers at +-mult * rolling std; ties and the unlabelled tail are 0."""
    df = rolling(bars.withColumn("_r", ratio("close", lag("close")) - 1.0), {"_v": ("std", "_r", 21)})
    up, dn = F.col("close") * (1.0 + mult * F.col("_v")), F.col("close") * (1.0 - mult * F.col("_v"))
    t_up, t_dn = first_touch(h, up, dn, "close", "close")
    df = df.select("*", t_up.alias("_tu"), t_dn.alias("_td"), lead("close", h).isNotNull().alias("_ok"))
    tu, td = F.coalesce("_tu", F.lit(10**9)), F.coalesce("_td", F.lit(10**9))
    return df.withColumn("tb_label", F.when(F.col("_ok"), F.when(tu < td, 1).when(td < tu, -1).otherwise(0)).otherwise(0)).drop("_r", "_v", "_tu", "_td", "_ok")


def add_labels(bars: DataFrame, h: int, label_type: str = "triple_barrier") -> DataFrame:
    if label_type == "triple_barrier":
        return triple_barrier(bars, h).withColumn("target", F.col("tb_label").cast("double"))
    return bars.withColumn("fwd_ret", forward_log_return(h)).withColumn("target", F.col("fwd_ret"))


# --- weights ---------------------------------------------------------------
def uniqueness_weights(df: DataFrame, h: int, label: str = "target", out: str = "w_unique") -> DataFrame:
    """Inverse label concurrency over the labelled rows of a ticker, mean 1, floor 0.01."""
    lab = F.col(label).isNotNull()
    w = W.partitionBy("ticker", "_lab")
    df = df.withColumn("_lab", lab)
    rn, n = F.row_number().over(w.orderBy("date")), F.count(F.lit(1)).over(w)
    conc = F.lit(1.0)
    for d in range(1, h):
        conc = conc + F.lit((h - d) / h) * ((F.col("_rn") > d).cast("double") + (F.col("_n") - F.col("_rn") >= d).cast("double"))
    df = df.select("*", rn.alias("_rn"), n.alias("_n")).withColumn("_u", 1.0 / conc)
    u = ratio("_u", F.avg("_u").over(w))
    return df.withColumn(out, F.when(F.col("_lab"), F.greatest(u, F.lit(0.01))).otherwise(1.0)).drop("_lab", "_rn", "_n", "_u")


def decay_weights(df: DataFrame, halflife_days: int = 252, out: str = "w_decay") -> DataFrame:
    """Exponential decay by age against the newest date of the whole table."""
    age = F.datediff(df.select(F.max("date")).scalar(), F.col("date")).cast("double")
    return df.withColumn(out, F.exp(F.lit(-math.log(2.0)) * age / float(halflife_days)))


def sample_weights(df: DataFrame, h: int, halflife_days: int = 252, label: str = "target", out: str = "weight") -> DataFrame:
    """uniqueness * decay, scaled to mean 1."""
    df = decay_weights(uniqueness_weights(df, h, label), halflife_days)
    df = df.withColumn("_w", F.col("w_unique") * F.col("w_decay"))
    return df.withColumn(out, F.col("_w") / (df.select(F.avg("_w")).scalar() + 1e-9)).drop("_w")


def group_weights(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Mean weight and dense code per date (the per-date table is calendar-bounded)."""
    g = df.groupBy("date").agg(F.avg(weight).alias("group_weight"), F.count(F.lit(1)).alias("group_size"))
    return g.withColumn("qid", (F.row_number().over(W.orderBy("date")) - 1).cast("int"))
