"""Index and volatility regime features joined per date, and strength relative to the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import EPS, log_ratio, ratio
from ..functions.windows import lag, rolling
from ..sources.panel import INDEX, VIX

REGIME = ("nifty_dist_sma50", "nifty_dist_sma200", "nifty_ret_5d", "nifty_ret_21d", "vix", "vix_change_5d", "vix_z20")


def split_index(index_bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long index frame -> (index level per date, volatility level per date)."""
    idx = index_bars.where(F.col("ticker") == INDEX).select("date", F.col("close").alias("nifty_close"))
    vix = index_bars.where(F.col("ticker") == VIX).select("date", F.col("close").alias("vix"))
    return idx, vix


def index_features(idx: DataFrame) -> DataFrame:
    """One series of at most one row per calendar day, hence a constant window key."""
    p = "nifty_close"
    df = rolling(idx.withColumn("_one", F.lit(0)), {"_m50": ("avg", p, 50), "_m200": ("avg", p, 200)}, by="_one")
    cols = {f"nifty_dist_sma{n}": ratio(p, F.col(f"_m{n}")) - 1.0 for n in (50, 200)}
    cols |= {f"nifty_ret_{n}d": log_ratio(p, lag(p, n, by="_one")) for n in (5, 21)}
    return df.select("date", p, *[c.alias(n) for n, c in cols.items()])


def vix_features(vix: DataFrame) -> DataFrame:
    df = rolling(vix.withColumn("_one", F.lit(0)), {"_m": ("mean", "vix", 20), "_s": ("std", "vix", 20)}, by="_one")
    change = ratio("vix", lag("vix", 5, by="_one")) - 1.0
    return df.select("date", "vix", change.alias("vix_change_5d"), ratio(F.col("vix") - F.col("_m"), F.col("_s") + EPS).alias("vix_z20"))


def regime_table(index_bars: DataFrame) -> DataFrame:
    """Full outer join of the two feature series: one row per date."""
    idx, vix = split_index(index_bars)
    return index_features(idx).join(vix_features(vix), "date", "full_outer")


def attach_regime(panel: DataFrame, regime: DataFrame) -> DataFrame:
    """Left join on date; the regime side has one row per calendar day, so it is broadcast."""
    return panel.join(F.broadcast(regime.drop("nifty_close")), "date", "left")


def relative_specs(n: int = 63) -> dict[str, tuple]:
    return {"_cov": ("cov", "ret_5d", "nifty_ret_5d", n), "_var": ("var", "nifty_ret_5d", n)}


def relative_features(panel: DataFrame, n: int = 63) -> DataFrame:
    """beta_63d and alpha_5d against the index over the ticker's own rows; moments that the panel brings along are taken."""
    specs = relative_specs(n)
    df = panel if set(specs) <= set(panel.columns) else rolling(panel, specs)
    df = df.withColumn(f"beta_{n}d", ratio("_cov", F.col("_var") + EPS)).drop(*specs)
    return df.withColumn("alpha_5d", F.col("ret_5d") - F.col(f"beta_{n}d") * F.col("nifty_ret_5d"))
