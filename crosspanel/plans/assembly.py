"""Compositions: bars -> features -> labels -> prediction frames -> reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import cross, labels, portfolio, regime
from ..operators.features import RANKED, log_returns, ticker_features, with_columns
from ..session import stage
from ..sources import panel


def raw_features(bars: DataFrame, index_bars: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Ticker, regime and relative features before any cross-sectional step; `known` is the regime table if worked out before."""
    if index_bars is None:
        return ticker_features(bars, in_arrays=True)
    r = stage(regime.regime_table(index_bars)) if known is None else known
    df = ticker_features(bars, in_arrays=True, more=regime.relative_specs(), market=r.select("date", "nifty_ret_5d"))
    return regime.relative_features(regime.attach_regime(df, r))


def feature_plan(bars: DataFrame, index_bars: DataFrame | None = None, staged: bool = True, along: Callable[[DataFrame], DataFrame] | None = None, from_files: bool = False) -> tuple[Callable[..., DataFrame], list[str]]:
    """The feature table as a function of which series are asked for (a condition on the bars; None: all), and its ordered feature list.
    Bars that come `from_files` are not staged again.

    Wide rows are never shuffled or staged: bars are, and the features are worked
    out again from them, once for what the ranks and moments of a date need and
    once for the table. Ranks, and the columns that `along` makes of the bars (one
    row a ticker and date), are joined to the bars and go through the features with them.
    """
    bars = stage(bars) if staged and not from_files else bars
    known = None if index_bars is None else stage(regime.regime_table(index_bars))
    raw = raw_features(bars, index_bars, known)
    meta = {"date", "ticker", "open", "high", "low", "close", "volume", "spike_flag"}
    feats = [c for c in raw.columns if c not in meta]
    scaled, ranked = cross.zscore_columns(feats), [c for c in RANKED if c in raw.columns]
    moments, values = cross.moments_in_arrays(raw, scaled), raw.select("date", "ticker", *ranked)
    if staged:
        moments, values = stage(moments), stage(values)
    wide = cross.percentile_ranks(bars, ranked, source=cross.zscore(values, ranked, known=moments))
    wide = wide if along is None else wide.join(along(bars), ["date", "ticker"], "left")
    names = [f"{c}_rank" for c in ranked]

    def table(series: Column | None = None) -> DataFrame:
        df = raw_features(wide if series is None else wide.where(series), index_bars, known)
        df = cross.zscore(df, scaled, known=moments)
        return df.select(*[c for c in df.columns if c not in names], *names)

    return table, feats + names


def build_features(bars: DataFrame, index_bars: DataFrame | None = None, staged: bool = True, along: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, list[str]]:
    """Full feature table and its ordered feature list, see `feature_plan`."""
    table, names = feature_plan(bars, index_bars, staged, along)
    return table(), names


def momentum_predictions(spark: SparkSession, root: str, h: int = 5, staged: bool = True, bars: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
    """Model-free prediction frame: pred = cross-sectional z-score of the 5-day return.

    Columns date, ticker, close, ret_5d, pred, fwd_ret, nifty_dist_sma200, or those
    of them in `only`; `bars` are the panel's if staged before.
    """
    names = only or ["date", "ticker", "close", "ret_5d", "pred", "fwd_ret", "nifty_dist_sma200"]
    b = panel.bars(spark, root) if bars is None else bars
    df = with_columns(b, {**log_returns((5,)), "fwd_ret": labels.forward_log_return(h)})
    r = regime.regime_table(panel.index_bars(spark, root)).select("date", "nifty_dist_sma200")
    # the return is staged once, as what is scored it is only named again
    df = df.join(F.broadcast(r), "date", "left").select(*dict.fromkeys("ret_5d" if c == "pred" else c for c in names))
    df = (stage(df) if staged else df).withColumn("pred", F.col("ret_5d")).select(*names)
    return cross.zscore(df, ["pred"])


def journal_predictions(preds: DataFrame, k: int = 5) -> DataFrame:
    """Stored predictions of every date: LONG top slice, levels around the close, yearly run id."""
    p = cross.top_long(cross.minmax_by_date(preds.where(F.col("pred").isNotNull()), "pred"), "pred", k)
    return p.select(F.concat(F.lit("run-"), F.year("date")).alias("run_id"), F.col("date").alias("signal_date"), "ticker", "signal", "prob_up",
                    rnd("close", 2).alias("entry_price"), rnd(F.col("close") * 0.97, 2).alias("stop_loss"), rnd(F.col("close") * 1.04, 2).alias("target_price"),
                    F.when(F.col("rn") % 3 == 0, F.lit(21)).when(F.col("rn") % 3 == 1, F.lit(5)).alias("horizon_days"), F.lit(False).alias("outcome_resolved"))


def backtest_report(preds: DataFrame, bars: DataFrame, rules: portfolio.Rules) -> DataFrame:
    """Single-row report: coverage, statistics, regime overlay and the cost grid as nested columns."""
    from ..operators import metrics

    grid = portfolio.cost_sensitivity(preds, rules)
    g = grid.agg(F.sort_array(F.collect_list(F.struct("cost_mult", "Sharpe", "CAGR", "max_drawdown"))).alias("sensitivity"))
    parts = {"stats": portfolio.backtest(preds, rules), "coverage": metrics.coverage(bars), "regime": metrics.regime_stats(preds, rules.regime or "nifty_dist_sma200")}
    for name, p in parts.items():
        g = g.withColumn(name, p.select(F.struct(*p.columns)).scalar())
    return g
