"""From bars to resolved outcomes with fitted scores: features, labels, walk-forward, portfolio, journal, outcomes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import cross, labels, metrics, models, outcomes, portfolio, splits
from ..operators.bins import Binned, binned, series_sample
from ..session import stage
from .assembly import build_features, feature_plan


@dataclass(frozen=True)
class Run:
    """What one run of the plan leaves: every part a table."""

    bars: DataFrame
    scored: DataFrame
    journal: DataFrame
    outcomes: DataFrame
    ic: DataFrame
    book: DataFrame


def _marked(task: str, h: int, extra: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
    """What goes along with the bars: target, forward return, weight, and the columns of `extra` (one row a ticker and date)."""
    def marked(bars: DataFrame) -> DataFrame:
        # the weights read the labels three times
        rows = stage(labels.add_labels(bars, h, "triple_barrier" if task == "classification" else "forward_return").select("ticker", "date", "fwd_ret", "target"))
        made = labels.sample_weights(rows, h).select("ticker", "date", "fwd_ret", "target", "weight", F.lit(True).alias("_marked"))
        return made if extra is None else made.join(extra(bars), ["date", "ticker"])

    return marked


def model_rows(bars: DataFrame, index_bars: DataFrame, task: str = "classification", h: int = 5) -> tuple[DataFrame, list[str]]:
    """(rows, features): the feature table with target, forward return and sample weight; staged because fits scan it repeatedly."""
    # labels go through the features with their bar, so wide rows are not shuffled to meet them
    table, names = build_features(bars, index_bars, along=_marked(task, h))
    rows = table.where("_marked").select("ticker", "date", *[F.col(c).cast("double").alias(c) for c in names], "fwd_ret", "target", "weight")
    return stage(rows), names


def model_bins(bars: DataFrame, index_bars: DataFrame, task: str = "classification", h: int = 5, extra: Callable[[DataFrame], DataFrame] | None = None) -> tuple[Binned, DataFrame]:
    """Complete rows of the feature table with target, forward return and weight as staged blocks, and the staged bars, which have the dates of all rows.

    The wide rows go from the features to their codes; what places the cuts is worked out for some series first.
    """
    bars = stage(bars)
    table, names = feature_plan(bars, index_bars, along=_marked(task, h, extra), from_files=True)

    def rows(df: DataFrame) -> DataFrame:
        more = [c for c in df.columns if c.startswith("fwd_ret_")]
        return df.where("_marked").select("ticker", "date", *[F.col(c).cast("double").alias(c) for c in names], "fwd_ret", *more, "target", "weight")

    some = series_sample(bars.count())
    return binned(rows(table()), names, None if some is None else rows(table(some))), bars


def journal_of(scored: DataFrame, bars: DataFrame, k: int = 5, h: int = 5, stop: float = 0.97, target: float = 1.04) -> DataFrame:
    """Stored predictions of every scored date: the top k-th LONG, levels around the close, a run a year."""
    p = scored.join(bars.select("ticker", "date", "close"), ["ticker", "date"])
    p = cross.top_long(cross.minmax_by_date(p, "pred"), "pred", k)
    return p.select(F.concat(F.lit("run-"), F.year("date")).alias("run_id"), F.col("date").alias("signal_date"), "ticker", "signal", "prob_up", rnd("close", 2).alias("entry_price"),
                    rnd(F.col("close") * stop, 2).alias("stop_loss"), rnd(F.col("close") * target, 2).alias("target_price"), F.lit(h).alias("horizon_days"), F.lit(False).alias("outcome_resolved"))


def run(bars: DataFrame, index_bars: DataFrame, as_of: date | str, refit_every: int = 20, min_rows: int = 504, k: int = 5, job: str | None = None, **trees) -> Run:
    """Train, score, trade, journal and resolve. With a `job` name a restarted run fits only missing refits."""
    v, bars = model_bins(bars, index_bars)
    scored = models.walk_forward(v, splits.rebalance_schedule(bars), v.features, weight="weight", refit_every=refit_every, min_rows=min_rows, job=job, **trees)
    scored = stage(scored.select("step", "date", "ticker", "pred", "fwd_ret"))
    entries = stage(journal_of(scored, bars, k))
    resolved = stage(outcomes.resolve(entries, bars, as_of))
    ic = metrics.ic_summary(metrics.daily_ic(scored))
    return Run(bars, scored, outcomes.merge_resolution(entries, resolved), resolved, ic, portfolio.backtest(scored, portfolio.Rules(k=k)))
