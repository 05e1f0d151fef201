"""Resolve predictions against later prices, and journal statistics over time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import ratio, rnd
from ..session import stage
from ..sources.tables import merge_rows
from .metrics import spearman

KEY = ["signal_date", "ticker", "run_id"]
SEARCH_DAYS = 5
# days of a ticker that one task orders at once
BLOCK_DAYS = 64


def horizon_of(default: int):
    return F.coalesce(F.col("horizon_days"), F.lit(default))


def due(predictions: DataFrame, as_of: date | str, default_horizon: int = 5) -> DataFrame:
    """Unresolved predictions whose horizon plus a two-day buffer has passed."""
    latest = F.date_sub(F.lit(as_of).cast("date"), (horizon_of(default_horizon) + 2).cast("int"))
    return predictions.where(~F.coalesce("outcome_resolved", F.lit(False)) & (F.col("signal_date") <= latest))


def asof_forward(rows: DataFrame, bars: DataFrame, on: str = "target_date", search: int = SEARCH_DAYS) -> DataFrame:
    """`rows` with close_date and actual_close of the first bar of the ticker on the day `on` or up to `search` days later; rows without one are left out.

    A row and the bars it may meet go to the same block of BLOCK_DAYS days of the
    ticker: a bar also goes to the block before, if that one's last days may meet
    it. A block is ordered once, newest day first, and a row takes the last bar
    it has seen. Neither side is multiplied by the days of the search.
    """
    rest = [c for c in rows.columns if c not in ("ticker", on)]
    # a null key or day matches nothing, and would gather in one block
    known = rows.where(F.col("ticker").isNotNull() & F.col(on).isNotNull())
    day = F.unix_date("date")
    seen = bars.where(F.col("ticker").isNotNull() & day.isNotNull()).select(
        "ticker", F.explode(F.sequence(F.floor((day - search) / BLOCK_DAYS), F.floor(day / BLOCK_DAYS))).alias("_block"), F.col("date").alias(on), F.struct("date", "close").alias("_hit"))
    asked = known.select("ticker", F.floor(F.unix_date(on) / BLOCK_DAYS).alias("_block"), on, F.struct(*rest).alias("_row") if rest else F.struct(F.lit(0)).alias("_row"))
    both = asked.unionByName(seen, allowMissingColumns=True)
    # a bar of the same day is there before the row
    order = W.partitionBy("ticker", "_block").orderBy(F.col(on).desc(), F.col("_row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(order))
    met = met.where(F.col("_row").isNotNull() & (F.col("_hit.date") <= F.date_add(on, search)))
    return met.select("ticker", on, *[F.col(f"_row.`{c}`").alias(c) for c in rest], F.col("_hit.date").alias("close_date"), F.col("_hit.close").alias("actual_close"))


def resolve(predictions: DataFrame, bars: DataFrame, as_of: date | str, default_horizon: int = 5) -> DataFrame:
    """Outcome columns for due predictions that have a price; the rest stay unresolved."""
    d = due(predictions, as_of, default_horizon)
    d = d.withColumn("target_date", F.date_add("signal_date", (horizon_of(default_horizon) + 2).cast("int")))
    d = asof_forward(d.select(*KEY, "signal", "prob_up", "entry_price", "stop_loss", "target_price", "target_date"), bars)
    close = F.col("actual_close")
    entry, stop, target = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("entry_price", "stop_loss", "target_price"))
    ret = F.when(entry > 0, F.log(ratio(close, entry))).otherwise(0.0)
    d = d.withColumn("_ret", ret).withColumn("hit_target", (target > 0) & (close >= target)).withColumn("hit_stop", (stop > 0) & (close <= stop))
    p = F.col("prob_up")
    ok = F.coalesce(((F.col("signal") == "LONG") & (F.col("_ret") > 0)) | ((F.col("signal") == "NEUTRAL") & (F.col("_ret") <= 0)), F.lit(False))
    return d.select(*KEY, "signal", F.when(p.isNull() | (p == 0), 0.5).otherwise(p).alias("prob_up"), F.col("target_date").alias("outcome_date"),
                    rnd(close, 2).alias("actual_close"), rnd("_ret", 6).alias("actual_fwd_ret"), "hit_target", "hit_stop",
                    F.when(F.col("_ret") > 0, 1).otherwise(-1).alias("label_direction"), ok.alias("is_correct"),
                    F.when(F.col("hit_target"), "target").when(F.col("hit_stop"), "stop").otherwise("expired").alias("exit_reason"))


def merge_resolution(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Predictions with new outcomes filled in by natural key; columns resolved before keep their values."""
    cols = ["outcome_date", "actual_close", "actual_fwd_ret", "hit_target", "hit_stop", "label_direction", "is_correct"]
    o = outcomes.select(*KEY, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_res"))
    keep = [c for c in predictions.columns if c not in cols and c != "outcome_resolved"]
    filled = [F.coalesce(f"_new_{c}", c).alias(c) if c in predictions.columns else F.col(f"_new_{c}").alias(c) for c in cols]
    return predictions.join(o, KEY, "left").select(*keep, *filled, F.coalesce("_res", "outcome_resolved", F.lit(False)).alias("outcome_resolved"))


def resolve_and_merge(predictions: DataFrame, outcomes: DataFrame, bars: DataFrame, as_of: date | str, default_horizon: int = 5) -> tuple[DataFrame, DataFrame, int]:
    """New (predictions, outcomes) tables and the number resolved; a second run resolves none and changes nothing."""
    new = stage(resolve(predictions, bars, as_of, default_horizon))
    return merge_resolution(predictions, new), merge_rows(outcomes, new, KEY), new.count()


def recent(outcomes: DataFrame, as_of: date | str, weeks: int) -> DataFrame:
    return outcomes.where(F.col("signal_date") >= F.date_sub(F.lit(as_of).cast("date"), 7 * weeks))


def recent_ic(outcomes: DataFrame, as_of: date | str, weeks: int = 4, min_rows: int = 5) -> DataFrame:
    r = spearman(recent(outcomes, as_of, weeks), "prob_up", "actual_fwd_ret")
    return r.withColumn("ic", F.when(F.col("n") >= min_rows, F.col("ic")))


def weekly_ic(outcomes: DataFrame, min_rows: int = 3) -> DataFrame:
    """Per Monday week: rank IC, rows and accuracy; weeks under min_rows rows are dropped."""
    o = outcomes.where(F.col("prob_up").isNotNull() & F.col("actual_fwd_ret").isNotNull()).withColumn("week_start", F.to_date(F.date_trunc("week", "signal_date")))
    acc = o.groupBy("week_start").agg(F.avg(F.col("is_correct").cast("double")).alias("_a"))
    ic = spearman(o, "prob_up", "actual_fwd_ret", ["week_start"], bounded=True).where(F.col("n") >= min_rows)
    return ic.join(acc, "week_start").select("week_start", rnd("ic", 4).alias("ic"), F.col("n").alias("n_obs"), rnd("_a", 3).alias("dir_accuracy"))


def latest_snapshot(predictions: DataFrame) -> DataFrame:
    """Rows of the newest signal date and, within it, the greatest run id."""
    day = predictions.select(F.max("signal_date")).scalar()
    last = predictions.where(F.col("signal_date") == day)
    return last.where(F.col("run_id") == last.select(F.max("run_id")).scalar())


def journal(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Predictions with their correctness joined from the outcomes."""
    return predictions.join(outcomes.select(*KEY, "is_correct", "actual_fwd_ret"), KEY, "left")


def scorecard(journal_rows: DataFrame) -> DataFrame:
    done = F.coalesce("outcome_resolved", F.lit(False))

    def mean_ret(s: str):
        return F.avg(F.when(done & (F.col("signal") == s), F.col("actual_fwd_ret")))

    return journal_rows.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(~done).alias("n_pending"), F.count_if(done).alias("n_resolved"),
                            F.avg(F.when(done, F.col("is_correct").cast("double"))).alias("hit_rate"), mean_ret("LONG").alias("mean_ret_long"), mean_ret("NEUTRAL").alias("mean_ret_neutral"))


def filter_journal(rows: DataFrame, status: str = "All", ticker=None, signal: str | None = None, correct: bool | None = None) -> DataFrame:
    done = F.coalesce("outcome_resolved", F.lit(False))
    if status != "All":
        rows = rows.where(done if status == "Resolved" else ~done)
    if ticker is not None:
        rows = rows.where(F.col("ticker") == F.lit(ticker))
    if signal is not None:
        rows = rows.where(F.col("signal") == F.lit(signal))
    return rows if correct is None else rows.where(F.col("is_correct") == F.lit(correct))


def health(weekly: DataFrame) -> DataFrame:
    """Status from the last three weekly ICs, weeks below thresholds and the trailing negative streak.

    Works on the weekly table: at most one row per calendar week.
    """
    w = weekly.where(F.col("ic").isNotNull()).withColumn("_d", F.row_number().over(W.orderBy(F.col("week_start").desc())))
    last3 = F.col("_d") <= 3
    g = w.agg(F.max(F.when(F.col("_d") == 1, F.col("ic"))).alias("last_ic"), F.count_if(last3 & (F.col("ic") < 0.0)).alias("n_bad"), F.count_if(last3 & (F.col("ic") < 0.01)).alias("n_warn"),
              F.count_if(F.col("ic") < 0.01).alias("weeks_below_target"), F.count_if(F.col("ic") < 0.0).alias("weeks_below_warn"), F.count_if(F.col("ic") < -0.01).alias("weeks_below_critical"),
              F.count(F.lit(1)).alias("n_weeks"), (F.coalesce(F.min(F.when(F.col("ic") >= 0, F.col("_d"))), F.count(F.lit(1)) + 1) - 1).alias("negative_streak"))
    status = F.when(F.col("n_weeks") == 0, "UNKNOWN").when(F.col("n_bad") >= 2, "CRITICAL").when(F.col("last_ic") < 0, "WARNING").when(F.col("n_warn") >= 2, "CAUTION").otherwise("HEALTHY")
    return g.withColumn("status", status)


def home_tiles(predictions: DataFrame, trades: DataFrame, as_of: date | str) -> DataFrame:
    """Pending predictions, latest signal date and its age, LONG count of that date, open trades."""
    day = predictions.select(F.max("signal_date")).scalar()
    n_open = trades.where(F.col("status") == "open").select(F.count(F.lit(1))).scalar()
    g = predictions.withColumn("_d", day).agg(F.count_if(~F.coalesce("outcome_resolved", F.lit(False))).alias("n_pending"), F.max("signal_date").alias("signal_date"),
                                              F.count_if((F.col("signal_date") == F.col("_d")) & (F.col("signal") == "LONG")).alias("n_long"))
    return g.withColumn("days_old", F.datediff(F.lit(as_of).cast("date"), "signal_date")).withColumn("stale", F.col("days_old") > 7).withColumn("n_open", n_open)
