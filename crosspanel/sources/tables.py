"""Table reads, keyed merges, journal readers and sinks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite
from ..session import stage


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


# --- scans -----------------------------------------------------------------
def load_prices(bars: DataFrame, symbols: list | None = None, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """Symbol list and inclusive date range; the filters reach the scan of a stored table."""
    if symbols:
        bars = bars.where(F.col("ticker").isin(list(symbols)))
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    return bars


def fetch_rows(df: DataFrame, filters: dict | None = None, order_by: str | list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Equality filters, `-col` for descending order, optional limit (a top-k sort)."""
    for c, v in (filters or {}).items():
        df = df.where(F.col(c) == F.lit(v))
    keys = [order_by] if isinstance(order_by, str) else (order_by or [])
    if keys:
        df = df.orderBy(*[F.col(k[1:]).desc() if k.startswith("-") else F.col(k).asc() for k in keys])
    return df if limit is None else df.limit(limit)


# --- keyed writes ----------------------------------------------------------
def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep one row per key: the first under `order`.

    An aggregate, not a window: copies of a hot key collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = df.select(*df.columns, *[o.alias(f"_k{i}") for i, o in enumerate(order)])
    best = rank.groupBy(*keys).agg(F.min(F.struct(*[f"_k{i}" for i in range(len(order))], *rest)).alias("_best"))
    return best.select(*[F.col(k) for k in keys], *[F.col(f"_best.{c}").alias(c) for c in rest]).select(*df.columns)


def merge_rows(target: DataFrame, batch: DataFrame, keys: list[str], keep_last: list[Column] | None = None) -> DataFrame:
    """Idempotent upsert: batch rows replace target rows of the same key; keys may be NULL.

    Of several batch rows of one key the first under `keep_last` stays; without
    an order, the one with the smallest other columns, so the result is defined.
    """
    batch = dedupe(batch, keys, keep_last or [F.lit(0)])
    return _without(target, batch, keys).unionByName(batch, allowMissingColumns=True)


def _without(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key `other` lacks; a NULL key equals a NULL key."""
    o = other.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(o, same, "left_anti")


def new_rows(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of the batch that the target does not hold yet."""
    return _without(dedupe(batch, keys, [F.lit(0)]), target, keys)


def replace_slice(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Replace every target row whose (partial) key occurs in the batch, then append."""
    hit = batch.select(*keys).distinct()
    return target.join(hit, keys, "left_anti").unionByName(batch, allowMissingColumns=True)


def update_rows(df: DataFrame, values: dict, match: dict) -> DataFrame:
    """Set columns where all equality matches hold."""
    hit = F.lit(True)
    for c, v in match.items():
        hit = hit & F.coalesce(F.col(c) == F.lit(v), F.lit(False))
    return df.select(*[F.when(hit, F.lit(values[c]).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def write_landing(df: DataFrame, path: str) -> None:
    """Landing zone: Parquet partitioned by year and month of `date`; files follow the data's size."""
    _write_months(_with_month(df), path, "static")


def _with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("date")).withColumn("month", F.month("date"))


def _write_months(df: DataFrame, path: str, mode: str) -> None:
    df.hint("rebalance", "year", "month").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("year", "month").parquet(path)


def append_landing(spark: SparkSession, path: str, batch: DataFrame, keep_last: list[Column] | None = None) -> None:
    """Append a batch to a landing table, newest row per (ticker, date) wins; only months of the batch are rewritten.

    The new months are written aside first, so a job that fails leaves the table as it was.
    """
    batch = stage(_with_month(batch))
    months = batch.select("year", "month").distinct()
    old = spark.read.parquet(path).join(months, ["year", "month"], "left_semi")
    _write_months(stage(merge_rows(old, batch, ["ticker", "date"], keep_last)), path, "dynamic")


# --- journals --------------------------------------------------------------
# The fields of the stored files.
SIGNAL_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("prob_up", T.DoubleType()),
    T.StructField("signal", T.StringType()), T.StructField("atr14", T.DoubleType()),
    T.StructField("entry_price", T.DoubleType()), T.StructField("stop_loss", T.DoubleType()),
    T.StructField("target_price", T.DoubleType()), T.StructField("risk_reward", T.DoubleType()),
    T.StructField("horizon_days", T.IntegerType()), T.StructField("signal_date", T.DateType()),
])

TRADE_SCHEMA = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("trade_id", "ticker")],
    T.StructField("entry_date", T.StringType()), T.StructField("entry_price", T.DoubleType()),
    T.StructField("shares", T.LongType()), T.StructField("signal", T.StringType()),
    T.StructField("stop_loss", T.DoubleType()), T.StructField("target_price", T.DoubleType()),
    T.StructField("horizon_days", T.IntegerType()), T.StructField("prob_up", T.DoubleType()),
    T.StructField("status", T.StringType()), T.StructField("exit_date", T.StringType()),
    T.StructField("exit_price", T.DoubleType()), T.StructField("exit_reason", T.StringType()),
    *[T.StructField(n, T.DoubleType()) for n in ("pnl", "pnl_pct", "entry_charges", "exit_charges", "entry_slippage",
                                                 "exit_slippage", "breakeven_price", "gross_pnl", "gross_pnl_pct")],
    T.StructField("opened_via", T.StringType()), T.StructField("notes", T.StringType()),
])

LEDGER_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("ts", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("trade_id", T.StringType()), T.StructField("ticker", T.StringType()), T.StructField("qty", T.DoubleType()),
    T.StructField("price", T.DoubleType()), T.StructField("amount", T.DoubleType()),
    T.StructField("running_balance", T.DoubleType()), T.StructField("note", T.StringType()),
])

PORTFOLIO_SCHEMA = T.StructType([
    T.StructField("saved_at", T.StringType()), T.StructField("initial_capital", T.DoubleType()), T.StructField("cash", T.DoubleType()),
    T.StructField("position_size_pct", T.DoubleType()), T.StructField("max_positions", T.IntegerType()),
    T.StructField("slippage_bps", T.DoubleType()), T.StructField("trades", T.ArrayType(TRADE_SCHEMA)),
    T.StructField("ledger", T.ArrayType(LEDGER_SCHEMA)),
])


def _exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def read_journal(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """JSON/CSV journal with a fixed schema; a missing file is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.option("multiLine", True).json(path) if fmt == "json" else reader.option("header", True).csv(path)


def read_hostile(spark: SparkSession, path: str, schema: T.StructType, required: list[str] | None = None, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of a journal whose lines may be broken; a missing file gives two empty tables.

    JSON is read line by line, so a large file splits over tasks and one broken
    line costs that line. A line that doesn't parse, or has a value of another
    type, goes to the quarantine (line, reason "broken"); one that parses but
    lacks a `required` value goes there as "missing <columns>". Unknown fields
    are dropped, blank lines are no rows. The file is parsed once.
    """
    required = required or []
    quarantine = "line string, reason string"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema), spark.createDataFrame([], quarantine)
    whole = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema], T.StructField("_broken", T.StringType())])
    reader = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
    parsed = stage(reader.json(path) if fmt == "json" else reader.option("header", True).csv(path))
    names = [f.name for f in schema]
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])) if required else F.expr("cast(array() as array<string>)")
    reason = F.when(F.col("_broken").isNotNull(), F.lit("broken")).when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.concat_ws(", ", lacking)))
    parsed = parsed.withColumn("_reason", reason)
    line = F.coalesce("_broken", F.to_json(F.struct(*names)))
    return parsed.where(F.col("_reason").isNull()).select(*names), parsed.where(F.col("_reason").isNotNull()).select(line.alias("line"), F.col("_reason").alias("reason"))


def write_panel(bars: DataFrame, name: str, buckets: int = 64, mode: str = "overwrite") -> DataFrame:
    """Store a panel as a table bucketed by ticker and sorted by date inside a bucket.

    Windows by ticker and joins of two such tables on ticker then need no
    shuffle. `mode` "append" adds rows in the same buckets: more files a bucket,
    so a sort but still no shuffle. One task writes a bucket, so it has one file.
    """
    spark = bars.sparkSession
    at = F.expr(f"pmod(hash(ticker), {buckets})")
    rows = bars.repartitionById(buckets, at).sortWithinPartitions("ticker", "date")
    rows.write.mode(mode).format("parquet").bucketBy(buckets, "ticker").sortBy("ticker", "date").saveAsTable(name)
    return spark.table(name)


def portfolio_trades(portfolio: DataFrame) -> DataFrame:
    """Nested portfolio file -> one row per trade (unknown fields are dropped by the schema)."""
    return portfolio.select(F.explode("trades").alias("t")).select("t.*")


def portfolio_ledger(portfolio: DataFrame) -> DataFrame:
    return portfolio.select(F.explode("ledger").alias("l")).select("l.*")


def portfolio_header(portfolio: DataFrame) -> DataFrame:
    return portfolio.select(F.coalesce("initial_capital", F.lit(1_000_000.0)).alias("initial_capital"),
                            F.coalesce("cash", "initial_capital").alias("cash"),
                            F.coalesce("position_size_pct", F.lit(0.05)).alias("position_size_pct"))


# --- sinks -----------------------------------------------------------------
def signal_envelope(signals: DataFrame) -> DataFrame:
    """Counts stored beside a signal file."""
    return signals.agg(F.count(F.lit(1)).alias("signal_count"), F.count_if(F.col("signal") == "LONG").alias("long_count"))


def write_signals(signals: DataFrame, path: str) -> None:
    """Signals as JSON lines and CSV plus the envelope, under one folder."""
    signals.write.mode("overwrite").json(f"{path}/json")
    signals.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    signal_envelope(signals).write.mode("overwrite").json(f"{path}/envelope")


def write_outcomes(outcomes: DataFrame, path: str) -> None:
    outcomes.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    outcomes.write.mode("overwrite").json(f"{path}/json")


def run_metadata(stats: DataFrame) -> DataFrame:
    """Backtest statistics renamed to the stored `bt_*` columns."""
    names = {"CAGR": "bt_cagr", "Sharpe": "bt_sharpe", "Sortino": "bt_sortino", "Calmar": "bt_calmar",
             "max_drawdown": "bt_max_drawdown", "hit_rate": "bt_hit_rate", "profit_factor": "bt_profit_factor"}
    return stats.withColumnsRenamed({k: v for k, v in names.items() if k in stats.columns})


def stamp_run(df: DataFrame, run_id: str) -> DataFrame:
    return df.withColumn("run_id", F.lit(run_id))


def newest_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.col("run_date").desc(), F.col("run_id")).limit(n)


# --- raw feed clean-up -----------------------------------------------------
FIELDS = ("open", "high", "low", "close", "volume")


def wide_to_long(wide: DataFrame, date_col: str = "Date", sep: str = "|") -> DataFrame:
    """Columns `Field|Ticker` -> rows (date, ticker, open..volume); other fields are dropped."""
    keep = [c for c in wide.columns if c != date_col and c.split(sep)[0].lower() in FIELDS]
    by_ticker: dict[str, dict[str, str]] = {}
    for c in keep:
        field, ticker = c.split(sep, 1)
        by_ticker.setdefault(ticker, {})[field.lower()] = c
    rows = [F.struct(F.lit(t).alias("ticker"), *[(F.col(f"`{m[f]}`") if f in m else F.lit(None)).cast("double").alias(f) for f in FIELDS]) for t, m in sorted(by_ticker.items())]
    return wide.select(F.col(date_col).alias("date"), F.explode(F.array(*rows)).alias("r")).select("date", "r.*")


def clean_bars(raw: DataFrame) -> DataFrame:
    """Types and filters of the feed: day dates, numeric or NULL, close present and positive; NaN and infinities are NULL."""
    num = [finite(F.col(c).try_cast("double")).alias(c) for c in FIELDS if c in raw.columns]
    return raw.select("ticker", F.to_date("date").alias("date"), *num).where(F.col("close") > 0)


def missing_tickers(requested: DataFrame, loaded: DataFrame) -> DataFrame:
    return requested.select("ticker").distinct().join(loaded.select("ticker").distinct(), "ticker", "left_anti")


def resolve_aliases(aliases: DataFrame, bars: DataFrame) -> DataFrame:
    """aliases(canonical, candidate, priority): rows of the first candidate that has data, relabelled."""
    have = bars.select(F.col("ticker").alias("candidate")).distinct()
    chosen = aliases.join(have, "candidate").groupBy("canonical").agg(F.min_by("candidate", "priority").alias("ticker"))
    return bars.join(chosen, "ticker").withColumn("ticker", F.col("canonical")).drop("canonical")
