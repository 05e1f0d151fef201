"""Trading calendar and session predicates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "Asia/Kolkata"
OPEN_MIN, CLOSE_SEC = 9 * 60 + 15, (15 * 60 + 30) * 60


def trading_days(spark: SparkSession, start: date | str, end: date | str, holidays: DataFrame) -> DataFrame:
    """Weekdays in [start, end] that are not in holidays(date)."""
    s = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return s.where(F.weekday("date") < 5).join(holidays.select("date").distinct(), "date", "left_anti")


def is_trading_day(df: DataFrame, holidays: DataFrame, day: str = "date", out: str = "is_trading_day") -> DataFrame:
    """Flag dates; the holiday list is at most one row per calendar day, so it is broadcast."""
    h = holidays.select(F.col("date").alias(day)).distinct().withColumn("_h", F.lit(True))
    return df.join(F.broadcast(h), day, "left").withColumn(out, (F.weekday(day) < 5) & F.col("_h").isNull()).drop("_h")


def next_trading_day(df: DataFrame, holidays: DataFrame, day: str = "date", out: str = "next_trading_day") -> DataFrame:
    """First trading day after `day` among the next 11 days; else the day after."""
    near = df.select(F.col(day).alias("_d")).distinct().select("_d", F.explode(F.sequence(F.date_add("_d", 1), F.date_add("_d", 11))).alias("date"))
    ok = is_trading_day(near, holidays).where("is_trading_day").groupBy(F.col("_d").alias(day)).agg(F.min("date").alias("_n"))
    return df.join(F.broadcast(ok), day, "left").withColumn(out, F.coalesce("_n", F.date_add(day, 1))).drop("_n")


def market_open(ts_utc: str | Column, zone: str = ZONE) -> Column:
    """Monday-Friday, 09:15:00 to 15:30:00 inclusive in the exchange's zone (holidays ignored)."""
    t = F.from_utc_timestamp(ts_utc, zone)
    micros = F.unix_micros(t) - F.unix_micros(F.date_trunc("day", t))
    return (F.weekday(t) < 5) & (micros >= OPEN_MIN * 60 * 1_000_000) & (micros <= CLOSE_SEC * 1_000_000)


def next_market_open(ts_utc: str | Column, zone: str = ZONE) -> Column:
    """Local timestamp of the next open strictly after ts."""
    t = F.from_utc_timestamp(ts_utc, zone)
    minutes = F.hour(t) * 60 + F.minute(t)
    d = F.to_date(t)
    d = F.when(minutes < OPEN_MIN, d).otherwise(F.date_add(d, 1))
    d = F.date_add(d, F.greatest(F.lit(0), 7 - F.weekday(d)) * F.when(F.weekday(d) >= 5, 1).otherwise(0))
    return F.to_timestamp(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 09:15:00")))
