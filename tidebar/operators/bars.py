"""Bars: resampling, completeness, validity and bar-level measures. Bars are keyed by (series_id, ts); bar_idx counts them from 0 in each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.operators import slicing
from tidebar.sources.tables import table

SECONDS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400}


def spoken(interval: str) -> str:
    """The interval as Spark's window() and SQL's INTERVAL say it."""
    return f"{SECONDS[interval] // 60} minutes"


def in_order() -> Window:
    return Window.partitionBy("series_id").orderBy("ts")


def rows(first: int | None, last: int | None) -> Window:
    """A frame of rows around the current one; None is without bound."""
    return in_order().rowsBetween(Window.unboundedPreceding if first is None else first, Window.unboundedFollowing if last is None else last)


def with_bar_idx(df: DataFrame) -> DataFrame:
    return df.withColumn("bar_idx", (F.row_number().over(in_order()) - 1).cast("long"))


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN is the only null of the source data; here it is NULL from the scan on."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns})


def resample(ticks: DataFrame, interval: str, price: str = "price", ts: str = "ts", tie: str = "tick_id", buy: Column | None = None) -> DataFrame:
    """Left-closed, left-labelled bars of (series_id, ts, price); empty bins give no bar. Partial aggregates run before the shuffle."""
    at = F.struct(F.col(ts), F.col(tie))
    buys = F.coalesce(F.sum(F.when(buy, F.col(price))), F.lit(0.0)) if buy is not None else F.lit(None).cast("double")
    binned = ticks.filter(F.col(price).isNotNull()).groupBy("series_id", F.window(ts, spoken(interval)).alias("w"))
    out = binned.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(price).alias("volume"), F.count("*").alias("trade_count"), buys.alias("taker_buy"))
    return out.select("series_id", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "trade_count", "taker_buy")


def coarsen(bars: DataFrame, interval: str) -> DataFrame:
    """Bars of a longer interval from shorter ones, with how many of them were there."""
    out = bars.groupBy("series_id", F.window("ts", spoken(interval)).alias("w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"), F.sum("taker_buy").alias("taker_buy"), F.count("open").alias("observed")
    )
    return out.select("series_id", F.col("w.start").alias("ts"), F.col("w.end").alias("end_ts"), "open", "high", "low", "close", "volume", "trade_count", "taker_buy", "observed")


def completeness(bars: DataFrame, interval: str, base: str) -> DataFrame:
    expected = SECONDS[interval] // SECONDS[base]
    return bars.withColumns({"expected": F.lit(expected).cast("long"), "missing": F.lit(expected).cast("long") - F.col("observed"), "is_complete": F.col("observed") == expected})


def ohlc_valid() -> Column:
    low, high = F.col("low"), F.col("high")
    return F.coalesce((low <= F.col("open")) & (F.col("open") <= high) & (low <= F.col("close")) & (F.col("close") <= high) & (F.col("volume") >= 0), F.lit(False))


def bars_of_events(spark: SparkSession, sf_dir: str, interval: str = "15m", by: str | None = "event_type", numbered: bool = True) -> DataFrame:
    """The events table as ticks: price is value; buyers are even user ids. One series for each event type, or one in all. Numbering the bars reads the
    table once more, as it counts days first."""
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    ticks = events.select((F.col(by) if by else F.lit("ALL")).alias("series_id"), "ts", F.col("value").alias("price"), F.col("event_id").alias("tick_id"), "user_id")
    bars = resample(ticks, interval, buy=F.col("user_id") % 2 == 0)
    return slicing.with_bar_idx(bars) if numbered else bars


def daily_bars_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long daily history: orders by day, one series for each priority."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    ticks = o.select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("tick_id"), "o_custkey")
    return with_bar_idx(resample(ticks, "1d", buy=F.col("o_custkey") % 2 == 0))
