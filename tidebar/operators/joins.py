"""Point-in-time joins: as-of, interval aggregates, lagged daily values, next events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, by: list[str], columns: list[str], prefix: str = "", grain: str | None = None) -> DataFrame:
    """left with the `columns` of the last right row whose right_ts is at or before left_ts, per `by`; null where there is none.

    A union and one window: a single shuffle on `by`, no range join. On equal times the right row comes first, so that it counts. Of right rows with
    equal keys and times, the one with the greatest values counts. With a grain (day, hour), the window runs within (by, grain), so that a key with a
    long history is spread; what is missing at the start of a grain is the last value of the grains before, from a table of one row a grain.
    """
    value = F.struct(*(F.col(c) for c in columns))
    r = right.filter(F.col(right_ts).isNotNull()).select(*by, F.col(right_ts).alias("__at"), F.lit(0).alias("__side"), value.alias("__value"))
    l_row = F.struct(*(F.col(c) for c in left.columns))
    both = left.select(*by, F.col(left_ts).alias("__at"), F.lit(1).alias("__side"), l_row.alias("__row")).unionByName(r, allowMissingColumns=True)
    keys = list(by)
    if grain:
        both, keys = both.withColumn("__grain", F.date_trunc(grain, "__at")), [*by, "__grain"]
    w = Window.partitionBy(*keys).orderBy(F.col("__at").asc_nulls_first(), "__side", "__value").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("__last", F.last("__value", ignorenulls=True).over(w)).filter("__side = 1")
    if grain:
        ends = r.groupBy(*by, F.date_trunc(grain, "__at").alias("__grain")).agg(F.max(F.struct("__at", "__value")).alias("__end"))
        there = ends.unionByName(left.filter(F.col(left_ts).isNotNull()).select(*by, F.date_trunc(grain, left_ts).alias("__grain")).distinct(), allowMissingColumns=True).groupBy(*by, "__grain").agg(F.max("__end").alias("__end"))
        past = Window.partitionBy(*by).orderBy("__grain").rowsBetween(Window.unboundedPreceding, -1)
        carried = there.select(*by, "__grain", F.last("__end", ignorenulls=True).over(past).alias("__end"))
        held = held.join(carried, keys, "left").withColumn("__last", F.coalesce("__last", "__end.__value"))
    return held.select("__row.*", *(F.col(f"__last.{c}").alias(prefix + c) for c in columns))


def range_agg_join(bars: DataFrame, events: DataFrame, event_ts: str, seconds: int, by: list[str], aggregates: dict[str, Column], ts: str = "ts") -> DataFrame:
    """bars with aggregates of the events in [ts, ts + seconds): events are summed by bin first, then joined on equal keys. Bars start on multiples of
    the interval, so the bin of an event names its bar."""
    binned = events.groupBy(*by, F.window(event_ts, f"{seconds} seconds").alias("w")).agg(*(c.alias(n) for n, c in aggregates.items()))
    keyed = binned.select(*by, F.col("w.start").alias(ts), *aggregates)
    return bars.join(keyed, [*by, ts], "left")


def lagged_daily_join(bars: DataFrame, daily: DataFrame, day: str, columns: list[str], days: int = 1, ts: str = "ts") -> DataFrame:
    """bars with the values that were known `days` days ago: the row of day D is seen from D + days on."""
    seen = daily.select(F.date_add(F.col(day).cast("date"), days).alias("__day"), *columns)
    return bars.withColumn("__day", F.col(ts).cast("date")).join(seen, "__day", "left").drop("__day")


def next_event(value: Column, happens: Column, by: list[str], order: str) -> Column:
    """The value at the next row where something happens, strictly after the row; null on such rows themselves. In descending order, what comes next has
    been seen already, so that the frame grows by one row at a time."""
    seen = Window.partitionBy(*by).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return F.when(~happens, F.last(F.when(happens, value), ignorenulls=True).over(seen))


def forward_asof(events: DataFrame, bars: DataFrame, event_ts: str, by: list[str], ts: str = "ts") -> DataFrame:
    """events with the index of the first bar at or after them; a running frame in descending order."""
    e = events.select(*by, F.col(event_ts).alias("__at"), F.lit(0).alias("__side"), F.struct(*events.columns).alias("__row"))
    b = bars.select(*by, F.col(ts).alias("__at"), F.lit(1).alias("__side"), F.col("bar_idx").alias("__idx"))
    w = Window.partitionBy(*by).orderBy(F.col("__at").desc(), F.col("__side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = e.unionByName(b, allowMissingColumns=True).withColumn("__first", F.last("__idx", ignorenulls=True).over(w)).filter("__side = 0")
    return found.select("__row.*", F.col("__first").alias("first_bar_idx"))
