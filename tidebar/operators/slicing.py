"""Long series in parallel: windows that look a bounded number of bars back or ahead run over slices of a series.

A window that is partitioned by series alone makes a series one task. Here a series is cut into slices of SLICE bars; the bars near a border are also sent
to the neighbour as guests, so that every bar finds all that its windows read in its own slice. Guests are dropped afterwards. What is sent twice is
(back + ahead) / size of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE = 4096


def with_bar_idx(df: DataFrame, ts: str = "ts") -> DataFrame:
    """bar_idx from 0 in each series, without a window over a whole series: bars are counted by day, days are summed up, and bars are numbered in their day."""
    dated = df.withColumn("__day", F.to_date(ts))
    days = dated.groupBy("series_id", "__day").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("series_id").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))
    offsets = days.select("series_id", "__day", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("series_id", "__day").orderBy(ts)) - 1
    return dated.join(offsets, ["series_id", "__day"]).withColumn("bar_idx", (F.col("__before") + own).cast("long")).drop("__day", "__before")


def sliced(df: DataFrame, f: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0, size: int = SLICE) -> DataFrame:
    """f(df) for an f whose outputs at a bar depend on at most `back` bars before it and `ahead` bars after it, in parallel over slices.

    f may use series_id as a partition key and bar_idx as a number; it must not change either, or add or drop rows.
    """
    size = max(size, back, ahead, 1)
    at, place = F.floor(F.col("bar_idx") / size), F.col("bar_idx") % size
    slots = F.filter(F.array(at, F.when(place >= size - back, at + 1) if back else F.lit(None), F.when(place < ahead, at - 1) if ahead else F.lit(None)), lambda s: s.isNotNull() & (s >= 0))
    dealt = df.withColumn("__slice", F.explode(slots))
    keyed = dealt.withColumns({"__series": F.col("series_id"), "__guest": F.col("__slice") != at, "series_id": F.concat(F.col("series_id").cast("string"), F.lit("\x1f"), F.col("__slice").cast("string"))})
    return f(keyed).filter(~F.col("__guest")).withColumn("series_id", F.col("__series")).drop("__slice", "__series", "__guest")
