"""Streaming twins: resampling with a watermark, and machines that keep their state by series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebar.operators.bars import spoken


def resample(ticks: DataFrame, interval: str, late: str = "10 minutes", price: str = "price", ts: str = "ts", tie: str = "tick_id", buy: Column | None = None) -> DataFrame:
    """Bars of a stream of (series_id, ts, price): a bar is given out when the watermark has passed its end. The same sums as for tables."""
    at = F.struct(F.col(ts), F.col(tie))
    buys = F.coalesce(F.sum(F.when(buy, F.col(price))), F.lit(0.0)) if buy is not None else F.lit(None).cast("double")
    marked = ticks.filter(F.col(price).isNotNull()).withWatermark(ts, late)
    binned = marked.groupBy("series_id", F.window(ts, spoken(interval)).alias("w"))
    out = binned.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(price).alias("volume"), F.count("*").alias("trade_count"), buys.alias("taker_buy"))
    return out.select("series_id", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "trade_count", "taker_buy")


def first_seen(df: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Keep-first deduplication: a key that comes again within the watermark is dropped."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


_SWING = "series_id string, ts timestamp, close double, last_high double, last_low double, trend int, bos int, choch int"


def swings(bars: DataFrame, n: int = 3) -> DataFrame:
    """Swing structure of a stream of bars (series_id, ts, high, low, close) that come in order by series; state is the last 2n + 1 bars and the levels."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        highs, lows, top, bottom, trend = ([], [], None, None, 0)
        if state.exists:
            highs, lows, top, bottom, trend = state.get
            highs, lows = list(highs), list(lows)
        rows = []
        for bar in pd.concat(batches).sort_values("ts").itertuples(index=False):
            highs, lows = [*highs, bar.high][-(2 * n + 1) :], [*lows, bar.low][-(2 * n + 1) :]
            if len(highs) == 2 * n + 1:
                top = highs[n] if highs[n] >= max(highs) else top
                bottom = lows[n] if lows[n] <= min(lows) else bottom
            broke = 1 if top is not None and bar.close > top else -1 if bottom is not None and bar.close < bottom else 0
            rows.append((key[0], bar.ts, bar.close, top, bottom, broke or trend, broke if broke and broke == trend else 0, broke if broke and broke == -trend else 0))
            trend = broke or trend
        state.update((highs, lows, top, bottom, trend))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SWING.split(", ")])

    kept = "highs array<double>, lows array<double>, top double, bottom double, trend int"
    return bars.groupBy("series_id").applyInPandasWithState(step, _SWING, kept, "append", GroupStateTimeout.NoTimeout)
