"""Streaming twins of gaps and barrier labels, as processors with value, list and map state and event-time timers.

A bar of a stream may come before an earlier one. Each is kept in a map by its time, with a timer for that time: when the watermark has passed it, no
earlier bar can come any more, and timers fire in order, so machines see each series as the table does. A bar that is later than the watermark is
dropped, as is a second one of the same time; what a machine keeps is therefore bounded by the watermark's delay and its own horizon, whatever comes late.

A last timer, `idle` after a series' latest bar, clears what is kept of a series that has ended.

transformWithState needs the RocksDB state store: `use_rocksdb(spark)`, or the cluster's own setting.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BAR = "high double, low double, close double, atr double"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Hands bars (ms, high, low, close, atr) to step() in order of time, once no earlier one can come."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", BAR)
        self.last = handle.getValueState("last", "ms long, idle long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        last, idle = self.last.get() or (-(2**62), -(2**62)) if self.last.exists() else (-(2**62), -(2**62))
        latest = idle
        for r in rows:
            if r.ms <= last or r.ms < timerValues.getCurrentWatermarkInMs() or self.waiting.containsKey((r.ms,)):
                continue  # too late, or a second bar of one time
            self.waiting.updateValue((r.ms,), (r.high, r.low, r.close, r.atr))
            self.handle.registerTimer(r.ms)
            latest = max(latest, r.ms + self.idle_ms)
        if latest > idle:
            if idle > 0:
                self.handle.deleteTimer(idle)
            self.handle.registerTimer(latest)
            self.last.update((last, latest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        ms = expiredTimerInfo.getExpiryTimeInMs()
        if self.waiting.containsKey((ms,)):
            bar = self.waiting.getValue((ms,))
            self.waiting.removeKey((ms,))
            _, idle = self.last.get()
            self.last.update((ms, idle))
            yield from self.step(key[0], ms, *bar)
        elif self.last.exists() and self.last.get()[1] == ms:
            self.forget()
            self.last.clear()

    def step(self, series: str, ms: int, high: float, low: float, close: float, atr: float | None) -> Iterator[Row]:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Gaps(InOrder):
    """operators.structure.gaps for one side, bar by bar: the open gaps are a list, the two bars before a value."""

    OUT = "series_id string, ms long, count long, age long, near_top double, near_bot double, in_zone int"

    def __init__(self, bull: bool, cap: int, least_atr: float, idle_ms: int):
        super().__init__(idle_ms)
        self.bull, self.cap, self.least_atr = bull, cap, least_atr

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.gaps = handle.getListState("gaps", "top double, bot double, birth long")
        self.before = handle.getValueState("before", "bar long, edge2 double, edge1 double")

    def forget(self) -> None:
        self.gaps.clear()
        self.before.clear()

    def step(self, series: str, ms: int, high: float, low: float, close: float, atr: float | None) -> Iterator[Row]:
        bar, edge2, edge1 = self.before.get() if self.before.exists() else (0, None, None)
        alive = [(top, bot, birth) for top, bot, birth in (self.gaps.get() if self.gaps.exists() else ()) if bar - birth < self.cap and not (close <= top if self.bull else close >= bot)]
        top, bot = (low, edge2) if self.bull else (edge2, high)
        if edge2 is not None and top - bot > (atr * self.least_atr if atr is not None else 0.0):
            alive.append((top, bot, bar))
        if alive:
            self.gaps.put(alive)
        else:
            self.gaps.clear()
        self.before.update((bar + 1, edge1, high if self.bull else low))
        near = min(alive, key=lambda g: (min(abs(g[0] - close), abs(g[1] - close)), g[2]), default=(None, None, None))
        inside = any(low <= g[0] and high >= g[1] for g in alive)
        yield Row(series_id=series, ms=ms, count=len(alive), age=bar - alive[-1][2] + 1 if alive else None, near_top=near[0], near_bot=near[1], in_zone=int(inside))


class Barriers(InOrder):
    """operators.labels.triple_barrier for one direction and ratio: a bar waits for its horizon as a row of a map, with what it has touched so far."""

    OUT = "series_id string, ms long, label int"

    def __init__(self, direction: str, ratio: float, horizon: int, idle_ms: int):
        super().__init__(idle_ms)
        self.up, self.ratio, self.horizon = direction == "long", ratio, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("open", "bar long", "ms long, target double, stop double, result int")
        self.bar = handle.getValueState("bar", "bar long")

    def forget(self) -> None:
        self.open.clear()
        self.bar.clear()

    def step(self, series: str, ms: int, high: float, low: float, close: float, atr: float | None) -> Iterator[Row]:
        bar = self.bar.get()[0] if self.bar.exists() else 0
        for (born,), (at, target, stop, result) in list(self.open.iterator()) if self.open.exists() else ():
            if result is None:
                lost, hit = (low <= stop, high >= target) if self.up else (high >= stop, low <= target)
                result = 0 if lost else 1 if hit else None  # both at once are a loss
            if bar - born == self.horizon:
                self.open.removeKey((born,))
                yield Row(series_id=series, ms=at, label=result or 0)
            elif result is not None:
                self.open.updateValue((born,), (at, target, stop, result))
        if atr is not None and atr > 0:
            sign = 1 if self.up else -1
            self.open.updateValue((bar,), (ms, close + sign * self.ratio * atr, close - sign * atr, None))
        self.bar.update((bar + 1,))


def _run(bars: DataFrame, machine: InOrder, late: str) -> DataFrame:
    marked = bars.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).select("series_id", F.col("ts").cast("timestamp").alias("ts"), "ms", *(c.split()[0] for c in BAR.split(", "))).withWatermark("ts", late)
    out = marked.groupBy("series_id").transformWithState(statefulProcessor=machine, outputStructType=machine.OUT, outputMode="append", timeMode="eventTime")
    return out.withColumn("ts", F.timestamp_millis("ms")).drop("ms")


def gaps(bars: DataFrame, side: str = "bull", cap: int = 100, least_atr: float = 0.5, late: str = "1 hour", idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """(series_id, ts, count, age, near_top, near_bot, in_zone) for every bar (series_id, ts, high, low, close, atr) that the watermark has passed."""
    return _run(bars, Gaps(side == "bull", cap, least_atr, idle_ms), late)


def barrier_labels(bars: DataFrame, direction: str = "long", ratio: float = 2.0, horizon: int = 24, late: str = "1 hour", idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """(series_id, ts, label) of every bar with an ATR, when its horizon is over; bars whose series ends before that have no label."""
    return _run(bars, Barriers(direction, ratio, horizon, idle_ms), late)
