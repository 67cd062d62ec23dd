"""Order-dependent machines that neither windows nor intervals express: one ordered pass over each series.

A machine is an object with step(bar) -> dict of outputs. Bars come as named tuples in order; state is what the object holds. A partition has whole series,
sorted by series and bar, and is streamed in Arrow batches: what is in memory is a batch and a machine's state, which its caps bound, and not a series.
Series are independent, so that they run in parallel. An output that isn't known is null.
"""

from __future__ import annotations

import math
from collections import deque, namedtuple
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAN = float("nan")
# The weights of a gap's score (displacement; distance, age, width), and the scale of age in bars.
GAP_WEIGHTS = (0.55, 0.30, 0.15)
GAP_DISPLACED, GAP_AGE = 1.35, 288
#: Columns that machines read.
INPUT = ("open", "high", "low", "close", "volume", "atr", "bos", "swing_high", "swing_low", "last_high", "last_low", "disp_bull", "disp_bear")


def valid(atr: float) -> bool:
    return atr == atr and atr > 0


def unit(x: float) -> float:
    return min(1.0, max(0.0, x))


def run(df: DataFrame, machine: type, *args: object) -> DataFrame:
    """(series_id, ts, bar_idx) and the machine's outputs for every bar."""
    used = [c for c in INPUT if c in df.columns]
    keys = ["series_id", "ts", "bar_idx"]
    names = list(machine(*args).outputs())
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, T.DoubleType()) for n in names)])
    bar_of = namedtuple("Bar", used)._make

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, m = None, None
        for batch in batches:
            made: dict[str, list[float]] = {n: [] for n in names}
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keys) :]]
            for series, values in zip(batch.column(0).to_pylist(), zip(*(c.tolist() for c in columns), strict=True), strict=True):
                if m is None or series != now:
                    now, m = series, machine(*args)
                for n, v in m.step(bar_of(values)).items():
                    made[n].append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(made[n], pa.float64(), from_pandas=True) for n in names)], names=[*keys, *names])

    # a null is NaN to a machine
    own = df.select(*keys, *(F.coalesce(F.col(c).cast("double"), F.lit(NAN)).alias(c) for c in used))
    return own.repartition("series_id").sortWithinPartitions("series_id", "bar_idx").mapInArrow(work, schema)


@dataclass
class Zone:
    top: float
    bot: float
    born: int
    bull: bool
    strength: float = 0.0
    wait: int = 0
    gap: bool = False
    tested: bool = False
    touched: bool = False
    rejected: bool = False
    inverted: bool = False
    strong: bool = False

    @property
    def mid(self) -> float:
        return (self.top + self.bot) / 2

    def overlaps(self, bar) -> bool:  # noqa: ANN001
        return bar.low <= self.top and bar.high >= self.bot

    def depth(self, bar, bull: bool) -> float:  # noqa: ANN001
        """How far the bar reaches into the zone from the side that it comes from."""
        width = max(self.top - self.bot, 1e-9)
        return unit((self.top - min(bar.low, self.top)) / width) if bull else unit((max(bar.high, self.bot) - self.bot) / width)


class TrackedGaps:
    """Gaps with touches of their middle, rejections, and inversion: a bull gap that a close falls through becomes a bear zone (valid until a close
    above its top), a bear gap that a close rises through becomes a bull gap like any other. Order on a bar: age out, close through, new, update."""

    SHOWN = 3

    def __init__(self, cap: int = 100, least_atr: float = 0.5):
        self.cap, self.least, self.now, self.past = cap, least_atr, -1, deque(maxlen=3)
        self.bulls: list[Zone] = []
        self.bears: list[Zone] = []

    def outputs(self) -> list[str]:
        return [x for s in ("bull", "bear") for x in (f"fvg_{s}_count", f"fvg_{s}_recent_age", *(f"fvg_{s}_{k}_{c}" for k in range(1, self.SHOWN + 1) for c in ("ce", "dist_atr", "touched", "rejected", "fill", "filled", "is_displacement", "is_inverted")))]

    def step(self, bar) -> dict:  # noqa: ANN001
        self.now += 1
        self.past.append(bar)
        young = lambda z: self.now - z.born < self.cap
        fallen = [z for z in filter(young, self.bulls) if bar.close <= z.top]
        self.bulls = [z for z in filter(young, self.bulls) if bar.close > z.top]
        turned = [z for z in fallen if bar.close < z.bot and not z.inverted]
        bears = [z for z in self.bears if young(z)]
        for z in turned:
            z.inverted, z.bull = True, False
        kept = []
        for z in bears + turned:
            if z.inverted:
                if bar.close <= z.top:
                    kept.append(z)
            elif bar.close < z.bot:
                kept.append(z)
            elif bar.close > z.top:
                z.inverted, z.bull = True, True
                self.bulls.append(z)
        self.bears = kept
        if len(self.past) == 3:
            first, middle, _ = self.past
            least = (bar.atr if valid(bar.atr) else 1e-9) * self.least
            if bar.low - first.high > least:
                self.bulls.append(Zone(bar.low, first.high, self.now, True, strong=bool(middle.disp_bull)))
            if first.low - bar.high > least:
                self.bears.append(Zone(first.low, bar.high, self.now, False, strong=bool(middle.disp_bear)))
        out = dict.fromkeys(self.outputs(), 0.0)
        for s, zones, bull in (("bull", self.bulls, True), ("bear", self.bears, False)):
            for z in zones:
                z.touched = z.touched or (bar.low <= z.mid if bull else bar.high >= z.mid)
                z.rejected = z.rejected or (z.touched and (bar.close > z.mid if bull else bar.close < z.mid))
            out[f"fvg_{s}_count"] = float(len(zones))
            out[f"fvg_{s}_recent_age"] = float(self.now - zones[-1].born + 1) if zones else NAN
            for k in range(1, self.SHOWN + 1):
                out[f"fvg_{s}_{k}_ce"] = out[f"fvg_{s}_{k}_dist_atr"] = NAN
            far = lambda z: abs(bar.close - z.mid) / bar.atr if valid(bar.atr) else 999.0

            def score(z: Zone) -> float:
                width = (z.top - z.bot) / bar.atr if valid(bar.atr) else 0.0  # noqa: B023
                near, young, wide = GAP_WEIGHTS
                return (GAP_DISPLACED if z.strong else 1.0) * (near / (1 + far(z)) + young * math.exp(-(self.now - z.born + 1) / GAP_AGE) + wide * unit(width))  # noqa: B023

            for k, z in enumerate(sorted(zones, key=lambda z: (-score(z), far(z)))[: self.SHOWN], 1):  # noqa: B023
                shown = {"ce": z.mid, "dist_atr": far(z) if valid(bar.atr) else NAN, "touched": z.touched, "rejected": z.rejected, "fill": z.depth(bar, bull), "filled": bar.low <= z.bot if bull else bar.high >= z.top, "is_displacement": z.strong, "is_inverted": z.inverted}
                out.update({f"fvg_{s}_{k}_{c}": float(v) for c, v in shown.items()})
        return out


class Liquidity:
    """Swing levels that no close has gone through, the newest `kept` of each side; the nearest one above and below, and whether another is level with it."""

    def __init__(self, tolerance: float = 0.10, kept: int = 50):
        self.tolerance, self.highs, self.lows = tolerance, deque(maxlen=kept), deque(maxlen=kept)

    def outputs(self) -> list[str]:
        return ["liq_above_pct", "liq_below_pct", "liq_equal_high", "liq_equal_low"]

    def step(self, bar) -> dict:  # noqa: ANN001
        if bar.swing_high:
            self.highs.append(bar.last_high)
        if bar.swing_low:
            self.lows.append(bar.last_low)
        c, out = bar.close, dict.fromkeys(self.outputs(), 0.0)
        self.highs = deque((p for p in self.highs if p > c), maxlen=self.highs.maxlen)
        self.lows = deque((p for p in self.lows if p < c), maxlen=self.lows.maxlen)
        near = self.tolerance * bar.atr if valid(bar.atr) else 0.0
        for levels, pick, share, equal in ((self.highs, min, "liq_above_pct", "liq_equal_high"), (self.lows, max, "liq_below_pct", "liq_equal_low")):
            out[share] = NAN
            if levels:
                nearest = pick(levels)
                out[share] = abs(nearest - c) / c * 100 if c else math.inf  # a level isn't the close, so that zero is as far as can be
                out[equal] = float(near > 0 and sum(abs(p - nearest) <= near for p in levels) >= 2)
        return out


class DeliveryChange:
    """The most recent run of at least two candles of one colour within the last bars; its first open is a level, and a close across it fires."""

    def __init__(self, reach: int = 20, least: int = 2, cap: int = 20):
        self.least, self.cap, self.now = least, cap, -1
        self.past = deque(maxlen=reach)
        self.last = {"bull": None, "bear": None}

    def outputs(self) -> list[str]:
        return ["cisd_bull", "cisd_bear", "cisd_bull_age", "cisd_bear_age"]

    def _level(self, sign: int) -> float | None:
        """sign -1: of falling candles."""
        newest_first = list(self.past)[::-1][: self.past.maxlen - 1]
        for falls, run_of in groupby(newest_first, key=lambda b: (b.close - b.open) * sign > 0):
            own = list(run_of)
            if falls and len(own) >= self.least:
                return own[-1].open
        return None

    def step(self, bar) -> dict:  # noqa: ANN001
        self.now += 1
        out = dict.fromkeys(self.outputs(), NAN)
        before = self.past[-1].close if self.past else None
        for s, sign in (("bull", 1), ("bear", -1)):
            level = self._level(-sign)
            fire = level is not None and (bar.close - level) * sign > 0 and (before - level) * sign <= 0
            out[f"cisd_{s}"] = float(fire)
            if fire:
                self.last[s] = self.now
            if self.last[s] is not None and self.now - self.last[s] <= self.cap:
                out[f"cisd_{s}_age"] = float(self.now - self.last[s])
        self.past.append(bar)
        return out


class Breakers:
    """An order block that a close goes through turns into a zone of the other direction, until a close through its far side or old age; a newer one
    replaces it. A break without a candle of the other colour leaves the block before it in place."""

    def __init__(self, lookback: int = 200, cap: int = 200):
        self.cap, self.now, self.past = cap, -1, deque(maxlen=lookback)
        self.block: dict[bool, Zone | None] = {True: None, False: None}
        self.breaker: dict[bool, Zone | None] = {True: None, False: None}

    def outputs(self) -> list[str]:
        return [f"breaker_{s}_{x}" for s in ("bull", "bear") for x in ("age", "dist", "in_zone")]

    def step(self, bar) -> dict:  # noqa: ANN001
        self.now += 1
        if bar.bos:
            bull = bar.bos > 0
            candle = next((b for b in reversed(self.past) if (b.open - b.close) * (1 if bull else -1) > 0), None)
            if candle:
                self.block[bull] = Zone(max(candle.open, candle.close), min(candle.open, candle.close), self.now, bull)
        for bull in (True, False):
            z = self.block[bull]
            if z and (bar.close < z.bot if bull else bar.close > z.top):
                self.breaker[not bull], self.block[bull] = Zone(z.top, z.bot, self.now, not bull), None
        out = dict.fromkeys(self.outputs(), NAN)
        for s, bull in (("bull", True), ("bear", False)):
            z = self.breaker[bull]
            if z and (self.now - z.born >= self.cap or (bar.close < z.bot if bull else bar.close > z.top)):
                z = self.breaker[bull] = None
            out[f"breaker_{s}_in_zone"] = float(bool(z) and z.overlaps(bar))
            if z:
                out[f"breaker_{s}_age"] = float(self.now - z.born)
                if valid(bar.atr):
                    out[f"breaker_{s}_dist"] = (bar.close - z.mid) * (1 if bull else -1) / bar.atr
        self.past.append(bar)
        return out


class Supertrend:
    """Bands around the middle that only tighten while the close stays on their side; the trend flips when a close crosses the band before it."""

    def __init__(self, width: float = 2.5):
        self.width, self.upper, self.lower, self.trend, self.before = width, NAN, NAN, 1, NAN

    def outputs(self) -> list[str]:
        return ["supertrend", "supertrend_dir", "supertrend_flip"]

    def step(self, bar) -> dict:  # noqa: ANN001
        if not valid(bar.atr):
            self.before = bar.close
            return dict.fromkeys(self.outputs(), NAN)
        mid, reach = (bar.high + bar.low) / 2, self.width * bar.atr
        up, low = mid + reach, mid - reach
        if self.upper == self.upper:
            up = up if up < self.upper or self.before > self.upper else self.upper
            low = low if low > self.lower or self.before < self.lower else self.lower
            trend = 1 if bar.close > self.upper else -1 if bar.close < self.lower else self.trend
        else:
            trend = 1 if bar.close >= mid else -1
        flip = float(trend != self.trend and self.upper == self.upper)
        self.upper, self.lower, self.trend, self.before = up, low, trend, bar.close
        return {"supertrend": low if trend > 0 else up, "supertrend_dir": float(trend), "supertrend_flip": flip}


def tracked_gaps(df: DataFrame) -> DataFrame:
    return run(df, TrackedGaps)


def liquidity_levels(df: DataFrame) -> DataFrame:
    return run(df, Liquidity)


def delivery_change(df: DataFrame) -> DataFrame:
    return run(df, DeliveryChange)


def breakers(df: DataFrame) -> DataFrame:
    return run(df, Breakers)


def supertrend(df: DataFrame) -> DataFrame:
    return run(df, Supertrend)
