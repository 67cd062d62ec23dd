"""Operators of earlier generations that have no later counterpart. Those that look ahead say so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators import machines as M
from tidebar.operators import rolling as R
from tidebar.operators.bars import in_order, rows


class LevelSweeps:
    """A wick beyond any intact swing level with a close back inside; the level reported is the last one swept. A close beyond a level ends it."""

    def __init__(self) -> None:
        self.highs: list[float] = []
        self.lows: list[float] = []

    def outputs(self) -> list[str]:
        return ["swept_high", "swept_low", "swept_high_level", "swept_low_level", "intact_highs", "intact_lows"]

    def step(self, bar) -> dict:  # noqa: ANN001
        out = dict.fromkeys(self.outputs(), float("nan"))
        high = [p for p in self.highs if bar.high > p > bar.close]
        low = [p for p in self.lows if bar.low < p < bar.close]
        out["swept_high"], out["swept_low"] = float(bool(high)), float(bool(low))
        if high:
            out["swept_high_level"] = high[-1]
        if low:
            out["swept_low_level"] = low[-1]
        self.highs = [p for p in self.highs if bar.high <= p]
        self.lows = [p for p in self.lows if bar.low >= p]
        if bar.swing_high:
            self.highs.append(bar.last_high)
        if bar.swing_low:
            self.lows.append(bar.last_low)
        out["intact_highs"], out["intact_lows"] = float(len(self.highs)), float(len(self.lows))
        return out


class OneShotDelivery:
    """After a swing low, the first close above the open of the last falling candle fires once; and the other way round."""

    def __init__(self) -> None:
        self.level: dict[str, float | None] = {"bull": None, "bear": None}
        self.last: dict[str, float | None] = {"bull": None, "bear": None}

    def outputs(self) -> list[str]:
        return ["legacy_cisd_bull", "legacy_cisd_bear"]

    def step(self, bar) -> dict:  # noqa: ANN001
        if bar.close < bar.open:
            self.last["bull"] = bar.open
        if bar.close > bar.open:
            self.last["bear"] = bar.open
        if bar.swing_low:
            self.level["bull"] = self.last["bull"]
        if bar.swing_high:
            self.level["bear"] = self.last["bear"]
        out = {}
        for s, sign in (("bull", 1), ("bear", -1)):
            fire = self.level[s] is not None and (bar.close - self.level[s]) * sign > 0
            out[f"legacy_cisd_{s}"] = float(fire)
            if fire:
                self.level[s] = None
        return out


def level_sweeps(df: DataFrame) -> DataFrame:
    return M.run(df, LevelSweeps)


def one_shot_delivery(df: DataFrame) -> DataFrame:
    return M.run(df, OneShotDelivery)


def single_gap(df: DataFrame, side: str = "bull") -> DataFrame:
    """The last gap of three bars alone, until a later bar reaches its middle: its edges while it is open, and whether it is. A new gap takes its place."""
    bull = side == "bull"
    before = lambda c: F.lag(c, 2).over(in_order())
    top, bot = (F.col("low"), before("high")) if bull else (before("low"), F.col("high"))
    x = df.withColumns({"__top": top, "__bot": bot})
    x = x.withColumn("__born", F.coalesce(F.col("__top") > F.col("__bot"), F.lit(False)))
    x = x.withColumns({"__track": F.sum(F.col("__born").cast("int")).over(rows(None, 0)), "__t": F.last(F.when(F.col("__born"), F.col("__top")), ignorenulls=True).over(rows(None, 0)), "__b": F.last(F.when(F.col("__born"), F.col("__bot")), ignorenulls=True).over(rows(None, 0))})
    since = Window.partitionBy("series_id", "__track").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    middle = (F.col("__t") + F.col("__b")) / 2
    reached = (F.min(F.when(~F.col("__born"), F.col("low"))).over(since) <= middle) if bull else (F.max(F.when(~F.col("__born"), F.col("high"))).over(since) >= middle)
    x = x.withColumn("__open", F.col("__t").isNotNull() & ~F.coalesce(reached, F.lit(False)))
    name = f"gap_{side}"
    x = x.withColumns({f"{name}_open": F.col("__open").cast("int"), f"{name}_top": F.when(F.col("__open"), F.col("__t")), f"{name}_bot": F.when(F.col("__open"), F.col("__b"))})
    return x.drop("__top", "__bot", "__born", "__track", "__t", "__b", "__open")


def strict_blocks(df: DataFrame, ahead: int = 20) -> DataFrame:
    """The last falling candle before a rise: marked if a break of structure comes within `ahead` bars and no other falling candle lies between. LOOKS AHEAD."""
    down = F.col("close") < F.col("open")
    to_break = F.first(F.when(F.col("bos") == 1, F.col("bar_idx")), ignorenulls=True).over(rows(1, ahead)) - F.col("bar_idx")
    to_down = F.first(F.when(down, F.col("bar_idx")), ignorenulls=True).over(rows(1, ahead)) - F.col("bar_idx")
    marked = down & to_break.isNotNull() & (to_down.isNull() | (to_down >= to_break))
    touched = F.min("low").over(rows(ahead + 1, 3 * ahead)) <= F.col("open")
    return df.withColumns({"strict_ob": F.coalesce(marked, F.lit(False)).cast("int"), "strict_ob_mitigated": F.coalesce(marked & touched, F.lit(False)).cast("int")})


def outcome_sign(horizon: int, up: float, down: float) -> Column:
    """1 if the price first rises by `up` per cent within the horizon, -1 if it first falls by `down`, 0 if neither; a bar that does both counts as -1."""
    a = R.ahead(["high", "low"], horizon)
    hit = R.first_true(a, lambda s: s["high"] >= F.col("close") * (1 + up / 100))
    lost = R.first_true(a, lambda s: s["low"] <= F.col("close") * (1 - down / 100))
    return F.when(lost.isNotNull() & (hit.isNull() | (lost <= hit)), -1).when(hit.isNotNull(), 1).otherwise(0)


def direction(horizon: int) -> Column:
    return F.signum(F.lead("close", horizon).over(in_order()) - F.col("close")).cast("int")
