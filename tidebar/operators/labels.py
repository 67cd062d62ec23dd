"""Forward-looking labels over bars with `atr`. What lies ahead is one array for the longest horizon; shorter horizons are slices of it."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions import quotient
from tidebar.operators import rolling as R
from tidebar.operators.bars import in_order, rows


def name_of(direction: str, r: int, horizon: int) -> str:
    return f"label_{direction}_hit_{r}r_{horizon}c"


def parse_name(label: str) -> tuple[str, int, int]:
    _, direction, _, r, horizon = label.split("_")
    return direction, int(r.rstrip("r")), int(horizon.rstrip("c"))


def aligned(label: str, embargo: int) -> bool:
    """Whether the embargo is the label's horizon; if not, that is said, and nothing is raised."""
    ok = parse_name(label)[2] == embargo
    if not ok:
        warnings.warn(f"embargo {embargo} isn't the horizon of {label}", stacklevel=2)
    return ok


def parsed(df: DataFrame, label: str, embargo: int) -> DataFrame:
    """df with what a column of labels' names says: direction, ratio, horizon, and whether the embargo is the horizon; null where it is no label's name."""
    part = lambda k: F.nullif(F.regexp_extract(label, r"^label_(long|short)_hit_([0-9]+)r_([0-9]+)c$", k), F.lit(""))
    out = df.withColumns({"direction": part(1), "ratio": part(2).cast("int"), "horizon": part(3).cast("int")})
    return out.withColumn("aligned", F.col("horizon") == embargo)


def forward_returns(df: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Per horizon: return to the close h bars on, best and worst excursion in per cent; null in the last h bars."""
    out = {}
    for h in horizons:
        there = F.lead("close", h).over(in_order())
        span = rows(1, h)
        out[f"fwd_return_{h}"] = (quotient(there, F.col("close")) - 1) * 100
        out[f"max_up_{h}"] = F.when(there.isNotNull(), (quotient(F.max("high").over(span), F.col("close")) - 1) * 100)
        out[f"max_down_{h}"] = F.when(there.isNotNull(), (quotient(F.min("low").over(span), F.col("close")) - 1) * 100)
    return df.withColumns(out)


def _touch(ahead: Column, direction: str, target: Column, stop: Column) -> tuple[Column, Column]:
    """Places of the first touch of target and stop."""
    up = direction == "long"
    hit = R.first_true(ahead, lambda s: (s["high"] >= target) if up else (s["low"] <= target))
    lost = R.first_true(ahead, lambda s: (s["low"] <= stop) if up else (s["high"] >= stop))
    return hit, lost


def triple_barrier(df: DataFrame, horizons: tuple[int, ...] = (12, 24, 48), ratios: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """1 if the target of r ATR is touched before the stop of 1 ATR; ties and neither are 0; null without an ATR or without a full horizon.

    First touches are looked for once, over the longest horizon: one stop for each direction, one target for each direction and ratio. A horizon only
    compares places."""
    base = df.withColumn("__ahead", R.ahead(["high", "low"], max(horizons)))
    sides = (("long", 1), ("short", -1))
    places = {"__size": F.size("__ahead")}
    for direction, sign in sides:
        for r in ratios:
            hit, lost = _touch(F.col("__ahead"), direction, F.col("close") + sign * r * F.col("atr"), F.col("close") - sign * F.col("atr"))
            places |= {f"__hit_{direction}_{r}": hit, f"__lost_{direction}": lost}
    base = base.withColumns(places).drop("__ahead")
    out = {}
    for h in horizons:
        whole = (F.col("__size") >= h) & (F.col("atr") > 0)
        for direction, _ in sides:
            for r in ratios:
                hit, lost = F.col(f"__hit_{direction}_{r}"), F.col(f"__lost_{direction}")
                out[name_of(direction, r, h)] = F.when(whole, F.coalesce((hit <= h) & (lost.isNull() | (hit < lost)), F.lit(False)).cast("int"))
    return base.withColumns(out).drop(*places)


def dynamic(df: DataFrame, direction: str = "long", r: float = 2.0, stop: str = "atr", multiple: float = 1.5, horizon: int = 48, delay: int = 0, pct: float = 0.01, out: str = "label") -> DataFrame:
    """A label with its own stop: atr (times `multiple`), swing_low, swing_high or fixed_pct, entered `delay` bars on at that bar's close (where an ATR
    stop is anchored too). Null where the stop is missing or on the wrong side, or the horizon isn't whole."""
    sign = 1 if direction == "long" else -1
    entry = F.lead("close", delay).over(in_order()) if delay else F.col("close")
    level = {"atr": entry - sign * multiple * F.col("atr"), "fixed_pct": entry * (1 - sign * pct), "swing_low": F.col("last_low") if "last_low" in df.columns else None, "swing_high": F.col("last_high") if "last_high" in df.columns else None}[stop]
    base = df.withColumns({"__entry": entry, "__stop": level, "__ahead": R.ahead(["high", "low"], delay + horizon, delay + 1)})
    risk = (F.col("__entry") - F.col("__stop")) * sign
    hit, lost = _touch(F.col("__ahead"), direction, F.col("__entry") + sign * r * risk, F.col("__stop"))
    won = hit.isNotNull() & (lost.isNull() | (hit < lost))
    return base.withColumn(out, F.when((risk > 0) & (F.size("__ahead") >= horizon), won.cast("int"))).drop("__entry", "__stop", "__ahead")


def fills(df: DataFrame, price: Column, timeout: int, direction: str = "long") -> DataFrame:
    """Bars until a limit order is filled, the signal's own bar included; null if it isn't within the timeout or has no price."""
    base = df.withColumns({"limit_price": price, "__now": R.ahead(["high", "low"], timeout, 0)})
    place = R.first_true(F.col("__now"), (lambda s: s["low"] <= F.col("limit_price")) if direction == "long" else (lambda s: s["high"] >= F.col("limit_price")))
    return base.withColumn("bars_to_fill", F.when(F.col("limit_price").isNotNull(), place - 1)).drop("__now")


def limit_labels(df: DataFrame, timeout: int, horizon: int, r: float = 2.0, direction: str = "long", out: str = "limit_label") -> DataFrame:
    """After fills(): the barriers are scanned from the bar after the fill; no fill is null, a tail that is cut off counts as no win."""
    sign = 1 if direction == "long" else -1
    base = df.withColumn("__all", R.ahead(["high", "low"], timeout + horizon))
    after = F.slice("__all", (F.col("bars_to_fill") + 1).cast("int"), F.lit(horizon))
    hit, lost = _touch(after, direction, F.col("limit_price") + sign * r * F.col("atr"), F.col("limit_price") - sign * F.col("atr"))
    won = hit.isNotNull() & (lost.isNull() | (hit < lost))
    return base.withColumn(out, F.when(F.col("bars_to_fill").isNotNull() & (F.col("atr") > 0), won.cast("int"))).drop("__all")


def outcomes(df: DataFrame, horizon: int, r: float = 2.0, direction: str = "long") -> DataFrame:
    """target, stop or expired (the stop is looked at first on a bar that touches both), bars held, and an expired trade's result in ATR."""
    sign = 1 if direction == "long" else -1
    base = df.withColumns({"__ahead": R.ahead(["high", "low", "close"], horizon)})
    hit, lost = _touch(F.col("__ahead"), direction, F.col("close") + sign * r * F.col("atr"), F.col("close") - sign * F.col("atr"))
    base = base.withColumns({"__hit": hit, "__lost": lost})
    kind = F.when(F.col("__lost").isNotNull() & (F.col("__hit").isNull() | (F.col("__lost") <= F.col("__hit"))), "stop").when(F.col("__hit").isNotNull(), "target").otherwise("expired")
    held = F.coalesce(F.least("__hit", "__lost"), F.size("__ahead").cast("long"))
    last = F.element_at("__ahead", -1)["close"]
    ok = (F.col("atr") > 0) & (F.size("__ahead") > 0)
    return base.withColumns({"outcome": F.when(ok, kind), "held": F.when(ok, held), "expired_atr": F.when(ok & (kind == "expired"), (last - F.col("close")) * sign / F.col("atr"))}).drop("__ahead", "__hit", "__lost")


def block_mean(df: DataFrame, x: str, size: int, out: str) -> DataFrame:
    """The mean of a block of `size` rows, given to all rows of that block; it looks ahead inside the block and is there for comparison only."""
    keyed = df.withColumn("__block", F.floor(F.col("bar_idx") / size))
    means = keyed.groupBy("series_id", "__block").agg(F.avg(x).alias(out))
    return keyed.join(means, ["series_id", "__block"]).drop("__block")
