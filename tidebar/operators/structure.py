"""Market structure that windows can express: displacement, swings, order blocks, gaps, ranges, shifts.

All of it is causal: a value at a bar depends on that bar and earlier ones (a swing is published where it is confirmed, `n` bars after the pivot).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators import rolling as R
from tidebar.operators.bars import in_order, rows

KEYS = ("series_id", "ts", "bar_idx")


def lag(x: str, n: int = 1) -> Column:
    return F.lag(x, n).over(in_order())


def latch(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(rows(None, 0))


def with_atr(df: DataFrame, n: int = 14) -> DataFrame:
    from tidebar.operators.indicators import true_range

    return df.withColumn("tr", true_range()).withColumn("atr", R.rolling(F.avg, "tr", n)).drop("tr")


def displacement(df: DataFrame, k: float = 1.5, close_share: float = 0.75, cap: int = 48, multi_k: float = 2.0) -> DataFrame:
    """Bars (or three of one colour) whose body is large against the ATR and that close near their end; properties last for `cap` bars."""
    spread = F.greatest(F.col("high") - F.col("low"), F.lit(1e-9))
    ok = F.coalesce(F.col("atr") > 0, F.lit(False))
    body = F.abs(F.col("close") - F.col("open")) / F.col("atr")
    place = (F.col("close") - F.col("low")) / spread
    three = F.abs(F.col("close") - lag("open", 2)) / F.col("atr")
    out = df
    for side, sign in (("bull", 1), ("bear", -1)):
        same = lambda n: F.coalesce(((F.col("close") - F.col("open")) if n == 0 else (lag("close", n) - lag("open", n))) * sign > 0, F.lit(False))  # noqa: B023, E731
        single = ok & same(0) & (body >= k) & ((place >= close_share) if sign > 0 else (place <= 1 - close_share))
        multi = ok & same(0) & same(1) & same(2) & F.coalesce(three >= multi_k, F.lit(False))
        gap = F.coalesce((F.col("low") > lag("high", 2)) if sign > 0 else (F.col("high") < lag("low", 2)), F.lit(False))
        out = out.withColumns({"__fire": single | multi, "__p": F.struct(F.when(single, body).otherwise(three).alias("strength"), place.alias("close_loc"), (spread / F.col("atr")).alias("range_atr"), gap.cast("int").alias("has_fvg"), (~single).cast("int").alias("is_multi"))})
        age = R.bars_since(F.col("__fire"))
        out = out.withColumns({"__age": age, "__held": latch(F.when(F.col("__fire"), F.col("__p")))})
        fresh = F.col("__age") <= cap
        name = f"disp_{side}"
        out = out.withColumns({name: F.col("__fire").cast("int"), f"{name}_age": F.when(fresh, F.col("__age")), **{f"{name}_{p}": F.when(fresh, F.col(f"__held.{p}")) for p in ("strength", "close_loc", "range_atr", "has_fvg", "is_multi")}})
    return out.drop("__fire", "__p", "__age", "__held")


def swings(df: DataFrame, n: int = 3, prefix: str = "") -> DataFrame:
    """Pivots over n bars on both sides, the last confirmed levels, breaks of structure and changes of character on closes, wick breaks, trend."""
    frame = rows(-2 * n, 0)
    there = F.col("bar_idx") >= 2 * n
    high, low = lag("high", n), lag("low", n)
    out = df.withColumns({"__sh": F.when(there & (high >= F.max("high").over(frame)), high), "__sl": F.when(there & (low <= F.min("low").over(frame)), low)})
    out = out.withColumns({"__h": latch(F.col("__sh")), "__l": latch(F.col("__sl"))})
    broke = F.when(F.col("close") > F.col("__h"), 1).when(F.col("close") < F.col("__l"), -1).otherwise(0)
    out = out.withColumn("__b", broke)
    out = out.withColumn("__t", F.coalesce(latch(F.nullif(F.col("__b"), F.lit(0))), F.lit(0)))
    before = F.coalesce(lag("__t"), F.lit(0))
    out = out.withColumns(
        {
            f"{prefix}swing_high": F.col("__sh").isNotNull().cast("int"), f"{prefix}swing_low": F.col("__sl").isNotNull().cast("int"), f"{prefix}last_high": F.col("__h"), f"{prefix}last_low": F.col("__l"), f"{prefix}trend": F.col("__t"),
            f"{prefix}bos": F.when((F.col("__b") != 0) & (F.col("__b") == before), F.col("__b")).otherwise(0), f"{prefix}choch": F.when((F.col("__b") != 0) & (F.col("__b") == -before), F.col("__b")).otherwise(0),
            f"{prefix}bos_wick": F.when(F.col("low") < F.col("__l"), -1).when(F.col("high") > F.col("__h"), 1).otherwise(0),
        }
    )
    return out.drop("__sh", "__sl", "__h", "__l", "__b", "__t")


def order_blocks(df: DataFrame, lookback: int = 200) -> DataFrame:
    """At a break, the last candle of the other colour within `lookback`; a break without one ends the block before it."""
    out = df
    for side, sign in (("bull", 1), ("bear", -1)):
        other = (F.col("open") - F.col("close")) * sign > 0
        found = F.last(F.when(other, F.struct(F.greatest("open", "close").alias("top"), F.least("open", "close").alias("bot"))), ignorenulls=True).over(rows(-lookback, -1))
        event = F.when(F.col("bos") == sign, F.struct(F.col("bar_idx").alias("at"), found.alias("zone")))
        out = out.withColumn("__e", event).withColumn("__e", latch(F.col("__e")))
        zone, name = F.col("__e.zone"), f"ob_{side}"
        top, bot = F.col("__e.zone.top"), F.col("__e.zone.bot")
        out = out.withColumns({f"{name}_top": top, f"{name}_bot": bot, f"{name}_mid": (top + bot) / 2, f"{name}_age": F.when(zone.isNotNull(), F.col("bar_idx") - F.col("__e.at")), f"{name}_in_zone": F.coalesce((F.col("low") <= top) & (F.col("high") >= bot), F.lit(False)).cast("int")})
    return out.drop("__e")


def ob_quality(df: DataFrame, lookback: int = 200) -> DataFrame:
    """1 / (age + 1) times body over ATR times relative volume of the block's candle, fixed when the block forms."""
    rel = F.col("volume") / R.rolling(F.avg, "volume", 20, 1)
    out = df.withColumn("__q", F.abs(F.col("close") - F.col("open")) / F.nullif(F.col("atr"), F.lit(0.0)) * rel)
    for side, sign in (("bull", 1), ("bear", -1)):
        other = (F.col("open") - F.col("close")) * sign > 0
        found = F.last(F.when(other, F.col("__q")), ignorenulls=True).over(rows(-lookback, -1))
        out = out.withColumn("__e", F.when(F.col("bos") == sign, F.struct(F.col("bar_idx").alias("at"), found.alias("q")))).withColumn("__e", latch(F.col("__e")))
        out = out.withColumn(f"ob_{side}_quality", F.col("__e.q") / (F.col("bar_idx") - F.col("__e.at") + 1))
    return out.drop("__q", "__e")


def gaps(df: DataFrame, side: str = "bull", cap: int = 100, least_atr: float = 0.5) -> DataFrame:
    """Fair value gaps as intervals of bars: born where three bars leave a gap, dead at the first later close through the near edge or after `cap` bars.

    Each gap becomes rows for the bars that it lives on (`cap` at most), with what they need of these bars. They meet the bars' own rows in one aggregate by
    bar: no state is carried from bar to bar, and nothing is joined.
    """
    bull = side == "bull"
    top, bot = (F.col("low"), lag("high", 2)) if bull else (lag("low", 2), F.col("high"))
    base = df.withColumns({"__top": top, "__bot": bot, "__now": R.ahead(["high", "low", "close"], cap - 1, 0)})
    born = F.coalesce(F.col("__top") - F.col("__bot") > F.coalesce(F.col("atr") * least_atr, F.lit(0.0)), F.lit(False))
    dies = R.first_true(F.slice("__now", 2, cap), (lambda s: s["close"] <= F.col("__top")) if bull else (lambda s: s["close"] >= F.col("__bot")))
    base = base.withColumn("__ages", F.when(born, F.coalesce(dies, F.size("__now").cast("long"))).otherwise(0))

    def living(s: Column, age: Column) -> Column:
        near = F.least(F.abs(F.col("__top") - s["close"]), F.abs(F.col("__bot") - s["close"]))
        inside = (s["low"] <= F.col("__top")) & (s["high"] >= F.col("__bot"))
        return F.struct((F.col("bar_idx") + age).alias("at"), F.struct(near.alias("near"), F.col("bar_idx").alias("birth"), F.col("__top").alias("top"), F.col("__bot").alias("bot"), inside.cast("int").alias("inside")).alias("gap"))

    gaps_of = F.transform(F.slice("__now", F.lit(1), F.col("__ages").cast("int")), living)
    nothing = F.struct(F.col("bar_idx").alias("at"), F.lit(None).cast("struct<near: double, birth: bigint, top: double, bot: double, inside: int>").alias("gap"))
    dealt = base.withColumn("__each", F.explode(F.concat(F.array(nothing), gaps_of)))
    own = F.when(F.col("__each.gap").isNull(), F.struct(*df.columns))
    met = dealt.select("series_id", F.col("__each.at").alias("__at"), own.alias("__own"), F.col("__each.gap").alias("__gap")).groupBy("series_id", "__at")
    name, gap = f"fvg_{side}", F.col("__gap")
    near = F.when(gap.isNotNull(), F.struct("__gap.near", "__gap.birth"))
    summed = met.agg(
        F.first("__own", ignorenulls=True).alias("__own"), F.count("__gap").alias(f"{name}_count"), (F.col("__at") - F.max("__gap.birth") + 1).alias(f"{name}_age"), F.min_by("__gap.top", near).alias(f"{name}_near_top"),
        F.min_by("__gap.bot", near).alias(f"{name}_near_bot"), F.coalesce(F.max("__gap.inside"), F.lit(0)).alias(f"{name}_in_zone"),
    )
    return summed.filter(F.col("__own").isNotNull()).select("__own.*", *(f"{name}_{c}" for c in ("count", "age", "near_top", "near_bot", "in_zone")))


def ranges(df: DataFrame) -> DataFrame:
    """Place in the last swing range (premium, discount), the retracement band and the distance to its middle."""
    span = F.nullif(F.col("last_high") - F.col("last_low"), F.lit(0.0))
    place = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("close") - F.col("last_low")) / span))
    back = (F.col("last_high") - F.col("close")) / span
    return df.withColumns({"range_place": place, "premium": F.coalesce(place > 0.5, F.lit(False)).cast("int"), "discount": F.coalesce(place < 0.5, F.lit(False)).cast("int"), "ote": F.coalesce((back >= 0.618) & (back <= 0.786), F.lit(False)).cast("int"), "ote_distance": F.abs(back - 0.705), "ote_near": F.coalesce(F.abs(back - 0.705) < 0.05, F.lit(False)).cast("int")})


def shifts(df: DataFrame, near: int = 3, age_cap: int = 24) -> DataFrame:
    """A change of character with a displacement on this bar or shortly before, and its age."""
    out = df
    for side, sign in (("bull", 1), ("bear", -1)):
        fire = (F.col("choch") == sign) & R.within(F.col(f"disp_{side}") == 1, near)
        out = out.withColumn(f"mss_{side}", fire.cast("int"))
        age = R.bars_since(F.col(f"mss_{side}") == 1)
        out = out.withColumn(f"mss_{side}_age", F.when(age <= age_cap, age))
    return out


def sweep_sequences(df: DataFrame, k: int = 6, n: int = 12) -> DataFrame:
    """A new gap now, a displacement within k bars and a sweep of the other side within n; and bars since it."""
    out = df
    for side, swept in (("bull", "ssl"), ("bear", "bsl")):
        more = F.coalesce(F.col(f"fvg_{side}_count") > lag(f"fvg_{side}_count"), F.lit(False))
        fire = more & R.within(F.col(f"disp_{side}") == 1, k) & R.within(F.col(f"sweep_{swept}") == 1, n)
        out = out.withColumn(f"sequence_{side}", fire.cast("int"))
        out = out.withColumn(f"sequence_{side}_age", R.bars_since(F.col(f"sequence_{side}") == 1))
    return out


def gap_events(df: DataFrame, horizon: int = 48) -> DataFrame:
    """A record for each gap of either direction, with its fill within the horizon and the best excursion before it."""
    parts = []
    for side, sign in (("bull", 1), ("bear", -1)):
        top, bot = (F.col("low"), lag("high", 2)) if sign > 0 else (lag("low", 2), F.col("high"))
        base = df.withColumns({"gap_top": top, "gap_bottom": bot, "__a": R.ahead(["high", "low"], horizon)}).filter(F.col("gap_top") > F.col("gap_bottom"))
        filled = R.first_true(F.col("__a"), (lambda s: s["low"] <= F.col("gap_bottom")) if sign > 0 else (lambda s: s["high"] >= F.col("gap_top")))
        until = F.slice("__a", F.lit(1), F.coalesce(filled, F.size("__a")).cast("int"))
        best = F.array_max(F.transform(until, lambda s: (s["high"] - F.col("close")) if sign > 0 else (F.col("close") - s["low"])))  # noqa: B023
        parts.append(base.select("series_id", F.col("ts").alias("confirmed_at"), F.lit(side).alias("direction"), "gap_top", "gap_bottom", (F.col("gap_top") - F.col("gap_bottom")).alias("gap_size"), F.col("close").alias("close_price"), filled.alias("bars_to_fill"), F.greatest(F.lit(0.0), best).alias("best_before_fill")))
    return parts[0].union(parts[1])


def power_of_three(df: DataFrame) -> DataFrame:
    """Asia's range of the day before London, London's one-sided sweep as a bias, and whether closes beyond the middle confirm it. Needs `session`."""
    day = F.to_date(F.col("ts") + F.expr("INTERVAL 4 HOURS"))  # Asia begins at 20:00 New York time, which is another date's first session
    out = df.withColumn("__day", day)
    w = Window.partitionBy("series_id", "__day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    asia = lambda f, x: f(F.when(F.col("session") == "asia", F.col(x))).over(w)
    out = out.withColumns({"asia_high": asia(F.max, "high"), "asia_low": asia(F.min, "low")})
    over = F.max(F.when((F.col("session") == "london") & (F.col("high") > F.col("asia_high")), 1)).over(w)
    under = F.max(F.when((F.col("session") == "london") & (F.col("low") < F.col("asia_low")), 1)).over(w)
    out = out.withColumn("po3_bias", F.when(under.isNotNull() & over.isNull(), 1).when(over.isNotNull() & under.isNull(), -1).otherwise(0))
    middle = (F.col("asia_high") + F.col("asia_low")) / 2
    return out.withColumn("po3_confirmed", F.coalesce((F.col("po3_bias") != 0) & (F.signum(F.col("close") - middle) == F.col("po3_bias")), F.lit(False)).cast("int")).drop("__day")
