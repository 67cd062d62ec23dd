"""Order blocks anchored at displacements, as zones that live on intervals of bars.

A break of structure makes a zone: the last displacement in reach (the bar itself included), and before it the last candle of the other colour in reach.
Breaks are few, so zones are a small table. Each meets the bars that it can live on in an equi-join on the bar's number; a running maximum over these bars
says from where on it is tested, and when a bar has closed beyond it. No state is carried from bar to bar, and a long series is spread over its bars.

A close beyond a zone has passed all of it, so the zone was tested by then: it dies at the first such close, or by age. A zone is looked at on the bar that
makes it already. Comparisons with null are false; without a valid ATR, distances and widths are null and count as 0 in the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.bars import rows

# What a displacement is (body in ATR, place of the close), the weights of a zone's score (strength, wait, width; gap, tested), and the scale
# of age in bars.
BODY, CLOSE_PLACE = 1.5, 0.75
WEIGHTS = (0.45, 0.35, 0.20)
WITH_GAP, TESTED, AGE_SCALE = 1.25, 0.85, 200
SHOWN = 3
FIELDS = ("state", "age", "top", "bot", "mid", "width_atr", "in_zone", "penetration", "dist_top_atr", "dist_bot_atr", "strength", "bars_to_bos", "has_fvg")


def _unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def zones(df: DataFrame, disp_search: int = 30, anchor_search: int = 20) -> DataFrame:
    """(series_id, birth, bull, top, bot, strength, wait, gap) of every zone, from bars with `bos` and `atr`."""
    o, h, l, c, atr = (F.col(x) for x in ("open", "high", "low", "close", "atr"))
    place = (c - l) / F.greatest(h - l, F.lit(1e-9))
    out = df
    for side, sign in (("bull", 1), ("bear", -1)):
        ends = place >= CLOSE_PLACE if sign > 0 else place <= 1 - CLOSE_PLACE
        fires = (atr > 0) & ((c - o) * sign > 0) & (F.abs(c - o) >= BODY * atr) & ends
        gap = l > F.lag("high", 2).over(rows_all()) if sign > 0 else h < F.lag("low", 2).over(rows_all())
        zone = F.struct(F.greatest(o, c).alias("top"), l.alias("bot")) if sign > 0 else F.struct(h.alias("top"), F.least(o, c).alias("bot"))
        anchor = F.last(F.when((o - c) * sign > 0, zone), ignorenulls=True).over(rows(1 - anchor_search, -1))
        out = out.withColumn("__d", F.when(fires, F.struct(F.col("bar_idx").alias("at"), (F.abs(c - o) / atr).alias("strength"), F.coalesce(gap, F.lit(False)).alias("gap"), anchor.alias("anchor"))))
        out = out.withColumn(f"__{side}", F.last("__d", ignorenulls=True).over(rows(1 - disp_search, 0)))
    made = F.when(F.col("bos") > 0, F.col("__bull")).when(F.col("bos") < 0, F.col("__bear"))
    found = out.select("series_id", F.col("bar_idx").alias("birth"), (F.col("bos") > 0).alias("bull"), made.alias("d")).filter("d.anchor IS NOT NULL")
    return found.select("series_id", "birth", "bull", "d.anchor.top", "d.anchor.bot", "d.strength", (F.col("birth") - F.col("d.at")).alias("wait"), "d.gap")


def rows_all() -> Window:
    return Window.partitionBy("series_id").orderBy("ts")


def lives(zones_: DataFrame, bars: DataFrame, cap: int = 200, half: float = 0.5) -> DataFrame:
    """A row for each zone and bar that it is alive on: the zone, the bar's prices, its depth, whether the zone is tested by then, and its age."""
    each = zones_.withColumn("bar_idx", F.explode(F.sequence(F.col("birth"), F.col("birth") + cap - 1)))
    x = each.join(bars.select("series_id", "bar_idx", "high", "low", "close", "atr"), ["series_id", "bar_idx"])
    width = F.greatest(F.col("top") - F.col("bot"), F.lit(1e-9))
    depth = F.when(F.col("bull"), _unit((F.col("top") - F.least("low", "top")) / width)).otherwise(_unit((F.greatest("high", "bot") - F.col("bot")) / width))
    beyond = F.when(F.col("bull"), F.col("close") < F.col("bot")).otherwise(F.col("close") > F.col("top"))
    so_far = Window.partitionBy("series_id", "bull", "birth").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("depth", depth).withColumns({"tested": F.max(F.col("depth") >= half).over(so_far), "__gone": F.max(F.coalesce(beyond, F.lit(False))).over(so_far)})
    return x.filter(~F.col("__gone")).withColumn("age", F.col("bar_idx") - F.col("birth") + 1).drop("__gone")


def anchored_blocks(df: DataFrame, disp_search: int = 30, anchor_search: int = 20, cap: int = 200, half: float = 0.5) -> DataFrame:
    """(series_id, ts, bar_idx) with, for each side, the number of zones, the distance of the nearest in ATR, and FIELDS of the best three by score and
    distance, for every bar."""
    valid = F.coalesce(F.col("atr") > 0, F.lit(False))
    by_atr = lambda x: F.when(valid, x / F.col("atr"))
    x = lives(zones(df, disp_search, anchor_search), df, cap, half).withColumn("mid", (F.col("top") + F.col("bot")) / 2)
    x = x.withColumns({"width_atr": by_atr(F.col("top") - F.col("bot")), "far": by_atr(F.abs(F.col("close") - F.col("mid")))})
    parts = (_unit((F.col("strength") - 1) / 2), _unit(1 - F.col("wait") / 12), _unit(F.coalesce("width_atr", F.lit(0.0))))
    score = sum((w * p for w, p in zip(WEIGHTS[1:], parts[1:], strict=True)), WEIGHTS[0] * parts[0])
    score = score * F.when(F.col("gap"), WITH_GAP).otherwise(1.0) * F.when(F.col("tested"), TESTED).otherwise(1.0) * F.exp(-F.col("age") / AGE_SCALE)
    inside = (F.col("low") <= F.col("top")) & (F.col("high") >= F.col("bot"))
    shown = {
        "state": F.when(F.col("tested"), 2.0).otherwise(1.0), "age": F.col("age") / cap, "top": F.col("top"), "bot": F.col("bot"), "mid": F.col("mid"), "width_atr": F.col("width_atr"), "in_zone": inside.cast("double"), "penetration": F.col("depth"),
        "dist_top_atr": by_atr(F.col("top") - F.col("close")), "dist_bot_atr": by_atr(F.col("close") - F.col("bot")), "strength": F.col("strength"), "bars_to_bos": F.col("wait").cast("double"), "has_fvg": F.col("gap").cast("double"),
    }
    ranked = F.struct((-score).alias("by"), F.coalesce("far", F.lit(0.0)).alias("then"), F.col("birth"), *(shown[f].alias(f) for f in FIELDS))
    # a bar has `cap` zones of a side at most
    met = x.groupBy("series_id", "bar_idx").agg(*(a for s, own in (("bull", F.col("bull")), ("bear", ~F.col("bull"))) for a in (F.count_if(own).alias(f"n_{s}"), F.min(F.when(own, F.col("far"))).alias(f"near_{s}"), F.slice(F.array_sort(F.collect_list(F.when(own, ranked))), 1, SHOWN).alias(f"best_{s}"))))
    out = df.select("series_id", "ts", "bar_idx").join(met, ["series_id", "bar_idx"], "left")
    columns = []
    for s in ("bull", "bear"):
        columns += [F.coalesce(F.col(f"n_{s}").cast("double"), F.lit(0.0)).alias(f"ob_{s}_count"), F.col(f"near_{s}").alias(f"ob_{s}_nearest_atr")]
        columns += [F.get(f"best_{s}", F.lit(k))[f].alias(f"ob_{s}_{k + 1}_{f}") for k in range(SHOWN) for f in FIELDS]
    return out.select("series_id", "ts", "bar_idx", *columns)


def sql(with_breaks: str) -> str:
    """The same for DuckDB, over a common table expression `st` of bars with bos and atr."""
    w = "PARTITION BY series_id ORDER BY ts"
    fires = "atr > 0 AND {0} AND abs(close - open) >= {1} * atr AND (close - low) / greatest(high - low, 1e-9) {2}"
    up, down = fires.format("close > open", BODY, f">= {CLOSE_PLACE}"), fires.format("close < open", BODY, f"<= {1 - CLOSE_PLACE}")
    clip = lambda x: f"least(1.0, greatest(0.0, {x}))"
    side = lambda d, cond: f"SELECT series_id, bar_idx AS birth, {cond} > 0 AS bull, {d}.a.top AS top, {d}.a.bot AS bot, {d}.s AS strength, bar_idx - {d}.at AS wait, {d}.g AS gap FROM e WHERE {cond} AND {d}.a IS NOT NULL"
    event = lambda test, gap, a: f"last(CASE WHEN {test} THEN {{'at': bar_idx, 's': abs(close - open) / atr, 'g': coalesce({gap}, false), 'a': {a}}} END IGNORE NULLS) OVER ({w} ROWS 29 PRECEDING)"
    shown = {"state": "CASE WHEN tested THEN 2.0 ELSE 1.0 END", "age": "age / 200", "in_zone": "CASE WHEN low <= top AND high >= bot THEN 1.0 ELSE 0.0 END", "penetration": "depth", "dist_top_atr": "CASE WHEN atr > 0 THEN (top - close) / atr END", "dist_bot_atr": "CASE WHEN atr > 0 THEN (close - bot) / atr END", "bars_to_bos": "wait", "has_fvg": "CASE WHEN gap THEN 1.0 ELSE 0.0 END"}
    columns = ", ".join(c for s, test in (("bull", "bull"), ("bear", "NOT bull")) for c in (f"(count(*) FILTER ({test}))::DOUBLE AS ob_{s}_count", f"min(far) FILTER ({test}) AS ob_{s}_nearest_atr", *(f"(max({shown.get(f, f)}) FILTER ({test} AND k = {k}))::DOUBLE AS ob_{s}_{k}_{f}" for k in range(1, SHOWN + 1) for f in FIELDS)))
    out = ", ".join(f"coalesce(ob_{s}_count, 0.0) AS ob_{s}_count, ob_{s}_nearest_atr, " + ", ".join(f"ob_{s}_{k}_{f}" for k in range(1, SHOWN + 1) for f in FIELDS) for s in ("bull", "bear"))
    return f"""{with_breaks}, g AS (SELECT *, lag(high, 2) OVER ({w}) AS h2, lag(low, 2) OVER ({w}) AS l2, last(CASE WHEN open > close THEN {{'top': open, 'bot': low}} END IGNORE NULLS) OVER f AS au, last(CASE WHEN close > open THEN {{'top': high, 'bot': open}} END IGNORE NULLS) OVER f AS ad FROM st WINDOW f AS ({w} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, {event(up, 'low > h2', 'au')} AS du, {event(down, 'high < l2', 'ad')} AS dd FROM g), z AS ({side('du', 'bos > 0').replace('bos > 0 > 0', 'true')} UNION ALL {side('dd', 'bos < 0').replace('bos < 0 > 0', 'false')}),
l AS (SELECT z.*, b.bar_idx, high, low, close, atr, CASE WHEN bull THEN {clip('(top - least(low, top)) / greatest(top - bot, 1e-9)')} ELSE {clip('(greatest(high, bot) - bot) / greatest(top - bot, 1e-9)')} END AS depth, CASE WHEN bull THEN close < bot ELSE close > top END AS beyond FROM z JOIN st b ON b.series_id = z.series_id AND b.bar_idx >= birth AND b.bar_idx < birth + 200),
a AS (SELECT *, bool_or(depth >= 0.5) OVER o AS tested, bool_or(beyond) OVER o AS gone, (bar_idx - birth + 1)::DOUBLE AS age, (top + bot) / 2 AS mid FROM l WINDOW o AS (PARTITION BY series_id, bull, birth ORDER BY bar_idx)), v AS (SELECT *, CASE WHEN atr > 0 THEN (top - bot) / atr END AS width_atr, CASE WHEN atr > 0 THEN abs(close - mid) / atr END AS far FROM a WHERE NOT gone),
q AS (SELECT *, row_number() OVER (PARTITION BY series_id, bull, bar_idx ORDER BY ({WEIGHTS[0]} * {clip('(strength - 1) / 2')} + {WEIGHTS[1]} * {clip('1 - wait / 12')} + {WEIGHTS[2]} * {clip('coalesce(width_atr, 0)')}) * CASE WHEN gap THEN {WITH_GAP} ELSE 1 END * CASE WHEN tested THEN {TESTED} ELSE 1 END * exp(-age / {AGE_SCALE}) DESC, coalesce(far, 0), birth) AS k FROM v),
m AS (SELECT series_id, bar_idx, {columns} FROM q GROUP BY 1, 2) SELECT st.series_id, st.ts, st.bar_idx, {out} FROM st LEFT JOIN m USING (series_id, bar_idx)"""
