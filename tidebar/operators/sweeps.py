"""Sweeps of clustered swing levels, without a pass over the series.

Levels of the last bars (this one left out) that lie near one another form chains; the mean of a chain of at least two is liquidity. A wick through the
nearest one beyond the close starts a wait: a close back inside within m bars confirms the sweep, else the wait ends; meanwhile no other wait starts. How
long a wait lasts follows from the bars right after it, so only which breaches start one depends on order. A breach that comes m + 1 bars or more after
the last breach surely starts one: the breaches between two such places are an island, and islands are folded each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.bars import in_order, rows

TOLERANCE, LOOKBACK, WAIT, VALID = 0.10, 50, 2, 6
SIDES = (("bsl", 1, "swing_high", "last_high", "high"), ("ssl", -1, "swing_low", "last_low", "low"))


def nearest_cluster(levels: Column, near: Column, close: Column, sign: int) -> Column:
    """The mean of the nearest chain beyond the close, from sorted levels: a level belongs to the chain of the one before it if they are near."""
    better = lambda a: F.when((a["n"] >= 2) & ((a["sum"] / a["n"] - close) * sign > 0) & (a["best"].isNull() | ((a["sum"] / a["n"] - close) * sign < (a["best"] - close) * sign)), a["sum"] / a["n"]).otherwise(a["best"])
    kind = "struct<sum: double, n: int, last: double, best: double>"
    none = F.lit(None).cast("double")

    def step(a: Column, p: Column) -> Column:
        joins = a["last"].isNotNull() & (p - a["last"] <= near)
        on = F.struct((a["sum"] + p).alias("sum"), (a["n"] + 1).alias("n"), p.alias("last"), a["best"].alias("best"))
        return F.when(joins, on).otherwise(F.struct(p.alias("sum"), F.lit(1).alias("n"), p.alias("last"), better(a).alias("best"))).cast(kind)

    return F.aggregate(levels, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), none.alias("last"), none.alias("best")).cast(kind), step, better)


def sweeps(df: DataFrame, tolerance: float = TOLERANCE, lookback: int = LOOKBACK, m: int = WAIT, validity: int = VALID) -> DataFrame:
    """(series_id, ts, bar_idx) with, for liquidity above (bsl) and below (ssl): whether a sweep is confirmed, bars since the last one (as long as it is
    valid), how deep the confirmed breach was in ATR, and the distance of the nearest liquidity in ATR. From bars with `atr` and swings."""
    valid = F.coalesce(F.col("atr") > 0, F.lit(False))
    near = tolerance * F.when(valid, F.col("atr")).otherwise(1e-9)
    close = F.col("close")
    x = df
    for s, sign, flag, level, tip in SIDES:
        seen = F.array_sort(F.collect_list(F.when(F.col(flag) != 0, F.col(level))).over(rows(-lookback, -1)))
        x = x.withColumn(f"__{s}_levels", seen)
        x = x.withColumn(f"__{s}", nearest_cluster(F.col(f"__{s}_levels"), near, close, sign))
        back = [((F.col(f"__{s}") - F.lead("close", k).over(in_order())) * sign > 0, k) for k in range(1, m + 1)]
        confirmed = F.coalesce(*(F.when(c, F.lit(k)) for c, k in back))
        breach = (F.col(tip) - F.col(f"__{s}")) * sign > 0
        x = x.withColumns({f"unswept_{s}_atr": F.when(valid, F.abs(F.col(f"__{s}") - close) / F.col("atr")), f"__{s}_wait": F.when(breach, F.struct("bar_idx", confirmed.alias("confirmed"), F.when(valid, F.abs(F.col(tip) - F.col(f"__{s}")) / F.col("atr")).otherwise(0.0).alias("depth")))})
    out = x.select("series_id", "ts", "bar_idx", *(f"unswept_{s}_atr" for s, *_ in SIDES))
    each = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"__{s}_wait").alias("w")) for s, *_ in SIDES))
    breaches = x.select("series_id", F.inline(each)).filter("w IS NOT NULL").select("series_id", "side", "w.bar_idx", "w")
    own = Window.partitionBy("series_id", "side").orderBy("bar_idx")
    free = F.coalesce(F.col("bar_idx") - F.lag("bar_idx").over(own) > m, F.lit(True))
    islands = breaches.withColumn("__new", free.cast("int")).withColumn("island", F.sum("__new").over(own)).groupBy("series_id", "side", "island").agg(F.array_sort(F.collect_list("w")).alias("ws"))

    def fold(a: Column, w: Column) -> Column:
        starts = w["bar_idx"] >= a["free"]
        return F.when(starts, F.struct((w["bar_idx"] + F.coalesce(w["confirmed"], F.lit(m + 1))).cast("long").alias("free"), F.concat(a["taken"], F.array(w)).alias("taken"))).otherwise(a)

    taken = islands.select("series_id", "side", "ws", F.array_except("ws", "ws").alias("none"))
    taken = taken.select("series_id", "side", F.explode(F.aggregate("ws", F.struct(F.lit(-1).cast("long").alias("free"), F.col("none").alias("taken")), fold)["taken"]).alias("w")).filter("w.confirmed IS NOT NULL")
    fired = taken.groupBy("series_id", (F.col("w.bar_idx") + F.col("w.confirmed")).alias("bar_idx")).agg(*(F.max(F.when(F.col("side") == s, F.col("w.depth"))).alias(f"sweep_{s}_pen_atr") for s, *_ in SIDES))
    out = out.join(fired, ["series_id", "bar_idx"], "left")
    for s, *_ in SIDES:
        hit = F.col(f"sweep_{s}_pen_atr").isNotNull()
        last = F.max(F.when(hit, F.col("bar_idx"))).over(rows(-validity, 0))
        out = out.withColumns({f"sweep_{s}_fired": hit.cast("double"), f"sweep_{s}_age": (F.col("bar_idx") - last).cast("double")})
    return out.select("series_id", "ts", "bar_idx", *(c for s, *_ in SIDES for c in (f"sweep_{s}_fired", f"sweep_{s}_age", f"sweep_{s}_pen_atr", f"unswept_{s}_atr")))


def sql(with_swings: str) -> str:
    return with_sql(with_swings) + " SELECT * FROM bsl_o JOIN ssl_o USING (series_id, ts, bar_idx)"


def with_sql(with_swings: str) -> str:
    """The same for DuckDB, over a common table expression `x` of bars with atr and swings, as tables bsl_o and ssl_o; the waits are a recursion over
    breaches."""
    w, parts = "PARTITION BY series_id ORDER BY ts", []
    for s, sign, flag, level, tip in SIDES:
        back = " ".join(f"WHEN (near - lead(close, {k}) OVER ({w})) * {sign} > 0 THEN {k}" for k in range(1, WAIT + 1))
        parts.append(f"""{s}_l AS (SELECT *, list(CASE WHEN {flag} <> 0 THEN {level} END) OVER ({w} ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING) AS lv FROM x), {s}_p AS (SELECT series_id, bar_idx, close, atr, unnest(list_filter(lv, lambda v: v IS NOT NULL)) AS p FROM {s}_l),
{s}_c AS (SELECT *, CASE WHEN p - lag(p) OVER c > {TOLERANCE} * CASE WHEN atr > 0 THEN atr ELSE 1e-9 END THEN 1 ELSE 0 END AS cut, row_number() OVER c AS i FROM {s}_p WINDOW c AS (PARTITION BY series_id, bar_idx ORDER BY p)), {s}_g AS (SELECT *, sum(cut) OVER (PARTITION BY series_id, bar_idx ORDER BY i) AS chain FROM {s}_c),
{s}_m AS (SELECT series_id, bar_idx, close, sum(p) / count(*) AS mean FROM {s}_g GROUP BY series_id, bar_idx, close, chain HAVING count(*) >= 2), {s}_n AS (SELECT series_id, bar_idx, arg_min(mean, (mean - close) * {sign}) AS near FROM {s}_m WHERE (mean - close) * {sign} > 0 GROUP BY 1, 2),
{s}_b AS (SELECT x.series_id, x.ts, x.bar_idx, high, low, close, atr, near FROM x LEFT JOIN {s}_n USING (series_id, bar_idx)), {s}_w AS (SELECT *, CASE {back} END AS confirmed, coalesce(({tip} - near) * {sign} > 0, false) AS breach, CASE WHEN atr > 0 THEN abs({tip} - near) / atr ELSE 0 END AS depth FROM {s}_b),
{s}_r AS (SELECT *, bar_idx + coalesce(confirmed, {WAIT + 1}) AS free FROM {s}_w WHERE breach), {s}_x AS (SELECT r.*, (SELECT min(q.bar_idx) FROM {s}_r q WHERE q.series_id = r.series_id AND q.bar_idx >= r.free) AS nxt FROM {s}_r r),
{s}_t AS (SELECT series_id, min(bar_idx) AS bar_idx FROM {s}_r GROUP BY 1 UNION ALL SELECT n.series_id, n.nxt FROM {s}_t t JOIN {s}_x n USING (series_id, bar_idx) WHERE n.nxt IS NOT NULL), {s}_f AS (SELECT series_id, bar_idx + confirmed AS bar_idx, depth FROM {s}_t JOIN {s}_r USING (series_id, bar_idx) WHERE confirmed IS NOT NULL),
{s}_o AS (SELECT b.series_id, b.ts, b.bar_idx, (f.depth IS NOT NULL)::INTEGER::DOUBLE AS sweep_{s}_fired, (b.bar_idx - max(CASE WHEN f.depth IS NOT NULL THEN b.bar_idx END) OVER (PARTITION BY b.series_id ORDER BY b.ts ROWS {VALID} PRECEDING))::DOUBLE AS sweep_{s}_age, f.depth AS sweep_{s}_pen_atr, CASE WHEN b.atr > 0 THEN abs(b.near - b.close) / b.atr END AS unswept_{s}_atr FROM {s}_b b LEFT JOIN {s}_f f USING (series_id, bar_idx))""")
    return with_swings.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + ", ".join(parts)
