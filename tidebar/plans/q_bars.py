"""Queries: scans, resampling, joins, filters and bar-level aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebar.functions import quotient
from tidebar.operators import bars as B
from tidebar.operators import joins as J
from tidebar.operators import rolling as R
from tidebar.operators.validation import correlation
from tidebar.plans.registry import bars_sql, query
from tidebar.session import scratch
from tidebar.sources import ingest
from tidebar.sources.tables import table

KEYS = ("series_id", "ts")
OHLCV = "open high low close volume taker_buy"


@query("a1_resample", f"WITH {bars_sql()} SELECT * FROM bars", OHLCV)
def _(spark, d):
    """Ticks to 15-minute bars, one series for each event type."""
    return B.bars_of_events(spark, d).select("series_id", "ts", "open", "high", "low", "close", "volume", "trade_count", "taker_buy", "bar_idx")


_COARSE = f"""WITH {bars_sql("5 minutes")} SELECT series_id, time_bucket(INTERVAL '1 hour', ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close,
sum(volume) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count, sum(taker_buy) AS taker_buy, count(*) AS observed, CAST(12 AS BIGINT) AS expected, 12 - count(*) AS missing, count(*) = 12 AS is_complete,
epoch_ms(time_bucket(INTERVAL '1 hour', ts)) AS start_ms, epoch_ms(time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour') AS end_ms FROM bars GROUP BY series_id, time_bucket(INTERVAL '1 hour', ts)"""


@query("a3_coarsen_completeness", _COARSE, OHLCV)
def _(spark, d):
    """5-minute bars to hours, with completeness and bar times in epoch milliseconds (A2, A3, A4)."""
    hours = B.completeness(B.coarsen(B.bars_of_events(spark, d, "5m", numbered=False), "1h"), "1h", "5m")
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return hours.withColumns({"start_ms": ms("ts"), "end_ms": ms("end_ts")}).drop("end_ts")


_BASIS = f"""WITH {bars_sql("1 hour", "'ALL'")}, m AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS ts, last(value ORDER BY ts, event_id) AS mark FROM events WHERE event_type = 'view' GROUP BY 1),
i AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS ts, last(value ORDER BY ts, event_id) AS idx FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT b.ts, close, mark, idx, (mark - idx) / idx AS basis_mark, (close - idx) / idx AS basis_last FROM bars b LEFT JOIN m USING (ts) LEFT JOIN i USING (ts)"""


@query("a5_basis", _BASIS, "close mark idx basis_mark basis_last")
def _(spark, d):
    """Mark and index prices joined onto bars on equal times, and their basis."""
    bars = B.bars_of_events(spark, d, "1h", None, numbered=False)
    side = lambda kind, name: B.bars_of_events(spark, d, "1h", numbered=False).filter(F.col("series_id") == kind).select("ts", F.col("close").alias(name))
    out = bars.join(side("view", "mark"), "ts", "left").join(side("click", "idx"), "ts", "left")
    return out.select("ts", "close", "mark", "idx", ((F.col("mark") - F.col("idx")) / F.col("idx")).alias("basis_mark"), ((F.col("close") - F.col("idx")) / F.col("idx")).alias("basis_last"))


_DELTA = """WITH t AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS ts, sum(CASE WHEN user_id % 2 = 0 THEN value ELSE -value END) AS delta, count(*) AS n FROM events GROUP BY 1)
SELECT ts, delta, n, sum(delta) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts) AS cvd_daily, sum(delta) OVER (PARTITION BY CAST(ts AS DATE), CASE WHEN hour(ts) < 8 THEN 0 WHEN hour(ts) < 13 THEN 1 ELSE 2 END ORDER BY ts) AS cvd_session,
CASE WHEN count(*) OVER w >= 20 AND stddev_samp(delta) OVER w <> 0 THEN (delta - avg(delta) OVER w) / stddev_samp(delta) OVER w END AS z FROM t WINDOW w AS (ORDER BY ts ROWS 19 PRECEDING)"""


@query("a6_tick_delta", _DELTA, "delta cvd_daily cvd_session z")
def _(spark, d):
    """Signed tick volume by 5 minutes with daily and session sums that start anew, and a z-score."""
    e = table(spark, d, "events", "ts", "user_id", "value")
    signed = F.col("value") * F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)
    t = e.groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.sum(signed).alias("delta"), F.count("*").alias("n")).select(F.lit("ALL").alias("series_id"), F.col("w.start").alias("ts"), "delta", "n")
    session = F.when(F.hour("ts") < 8, 0).when(F.hour("ts") < 13, 1).otherwise(2)
    day = F.col("ts").cast("date")
    return t.select("ts", "delta", "n", F.sum("delta").over(Window.partitionBy(day).orderBy("ts")).alias("cvd_daily"), F.sum("delta").over(Window.partitionBy(day, session).orderBy("ts")).alias("cvd_session"), R.zscore("delta", 20).alias("z"))


_ASOF = f"""WITH {bars_sql("5 minutes")}, h AS (SELECT series_id, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS end_ts, last(close ORDER BY ts) AS close, max(high) AS high, min(low) AS low FROM bars GROUP BY 1, 2)
SELECT b.series_id, b.ts, b.close, h.close AS h1_close, h.high AS h1_high, h.low AS h1_low FROM bars b ASOF LEFT JOIN h ON b.series_id = h.series_id AND b.ts >= h.end_ts"""


@query("j1_asof_higher_timeframe", _ASOF, "close h1_close h1_high h1_low")
def _(spark, d):
    """Each 5-minute bar with the last hour that had ended at its start."""
    path = scratch(spark, "bars")
    B.bars_of_events(spark, d, "5m", numbered=False).write.parquet(path)  # made once, read for each side of the join
    base = spark.read.parquet(path)
    hours = B.coarsen(base, "1h")
    out = J.asof_join(base.select("series_id", "ts", "close"), hours, "ts", "end_ts", ["series_id"], ["close", "high", "low"], "h1_", grain="day")
    return out.select("series_id", "ts", "close", "h1_close", "h1_high", "h1_low")


_ASOF_EVENT = f"""WITH {bars_sql("1 hour", "'ALL'")}, f AS (SELECT ts AS at, value AS rate, event_id FROM events WHERE event_type = 'error')
SELECT b.ts, b.close, f.rate, f.event_id FROM bars b ASOF LEFT JOIN f ON b.ts >= f.at"""


@query("j3_asof_events", _ASOF_EVENT, "close rate")
def _(spark, d):
    """Bars with the last funding event before them."""
    f = table(spark, d, "events").filter("event_type = 'error'").select(F.lit("ALL").alias("series_id"), F.col("ts").alias("at"), F.col("value").alias("rate"), "event_id")
    return J.asof_join(B.bars_of_events(spark, d, "1h", None, numbered=False).select("series_id", "ts", "close"), f, "ts", "at", ["series_id"], ["rate", "event_id"], grain="day").drop("series_id")


_RANGE = f"""WITH {bars_sql("1 hour", "'ALL'")}, f AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS ts, sum(value) / 1e4 AS fund_rate_period, count(*) AS fund_events FROM events WHERE event_type = 'error' GROUP BY 1),
j AS (SELECT b.ts, bar_idx, fund_rate_period, coalesce(fund_events, 0) AS fund_events FROM bars b LEFT JOIN f USING (ts))
SELECT ts, fund_rate_period, fund_events, sum(fund_rate_period) OVER (ORDER BY ts ROWS 23 PRECEDING) AS fund_cum_24, CASE WHEN count(fund_rate_period) OVER w >= 10 AND stddev_samp(fund_rate_period) OVER w <> 0 THEN (fund_rate_period - avg(fund_rate_period) OVER w) / stddev_samp(fund_rate_period) OVER w END AS fund_z FROM j WINDOW w AS (ORDER BY ts ROWS 29 PRECEDING)"""


@query("j5_range_aggregate", _RANGE, "fund_rate_period fund_cum_24 fund_z")
def _(spark, d):
    """Funding events summed into the bars that they fall into, with a rolling sum and z-score."""
    f = table(spark, d, "events").filter("event_type = 'error'").select(F.lit("ALL").alias("series_id"), F.col("ts").alias("at"), "value")
    out = J.range_agg_join(B.bars_of_events(spark, d, "1h", None, numbered=False), f, "at", 3600, ["series_id"], {"fund_rate_period": F.sum("value") / 1e4, "fund_events": F.count("*")})
    x = "fund_rate_period"
    return out.select("ts", x, F.coalesce("fund_events", F.lit(0).cast("long")).alias("fund_events"), F.sum(x).over(B.rows(-23, 0)).alias("fund_cum_24"), R.zscore(x, 30, 10).alias("fund_z"))


_LAGGED = """WITH liq AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS liq_long, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS liq_short FROM lineitem GROUP BY 1),
o AS (SELECT o_orderdate AS ts, sum(o_totalprice) AS volume FROM orders GROUP BY 1)
SELECT ts, volume, liq_long, liq_short FROM o LEFT JOIN liq ON CAST(o.ts AS DATE) = liq.day + 1"""


@query("j7_lagged_daily", _LAGGED, "volume liq_long liq_short")
def _(spark, d):
    """Daily liquidations that are seen from the next day on."""
    liq = table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).alias("liq_long"), F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0)).alias("liq_short"))
    o = table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("volume"))
    return J.lagged_daily_join(o, liq, "day", ["liq_long", "liq_short"])


_LIQ = """WITH liq AS (SELECT CAST(l_shipdate AS DATE) AS ts, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS l, coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0) AS s FROM lineitem GROUP BY 1), t AS (SELECT *, l + s AS total FROM liq)
SELECT ts, l, s, total, (l - s) / (total + 1e-9) AS liq_ratio, total > 2 * avg(total) OVER w AS cascade, CASE WHEN count(*) OVER w >= 2 AND stddev_samp(total) OVER w <> 0 THEN (total - avg(total) OVER w) / stddev_samp(total) OVER w END AS z7,
total - lag(total) OVER o AS change, (total - lag(total) OVER o) / nullif(lag(total) OVER o, 0) AS change_pct FROM t WINDOW w AS (ORDER BY ts ROWS 6 PRECEDING), o AS (ORDER BY ts)"""


@query("i27_liquidations", _LIQ, "l s total liq_ratio z7 change change_pct")
def _(spark, d):
    """Daily liquidation measures."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("ts")).agg(F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), F.lit(0.0)).alias("l"), F.coalesce(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))), F.lit(0.0)).alias("s"))
    x = x.withColumn("series_id", F.lit("ALL")).withColumn("total", F.col("l") + F.col("s"))
    before = F.lag("total").over(B.in_order())
    return x.select("ts", "l", "s", "total", ((F.col("l") - F.col("s")) / (F.col("total") + 1e-9)).alias("liq_ratio"), (F.col("total") > 2 * F.avg("total").over(B.rows(-6, 0))).alias("cascade"), R.zscore("total", 7, 2).alias("z7"), (F.col("total") - before).alias("change"), ((F.col("total") - before) / F.nullif(before, F.lit(0.0))).alias("change_pct"))


_LEVELS = f"""WITH {bars_sql("15 minutes")}, p AS (SELECT series_id, CAST(ts AS DATE) AS day, max(high) AS h, min(low) AS l, last(close ORDER BY ts) AS c, first(open ORDER BY ts) AS o FROM bars GROUP BY 1, 2),
q AS (SELECT *, lag(h) OVER w AS pdh, lag(l) OVER w AS pdl, lag(c) OVER w AS pdc FROM p WINDOW w AS (PARTITION BY series_id ORDER BY day)),
wk AS (SELECT series_id, date_trunc('week', ts) AS week, max(high) AS h, min(low) AS l FROM bars GROUP BY 1, 2), wq AS (SELECT *, lag(h) OVER v AS pwh, lag(l) OVER v AS pwl FROM wk WINDOW v AS (PARTITION BY series_id ORDER BY week))
SELECT b.series_id, b.ts, pdh, pdl, pdc, pwh, pwl, close - pdh AS dist_pdh, (close - pdh) / close * 100 AS dist_pdh_pct, q.o - q.pdc AS opening_gap, CASE WHEN q.pdc IS NULL OR q.o <> q.pdc THEN 1 ELSE 0 END AS gap_exists, least(q.o, q.pdc) AS x FROM bars b JOIN q ON b.series_id = q.series_id AND CAST(b.ts AS DATE) = q.day JOIN wq ON b.series_id = wq.series_id AND date_trunc('week', b.ts) = wq.week"""


@query("a7_previous_levels", _LEVELS.replace(", least(q.o, q.pdc) AS x", ""), "pdh pdl pdc pwh pwl dist_pdh dist_pdh_pct opening_gap")
def _(spark, d):
    """Previous day's and week's levels joined back, distances to them and opening gaps."""
    b = B.bars_of_events(spark, d, numbered=False).withColumns({"day": F.to_date("ts"), "week": F.date_trunc("week", "ts")})
    days = b.groupBy("series_id", "day").agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "ts").alias("c"), F.min_by("open", "ts").alias("o"))
    per = Window.partitionBy("series_id")
    days = days.select("series_id", "day", "o", *(F.lag(c).over(per.orderBy("day")).alias(f"pd{c}") for c in "hlc"))
    weeks = b.groupBy("series_id", "week").agg(F.max("high").alias("h"), F.min("low").alias("l"))
    weeks = weeks.select("series_id", "week", *(F.lag(c).over(per.orderBy("week")).alias(f"pw{c}") for c in "hl"))
    out = b.join(days, ["series_id", "day"]).join(weeks, ["series_id", "week"])
    gap = F.when(F.col("pdc").isNull() | (F.col("o") != F.col("pdc")), 1).otherwise(0)
    return out.select("series_id", "ts", "pdh", "pdl", "pdc", "pwh", "pwl", (F.col("close") - F.col("pdh")).alias("dist_pdh"), (quotient(F.col("close") - F.col("pdh"), F.col("close")) * 100).alias("dist_pdh_pct"), (F.col("o") - F.col("pdc")).alias("opening_gap"), gap.alias("gap_exists"))


_NEXT = f"""WITH {bars_sql("1 hour")}, e AS (SELECT *, close > 1.5 * open AS up FROM bars)
SELECT series_id, ts, up, CASE WHEN NOT up THEN (SELECT f.close FROM e f WHERE f.series_id = e.series_id AND f.ts > e.ts AND f.up ORDER BY f.ts LIMIT 1) END AS next_close, CASE WHEN NOT up THEN (SELECT f.bar_idx - e.bar_idx FROM e f WHERE f.series_id = e.series_id AND f.ts > e.ts AND f.up ORDER BY f.ts LIMIT 1) END AS bars_to_next FROM e"""


@query("j10_next_event", _NEXT, "next_close")
def _(spark, d):
    """The next strong bar after each bar."""
    b = B.bars_of_events(spark, d, "1h").withColumn("up", F.col("close") > 1.5 * F.col("open"))
    nxt = lambda v: J.next_event(v, F.col("up"), ["series_id"], "ts")
    return b.select("series_id", "ts", "up", nxt(F.col("close")).alias("next_close"), (nxt(F.col("bar_idx")) - F.col("bar_idx")).alias("bars_to_next"))


_FORWARD = f"""WITH {bars_sql("1 hour")}, e AS (SELECT event_id, event_type AS series_id, ts AS at FROM events)
SELECT e.event_id, e.at, b.bar_idx AS first_bar_idx FROM e ASOF LEFT JOIN bars b ON e.series_id = b.series_id AND e.at <= b.ts"""


@query("j11_forward_asof", _FORWARD)
def _(spark, d):
    """The first bar at or after each event."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("series_id"), F.col("ts").alias("at"))
    return J.forward_asof(e, B.bars_of_events(spark, d, "1h"), "at", ["series_id"]).select("event_id", "at", "first_bar_idx")


_CORR = f"""WITH {bars_sql("1 hour")}, a AS (SELECT ts, close, volume FROM bars WHERE series_id = 'view'), b AS (SELECT ts, close, volume FROM bars WHERE series_id = 'click')
SELECT count(*) AS n, corr(a.close, b.close) AS corr_close, corr(a.volume, b.volume) AS corr_volume FROM a JOIN b USING (ts)"""


@query("a24_correlation", _CORR, "corr_close corr_volume")
def _(spark, d):
    """Correlation of two series on equal times."""
    b = B.bars_of_events(spark, d, "1h", numbered=False).select("series_id", "ts", "close", "volume")
    side = lambda kind, p: b.filter(F.col("series_id") == kind).select("ts", F.col("close").alias(p + "c"), F.col("volume").alias(p + "v"))
    return side("view", "a").join(side("click", "b"), "ts").agg(F.count("*").alias("n"), correlation("ac", "bc").alias("corr_close"), correlation("av", "bv").alias("corr_volume"))


_SETS = """WITH a AS (SELECT user_id, sum(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1 ORDER BY v DESC, user_id LIMIT 30), b AS (SELECT user_id, sum(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1 ORDER BY v DESC, user_id LIMIT 30)
SELECT user_id, 'left' AS change FROM (SELECT user_id FROM a EXCEPT SELECT user_id FROM b) UNION ALL SELECT user_id, 'entered' FROM (SELECT user_id FROM b EXCEPT SELECT user_id FROM a) UNION ALL SELECT user_id, 'stayed' FROM (SELECT user_id FROM a INTERSECT SELECT user_id FROM b)"""


@query("j13_top_sets", _SETS)
def _(spark, d):
    """Who entered, left and stayed in a top 30."""
    e = table(spark, d, "events")
    top = lambda cond: e.filter(cond).groupBy("user_id").agg(F.sum("value").alias("v")).orderBy(F.desc("v"), "user_id").limit(30).select("user_id")
    a, b = top(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")), top(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    mark = lambda df, c: df.withColumn("change", F.lit(c))
    return mark(a.join(b, "user_id", "left_anti"), "left").union(mark(b.join(a, "user_id", "left_anti"), "entered")).union(mark(a.intersect(b), "stayed"))


_QA = f"""WITH {bars_sql("15 minutes")}, g AS (SELECT *, date_diff('second', lag(ts) OVER (PARTITION BY series_id ORDER BY ts), ts) AS gap FROM bars)
SELECT series_id, count(*) AS n, count(*) - count(DISTINCT ts) AS duplicates, count(*) FILTER (gap > 1.5 * 900) AS gaps, max(gap) AS longest_gap, count(*) FILTER (NOT (low <= open AND open <= high AND low <= close AND close <= high AND volume >= 0)) AS invalid, count(*) FILTER (close IS NULL) AS null_close,
count(*) FILTER (taker_buy > volume) AS bad_taker, mode(hour(ts) ORDER BY hour(ts)) AS busiest_hour FROM g GROUP BY series_id"""


@query("a23_audit", _QA.replace(", mode(hour(ts) ORDER BY hour(ts)) AS busiest_hour", ""))
def _(spark, d):
    """Audit of bars: duplicates, gaps, validity, nulls."""
    b = B.bars_of_events(spark, d, numbered=False).withColumn("gap", F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(B.in_order()).cast("timestamp")))
    return b.groupBy("series_id").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("ts")).alias("duplicates"), F.count_if(F.col("gap") > 1350).alias("gaps"), F.max("gap").alias("longest_gap"), F.count_if(~B.ohlc_valid()).alias("invalid"), F.count_if(F.col("close").isNull()).alias("null_close"), F.count_if(F.col("taker_buy") > F.col("volume")).alias("bad_taker"))


_CSV = """SELECT CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS open_ms, value AS price, event_type AS kind, event_id FROM events"""


@query("s6_kline_csv", _CSV, "price")
def _(spark, d):
    """A round trip through headed, dirty CSV text: header rows and rows that don't parse go, microseconds become milliseconds."""
    e = table(spark, d, "events")
    lines = e.select(F.concat_ws(",", F.unix_micros(F.col("ts").cast("timestamp")), "value", "event_type", "event_id").alias("line"))
    dirty = lines.union(spark.createDataFrame([("open_time,price,kind,event_id",), ("n/a,1.0,x,0",)], "line string"))
    return ingest.parse_lines(dirty, "open_time string, price string, kind string, event_id string").select(ingest.to_millis("open_time").alias("open_ms"), F.expr("try_cast(price AS double)").alias("price"), "kind", F.expr("try_cast(event_id AS bigint)").alias("event_id")).filter("open_ms is not null")


_DEDUP = """SELECT user_id, event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, time_bucket(INTERVAL '1 day', ts) ORDER BY ts, event_id) AS n FROM events) WHERE n = 1"""


@query("s5_dedup_keep_first", _DEDUP, "value")
def _(spark, d):
    """Sorted keep-first deduplication."""
    return ingest.keep_first(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "event_type", "day"], ["ts", "event_id"]).select("user_id", "event_type", "ts", "value")


_FILTER = f"""WITH {bars_sql("1 hour")} SELECT series_id, ts, close, volume FROM bars WHERE ts >= TIMESTAMP '2024-01-05' AND close >= 10 AND close <= 80 AND trade_count = 3"""


@query("f7_declarative_filter", _FILTER, "close volume")
def _(spark, d):
    """A filter given as {column: {min, max, eq}}; unknown columns and operators are skipped."""
    from tidebar.operators.filters import declarative

    b = B.bars_of_events(spark, d, "1h", numbered=False).filter(F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz"))
    return b.filter(declarative(b, {"close": {"min": 10, "max": 80}, "trade_count": {"eq": 3}, "no_such": {"min": 1}, "volume": {"near": 3}})).select("series_id", "ts", "close", "volume")


_MASKS = f"""WITH {bars_sql("1 hour")}, m AS (SELECT close > open AS a, volume > 100 AS b, trade_count >= 3 AS c FROM bars)
SELECT CASE WHEN a THEN 'H4' WHEN b THEN 'H1' WHEN c THEN 'M15' END AS source, count(*) AS n, count(*) FILTER (a AND b) AS ab, count(*) FILTER (a AND c) AS ac, count(*) FILTER (b AND c) AS bc, count(*) FILTER (a AND b AND c) AS abc FROM m GROUP BY 1"""


@query("f11_mask_priority", _MASKS)
def _(spark, d):
    """Signals united with the first source's priority, and their overlaps."""
    b = B.bars_of_events(spark, d, "1h", numbered=False)
    m = b.select((F.col("close") > F.col("open")).alias("a"), (F.col("volume") > 100).alias("b"), (F.col("trade_count") >= 3).alias("c"))
    source = F.when(F.col("a"), "H4").when(F.col("b"), "H1").when(F.col("c"), "M15")
    n = lambda *c: F.count_if(F.expr(" and ".join(c)))
    return m.groupBy(source.alias("source")).agg(F.count("*").alias("n"), n("a", "b").alias("ab"), n("a", "c").alias("ac"), n("b", "c").alias("bc"), n("a", "b", "c").alias("abc"))
