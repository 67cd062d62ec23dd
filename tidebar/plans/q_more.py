"""Queries: filter stacks, breakdowns, confluence, legacy operators, small catalogue operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebar.operators import backtest as T
from tidebar.operators import bars as B
from tidebar.operators import indicators as I
from tidebar.operators import joins as J
from tidebar.operators import labels as L
from tidebar.operators import legacy as G
from tidebar.operators import rolling as R
from tidebar.operators import structure as S
from tidebar.plans.q_indicators import W, roll
from tidebar.plans import machine_sql as Q
from tidebar.plans.q_structure import _X, BASE, base, swing_sql
from tidebar.plans.q_trading import LABELLED, ahead_sql, first_sql, taken_sql, trades
from tidebar.plans.registry import ORACLES, bars_sql, query
from tidebar.sources.tables import table

#: The switches of the configurable filter stack.
STACK = {"atr_low": 0.8, "atr_high": 1.5, "no_days": (0, 1), "sessions": ("london", "new_york")}

_NY = "CASE WHEN m >= 1200 OR m < 60 THEN 'asia' WHEN m >= 120 AND m < 300 THEN 'london' WHEN m >= 420 AND m < 600 THEN 'new_york' ELSE 'none' END"
_STACK = f"""{LABELLED}, c AS (SELECT *, atr / nullif(CASE WHEN count(atr) OVER v >= 10 THEN avg(atr) OVER v END, 0) AS ratio, hour(ts - INTERVAL '5 hours') * 60 + minute(ts) AS m FROM labels WINDOW v AS (PARTITION BY series_id ORDER BY ts ROWS 49 PRECEDING)),
f AS (SELECT *, ratio >= 0.8 AND ratio <= 1.5 AS atr_ok, isodow(ts) - 1 NOT IN (0, 1) AS day_ok, ({_NY}) IN ('london', 'new_york') AS session_ok FROM c)"""


def stacked(spark, d):  # noqa: ANN001, ANN201
    x = I.sessions(L.triple_barrier(base(spark, d), (12, 24, 48)))
    ratio = F.col("atr") / F.nullif(R.rolling(F.avg, "atr", 50, 10), F.lit(0.0))
    x = x.withColumn("ratio", ratio)
    return x.withColumns({"atr_ok": (F.col("ratio") >= STACK["atr_low"]) & (F.col("ratio") <= STACK["atr_high"]), "day_ok": ~F.col("weekday").isin(*STACK["no_days"]), "session_ok": F.col("session").isin(*STACK["sessions"])})


@query("f9_filter_stack", f"{_STACK} SELECT series_id, ts, ratio, label_long_hit_2r_24c AS label FROM f WHERE atr_ok AND day_ok AND session_ok", "ratio")
def _(spark, d):
    """ATR band, excluded days and sessions together."""
    return stacked(spark, d).filter("atr_ok and day_ok and session_ok").select("series_id", "ts", "ratio", F.col("label_long_hit_2r_24c").alias("label"))


_PARTS = ("atr_ok", "day_ok", "session_ok")
_CONTRIB = f"{_STACK} SELECT variant, count(*) FILTER (kept) AS n, avg(CASE WHEN kept THEN label_long_hit_2r_24c END) AS win_rate FROM (" + " UNION ALL ".join([f"SELECT 'all' AS variant, coalesce({' AND '.join(_PARTS)}, false) AS kept, label_long_hit_2r_24c FROM f"] + [f"SELECT 'without {p}', coalesce({' AND '.join(q for q in _PARTS if q != p)}, false), label_long_hit_2r_24c FROM f" for p in _PARTS] + [f"SELECT 'only {p}', coalesce({p}, false), label_long_hit_2r_24c FROM f" for p in _PARTS]) + ") GROUP BY 1"


@query("a9_contributions", _CONTRIB, "win_rate")
def _(spark, d):
    """What each filter adds: all, all but one, each alone, in a single pass."""
    both = lambda cols: F.expr(" and ".join(cols))
    variants = [("all", both(_PARTS)), *((f"without {p}", both([q for q in _PARTS if q != p])) for p in _PARTS), *((f"only {p}", F.col(p)) for p in _PARTS)]
    x = stacked(spark, d).select(F.col("label_long_hit_2r_24c").alias("y"), F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.coalesce(c, F.lit(False)).alias("kept")) for n, c in variants))).alias("v"))
    return x.groupBy("v.variant").agg(F.count_if("v.kept").alias("n"), F.avg(F.when(F.col("v.kept"), F.col("y"))).alias("win_rate"))


_REGIME = f"""{taken_sql(3)}, reg AS (SELECT b.series_id, b.bar_idx, CASE WHEN b.close > avg(b.close) OVER (PARTITION BY series_id ORDER BY ts ROWS 95 PRECEDING) THEN 1 ELSE 0 END AS regime FROM base b) SELECT t.series_id, regime, count(*) AS n, avg(r) AS ev, avg(won) AS win_rate, year(any_value(t.ts)) AS year FROM trades t JOIN reg USING (series_id, bar_idx) GROUP BY 1, 2"""


@query("a14_regime_results", _REGIME, "ev win_rate")
def _(spark, d):
    """Results by regime and year."""
    reg = base(spark, d).select("series_id", "bar_idx", F.when(F.col("close") > F.avg("close").over(B.rows(-95, 0)), 1).otherwise(0).alias("regime"))
    return trades(spark, d, 3).join(reg, ["series_id", "bar_idx"]).groupBy("series_id", "regime").agg(F.count("*").alias("n"), F.avg("r").alias("ev"), F.avg("won").alias("win_rate"), F.year(F.max("ts")).cast("long").alias("year"))


def _htf(interval: str, name: str) -> str:
    return f"""{name} AS (SELECT series_id, time_bucket(INTERVAL '{interval}', ts) + INTERVAL '{interval}' AS end_ts, CASE WHEN last(close ORDER BY ts) > first(open ORDER BY ts) THEN 1 ELSE -1 END AS trend FROM bars GROUP BY series_id, time_bucket(INTERVAL '{interval}', ts))"""


_CONFLUENCE = f"""WITH {bars_sql()}, {_htf("1 hour", "h1")}, {_htf("4 hours", "h4")}, {_htf("1 day", "d1")}, a AS (SELECT b.*, h1.trend AS t1 FROM bars b ASOF LEFT JOIN h1 ON b.series_id = h1.series_id AND b.ts >= h1.end_ts), c AS (SELECT a.*, h4.trend AS t4 FROM a ASOF LEFT JOIN h4 ON a.series_id = h4.series_id AND a.ts >= h4.end_ts)
SELECT c.series_id, c.ts, t1 AS h1_trend, t4 AS h4_trend, d1.trend AS d1_trend, coalesce(t1, 0) + coalesce(t4, 0) + coalesce(d1.trend, 0) AS confluence FROM c ASOF LEFT JOIN d1 ON c.series_id = d1.series_id AND c.ts >= d1.end_ts"""


@query("i35_confluence", _CONFLUENCE)
def _(spark, d):
    """Trends of three higher timeframes as of each bar, and their sum."""
    b = B.bars_of_events(spark, d)
    out = b.select("series_id", "ts")
    for interval in ("1h", "4h", "1d"):
        h = B.coarsen(b, interval).withColumn("trend", F.when(F.col("close") > F.col("open"), 1).otherwise(-1))
        out = J.asof_join(out, h, "ts", "end_ts", ["series_id"], ["trend"], f"{'d1' if interval == '1d' else 'h' + interval[0]}_")
    names = ("h1_trend", "h4_trend", "d1_trend")
    return out.select("series_id", "ts", *names, sum((F.coalesce(c, F.lit(0)) for c in names), F.lit(0)).alias("confluence"))


_DIVERGE = f"""WITH {BASE}, q AS (SELECT *, {roll("min", "low", 20)} AS low20, least(lag(close, 5) OVER ({W}), lag(close, 15) OVER ({W})) AS old FROM base) SELECT series_id, ts, CASE WHEN coalesce(low - low20 <= 0.5 * atr AND close < old, false) THEN 1 ELSE 0 END AS bull_setup, (96 - bar_idx % 96) / 96.0::DOUBLE AS to_funding FROM q"""


@query("i7_divergence_setup", _DIVERGE, "to_funding")
def _(spark, d):
    """The price part of a divergence, and the time to the next funding."""
    old = F.least(F.lag("close", 5).over(B.in_order()), F.lag("close", 15).over(B.in_order()))
    both = F.lag("close", 15).over(B.in_order()).isNotNull() | F.lag("close", 5).over(B.in_order()).isNotNull()
    hit = (F.col("low") - R.rolling(F.min, "low", 20) <= 0.5 * F.col("atr")) & (F.col("close") < old) & both
    return base(spark, d).select("series_id", "ts", F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0).alias("bull_setup"), ((96 - F.col("bar_idx") % 96) / 96.0).alias("to_funding"))


_LEGACY = f"""WITH {BASE}, x AS (SELECT *, {ahead_sql(24)} AS ahead FROM base) SELECT series_id, ts, CAST(sign(lead(close, 12) OVER ({W}) - close) AS INTEGER) AS direction_12, CASE WHEN hit IS NULL AND lost IS NULL THEN 0 WHEN lost IS NOT NULL AND (hit IS NULL OR lost <= hit) THEN -1 ELSE 1 END AS outcome FROM (SELECT *, {first_sql("ahead", "s.h >= close * 1.5")} AS hit, {first_sql("ahead", "s.l <= close * 0.5")} AS lost FROM x)"""


@query("l8_legacy_labels", _LEGACY)
def _(spark, d):
    """Signs of forward moves and first outcomes."""
    x = base(spark, d)
    return x.select("series_id", "ts", G.direction(12).alias("direction_12"), G.outcome_sign(24, 50, 50).alias("outcome"))


_FILLS = f"""WITH RECURSIVE {BASE}, x AS (SELECT *, {ahead_sql(12, 0)} AS soon, close - 0.5 * atr AS limit_price FROM base), sig AS (SELECT series_id, ts, bar_idx, limit_price, {first_sql("soon", "s.l <= limit_price")} AS filled FROM x WHERE close > open AND atr > 0),
go AS (SELECT series_id, min(bar_idx) AS at FROM sig GROUP BY 1 UNION ALL SELECT go.series_id, min(s.bar_idx) FROM go JOIN sig s ON s.series_id = go.series_id AND s.bar_idx > go.at + 10 GROUP BY 1)
SELECT s.series_id, count(*) AS attempted, count(filled) AS filled, count(filled) / count(*) AS fill_rate FROM go JOIN sig s ON s.series_id = go.series_id AND s.bar_idx = go.at GROUP BY 1"""


@query("b2_cooldown_fills", _FILLS, "fill_rate")
def _(spark, d):
    """A cooldown that every attempt restarts, filled or not (B2)."""
    x = L.fills(base(spark, d), F.col("close") - 0.5 * F.col("atr"), 12).filter("close > open and atr > 0").select("series_id", "ts", "bar_idx", "bars_to_fill")
    return T.take(x, 10).groupBy("series_id").agg(F.count("*").alias("attempted"), F.count("bars_to_fill").alias("filled"), (F.count("bars_to_fill") / F.count("*")).alias("fill_rate"))


_SIZES = f"""{taken_sql(3)}, z AS (SELECT t.*, b.atr, avg(b.atr) OVER (PARTITION BY t.series_id) AS mean_atr FROM trades t JOIN base b USING (series_id, bar_idx)) SELECT series_id, exp(sum(ln(1 + 0.01 * r))) AS fixed, exp(sum(ln(1 + least(0.02, greatest(0.005, 0.01 * mean_atr / atr)) * r))) AS vol_adjusted, pow(exp(sum(ln(1 + 0.01 * r))), 12.0) - 1 AS cagr FROM z GROUP BY 1"""


@query("b7_sizing_variants", _SIZES, "fixed vol_adjusted cagr")
def _(spark, d):
    """Final equity by sizing rule."""
    x = trades(spark, d, 3).join(base(spark, d).select("series_id", "bar_idx", "atr"), ["series_id", "bar_idx"])
    x = x.withColumn("f", F.least(F.lit(0.02), F.greatest(F.lit(0.005), 0.01 * F.avg("atr").over(Window.partitionBy("series_id")) / F.col("atr"))))
    grown = lambda f: F.exp(F.sum(F.log(1 + f * F.col("r"))))
    return x.groupBy("series_id").agg(grown(F.lit(0.01)).alias("fixed"), grown(F.col("f")).alias("vol_adjusted"), (F.pow(grown(F.lit(0.01)), F.lit(12.0)) - 1).alias("cagr"))


_BOTH = f"""{LABELLED}, l AS (SELECT *, CASE WHEN close > open AND label_long_hit_2r_24c IS NOT NULL THEN 'long' WHEN close < open AND label_short_hit_2r_24c IS NOT NULL THEN 'short' END AS side FROM labels) SELECT series_id, side, count(*) AS n, avg(CASE WHEN side = 'long' THEN label_long_hit_2r_24c ELSE label_short_hit_2r_24c END) AS win_rate FROM l WHERE side IS NOT NULL GROUP BY GROUPING SETS ((series_id, side), (series_id))"""


@query("b8_bidirectional", _BOTH, "win_rate")
def _(spark, d):
    """Both directions, long first, and together."""
    x = L.triple_barrier(base(spark, d), (24,), (2,))
    long_, short = F.col("label_long_hit_2r_24c"), F.col("label_short_hit_2r_24c")
    side = F.when((F.col("close") > F.col("open")) & long_.isNotNull(), "long").when((F.col("close") < F.col("open")) & short.isNotNull(), "short")
    x = x.withColumn("side", side).filter("side is not null").withColumn("y", F.when(F.col("side") == "long", long_).otherwise(short))
    return x.groupingSets([["series_id", "side"], ["series_id"]], "series_id", "side").agg(F.count("*").alias("n"), F.avg("y").alias("win_rate"))


_JSON = """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"""


@query("s13_json_payloads", _JSON)
def _(spark, d):
    """Stored JSON payloads."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_FAMILY = """WITH c AS (SELECT unnest(['ict_fvg', 'sess_label', 'liq_z', 'fund_rate', 'cvd_daily', 'h4_trend', 'd1_trend', 'label_x', 'rsi_14']) AS feature) SELECT feature, CASE WHEN regexp_matches(feature, '^(m15|m30|h1|h4|d1)_') THEN 'htf' WHEN split_part(feature, '_', 1) IN ('ict', 'sess', 'liq', 'fund', 'cvd', 'label') THEN split_part(feature, '_', 1) ELSE 'ta' END AS family FROM c"""


@query("v15_families", _FAMILY)
def _(spark, d):
    """Feature families by prefix, as a catalogue table."""
    c = spark.createDataFrame([(x,) for x in ("ict_fvg", "sess_label", "liq_z", "fund_rate", "cvd_daily", "h4_trend", "d1_trend", "label_x", "rsi_14")], "feature string")
    head = F.split_part("feature", F.lit("_"), F.lit(1))
    return c.select("feature", F.when(F.col("feature").rlike("^(m15|m30|h1|h4|d1)_"), "htf").when(head.isin("ict", "sess", "liq", "fund", "cvd", "label"), head).otherwise("ta").alias("family"))


_UNTRIED = """WITH tried AS (SELECT DISTINCT user_id % 7 AS a, event_id % 5 AS b FROM events), grid AS (SELECT x.range AS a, y.range AS b FROM range(9) x, range(6) y) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM grid EXCEPT SELECT a, b FROM tried"""


@query("o8_untried", _UNTRIED)
def _(spark, d):
    """Options of a small search grid that weren't tried."""
    tried = table(spark, d, "events").select((F.col("user_id") % 7).alias("a"), (F.col("event_id") % 5).alias("b")).distinct()
    grid = spark.range(9 * 6).select(F.floor(F.col("id") / 6).alias("a"), (F.col("id") % 6).alias("b"))
    return grid.join(tried, ["a", "b"], "left_anti")


_STRICT = f"""WITH {BASE}, {swing_sql("base")}, x AS (SELECT *, (SELECT min(f.bar_idx) FROM st f WHERE f.series_id = st.series_id AND f.bos = 1 AND f.bar_idx > st.bar_idx AND f.bar_idx <= st.bar_idx + 20) AS nb, (SELECT min(f.bar_idx) FROM st f WHERE f.series_id = st.series_id AND f.close < f.open AND f.bar_idx > st.bar_idx AND f.bar_idx <= st.bar_idx + 20) AS nd, min(low) OVER ({W} ROWS BETWEEN 21 FOLLOWING AND 60 FOLLOWING) AS later FROM st),
m AS (SELECT *, coalesce(close < open AND nb IS NOT NULL AND (nd IS NULL OR nd >= nb), false) AS ob FROM x) SELECT series_id, ts, CAST(ob AS INTEGER) AS strict_ob, CAST(coalesce(ob AND later <= open, false) AS INTEGER) AS strict_ob_mitigated FROM m"""


@query("m21_strict_blocks", _STRICT)
def _(spark, d):
    """Order blocks known only after their break; looks ahead."""
    return G.strict_blocks(S.swings(base(spark, d))).select("series_id", "ts", "strict_ob", "strict_ob_mitigated")


@query("m18_level_sweeps", Q.level_sweeps_sql(_X), "swept_high_level swept_low_level")
def _(spark, d):
    """Sweeps of any intact level."""
    return G.level_sweeps(S.swings(base(spark, d)))


@query("m26_one_shot_delivery", Q.one_shot_sql(_X))
def _(spark, d):
    """One-shot change of delivery after a swing."""
    return G.one_shot_delivery(S.swings(base(spark, d)))


_COSTS = f"""{taken_sql(3)}, c AS (SELECT t.series_id, t.r, abs(b.nxt - b.close) / b.close AS latency FROM trades t JOIN (SELECT *, lead(open) OVER ({W}) AS nxt FROM base) b USING (series_id, bar_idx)) SELECT series_id, avg(latency) AS mean_latency, median(latency) AS median_latency, stddev_samp(latency) AS sd_latency, sum(CASE WHEN r > 0 THEN r - 0.1 * latency END) / nullif(-sum(CASE WHEN r < 0 THEN r - 0.1 * latency END), 0) AS profit_factor FROM c GROUP BY 1"""


@query("a33_cost_summary", _COSTS, "mean_latency median_latency sd_latency profit_factor")
def _(spark, d):
    """Costs of trades summed up."""
    c = T.costs(base(spark, d)).select("series_id", "bar_idx", "latency_cost")
    x = trades(spark, d, 3).join(c, ["series_id", "bar_idx"]).withColumn("net", F.col("r") - 0.1 * F.col("latency_cost"))
    return x.groupBy("series_id").agg(F.avg("latency_cost").alias("mean_latency"), F.median("latency_cost").alias("median_latency"), F.stddev_samp("latency_cost").alias("sd_latency"), (F.sum(F.when(F.col("r") > 0, F.col("net"))) / F.nullif(-F.sum(F.when(F.col("r") < 0, F.col("net"))), F.lit(0.0))).alias("profit_factor"))



def _single(side: str, top: str, bot: str, reached: str, source: str) -> str:
    return f"""a_{side} AS (SELECT *, coalesce({top} > {bot}, false) AS born_{side} FROM {source}), b_{side} AS (SELECT *, sum(CAST(born_{side} AS INTEGER)) OVER ({W}) AS track_{side}, last(CASE WHEN born_{side} THEN {top} END IGNORE NULLS) OVER ({W}) AS t_{side}, last(CASE WHEN born_{side} THEN {bot} END IGNORE NULLS) OVER ({W}) AS o_{side} FROM a_{side}),
c_{side} AS (SELECT *, t_{side} IS NOT NULL AND NOT coalesce({reached}, false) AS open_{side} FROM b_{side})"""


_S = lambda s: f"CAST(open_{s} AS INTEGER) AS gap_{s}_open, CASE WHEN open_{s} THEN t_{s} END AS gap_{s}_top, CASE WHEN open_{s} THEN o_{s} END AS gap_{s}_bot"
_SINGLE = f"""WITH {bars_sql()}, z AS (SELECT *, lag(high, 2) OVER ({W}) AS h2, lag(low, 2) OVER ({W}) AS l2 FROM bars),
{_single("bull", "low", "h2", "min(CASE WHEN NOT born_bull THEN low END) OVER (PARTITION BY series_id, track_bull ORDER BY ts) <= (t_bull + o_bull) / 2", "z")},
{_single("bear", "l2", "high", "max(CASE WHEN NOT born_bear THEN high END) OVER (PARTITION BY series_id, track_bear ORDER BY ts) >= (t_bear + o_bear) / 2", "c_bull")} SELECT series_id, ts, {_S("bull")}, {_S("bear")} FROM c_bear"""


@query("m30_single_gap", _SINGLE, "gap_bull_top gap_bull_bot gap_bear_top gap_bear_bot")
def _(spark, d):
    """One gap of each side at a time, open until its middle is reached."""
    x = G.single_gap(G.single_gap(B.bars_of_events(spark, d, numbered=False), "bull"), "bear")
    return x.select("series_id", "ts", *(f"gap_{s}_{c}" for s in ("bull", "bear") for c in ("open", "top", "bot")))


_CONF45 = f"""SELECT a.series_id, a.ts, CAST(a.ob_bull_in_zone = 1 AND b.fvg_bull_in_zone = 1 AS INTEGER) AS confluence_bull, CAST(a.ob_bear_in_zone = 1 AND b.fvg_bear_in_zone = 1 AS INTEGER) AS confluence_bear,
CAST((m >= 120 AND m < 300) OR (m >= 420 AND m < 600) AS INTEGER) AS kill_zone, sell_volume, funding_24 FROM ({ORACLES["m4_order_blocks"]}) a JOIN ({ORACLES["m6_gaps"]}) b USING (series_id, ts)
JOIN (WITH {bars_sql()} SELECT series_id, ts, (hour(ts) * 60 + minute(ts) + 1140) % 1440 AS m, volume - taker_buy AS sell_volume, sum(volume / 7.3e5 - 5e-5) OVER ({W} ROWS 95 PRECEDING) AS funding_24 FROM bars) c USING (series_id, ts)"""


@query("i45_zone_confluence", _CONF45, "sell_volume funding_24")
def _(spark, d):
    """Block and gap zones at once, kill zones, sold volume, and funding of 96 quarter hours."""
    x = S.gaps(S.gaps(S.order_blocks(S.swings(I.sessions(base(spark, d)))), "bull"), "bear")
    both = lambda s: ((F.col(f"ob_{s}_in_zone") == 1) & (F.col(f"fvg_{s}_in_zone") == 1)).cast("int")
    zone = F.col("session").isin("london", "new_york").cast("int")
    funding = F.sum(F.col("volume") / 7.3e5 - 5e-5).over(B.rows(-95, 0))
    return x.select("series_id", "ts", both("bull").alias("confluence_bull"), both("bear").alias("confluence_bear"), zone.alias("kill_zone"), (F.col("volume") - F.col("taker_buy")).alias("sell_volume"), funding.alias("funding_24"))
