"""Queries: labels, simulation and statistics of trades."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebar.operators import backtest as T
from tidebar.operators import bars as B
from tidebar.operators import indicators as I
from tidebar.operators import labels as L
from tidebar.operators import structure as S
from tidebar.plans.q_indicators import W
from tidebar.plans.q_structure import BASE, base, in_slices, swing_sql
from tidebar.plans.registry import query

_FWD = ", ".join(f"(lead(close, {h}) OVER ({W}) / close - 1) * 100 AS fwd_return_{h}, CASE WHEN lead(close, {h}) OVER ({W}) IS NOT NULL THEN (max(high) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) / close - 1) * 100 END AS max_up_{h}, CASE WHEN lead(close, {h}) OVER ({W}) IS NOT NULL THEN (min(low) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) / close - 1) * 100 END AS max_down_{h}" for h in (12, 48))


@query("l1_forward_returns", f"WITH {BASE} SELECT series_id, ts, {_FWD} FROM base", "fwd_return_12 max_up_12 max_down_12 fwd_return_48 max_up_48 max_down_48")
def _(spark, d):
    """Forward returns and excursions."""
    return in_slices(spark, d, lambda b: L.forward_returns(b, (12, 48)), 0, 48).select("series_id", "ts", *(f"{x}_{h}" for h in (12, 48) for x in ("fwd_return", "max_up", "max_down")))


def ahead_sql(n: int, start: int = 1) -> str:
    return f"list({{'h': high, 'l': low, 'c': close}}) OVER ({W} ROWS BETWEEN {f'{start} FOLLOWING' if start else 'CURRENT ROW'} AND {n} FOLLOWING)"


def first_sql(array: str, test: str) -> str:
    return f"nullif(list_position(list_transform({array}, lambda s: {test}), true), 0)"


def _won(h: int, direction: str, r: float, array: str = "", price: str = "close") -> str:
    a = array or f"ahead[1:{h}]"
    hit, lost = (f"s.h >= {price} + {r} * atr", f"s.l <= {price} - atr") if direction == "long" else (f"s.l <= {price} - {r} * atr", f"s.h >= {price} + atr")
    return f"CASE WHEN coalesce({first_sql(a, hit)} < coalesce({first_sql(a, lost)}, 1000000), false) THEN 1 ELSE 0 END"


_GRID = [(d, r, h) for h in (12, 24, 48) for d in ("long", "short") for r in (1, 2, 3)]
_GRID_SQL = ", ".join(f"CASE WHEN len(ahead) >= {h} AND atr > 0 THEN {_won(h, d, r)} END AS {L.name_of(d, r, h)}" for d, r, h in _GRID)
LABELLED = f"WITH {BASE}, x AS (SELECT *, {ahead_sql(48)} AS ahead FROM base), labels AS (SELECT series_id, ts, bar_idx, open, high, low, close, atr, {_GRID_SQL} FROM x)"


@query("l2_triple_barrier", f"{LABELLED} SELECT * EXCLUDE (bar_idx, open, high, low, close, atr) FROM labels")
def _(spark, d):
    """Barrier labels for three horizons, three ratios and both directions."""
    return in_slices(spark, d, L.triple_barrier, 0, 48).select("series_id", "ts", *(L.name_of(*g) for g in _GRID))


_DYN = f"WITH {BASE}, {swing_sql('base')}, x AS (SELECT *, list({{'h': high, 'l': low}}) OVER ({W} ROWS BETWEEN 2 FOLLOWING AND 49 FOLLOWING) AS ahead, lead(close) OVER ({W}) AS entry FROM st), y AS (SELECT *, entry - last_low AS risk FROM x) SELECT series_id, ts, CASE WHEN risk > 0 AND len(ahead) >= 48 THEN CASE WHEN coalesce({first_sql('ahead', 's.h >= entry + 2 * risk')} < coalesce({first_sql('ahead', 's.l <= last_low')}, 1000000), false) THEN 1 ELSE 0 END END AS label FROM y"


@query("l3_dynamic_label", _DYN)
def _(spark, d):
    """A label with a swing stop and one bar of delay (L3)."""
    return L.dynamic(S.swings(base(spark, d)), stop="swing_low", delay=1).select("series_id", "ts", "label")


_FILL = f"""WITH {BASE}, {swing_sql("base")}, x AS (SELECT *, (last_high + last_low) / 2 AS limit_price, {ahead_sql(12, 0)} AS soon, {ahead_sql(60)} AS later FROM st),
y AS (SELECT *, CASE WHEN limit_price IS NOT NULL THEN CAST({first_sql("soon", "s.l <= limit_price")} - 1 AS BIGINT) END AS bars_to_fill FROM x)
SELECT series_id, ts, limit_price, bars_to_fill, CASE WHEN bars_to_fill IS NOT NULL AND atr > 0 THEN {_won(48, "long", 2, "later[bars_to_fill + 1:bars_to_fill + 48]", "limit_price")} END AS limit_label FROM y"""


@query("l5_limit_fills", _FILL, "limit_price")
def _(spark, d):
    """Limit orders at the middle of the last swings, their fills and labels from there."""
    x = L.fills(S.swings(base(spark, d)), (F.col("last_high") + F.col("last_low")) / 2, 12)
    return L.limit_labels(x, 12, 48).select("series_id", "ts", "limit_price", "bars_to_fill", "limit_label")


_OUT = f"""WITH {BASE}, x AS (SELECT *, {ahead_sql(24)} AS ahead FROM base), y AS (SELECT *, {first_sql("ahead", "s.h >= close + 2 * atr")} AS hit, {first_sql("ahead", "s.l <= close - atr")} AS lost FROM x), z AS (SELECT *, CASE WHEN lost IS NOT NULL AND (hit IS NULL OR lost <= hit) THEN 'stop' WHEN hit IS NOT NULL THEN 'target' ELSE 'expired' END AS kind FROM y)
SELECT series_id, kind AS outcome, count(*) AS n, avg(coalesce(least(hit, lost), len(ahead))) AS mean_held, avg(CASE WHEN kind = 'expired' THEN (ahead[len(ahead)].c - close) / atr END) AS expired_atr FROM z WHERE atr > 0 AND len(ahead) > 0 GROUP BY 1, 2"""


@query("l9_outcomes", _OUT, "mean_held expired_atr")
def _(spark, d):
    """Targets, stops and expiries with holding times."""
    x = in_slices(spark, d, lambda b: L.outcomes(b, 24), 0, 24).filter("outcome is not null")
    return x.groupBy("series_id", "outcome").agg(F.count("*").alias("n"), F.avg("held").alias("mean_held"), F.avg("expired_atr").alias("expired_atr"))


_BLOCK = f"WITH {BASE} SELECT series_id, ts, avg(atr) OVER (PARTITION BY series_id, bar_idx // 12) AS h1_atr FROM base"


@query("l7_block_atr", _BLOCK, "h1_atr")
def _(spark, d):
    """A block's mean given to its rows."""
    return L.block_mean(base(spark, d), "atr", 12, "h1_atr").select("series_id", "ts", "h1_atr")


_SIGNALS = f"{LABELLED}, sig AS (SELECT *, label_long_hit_2r_24c AS won FROM labels WHERE close > open AND label_long_hit_2r_24c IS NOT NULL)"


def signals(spark, d):  # noqa: ANN001, ANN201
    x = in_slices(spark, d, lambda b: L.triple_barrier(b, (24,), (2,)), 0, 24).withColumn("won", F.col("label_long_hit_2r_24c"))
    return x.filter((F.col("close") > F.col("open")) & F.col("won").isNotNull()).select("series_id", "ts", "bar_idx", "close", "won")


def taken_sql(cooldown: int) -> str:
    base_ = _SIGNALS.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{base_}, go AS (SELECT series_id, min(bar_idx) AS at FROM sig GROUP BY 1 UNION ALL SELECT go.series_id, min(s.bar_idx) FROM go JOIN sig s ON s.series_id = go.series_id AND s.bar_idx > go.at + {cooldown} GROUP BY 1),
trades AS (SELECT s.series_id, s.ts, s.bar_idx, s.won, CASE WHEN s.won = 1 THEN 1.95::DOUBLE ELSE -1.05::DOUBLE END AS r FROM go JOIN sig s ON s.series_id = go.series_id AND s.bar_idx = go.at)"""


def trades(spark, d, cooldown: int = 10):  # noqa: ANN001, ANN201
    return T.take(signals(spark, d), cooldown).withColumn("r", T.trade_return(F.col("won") == 1)).select("series_id", "ts", "bar_idx", "won", "r")


@query("b1_cooldown", f"{taken_sql(10)} SELECT * FROM trades", "r")
def _(spark, d):
    """Signals taken under a cooldown, and their returns."""
    return trades(spark, d)


_EQ = f"""{taken_sql(10)}, e AS (SELECT *, exp(sum(ln(1 + 0.01 * r)) OVER ({W})) AS equity FROM trades) SELECT series_id, ts, r, equity, 1 - equity / greatest(1, max(equity) OVER ({W})) AS drawdown FROM e"""


@query("b4_equity", _EQ, "r equity drawdown")
def _(spark, d):
    """Equity at fixed risk and its drawdown."""
    return T.equity(trades(spark, d), F.lit(0.01)).select("series_id", "ts", "r", "equity", "drawdown")


_KELLY = f"""{taken_sql(10)}, p AS (SELECT *, (bar_idx * 37 % 101) / 100.0 AS p FROM trades), k AS (SELECT *, least(0.02, greatest(0.0025, greatest(0, p - (1 - p) / 2) / 40)) AS f FROM p), e AS (SELECT *, exp(sum(ln(1 + f * r)) OVER ({W})) AS equity FROM k)
SELECT series_id, ts, p, f, least(0.02, greatest(0.01, greatest(0, p - (1 - p) / 2) / 40)) AS f_scalar, equity, 1 - equity / greatest(1, max(equity) OVER ({W})) AS drawdown FROM e"""


@query("b6_kelly", _KELLY, "p f f_scalar equity drawdown")
def _(spark, d):
    """Fractional Kelly sizes and equity at variable risk."""
    x = trades(spark, d).withColumn("p", (F.col("bar_idx") * 37 % 101) / 100.0)
    x = x.withColumns({"f": T.kelly(F.col("p")), "f_scalar": T.kelly(F.col("p"), floor=0.01)})
    return T.equity(x, F.col("f")).select("series_id", "ts", "p", "f", "f_scalar", "equity", "drawdown")


_COST = f"""WITH {BASE}, f AS (SELECT time_bucket(INTERVAL '15 minutes', ts) AS ts, sum(value) / 1e4 AS funding FROM events WHERE event_type = 'error' GROUP BY 1),
x AS (SELECT b.*, f.funding, ln(close / open) AS co FROM base b LEFT JOIN f USING (ts)), y AS (SELECT *, lead(open) OVER ({W}) AS next_open, CASE WHEN count(co) OVER (PARTITION BY series_id ORDER BY ts ROWS 19 PRECEDING) >= 20 THEN stddev_samp(co) OVER (PARTITION BY series_id ORDER BY ts ROWS 19 PRECEDING) END AS sigma,
CASE WHEN count(volume) OVER (PARTITION BY series_id ORDER BY ts ROWS 95 PRECEDING) >= 10 THEN avg(volume) OVER (PARTITION BY series_id ORDER BY ts ROWS 95 PRECEDING) END AS adv, sum(funding) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 48 FOLLOWING) AS funding_sum FROM x)
SELECT series_id, ts, abs(next_open - close) / close AS latency_cost, 0.1 * sigma * sqrt(1 / nullif(adv, 0)) * CASE WHEN sigma > 1 THEN 1.5 ELSE 1 END AS impact_cost, funding_sum FROM y"""


@query("b10_costs", _COST, "latency_cost impact_cost funding_sum")
def _(spark, d):
    """Latency, impact and funding costs."""
    f = B.bars_of_events(spark, d).filter("series_id = 'error'").select("ts", (F.col("volume") / 1e4).alias("funding"))
    return T.costs(base(spark, d).join(f, "ts", "left")).select("series_id", "ts", "latency_cost", "impact_cost", "funding_sum")


_SWEEP = " UNION ALL ".join(f"SELECT CAST({c} AS INTEGER) AS cooldown, * FROM ({taken_sql(c)} SELECT series_id, count(*) AS n, avg(r) AS ev, avg(won) AS win_rate FROM trades GROUP BY 1)" for c in (0, 6, 48))


@query("b12_cooldown_sweep", _SWEEP, "ev win_rate")
def _(spark, d):
    """A grid of cooldowns."""
    x = T.sweep(signals(spark, d), [0, 6, 48]).withColumn("r", T.trade_return(F.col("won") == 1))
    return x.groupBy("cooldown", "series_id").agg(F.count("*").alias("n"), F.avg("r").alias("ev"), F.avg("won").alias("win_rate"))


_METRICS = f"{taken_sql(10)} SELECT series_id, count(*) AS n, count(*) FILTER (r > 0) AS wins, avg(r) AS ev, count(*) FILTER (r > 0) / count(*) AS win_rate, sum(CASE WHEN r > 0 THEN r END) / nullif(sum(CASE WHEN r < 0 THEN -r END), 0) AS profit_factor, avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(*) / 0.082) AS sharpe FROM trades GROUP BY 1"


@query("a21_trade_metrics", _METRICS, "ev win_rate profit_factor sharpe")
def _(spark, d):
    """Metrics of trades."""
    return T.metrics(trades(spark, d), ("series_id",), 0.082)


_SESSION = "CASE WHEN m >= 1200 OR m < 60 THEN 'asia' WHEN m >= 120 AND m < 300 THEN 'london' WHEN m >= 420 AND m < 600 THEN 'new_york' ELSE 'none' END"
_BREAK = f"""{LABELLED}, t AS (SELECT *, {_SESSION} AS session FROM (SELECT *, hour(ts - INTERVAL '5 hours') * 60 + minute(ts) AS m FROM labels) WHERE label_long_hit_2r_48c IS NOT NULL)
SELECT session, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, hour(ts) // 4 AS hour_bucket, count(*) AS n, avg(label_long_hit_2r_48c) AS win_rate FROM t GROUP BY GROUPING SETS ((session), (isodow(ts) - 1), (hour(ts) // 4), (session, isodow(ts) - 1), ())"""


@query("a8_win_rates", _BREAK.replace("CAST(isodow(ts) - 1 AS INTEGER) AS weekday, hour(ts) // 4 AS hour_bucket", "w AS weekday, h AS hour_bucket").replace("FROM t GROUP BY", "FROM (SELECT *, CAST(isodow(ts) - 1 AS INTEGER) AS w, CAST(hour(ts) // 4 AS INTEGER) AS h FROM t) GROUP BY").replace("(isodow(ts) - 1), (hour(ts) // 4), (session, isodow(ts) - 1)", "(w), (h), (session, w)"), "win_rate")
def _(spark, d):
    """Win rates by session, weekday and part of day in one pass."""
    x = I.sessions(in_slices(spark, d, lambda b: L.triple_barrier(b, (48,), (2,)), 0, 48)).filter("label_long_hit_2r_48c is not null")
    x = x.withColumn("hour_bucket", F.floor(F.hour("ts") / 4).cast("int"))
    return x.groupingSets([["session"], ["weekday"], ["hour_bucket"], ["session", "weekday"], []], "session", "weekday", "hour_bucket").agg(F.count("*").alias("n"), F.avg("label_long_hit_2r_48c").alias("win_rate"))


_MATRIX = f"{LABELLED} SELECT direction, ratio, horizon, count(y) AS n, avg(y) AS random_wr, avg(CASE WHEN close > open THEN y END) AS filtered_wr, 1.0 / (1 + ratio) AS breakeven, avg(CASE WHEN close > open THEN y END) - 1.0 / (1 + ratio) AS edge FROM (" + " UNION ALL ".join(f"SELECT '{d}' AS direction, CAST({r} AS INTEGER) AS ratio, CAST({h} AS INTEGER) AS horizon, open, close, {L.name_of(d, r, h)} AS y FROM labels" for d, r, h in _GRID) + ") GROUP BY 1, 2, 3"


@query("a10_ratio_horizon_matrix", _MATRIX, "random_wr filtered_wr breakeven edge")
def _(spark, d):
    """Win rates by ratio and horizon against their breakeven."""
    x = in_slices(spark, d, L.triple_barrier, 0, 48)
    rows_ = F.explode(F.array(*(F.struct(F.lit(a).alias("direction"), F.lit(r).alias("ratio"), F.lit(h).alias("horizon"), F.col(L.name_of(a, r, h)).alias("y")) for a, r, h in _GRID)))
    x = x.select("open", "close", rows_.alias("g")).select("open", "close", "g.*")
    picked = F.avg(F.when(F.col("close") > F.col("open"), F.col("y")))
    even = 1.0 / (1 + F.col("ratio"))
    return x.groupBy("direction", "ratio", "horizon").agg(F.count("y").alias("n"), F.avg("y").alias("random_wr"), picked.alias("filtered_wr")).withColumns({"breakeven": even, "edge": F.col("filtered_wr") - even})


_STREAK = f"""{taken_sql(3)}, a AS (SELECT *, CASE WHEN r > 0 THEN 1 ELSE 0 END AS w FROM trades), b AS (SELECT *, sum(w) OVER ({W}) AS run, lead(w) OVER ({W}) AS nxt FROM a), c AS (SELECT series_id, run, count(*) FILTER (w = 0) AS length, max(CASE WHEN w = 1 THEN nxt END) AS f FROM b GROUP BY 1, 2), e AS (SELECT *, lead(f) OVER (PARTITION BY series_id ORDER BY run) AS t FROM c)
SELECT series_id, length, count(*) AS runs, avg(t) AS win_rate_after FROM e WHERE length > 0 GROUP BY 1, 2"""


@query("a16_loss_streaks", _STREAK, "win_rate_after")
def _(spark, d):
    """Loss streaks and what follows them."""
    return T.streaks(trades(spark, d, 3))


_DAILY = f"""{taken_sql(3)}, days AS (SELECT series_id, unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL '1 day')) AS day FROM trades GROUP BY 1), p AS (SELECT series_id, CAST(ts AS DATE) AS day, sum(r) AS r FROM trades GROUP BY 1, 2),
z AS (SELECT days.series_id, CAST(days.day AS DATE) AS day, coalesce(p.r, 0) AS r FROM days LEFT JOIN p ON p.series_id = days.series_id AND p.day = CAST(days.day AS DATE)) SELECT series_id, count(*) AS days, sum(r) AS total, avg(r) / nullif(stddev_samp(r), 0) * sqrt(365) AS sharpe_365, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS sharpe_252 FROM z GROUP BY 1"""


@query("a32_daily_pnl", _DAILY, "total sharpe_365 sharpe_252")
def _(spark, d):
    """Daily results with empty days, and Sharpe ratios by both year lengths."""
    t = trades(spark, d, 3).withColumn("day", F.to_date("ts"))
    spine = t.groupBy("series_id").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("series_id", F.explode(F.sequence("a", "b")).alias("day"))
    z = spine.join(t.groupBy("series_id", "day").agg(F.sum("r").alias("r")), ["series_id", "day"], "left").select("series_id", F.coalesce("r", F.lit(0.0)).alias("r"))
    s = F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0))
    return z.groupBy("series_id").agg(F.count("*").alias("days"), F.sum("r").alias("total"), (s * 365**0.5).alias("sharpe_365"), (s * 252**0.5).alias("sharpe_252"))


_DECAY = f"""{taken_sql(3)}, q AS (SELECT series_id, date_trunc('week', ts) AS week, avg(won) AS win_rate, count(*) AS n FROM trades GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY week) - 1 AS x FROM q) SELECT series_id, count(*) AS weeks, regr_slope(win_rate, x) AS slope, regr_intercept(win_rate, x) AS intercept, regr_r2(win_rate, x) AS r2 FROM k GROUP BY 1"""


@query("a13_decay", _DECAY, "slope intercept r2")
def _(spark, d):
    """Win rate by period with a regression line."""
    q = trades(spark, d, 3).groupBy("series_id", F.date_trunc("week", "ts").alias("week")).agg(F.avg("won").alias("win_rate"))
    q = q.withColumn("x", F.row_number().over(Window.partitionBy("series_id").orderBy("week")) - 1)
    return q.groupBy("series_id").agg(F.count("*").alias("weeks"), F.regr_slope("win_rate", "x").alias("slope"), F.regr_intercept("win_rate", "x").alias("intercept"), F.regr_r2("win_rate", "x").alias("r2"))


_TERCILE = f"""{LABELLED}, q AS (SELECT series_id, quantile_cont(atr, {1 / 3!r}) AS lo, quantile_cont(atr, {2 / 3!r}) AS hi FROM labels WHERE atr IS NOT NULL GROUP BY 1) SELECT series_id, CAST(CASE WHEN atr <= lo THEN 0 WHEN atr <= hi THEN 1 ELSE 2 END AS INTEGER) AS tercile, count(*) AS n, avg(label_long_hit_1r_12c) AS win_rate, min(ts >= TIMESTAMP '2024-01-15')::INTEGER AS x FROM labels JOIN q USING (series_id) WHERE atr IS NOT NULL GROUP BY 1, 2"""


@query("a28_quantile_buckets", _TERCILE.replace(", min(ts >= TIMESTAMP '2024-01-15')::INTEGER AS x", ""), "win_rate")
def _(spark, d):
    """Terciles by exact quantiles."""
    x = L.triple_barrier(base(spark, d), (12,), (1,)).filter("atr is not null")
    q = x.groupBy("series_id").agg(F.percentile("atr", F.lit(1 / 3)).alias("lo"), F.percentile("atr", F.lit(2 / 3)).alias("hi"))
    t = F.when(F.col("atr") <= F.col("lo"), 0).when(F.col("atr") <= F.col("hi"), 1).otherwise(2)
    return x.join(q, "series_id").groupBy("series_id", t.alias("tercile")).agg(F.count("*").alias("n"), F.avg("label_long_hit_1r_12c").alias("win_rate"))


_SPLIT = f"{taken_sql(3)} SELECT series_id, ts < TIMESTAMP '2024-01-15' AS before, count(*) AS n, avg(r) AS ev, avg(r) / nullif(stddev_samp(r) / sqrt(count(*)), 0) AS t_stat FROM trades GROUP BY 1, 2"


@query("a31_date_split", _SPLIT, "ev t_stat")
def _(spark, d):
    """Before and after a date, with t statistics."""
    x = trades(spark, d, 3).withColumn("before", F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    return x.groupBy("series_id", "before").agg(F.count("*").alias("n"), F.avg("r").alias("ev"), (F.avg("r") / F.nullif(F.stddev_samp("r") / F.sqrt(F.count("*")), F.lit(0.0))).alias("t_stat"))
