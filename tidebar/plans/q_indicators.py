"""Queries: indicators, each family in one query."""

from __future__ import annotations

import math

from tidebar.operators import bars as B
from tidebar.operators import indicators as I
from tidebar.operators import slicing
from tidebar.plans.registry import bars_sql, query

W = "PARTITION BY series_id ORDER BY ts"


def roll(f: str, x: str, n: int, least: int | None = None) -> str:
    over = f"OVER ({W} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {over} >= {n if least is None else least} THEN {f}({x}) {over} END"


def rank(x: str, n: int) -> str:
    """The same rank from a list of the frame."""
    over = f"OVER ({W} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) {over} >= {n} THEN (len(list_filter(list({x}) {over}, lambda v: v < {x})) + (len(list_filter(list({x}) {over}, lambda v: v = {x})) + 1) / 2.0) / count({x}) {over} END"


def zs(x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN ({roll('stddev_samp', x, n, least)}) <> 0 THEN ({x} - ({roll('avg', x, n, least)})) / ({roll('stddev_samp', x, n, least)}) END"


LAG = f"lag(close) OVER ({W})"
TR = f"greatest(high - low, abs(high - {LAG}), abs(low - {LAG}))"


def ewm_sql(name: str, source: str, x: str, a: float, weight: str, out: str) -> str:
    """sum of x_i * weight * a ** (t - i) over i <= t, written out."""
    return f"{name} AS (SELECT t.series_id, t.bar_idx, sum(s.{x} * ({weight}) * pow({a!r}, t.bar_idx - s.bar_idx)) AS {out} FROM {source} t JOIN {source} s ON s.series_id = t.series_id AND s.bar_idx <= t.bar_idx GROUP BY 1, 2)"


def wilder_sql(name: str, source: str, x: str, n: int, out: str, start: int) -> str:
    """Wilder's average of a column that begins at bar `start`: the seed decays, later values come in with weight 1 / n."""
    a = (n - 1) / n
    return f"""{name} AS (SELECT t.series_id, t.bar_idx, CASE WHEN t.bar_idx >= {start + n - 1} THEN sum(CASE WHEN s.bar_idx < {start + n} THEN s.{x} / {n} * pow({a!r}, t.bar_idx - {start + n - 1}) ELSE s.{x} / {n} * pow({a!r}, t.bar_idx - s.bar_idx) END) END AS {out}
FROM {source} t JOIN {source} s ON s.series_id = t.series_id AND s.bar_idx <= t.bar_idx AND s.bar_idx >= {start} GROUP BY 1, 2)"""


_ATR = f"""WITH {bars_sql("1 hour")}, x AS (SELECT *, {TR} AS tr FROM bars), {ewm_sql("e", "x", "tr", 13 / 14, "1", "num")}, {wilder_sql("v", "x", "tr", 14, "atr_wilder14", 0)}
SELECT series_id, ts, tr, {roll("avg", "tr", 14)} AS atr_sma14, {roll("avg", "tr", 10)} AS atr_sma10, {roll("avg", "tr", 14, 1)} AS atr_sma14_any, CASE WHEN bar_idx >= 13 THEN num / 14 / (1 - pow({13 / 14!r}, bar_idx + 1)) END AS atr_ewm14, atr_wilder14 FROM x LEFT JOIN e USING (series_id, bar_idx) LEFT JOIN v USING (series_id, bar_idx)"""


@query("i1_atr", _ATR, "tr atr_sma14 atr_sma10 atr_sma14_any atr_ewm14 atr_wilder14")
def _(spark, d):
    """True range and its averages."""
    return I.atr(B.bars_of_events(spark, d, "1h")).select("series_id", "ts", "tr", "atr_sma14", "atr_sma10", "atr_sma14_any", "atr_ewm14", "atr_wilder14")


_RSI = f"""WITH {bars_sql("1 hour")}, x AS (SELECT *, CASE WHEN bar_idx > 0 THEN greatest(close - {LAG}, 0) END AS up, CASE WHEN bar_idx > 0 THEN greatest({LAG} - close, 0) END AS down FROM bars), {wilder_sql("u", "x", "up", 14, "u", 1)}, {wilder_sql("w", "x", "down", 14, "dn", 1)}
SELECT series_id, ts, CASE WHEN dn IS NOT NULL THEN CASE WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + u.u / dn) END END AS rsi_14 FROM x LEFT JOIN u USING (series_id, bar_idx) LEFT JOIN w USING (series_id, bar_idx)"""


@query("i6_rsi", _RSI, "rsi_14")
def _(spark, d):
    """Wilder's relative strength."""
    return I.rsi(B.bars_of_events(spark, d, "1h")).select("series_id", "ts", "rsi_14")


def _span(n: int) -> tuple[float, str]:
    alpha = 2 / (n + 1)
    return 1 - alpha, f"CASE WHEN s.bar_idx = 0 THEN 1 ELSE {alpha!r} END"


_MACD = f"""WITH {bars_sql("1 hour")}, {ewm_sql("f", "bars", "close", *_span(12), "f")}, {ewm_sql("s", "bars", "close", *_span(26), "s")}, m AS (SELECT bars.series_id, ts, bars.bar_idx, f.f - s.s AS macd FROM bars JOIN f USING (series_id, bar_idx) JOIN s USING (series_id, bar_idx)), {ewm_sql("g", "m", "macd", *_span(9), "macd_signal")}
SELECT series_id, ts, macd, macd_signal, macd - macd_signal AS macd_hist FROM m JOIN g USING (series_id, bar_idx)"""


@query("i9_macd", _MACD, "macd macd_signal macd_hist")
def _(spark, d):
    """MACD by exponential averages seeded with the first value."""
    return I.macd(B.bars_of_events(spark, d, "1h")).select("series_id", "ts", "macd", "macd_signal", "macd_hist")


_EMA = f"""WITH {bars_sql("1 hour")}, {ewm_sql("a", "bars", "close", *_span(9), "ema_9")}, {ewm_sql("b", "bars", "close", *_span(21), "ema_21")}, {ewm_sql("c", "bars", "close", *_span(50), "ema_50")}
SELECT series_id, ts, ema_9, ema_21, ema_50, sign(ema_9 - ema_21) * 1.0 AS ema_cross, ema_9 - lag(ema_9, 5) OVER ({W}) AS ema_slope, (close - ema_9) / ema_9 AS ema_distance FROM bars JOIN a USING (series_id, bar_idx) JOIN b USING (series_id, bar_idx) JOIN c USING (series_id, bar_idx)"""


@query("i12_ema", _EMA.replace("sign(ema_9 - ema_21) * 1.0", "CAST(sign(round(ema_9 - ema_21, 9)) AS DOUBLE)"), "ema_9 ema_21 ema_50 ema_cross ema_slope ema_distance")
def _(spark, d):
    """Exponential averages, their cross, slope and distance."""
    return I.emas(B.bars_of_events(spark, d, "1h")).select("series_id", "ts", "ema_9", "ema_21", "ema_50", I.F.signum(I.F.round(I.F.col("ema_9") - I.F.col("ema_21"), 9)).alias("ema_cross"), "ema_slope", "ema_distance")


_ADX = f"""WITH {bars_sql("1 hour")}, y AS (SELECT *, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS dn, {TR} AS t0 FROM bars),
x AS (SELECT *, CASE WHEN bar_idx > 0 THEN CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END END AS p, CASE WHEN bar_idx > 0 THEN CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END END AS m, CASE WHEN bar_idx > 0 THEN t0 END AS t FROM y),
{wilder_sql("a", "x", "p", 14, "ps", 1)}, {wilder_sql("b", "x", "m", 14, "ms", 1)}, {wilder_sql("c", "x", "t", 14, "ts_", 1)},
z AS (SELECT x.series_id, x.ts, x.bar_idx, 100 * ps / nullif(ts_, 0) AS plus_di, 100 * ms / nullif(ts_, 0) AS minus_di FROM x LEFT JOIN a USING (series_id, bar_idx) LEFT JOIN b USING (series_id, bar_idx) LEFT JOIN c USING (series_id, bar_idx)),
q AS (SELECT *, CASE WHEN plus_di + minus_di = 0 THEN 0 ELSE 100 * abs(plus_di - minus_di) / (plus_di + minus_di) END AS dx FROM z), {wilder_sql("e", "q", "dx", 14, "adx", 14)}
SELECT series_id, ts, plus_di, minus_di, adx FROM q LEFT JOIN e USING (series_id, bar_idx)"""


@query("i17_adx", _ADX, "plus_di minus_di adx")
def _(spark, d):
    """Directional movement and ADX."""
    return I.adx(B.bars_of_events(spark, d, "1h")).select("series_id", "ts", "plus_di", "minus_di", "adx")


_LN2 = math.log(2)
_VOL = f"""WITH {bars_sql()}, x AS (SELECT *, ln(close / {LAG}) AS r, ln(close) - ln((high + low) / 2) AS eta, 0.5 * pow(ln(high / low), 2) - {2 * _LN2 - 1!r} * pow(ln(close / open), 2) AS gk, pow(ln(high / low), 2) / {4 * _LN2!r} AS pk, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM bars),
y AS (SELECT *, lag(eta) OVER ({W}) AS eta1, eta * lag(eta) OVER ({W}) AS ee FROM x)
SELECT series_id, ts, r, {roll("stddev_samp", "r", 20)} AS rv_20, {roll("stddev_samp", "r", 48, 24)} AS rv_48_half, 2 * sqrt(greatest(0, CASE WHEN count(ee) OVER w >= 20 THEN avg(ee) OVER w - avg(eta1) OVER w * avg(eta) OVER w END)) AS ar_spread,
sqrt(greatest(0, {roll("avg", "gk", 20)})) AS garman_klass, sqrt(greatest(0, {roll("avg", "pk", 20)})) AS parkinson, sqrt(greatest(0, {roll("avg", "rs", 20)})) AS rogers_satchell FROM y WINDOW w AS ({W} ROWS 19 PRECEDING)"""


@query("i21_volatility", _VOL, "r rv_20 rv_48_half ar_spread garman_klass parkinson rogers_satchell")
def _(spark, d):
    """Realised and range volatility, effective spread."""
    return slicing.sliced(B.bars_of_events(spark, d), I.volatility, 50).select("series_id", "ts", "r", "rv_20", "rv_48_half", "ar_spread", "garman_klass", "parkinson", "rogers_satchell")


_BANDS = f"""WITH {bars_sql()}, x AS (SELECT *, {roll("avg", "close", 20)} AS bb_mid, {roll("stddev_samp", "close", 20)} AS sd, {TR} AS tr, {roll("min", "low", 14)} AS lo, {roll("max", "high", 14)} AS hi FROM bars),
y AS (SELECT *, {roll("avg", "tr", 10)} AS a10, 100 * (close - lo) / nullif(hi - lo, 0) AS k FROM x), z AS (SELECT *, CASE WHEN 2 * sd < 1.5 * a10 THEN 1 ELSE 0 END AS squeeze, {roll("avg", "k", 3)} AS stoch_k FROM y),
i AS (SELECT *, bar_idx - row_number() OVER (PARTITION BY series_id, squeeze ORDER BY ts) AS isl FROM z)
SELECT series_id, ts, bb_mid, (close - (bb_mid - 2 * sd)) / nullif(4 * sd, 0) AS bb_pct, 4 * sd / bb_mid AS bb_width, squeeze, CAST(CASE WHEN squeeze = 1 THEN row_number() OVER (PARTITION BY series_id, squeeze, isl ORDER BY ts) ELSE 0 END AS INTEGER) AS squeeze_bars,
(({roll("max", "high", 10)}) + ({roll("min", "low", 10)})) / 2 AS tenkan, (({roll("max", "high", 30)}) + ({roll("min", "low", 30)})) / 2 AS kijun, (({roll("max", "high", 60)}) + ({roll("min", "low", 60)})) / 2 AS senkou_b, stoch_k, {roll("avg", "stoch_k", 3)} AS stoch_d FROM i"""


@query("i22_bands", _BANDS, "bb_mid bb_pct bb_width tenkan kijun senkou_b stoch_k stoch_d")
def _(spark, d):
    """Bands, squeeze, Ichimoku and stochastic lines."""
    return I.bands(B.bars_of_events(spark, d)).select("series_id", "ts", "bb_mid", "bb_pct", "bb_width", "squeeze", "squeeze_bars", "tenkan", "kijun", "senkou_b", "stoch_k", "stoch_d")


_D = "PARTITION BY series_id, CAST(ts AS DATE) ORDER BY ts"
_VOLUME = f"""WITH {bars_sql()}, x AS (SELECT *, CASE WHEN high <> low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END AS clv, (high + low + close) / 3 AS tp, 2 * taker_buy - volume AS delta, {LAG} AS c1 FROM bars),
y AS (SELECT *, lag(tp) OVER ({W}) AS tp1, tp * volume AS flow, clv * volume AS cv FROM x), z AS (SELECT *, CASE WHEN tp > tp1 THEN flow ELSE 0 END AS pos, CASE WHEN tp < tp1 THEN flow ELSE 0 END AS neg, sum(flow) OVER ({_D}) / nullif(sum(volume) OVER ({_D}), 0) AS vwap FROM y),
v AS (SELECT *, {roll("sum", "pos", 14)} AS p14, {roll("sum", "neg", 14)} AS n14, volume * pow(tp - vwap, 2) AS dev FROM z), q AS (SELECT *, sqrt(sum(dev) OVER ({_D}) / nullif(sum(volume) OVER ({_D}), 0)) AS vwap_sigma FROM v)
SELECT series_id, ts, clv, delta, CASE WHEN n14 = 0 THEN 100 ELSE 100 - 100 / (1 + p14 / nullif(n14, 0)) END AS mfi_14, sum(coalesce(sign(close - c1) * volume, 0)) OVER ({W}) AS obv, ({roll("sum", "cv", 20)}) / nullif(({roll("sum", "volume", 20)}), 0) AS cmf_20, sum(delta) OVER ({_D}) AS cvd_daily, {roll("sum", "delta", 7)} AS cvd_7,
{zs("volume", 20)} AS volume_z, volume / nullif(({roll("avg", "volume", 20)}), 0) AS rvol, taker_buy / nullif(volume, 0) AS taker_ratio, {rank("volume", 50)} AS volume_rank, vwap, vwap_sigma FROM q"""


@query("i19_volume", _VOLUME, "clv delta mfi_14 obv cmf_20 cvd_daily cvd_7 volume_z rvol taker_ratio volume_rank vwap vwap_sigma")
def _(spark, d):
    """Volume measures and daily VWAP with deviation."""
    return I.volume_measures(B.bars_of_events(spark, d)).select("series_id", "ts", "clv", "delta", "mfi_14", "obv", "cmf_20", "cvd_daily", "cvd_7", "volume_z", "rvol", "taker_ratio", "volume_rank", "vwap", "vwap_sigma")


_MOMENTUM = f"""WITH {bars_sql()}, x AS (SELECT *, ln(close / lag(close, 5) OVER ({W})) AS roc_5, ln(close / lag(close, 10) OVER ({W})) AS roc_10, ln(close / lag(close, 20) OVER ({W})) AS roc_20, CASE WHEN close > lag(close, 5) OVER ({W}) THEN 1 ELSE 0 END AS above FROM bars)
SELECT series_id, ts, roc_5, roc_10, roc_20, {zs("roc_10", 50)} AS roc_10_z, CASE WHEN low <= ({roll("min", "low", 20)}) * 1.005 THEN 1 ELSE 0 END AS near_low, {roll("min", "above", 3)} AS up_confirmed FROM x"""


@query("i11_momentum", _MOMENTUM, "roc_5 roc_10 roc_20 roc_10_z")
def _(spark, d):
    """Rates of change and confirmations."""
    return slicing.sliced(B.bars_of_events(spark, d), I.momentum, 62).select("series_id", "ts", "roc_5", "roc_10", "roc_20", "roc_10_z", "near_low", "up_confirmed")


_SESSION = f"""WITH {bars_sql()}, x AS (SELECT *, ts - INTERVAL '5 hours' AS ny FROM bars), y AS (SELECT *, hour(ny) * 60 + minute(ny) AS m FROM x)
SELECT series_id, ts, CAST(m AS INTEGER) AS ny_minute, CASE WHEN m >= 1200 OR m < 60 THEN 'asia' WHEN m >= 120 AND m < 300 THEN 'london' WHEN m >= 420 AND m < 600 THEN 'new_york' ELSE 'none' END AS session,
CASE WHEN (m >= 180 AND m < 240) OR (m >= 600 AND m < 660) OR (m >= 840 AND m < 900) THEN 1 ELSE 0 END AS silver_bullet, CASE WHEN m >= 720 AND m < 780 THEN 1 ELSE 0 END AS lunch, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
first(open) OVER ({_D}) AS midnight_open, last(CASE WHEN m >= 510 THEN open END IGNORE NULLS) OVER ({_D}) AS ny_open FROM y"""


@query("i29_sessions", _SESSION, "hour_sin hour_cos midnight_open ny_open")
def _(spark, d):
    """Sessions by New York time, which is five hours behind in January."""
    return I.sessions(B.bars_of_events(spark, d)).select("series_id", "ts", "ny_minute", "session", "silver_bullet", "lunch", "weekday", "hour_sin", "hour_cos", "midnight_open", "ny_open")


_P = f"({W} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)"
_REGIME = f"""WITH {bars_sql()}, x AS (SELECT *, ln(close / {LAG}) AS r FROM bars), y AS (SELECT *, {roll("stddev_samp", "r", 20)} AS rv FROM x),
z AS (SELECT *, CASE WHEN count(rv) OVER {_P} >= 50 THEN quantile_cont(rv, {1 / 3!r}) OVER {_P} END AS lo, CASE WHEN count(rv) OVER {_P} >= 50 THEN quantile_cont(rv, {2 / 3!r}) OVER {_P} END AS hi FROM y),
q AS (SELECT *, CASE WHEN rv IS NULL OR lo IS NULL THEN -1 WHEN rv <= lo THEN 0 WHEN rv <= hi THEN 1 ELSE 2 END AS regime FROM z), i AS (SELECT *, CASE WHEN bar_idx = 0 OR regime <> lag(regime) OVER ({W}) THEN 1 ELSE 0 END AS changed FROM q),
u AS (SELECT *, CAST(sum(changed) OVER ({W}) AS BIGINT) AS regime_run, {rank("rv", 60)} AS rv_rank FROM i)
SELECT series_id, ts, rv, regime, regime_run, CAST(row_number() OVER (PARTITION BY series_id, regime_run ORDER BY ts) AS INTEGER) AS regime_age, pow(({roll("stddev_samp", "r", 24)}), 2) / nullif(pow(({roll("stddev_samp", "r", 96)}), 2), 0) AS variance_ratio, rv_rank, CASE WHEN rv_rank < 0.33 THEN 0 WHEN rv_rank > 0.67 THEN 2 ELSE 1 END AS rv_class FROM u"""


@query("i38_regimes", _REGIME, "rv variance_ratio rv_rank")
def _(spark, d):
    """Regimes by past terciles and by percentile, runs, variance ratio."""
    return I.regimes(B.bars_of_events(spark, d)).select("series_id", "ts", "rv", "regime", "regime_run", "regime_age", "variance_ratio", "rv_rank", "rv_class")


_REGIME_STATS = f"""WITH g AS ({_REGIME}), r AS (SELECT series_id, regime, regime_run, count(*) AS n, avg(rv) AS rv FROM g GROUP BY 1, 2, 3)
SELECT series_id, regime, count(*) AS runs, CAST(sum(n) AS BIGINT) AS bars, avg(n) AS mean_length, median(n) AS median_length, CAST(max(n) AS BIGINT) AS longest FROM r GROUP BY 1, 2"""


@query("a15_regime_runs", _REGIME_STATS, "mean_length median_length")
def _(spark, d):
    """Lengths of regime runs."""
    F = I.F
    runs = I.regimes(B.bars_of_events(spark, d)).groupBy("series_id", "regime", "regime_run").agg(F.count("*").alias("n"))
    return runs.groupBy("series_id", "regime").agg(F.count("*").alias("runs"), F.sum("n").alias("bars"), F.avg("n").alias("mean_length"), F.median("n").alias("median_length"), F.max("n").alias("longest"))
