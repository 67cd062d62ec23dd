"""Queries: market structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import bars as B
from tidebar.operators import indicators as I
from tidebar.operators import machines as M
from tidebar.operators import slicing
from tidebar.operators import structure as S
from tidebar.operators import sweeps as P
from tidebar.operators import zones as Z
from tidebar.plans import machine_sql as Q
from tidebar.plans.q_indicators import TR, W, roll
from tidebar.plans.registry import bars_sql, query

BASE = f"""{bars_sql()}, base AS (SELECT *, {roll("avg", "tr", 14)} AS atr FROM (SELECT *, {TR} AS tr FROM bars))"""


def base(spark, d):  # noqa: ANN001, ANN201
    return S.with_atr(B.bars_of_events(spark, d))


def in_slices(spark, d, f, back: int, ahead: int = 0):  # noqa: ANN001, ANN201
    """f over bars with their ATR (15 bars back) in slices of the series."""
    return slicing.sliced(B.bars_of_events(spark, d), lambda x: f(S.with_atr(x)), back + 15, ahead)


def _disp(side: str, up: str, gap: str, end: str) -> str:
    three = "abs(close - o2) / atr"
    single = f"(atr > 0 AND {up.format(c='close', o='open')} AND body >= 1.5 AND {end})"
    multi = f"(atr > 0 AND {up.format(c='close', o='open')} AND {up.format(c='c1', o='o1')} AND {up.format(c='c2', o='o2')} AND {three} >= 2)"
    n = f"disp_{side}"
    return f"""{n}_f AS (SELECT *, coalesce({single}, false) AS single_{side}, coalesce({single} OR {multi}, false) AS {n}, coalesce(CASE WHEN {gap} THEN 1 ELSE 0 END, 0) AS gap_{side} FROM {{source}}),
{n}_l AS (SELECT *, bar_idx - last(CASE WHEN {n} THEN bar_idx END IGNORE NULLS) OVER ({W}) AS age_{side}, last(CASE WHEN {n} THEN CASE WHEN single_{side} THEN body ELSE {three} END END IGNORE NULLS) OVER ({W}) AS s_{side}, last(CASE WHEN {n} THEN place END IGNORE NULLS) OVER ({W}) AS p_{side},
last(CASE WHEN {n} THEN gap_{side} END IGNORE NULLS) OVER ({W}) AS g_{side}, last(CASE WHEN {n} THEN CASE WHEN single_{side} THEN 0 ELSE 1 END END IGNORE NULLS) OVER ({W}) AS m_{side} FROM {n}_f)"""


DISP = f"""props AS (SELECT *, abs(close - open) / atr AS body, (close - low) / greatest(high - low, 1e-9) AS place, lag(open, 2) OVER ({W}) AS o2, lag(open) OVER ({W}) AS o1, lag(close) OVER ({W}) AS c1, lag(close, 2) OVER ({W}) AS c2, lag(high, 2) OVER ({W}) AS h2, lag(low, 2) OVER ({W}) AS l2 FROM {{source}}),
{_disp("bull", "{c} > {o}", "low > h2", "place >= 0.75").replace("{source}", "props")}, {_disp("bear", "{c} < {o}", "high < l2", "place <= 0.25").replace("{source}", "disp_bull_l")}"""
_SIDE = lambda s: f"CAST(disp_{s} AS INTEGER) AS disp_{s}, CASE WHEN age_{s} <= 48 THEN age_{s} END AS disp_{s}_age, CASE WHEN age_{s} <= 48 THEN s_{s} END AS disp_{s}_strength, CASE WHEN age_{s} <= 48 THEN p_{s} END AS disp_{s}_close_loc, CASE WHEN age_{s} <= 48 THEN g_{s} END AS disp_{s}_has_fvg, CASE WHEN age_{s} <= 48 THEN m_{s} END AS disp_{s}_is_multi"
_DISP_OUT = [f"disp_{s}{x}" for s in ("bull", "bear") for x in ("", "_age", "_strength", "_close_loc", "_has_fvg", "_is_multi")]


@query("m1_displacement", f"WITH {BASE}, {DISP.format(source='base')} SELECT series_id, ts, {_SIDE('bull')}, {_SIDE('bear')} FROM disp_bear_l", "disp_bull_strength disp_bull_close_loc disp_bear_strength disp_bear_close_loc")
def _(spark, d):
    """Displacements and their latched properties."""
    return in_slices(spark, d, S.displacement, 51).select("series_id", "ts", *_DISP_OUT)


def swing_sql(source: str, n: int = 3, p: str = "") -> str:
    f = f"({W} ROWS {2 * n} PRECEDING)"
    return f"""{p}sw AS (SELECT *, CASE WHEN bar_idx >= {2 * n} AND lag(high, {n}) OVER ({W}) >= max(high) OVER {f} THEN lag(high, {n}) OVER ({W}) END AS {p}sh, CASE WHEN bar_idx >= {2 * n} AND lag(low, {n}) OVER ({W}) <= min(low) OVER {f} THEN lag(low, {n}) OVER ({W}) END AS {p}sl FROM {source}),
{p}lv AS (SELECT *, last({p}sh IGNORE NULLS) OVER ({W}) AS {p}last_high, last({p}sl IGNORE NULLS) OVER ({W}) AS {p}last_low FROM {p}sw),
{p}br AS (SELECT *, CASE WHEN close > {p}last_high THEN 1 WHEN close < {p}last_low THEN -1 ELSE 0 END AS {p}b FROM {p}lv),
{p}tr AS (SELECT *, coalesce(last(nullif({p}b, 0) IGNORE NULLS) OVER ({W}), 0) AS {p}trend FROM {p}br),
{p}st AS (SELECT *, CASE WHEN {p}b <> 0 AND {p}b = coalesce(lag({p}trend) OVER ({W}), 0) THEN {p}b ELSE 0 END AS {p}bos, CASE WHEN {p}b <> 0 AND {p}b = -coalesce(lag({p}trend) OVER ({W}), 0) THEN {p}b ELSE 0 END AS {p}choch, CASE WHEN low < {p}last_low THEN -1 WHEN high > {p}last_high THEN 1 ELSE 0 END AS {p}bos_wick FROM {p}tr)"""


def _sw(p: str) -> str:
    return f"CAST({p}sh IS NOT NULL AS INTEGER) AS {p}swing_high, CAST({p}sl IS NOT NULL AS INTEGER) AS {p}swing_low, {p}last_high, {p}last_low, {p}trend, {p}bos, {p}choch, {p}bos_wick"


@query("m2_swings", f"WITH {BASE}, {swing_sql('base')} SELECT series_id, ts, {_sw('')} FROM st", "last_high last_low")
def _(spark, d):
    """Swings, breaks of structure and changes of character."""
    return S.swings(base(spark, d)).select("series_id", "ts", "swing_high", "swing_low", "last_high", "last_low", "trend", "bos", "choch", "bos_wick")


_DUAL = f"WITH {BASE}, {swing_sql('base', 5, 'int_')}, {swing_sql('int_st', 10, 'ext_')} SELECT series_id, ts, {_sw('int_')}, {_sw('ext_')}, (int_last_high - close) / nullif(atr, 0) AS int_to_high, (close - ext_last_low) / nullif(atr, 0) AS ext_to_low FROM ext_st"


@query("m3_dual_swings", _DUAL, "int_last_high int_last_low ext_last_high ext_last_low int_to_high ext_to_low")
def _(spark, d):
    """Two layers of swings with distances in ATR (M3)."""
    x = S.swings(S.swings(base(spark, d), 5, "int_"), 10, "ext_")
    a = F.nullif(F.col("atr"), F.lit(0.0))
    names = [f"{p}{c}" for p in ("int_", "ext_") for c in ("swing_high", "swing_low", "last_high", "last_low", "trend", "bos", "choch", "bos_wick")]
    return x.select("series_id", "ts", *names, ((F.col("int_last_high") - F.col("close")) / a).alias("int_to_high"), ((F.col("close") - F.col("ext_last_low")) / a).alias("ext_to_low"))


def _ob(side: str, cond: str, sign: int, source: str) -> str:
    f = f"({W} ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)"
    return f"""o1_{side} AS (SELECT *, last(CASE WHEN {cond} THEN greatest(open, close) END IGNORE NULLS) OVER {f} AS ft_{side}, last(CASE WHEN {cond} THEN least(open, close) END IGNORE NULLS) OVER {f} AS fb_{side} FROM {source}),
o2_{side} AS (SELECT *, last(CASE WHEN bos = {sign} THEN bar_idx END IGNORE NULLS) OVER ({W}) AS at_{side} FROM o1_{side}), o3_{side} AS (SELECT x.*, y.ft_{side} AS t_{side}, y.fb_{side} AS b_{side} FROM o2_{side} x LEFT JOIN o1_{side} y ON x.series_id = y.series_id AND x.at_{side} = y.bar_idx)"""


_OBC = lambda s: f"t_{s} AS ob_{s}_top, b_{s} AS ob_{s}_bot, (t_{s} + b_{s}) / 2 AS ob_{s}_mid, CASE WHEN t_{s} IS NOT NULL THEN bar_idx - at_{s} END AS ob_{s}_age, CAST(coalesce(low <= t_{s} AND high >= b_{s}, false) AS INTEGER) AS ob_{s}_in_zone"


@query("m4_order_blocks", f"WITH {BASE}, {swing_sql('base')}, {_ob('bull', 'close < open', 1, 'st')}, {_ob('bear', 'close > open', -1, 'o3_bull')} SELECT series_id, ts, {_OBC('bull')}, {_OBC('bear')} FROM o3_bear", "ob_bull_top ob_bull_bot ob_bull_mid ob_bear_top ob_bear_bot ob_bear_mid")
def _(spark, d):
    """Order blocks of both directions (M4)."""
    return S.order_blocks(S.swings(base(spark, d))).select("series_id", "ts", *(f"ob_{s}_{x}" for s in ("bull", "bear") for x in ("top", "bot", "mid", "age", "in_zone")))


def _quality(side: str, test: str, sign: int, source: str) -> str:
    return f"""q_{side} AS (SELECT *, last(CASE WHEN {test} THEN q END IGNORE NULLS) OVER ({W} ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS f_{side} FROM {source}), k_{side} AS (SELECT *, last(CASE WHEN bos = {sign} THEN {{'at': bar_idx, 'q': f_{side}}} END IGNORE NULLS) OVER ({W}) AS e_{side} FROM q_{side})"""


_QUALITY = f"""WITH {BASE}, {swing_sql("base")}, r AS (SELECT *, abs(close - open) / nullif(atr, 0) * volume / ({roll("avg", "volume", 20, 1)}) AS q FROM st), {_quality("bull", "close < open", 1, "r")}, {_quality("bear", "close > open", -1, "k_bull")}
SELECT series_id, ts, e_bull.q / (bar_idx - e_bull.at + 1) AS ob_bull_quality, e_bear.q / (bar_idx - e_bear.at + 1) AS ob_bear_quality FROM k_bear"""


@query("m14_ob_quality", _QUALITY, "ob_bull_quality ob_bear_quality")
def _(spark, d):
    """Quality of order blocks, fixed when they form."""
    return S.ob_quality(S.swings(base(spark, d))).select("series_id", "ts", "ob_bull_quality", "ob_bear_quality")


def gap_sql(side: str) -> str:
    born, dies = ("low - h2 > coalesce(atr * 0.5, 0)", "c.close <= g.top") if side == "bull" else ("l2 - high > coalesce(atr * 0.5, 0)", "c.close >= g.bot")
    top, bot = ("low", "h2") if side == "bull" else ("l2", "high")
    return f"""g_{side} AS (SELECT series_id, bar_idx AS birth, {top} AS top, {bot} AS bot FROM (SELECT *, lag(high, 2) OVER ({W}) AS h2, lag(low, 2) OVER ({W}) AS l2 FROM base) WHERE {born}),
e_{side} AS (SELECT g.series_id, g.birth, any_value(g.top) AS top, any_value(g.bot) AS bot, min(c.bar_idx) AS death FROM g_{side} g LEFT JOIN base c ON c.series_id = g.series_id AND c.bar_idx > g.birth AND c.bar_idx < g.birth + 100 AND {dies} GROUP BY 1, 2),
a_{side} AS (SELECT b.series_id, b.bar_idx, b.close, b.low, b.high, e.* EXCLUDE (series_id) FROM base b JOIN e_{side} e ON b.series_id = e.series_id AND b.bar_idx >= e.birth AND b.bar_idx < coalesce(e.death, e.birth + 100)),
s_{side} AS (SELECT series_id, bar_idx, count(*) AS fvg_{side}_count, max(bar_idx) - max(birth) + 1 AS fvg_{side}_age, first(top ORDER BY least(abs(top - close), abs(bot - close)), birth) AS fvg_{side}_near_top, first(bot ORDER BY least(abs(top - close), abs(bot - close)), birth) AS fvg_{side}_near_bot, CAST(max(CASE WHEN low <= top AND high >= bot THEN 1 ELSE 0 END) AS INTEGER) AS fvg_{side}_in_zone FROM a_{side} GROUP BY 1, 2)"""


_GAPS = f"""WITH {BASE}, {gap_sql("bull")}, {gap_sql("bear")} SELECT series_id, ts, {", ".join(f"coalesce(fvg_{s}_count, 0) AS fvg_{s}_count, fvg_{s}_age, fvg_{s}_near_top, fvg_{s}_near_bot, coalesce(fvg_{s}_in_zone, 0) AS fvg_{s}_in_zone" for s in ("bull", "bear"))}
FROM base LEFT JOIN s_bull USING (series_id, bar_idx) LEFT JOIN s_bear USING (series_id, bar_idx)"""


@query("m6_gaps", _GAPS, "fvg_bull_near_top fvg_bull_near_bot fvg_bear_near_top fvg_bear_near_bot")
def _(spark, d):
    """Fair value gaps as intervals."""
    x = in_slices(spark, d, lambda b: S.gaps(S.gaps(b, "bull"), "bear"), 102)
    return x.select("series_id", "ts", *(f"fvg_{s}_{c}" for s in ("bull", "bear") for c in ("count", "age", "near_top", "near_bot", "in_zone")))


_RANGES = f"""WITH {BASE}, {swing_sql("base")}, q AS (SELECT *, least(1, greatest(0, (close - last_low) / nullif(last_high - last_low, 0))) AS place, (last_high - close) / nullif(last_high - last_low, 0) AS back FROM st)
SELECT series_id, ts, CASE WHEN last_low IS NULL OR last_high IS NULL OR last_high = last_low THEN NULL ELSE place END AS range_place, CAST(coalesce(place > 0.5 AND back IS NOT NULL, false) AS INTEGER) AS premium, CAST(coalesce(place < 0.5 AND back IS NOT NULL, false) AS INTEGER) AS discount,
CAST(coalesce(back >= 0.618 AND back <= 0.786, false) AS INTEGER) AS ote, abs(back - 0.705) AS ote_distance, CAST(coalesce(abs(back - 0.705) < 0.05, false) AS INTEGER) AS ote_near FROM q"""


@query("m12_ranges", _RANGES, "range_place ote_distance")
def _(spark, d):
    """Premium, discount and retracement band of the swing range."""
    x = S.ranges(S.swings(base(spark, d)))
    both = F.col("last_low").isNotNull() & F.col("last_high").isNotNull() & (F.col("last_high") != F.col("last_low"))
    return x.select("series_id", "ts", F.when(both, F.col("range_place")).alias("range_place"), *((F.when(both, F.col(c)).otherwise(0)).alias(c) for c in ("premium", "discount")), "ote", "ote_distance", "ote_near")


_MSS = f"""WITH {BASE}, {swing_sql("base")}, {DISP.format(source="st")}, q AS (SELECT *, CASE WHEN choch = 1 AND max(CAST(disp_bull AS INTEGER)) OVER w = 1 THEN 1 ELSE 0 END AS mss_bull, CASE WHEN choch = -1 AND max(CAST(disp_bear AS INTEGER)) OVER w = 1 THEN 1 ELSE 0 END AS mss_bear FROM disp_bear_l WINDOW w AS ({W} ROWS 3 PRECEDING)),
z AS (SELECT *, bar_idx - last(CASE WHEN mss_bull = 1 THEN bar_idx END IGNORE NULLS) OVER ({W}) AS ab, bar_idx - last(CASE WHEN mss_bear = 1 THEN bar_idx END IGNORE NULLS) OVER ({W}) AS ar FROM q)
SELECT series_id, ts, mss_bull, CASE WHEN ab <= 24 THEN ab END AS mss_bull_age, mss_bear, CASE WHEN ar <= 24 THEN ar END AS mss_bear_age FROM z"""


@query("m16_structure_shift", _MSS)
def _(spark, d):
    """Structure shifts with displacement."""
    return S.shifts(S.displacement(S.swings(base(spark, d)))).select("series_id", "ts", "mss_bull", "mss_bull_age", "mss_bear", "mss_bear_age")


def _event(side: str, top: str, bot: str, fill: str, best: str) -> str:
    return f"""SELECT g.series_id, g.ts AS confirmed_at, '{side}' AS direction, g.{top} AS gap_top, g.{bot} AS gap_bottom, g.{top} - g.{bot} AS gap_size, g.close AS close_price,
(SELECT min(f.bar_idx) - g.bar_idx FROM x f WHERE f.series_id = g.series_id AND f.bar_idx > g.bar_idx AND f.bar_idx <= g.bar_idx + 48 AND {fill}) AS bars_to_fill, g.bar_idx FROM x g WHERE g.{top} > g.{bot}"""


_EVENTS = f"""WITH {BASE}, x AS (SELECT *, lag(high, 2) OVER ({W}) AS h2, lag(low, 2) OVER ({W}) AS l2 FROM base), e AS ({_event("bull", "low", "h2", "f.low <= g.h2", "")} UNION ALL {_event("bear", "l2", "high", "f.high >= g.l2", "")})
SELECT e.* EXCLUDE (bar_idx), greatest(0, (SELECT max(CASE WHEN direction = 'bull' THEN f.high - close_price ELSE close_price - f.low END) FROM x f WHERE f.series_id = e.series_id AND f.bar_idx > e.bar_idx AND f.bar_idx <= e.bar_idx + coalesce(bars_to_fill, 48))) AS best_before_fill FROM e"""


@query("m28_gap_events", _EVENTS, "gap_top gap_bottom gap_size close_price best_before_fill")
def _(spark, d):
    """A record for each gap with its fill."""
    return S.gap_events(base(spark, d))


_PO3W = "(PARTITION BY series_id, day ORDER BY ts)"
_PO3 = f"""WITH {bars_sql()}, y AS (SELECT *, (hour(ts) * 60 + minute(ts) + 1140) % 1440 AS m, CAST(ts + INTERVAL '4 hours' AS DATE) AS day FROM bars), s AS (SELECT *, CASE WHEN m >= 1200 OR m < 60 THEN 'asia' WHEN m >= 120 AND m < 300 THEN 'london' WHEN m >= 420 AND m < 600 THEN 'new_york' ELSE 'none' END AS session FROM y),
a AS (SELECT *, max(CASE WHEN session = 'asia' THEN high END) OVER {_PO3W} AS asia_high, min(CASE WHEN session = 'asia' THEN low END) OVER {_PO3W} AS asia_low FROM s), o AS (SELECT *, max(CASE WHEN session = 'london' AND high > asia_high THEN 1 END) OVER {_PO3W} AS over, max(CASE WHEN session = 'london' AND low < asia_low THEN 1 END) OVER {_PO3W} AS under FROM a),
p AS (SELECT *, CASE WHEN under = 1 AND over IS NULL THEN 1 WHEN over = 1 AND under IS NULL THEN -1 ELSE 0 END AS po3_bias FROM o) SELECT series_id, ts, session, asia_high, asia_low, po3_bias, CAST(coalesce(po3_bias <> 0 AND sign(close - (asia_high + asia_low) / 2) = po3_bias, false) AS INTEGER) AS po3_confirmed FROM p"""


@query("m25_power_of_three", _PO3, "asia_high asia_low")
def _(spark, d):
    """Asia range, London sweep, confirmation."""
    return S.power_of_three(I.sessions(base(spark, d))).select("series_id", "ts", "session", "asia_high", "asia_low", "po3_bias", "po3_confirmed")


_X = f"WITH {BASE}, {swing_sql('base')}, x AS (SELECT *, CAST(sh IS NOT NULL AS INTEGER) AS swing_high, CAST(sl IS NOT NULL AS INTEGER) AS swing_low FROM st)"

_SWEPT = " ".join(f"{c}_{s}{e}" for s in ("bsl", "ssl") for c, e in (("sweep", "_pen_atr"), ("unswept", "_atr")))
_BLOCKS = " ".join(f"ob_{s}_{c}" for s in ("bull", "bear") for c in ("count", "nearest_atr", *(f"{k}_{f}" for k in range(1, Z.SHOWN + 1) for f in Z.FIELDS)))

for _name, _machine, _why, _sql, _floats in (
    ("m5_anchored_blocks", Z.anchored_blocks, "Order blocks anchored at displacements, best three of each side, 82 columns (M5, W22)", Z.sql(f"WITH {BASE}, {swing_sql('base')}"), _BLOCKS),
    ("m7_tracked_gaps", M.tracked_gaps, "Gaps with middle touches, rejections and inversion, best three (M7)", None, ""),
    ("m9_liquidity", M.liquidity_levels, "Intact swing levels, nearest ones and equal highs and lows (M9, M23)", Q.liquidity_sql(_X), "liq_above_pct liq_below_pct"),
    ("m10_sweeps", P.sweeps, "Sweeps of clustered levels with confirmation (M10, M18)", P.sql(_X), _SWEPT),
    ("m13_delivery_change", M.delivery_change, "Changes in the state of delivery (M13, M26)", Q.delivery_sql(_X), ""),
    ("m15_breakers", M.breakers, "Order blocks that turned into breakers (M15)", Q.breakers_sql(_X), "breaker_bull_dist breaker_bear_dist"),
    ("i16_supertrend", M.supertrend, "Ratcheting bands and their flips (I16)", Q.supertrend_sql(_X), "supertrend"),
):

    def _run(spark, d, machine=_machine):  # noqa: ANN001, ANN202
        return machine(S.displacement(S.swings(base(spark, d))))

    _run.__doc__ = _why
    query(_name, _sql, _floats)(_run)


_FIRES = lambda s: f"coalesce(n_{s} > lag(n_{s}) OVER ({W}), false) AND max(d_{s}) OVER ({W} ROWS 6 PRECEDING) = 1 AND max(w_{s}) OVER ({W} ROWS 12 PRECEDING) = 1 AS f_{s}"
_SEQUENCE = f"""{P.with_sql(_X)}, {gap_sql("bull")}, {gap_sql("bear")}, {DISP.format(source="base")}, j AS (SELECT d.series_id, d.ts, d.bar_idx, coalesce(fvg_bull_count, 0) AS n_bull, coalesce(fvg_bear_count, 0) AS n_bear, CAST(disp_bull AS INTEGER) AS d_bull, CAST(disp_bear AS INTEGER) AS d_bear, sweep_ssl_fired AS w_bull, sweep_bsl_fired AS w_bear
FROM disp_bear_l d JOIN bsl_o USING (series_id, bar_idx) JOIN ssl_o USING (series_id, bar_idx) LEFT JOIN s_bull USING (series_id, bar_idx) LEFT JOIN s_bear USING (series_id, bar_idx)), k AS (SELECT *, {_FIRES("bull")}, {_FIRES("bear")} FROM j)
SELECT series_id, ts, {", ".join(f"CAST(f_{s} AS INTEGER) AS sequence_{s}, bar_idx - last(CASE WHEN f_{s} THEN bar_idx END IGNORE NULLS) OVER ({W}) AS sequence_{s}_age" for s in ("bull", "bear"))} FROM k"""


@query("m11_sweep_sequence", _SEQUENCE)
def _(spark, d):
    """Gap after displacement after sweep."""
    x = S.gaps(S.gaps(S.displacement(S.swings(base(spark, d))), "bull"), "bear")
    fired = P.sweeps(S.swings(base(spark, d))).select("series_id", "bar_idx", F.col("sweep_bsl_fired").alias("sweep_bsl"), F.col("sweep_ssl_fired").alias("sweep_ssl"))
    return S.sweep_sequences(x.join(fired, ["series_id", "bar_idx"])).select("series_id", "ts", "sequence_bull", "sequence_bull_age", "sequence_bear", "sequence_bear_age")
