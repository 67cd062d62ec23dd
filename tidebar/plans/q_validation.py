"""Queries: validation statistics, regimes, models."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from tidebar.operators import bars as B
from tidebar.operators import backtest as T
from tidebar.operators import hmm
from tidebar.operators import indicators as I
from tidebar.operators import labels as L
from tidebar.operators import rolling as R
from tidebar.operators import validation as V
from tidebar.plans.machine_sql import normal_sql
from tidebar.plans.q_indicators import _ADX, W, rank, roll
from tidebar.plans.q_structure import BASE, base
from tidebar.plans.q_trading import taken_sql, trades
from tidebar.plans.registry import daily_sql, query
from tidebar.sources.tables import table

PROBS = "probs AS (SELECT event_type AS series_id, event_id, (event_id * 7919 % 101) / 100.0::DOUBLE AS p, CASE WHEN (user_id + event_id) % 3 = 0 THEN 1 ELSE 0 END AS y FROM events)"


def probs(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "events").select(F.col("event_type").alias("series_id"), "event_id", (F.col("event_id") * 7919 % 101 / 100.0).alias("p"), F.when((F.col("user_id") + F.col("event_id")) % 3 == 0, 1).otherwise(0).alias("y"))


@query("a17_auc", f"WITH {PROBS}, r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY series_id, p) - 1) / 2.0 AS k FROM probs WINDOW w AS (PARTITION BY series_id ORDER BY p)) SELECT series_id, (sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc, count(*) AS n FROM r GROUP BY 1", "auc")
def _(spark, d):
    """ROC area by average ranks."""
    return V.auc(probs(spark, d), "p", "y", ("series_id",))


_ECE = f"WITH {PROBS}, b AS (SELECT series_id, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my, sum(-(y * ln(least(1 - 1e-10, greatest(1e-10, p))) + (1 - y) * ln(1 - least(1 - 1e-10, greatest(1e-10, p))))) AS loss FROM probs GROUP BY 1, 2) SELECT series_id, sum(n * abs(mp - my)) / sum(n) AS ece, sum(loss) / sum(n) AS log_loss FROM b GROUP BY 1"


@query("a18_calibration", _ECE, "ece log_loss")
def _(spark, d):
    """Calibration error and log loss."""
    return V.calibration(probs(spark, d), "p", "y", by=("series_id",))


_CUTS = [0.3 + 0.05 * k for k in range(12)]
_THRESHOLDS = f"WITH {PROBS}, c AS (SELECT unnest(CAST({_CUTS!r} AS DOUBLE[])) AS threshold), t AS (SELECT threshold, count(*) AS n, CAST(sum(y) AS BIGINT) AS wins FROM probs JOIN c ON p >= threshold GROUP BY 1), a AS (SELECT sum(y) AS w FROM probs) SELECT threshold, n, wins / n AS precision, wins / w AS recall, wins / n * 2 - (1 - wins / n) AS ev, wins * 2.0 / nullif(n - wins, 0) AS profit_factor FROM t, a"


@query("a20_thresholds", _THRESHOLDS, "threshold precision recall ev profit_factor")
def _(spark, d):
    """Metrics by probability threshold."""
    return V.thresholds(probs(spark, d), "p", "y", _CUTS)


_CSCV = f"""{taken_sql(3)}, b AS (SELECT *, CAST(least(7, floor((row_number() OVER (PARTITION BY series_id ORDER BY bar_idx) - 1) / greatest(1, floor(count(*) OVER (PARTITION BY series_id) / 8)))) AS INTEGER) AS block FROM trades), s AS (SELECT series_id, block, sum(r) AS s, count(*) AS n FROM b GROUP BY 1, 2),
m AS (SELECT range AS mask FROM range(256) WHERE bit_count(CAST(range AS INTEGER)) = 4), halves AS (SELECT series_id, mask, sum(CASE WHEN (mask >> block) & 1 = 1 THEN s END) / sum(CASE WHEN (mask >> block) & 1 = 1 THEN n END) AS i, sum(CASE WHEN (mask >> block) & 1 = 0 THEN s END) / sum(CASE WHEN (mask >> block) & 1 = 0 THEN n END) AS o FROM s, m GROUP BY 1, 2)
SELECT series_id, avg(CASE WHEN o <= 0 THEN 1.0::DOUBLE ELSE 0 END) AS pbo, count(*) AS splits, avg(o) AS oos_mean, median(o) AS oos_median, stddev_pop(o) AS oos_std, corr(i, o) AS is_oos_corr FROM halves WHERE i IS NOT NULL AND o IS NOT NULL GROUP BY 1"""


@query("v4_cscv", _CSCV, "pbo oos_mean oos_median oos_std is_oos_corr")
def _(spark, d):
    """Combinatorially symmetric cross-validation (V4)."""
    return V.cscv(trades(spark, d, 3))


_PSR = f"""{taken_sql(3)}, m AS (SELECT series_id, count(*) AS n, avg(r) / nullif(stddev_samp(r), 0) AS sharpe, skewness(r) AS skew, kurtosis(r) + 3 AS kurt FROM trades GROUP BY 1) SELECT *, sharpe * sqrt(n - 1) / sqrt(CASE WHEN 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe <= 0 THEN 1 ELSE 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe END) AS z FROM m"""


@query("v5_sharpe_test", _PSR, "sharpe skew kurt z")
def _(spark, d):
    """Moments and z score of the probabilistic Sharpe ratio (V5)."""
    return V.sharpe_test(trades(spark, d, 3))


@query("v5_psr", f"SELECT *, {normal_sql('z')} AS psr FROM ({_PSR})", "sharpe skew kurt z psr")
def _(spark, d):
    """The probabilistic Sharpe ratio itself (V5)."""
    return V.sharpe_test(trades(spark, d, 3)).withColumn("psr", V.normal_cdf(F.col("z")))


_DEFLATED = f"""SELECT series_id, {normal_sql(f"((sharpe - {V.expected_best(100)!r}) / sqrt((1 + 0.5 * sharpe * sharpe - skew * sharpe + (kurt - 3) / 4 * sharpe * sharpe) / n))")} AS dsr FROM (SELECT series_id, n, coalesce(sharpe, 0) AS sharpe, coalesce(skew, 0) AS skew, coalesce(kurt, 3) AS kurt FROM ({_PSR}))"""


@query("v6_deflated_sharpe", _DEFLATED, "dsr")
def _(spark, d):
    """Deflated Sharpe ratios from a row of moments for each series (V6)."""
    m = V.sharpe_test(trades(spark, d, 3)).na.fill({"sharpe": 0.0, "skew": 0.0, "kurt": 3.0})
    return m.select("series_id", V.deflated(100, F.col("sharpe"), F.col("n"), F.col("skew"), F.col("kurt")).alias("dsr"))


_BOOT = f"""{taken_sql(3)}, blocks AS (SELECT series_id, row_number() OVER ({W}) - 1 AS spot, sum(r) OVER ({W} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s, count(*) OVER ({W} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS m FROM trades), sizes AS (SELECT series_id, count(*) AS n FROM blocks GROUP BY 1),
picks AS (SELECT series_id, draw, CAST('0x' || substr(md5('42-' || draw || '-' || b), 1, 8) AS BIGINT) % greatest(n - 4, 1) AS spot FROM (SELECT *, unnest(range(1, CAST(ceil(n / 5) AS BIGINT) + 1)) AS b FROM (SELECT series_id, n, unnest(range(1, 501)) AS draw FROM sizes))),
means AS (SELECT series_id, draw, sum(s) / sum(m) AS mean FROM picks JOIN blocks USING (series_id, spot) GROUP BY 1, 2) SELECT series_id, quantile_cont(mean, 0.025) AS lower, quantile_cont(mean, 0.975) AS upper, avg(CASE WHEN mean > 0 THEN 1.0::DOUBLE ELSE 0 END) AS positive FROM means GROUP BY 1"""


@query("v7_bootstrap", _BOOT, "lower upper positive")
def _(spark, d):
    """Block bootstrap intervals with hash-seeded starts (V7)."""
    return V.bootstrap(trades(spark, d, 3), 500)


_EXPAND = f"""{taken_sql(3)}, ordered AS (SELECT *, row_number() OVER ({W}) - 1 AS pos FROM trades), w AS (SELECT series_id, CAST(floor((pos - 40) / 25) AS BIGINT) AS k, count(*) AS test_n, avg(r) AS test_mean, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) AS test_wr, min(pos) AS a FROM ordered WHERE pos >= 40 GROUP BY 1, 2)
SELECT w.series_id, w.k + 1 AS "window", w.a AS train_n, any_value(w.test_n) AS test_n, avg(x.r) AS train_mean, any_value(w.test_mean) AS test_mean, avg(CASE WHEN x.r > 0 THEN 1.0::DOUBLE ELSE 0 END) AS train_wr, any_value(w.test_wr) AS test_wr FROM w JOIN ordered x ON x.series_id = w.series_id AND x.pos < w.a WHERE w.test_n >= 5 GROUP BY 1, 2, 3"""


@query("v8_expanding", _EXPAND, "train_mean test_mean train_wr test_wr")
def _(spark, d):
    """Expanding walk-forward over trades (V8)."""
    return V.expanding(trades(spark, d, 3))


_FOLDS = f"""WITH {daily_sql()}, s AS (SELECT unnest(range(290, n, 60)) AS start, n FROM (SELECT max(bar_idx) + 1 AS n FROM bars)), v AS (SELECT row_number() OVER (ORDER BY start) AS fold, start, least(start + 60, n) AS test_end, start - 5 AS free, start - 5 - greatest(CAST(floor((start - 5) * 0.1) AS BIGINT), 50) AS val FROM s),
r AS (SELECT fold, CASE WHEN bar_idx < val - 24 THEN 'train' WHEN bar_idx >= val AND bar_idx < start - 48 THEN 'validate' WHEN bar_idx >= start AND bar_idx < test_end THEN 'test' END AS role FROM bars JOIN v ON bar_idx < test_end) SELECT CAST(fold AS BIGINT) AS fold, role, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY 1, 2"""


@query("v1_folds", _FOLDS)
def _(spark, d):
    """Walk-forward folds with embargo and purging, to the end of the longest series."""
    return V.fold_counts(B.daily_bars_of_orders(spark, d), 285, 60, 5, 24, 48, least=50)


_LO = f"""WITH {daily_sql()}, d AS (SELECT series_id, ts AS day, close / open - 1 AS r FROM bars), m AS (SELECT *, r - avg(r) OVER (PARTITION BY series_id) AS x FROM d), l AS (SELECT *, {", ".join(f"x * lag(x, {k}) OVER (PARTITION BY series_id ORDER BY day) AS l{k}" for k in range(1, 11))} FROM m),
s AS (SELECT series_id, avg(r) / sqrt(sum(x * x) / count(*)) AS sharpe, 1 + 2 * ({" + ".join(f"{1 - k / 11!r} * sum(l{k}) / sum(x * x)" for k in range(1, 11))}) AS eta2 FROM l GROUP BY 1) SELECT *, sharpe / sqrt(eta2) AS sharpe_adjusted FROM s"""


@query("v11_lo_sharpe", _LO, "sharpe eta2 sharpe_adjusted")
def _(spark, d):
    """Sharpe ratio corrected for autocorrelation."""
    x = B.daily_bars_of_orders(spark, d).select("series_id", F.col("ts").alias("day"), (F.col("close") / F.col("open") - 1).alias("r"))
    return V.autocorrelation_sharpe(x)


_TM = f"""WITH {daily_sql()}, d AS (SELECT series_id, ts, ln(close / open) AS r FROM bars), k AS (SELECT ts, avg(r) AS m FROM d GROUP BY 1), j AS (SELECT series_id, r AS y, m AS x, m * m AS z FROM d JOIN k USING (ts)),
c AS (SELECT series_id, avg(y) AS ay, avg(x) AS ax, avg(z) AS az, covar_pop(x, x) AS xx, covar_pop(x, z) AS xz, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM j GROUP BY 1), b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS beta, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS gamma FROM c) SELECT series_id, ay - beta * ax - gamma * az AS alpha, beta, gamma FROM b"""


@query("v12_timing_regression", _TM, "alpha beta gamma")
def _(spark, d):
    """Market timing regression from sums."""
    x = B.daily_bars_of_orders(spark, d).select("series_id", "ts", F.log(F.col("close") / F.col("open")).alias("r"))
    return V.timing_regression(x.join(x.groupBy("ts").agg(F.avg("r").alias("m")), "ts"), "r", "m", ("series_id",))


_ISO = f"""WITH {PROBS}, g AS (SELECT p, count(*) AS w, sum(y) AS s, row_number() OVER (ORDER BY p) AS i FROM probs GROUP BY 1), c AS (SELECT *, sum(w) OVER (ORDER BY i) AS cw, sum(s) OVER (ORDER BY i) AS cs FROM g),
jk AS (SELECT j.i AS j, k.i AS k, (k.cs - j.cs + j.s) / (k.cw - j.cw + j.w) AS a FROM c j JOIN c k ON j.i <= k.i), ji AS (SELECT c.i, c.p, jk.j, min(a) AS a FROM c JOIN jk ON jk.j <= c.i AND jk.k >= c.i GROUP BY 1, 2, 3), f AS (SELECT i, p, round(max(a), 9) AS calibrated FROM ji GROUP BY 1, 2)
SELECT p, calibrated FROM (SELECT *, lag(calibrated) OVER (ORDER BY i) AS before, lead(calibrated) OVER (ORDER BY i) AS after FROM f) WHERE calibrated IS DISTINCT FROM before OR calibrated IS DISTINCT FROM after"""


@query("v3_isotonic", _ISO, "p calibrated")
def _(spark, d):
    """Isotonic calibration (V3)."""
    return V.isotonic(probs(spark, d), "p", "y")


@query("v2_walk_forward_model")
def _(spark, d):
    """Boosted trees on walk-forward folds, out-of-sample probabilities."""
    x = I.momentum(L.triple_barrier(base(spark, d), (24,), (2,)))
    last = base(spark, d).agg(F.max("bar_idx")).first()[0]  # folds run to the end of the longest series
    x = x.select("series_id", "bar_idx", "roc_5", "roc_10", "volume", "label_long_hit_2r_24c")
    return V.boosted_folds(x, ["roc_5", "roc_10", "volume"], "label_long_hit_2r_24c", V.folds(0 if last is None else last + 1, 350, 150, 24, 24, least=50), 3)


_W3 = [0.5 ** ((2 - k) / 3) for k in range(3)]
_WS = [v / sum(_W3) for v in _W3]
_GATES = f"""{taken_sql(3)}, m AS (SELECT series_id, count(*) AS n, count(*) FILTER (r > 0) / count(*) AS win_rate, avg(r) AS ev, avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(*) / 0.082) AS sharpe FROM trades GROUP BY 1), g AS (SELECT *, coalesce(sharpe / 20, 0) AS a FROM m),
h AS (SELECT *, CAST(n >= 20 AS INTEGER) + CAST(win_rate >= 0.35 AS INTEGER) + CAST(ev <= 5 AS INTEGER) AS held, {_WS[0]!r} * a + {_WS[1] * 0.1 + _WS[2] * 0.2!r} AS mean FROM g)
SELECT series_id, held = 3 AS passed, held, CASE WHEN a < -0.5 THEN -999.0 ELSE round(mean - 0.3 * sqrt({_WS[0]!r} * pow(a - mean, 2) + {_WS[1]!r} * pow(0.1 - mean, 2) + {_WS[2]!r} * pow(0.2 - mean, 2)) - {12 * math.log2(31) * math.log(10_000) / 20_000 + 0.012!r}, 6) END AS gt_score FROM h"""


@query("v9_gates", _GATES, "gt_score")
def _(spark, d):
    """Gates over a metrics row of each series, and a search score."""
    m = T.metrics(trades(spark, d, 3), ("series_id",), 0.082)
    passed = V.gate_columns({"n": 20, "win_rate": 0.3}, {"ev": 5.0}, {"win_rate": 0.35})
    score = V.score_column([F.col("sharpe") / 20, F.lit(0.1), F.lit(0.2)], 10_000, 12)
    return m.select("series_id", reduce(and_, passed).alias("passed"), sum(p.cast("int") for p in passed).alias("held"), score.alias("gt_score"))


_IMPORTANCE = """WITH r AS (SELECT 'f' || (user_id % 40) AS feature, event_id % 5 AS fold, value - 20 AS value FROM events), p AS (SELECT feature, fold, avg(abs(value)) AS v FROM r GROUP BY 1, 2) SELECT feature, sum(v) / 5 AS mean_abs, sqrt(greatest(0, sum(v * v) / 5 - pow(sum(v) / 5, 2))) / nullif(sum(v) / 5, 0) AS cv FROM p GROUP BY 1 ORDER BY mean_abs DESC, feature LIMIT 30"""


@query("a26_importance", _IMPORTANCE, "mean_abs cv")
def _(spark, d):
    """Feature importance over folds, the best 30."""
    r = table(spark, d, "events").select(F.concat(F.lit("f"), F.col("user_id") % 40).alias("feature"), (F.col("event_id") % 5).alias("fold"), (F.col("value") - 20).alias("value"))
    return V.importance(r, 5, 30)


_RHO = """WITH r AS (SELECT 'f' || (user_id % 40) AS feature, event_id % 5 AS fold, round(avg(abs(value - 20)), 1) AS v FROM events GROUP BY 1, 2), k AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY v) + (count(*) OVER (PARTITION BY fold, v) - 1) / 2.0 AS x FROM r) SELECT a.fold AS a, b.fold AS b, corr(a.x, b.x) AS rho, count(*) AS n FROM k a JOIN k b ON a.feature = b.feature AND a.fold < b.fold GROUP BY 1, 2"""


@query("a25_rank_correlation", _RHO, "rho")
def _(spark, d):
    """Rank correlation between folds."""
    r = table(spark, d, "events").groupBy(F.concat(F.lit("f"), F.col("user_id") % 40).alias("feature"), (F.col("event_id") % 5).alias("fold")).agg(F.round(F.avg(F.abs(F.col("value") - 20)), 1).alias("v"))
    return V.rank_correlation(r, "feature", "fold", "v")


_CONTEXT = f"""WITH {daily_sql()}, s AS (SELECT *, {roll("avg", "close", 200)} AS sma, ln(close / lag(close) OVER ({W})) AS r FROM bars) SELECT series_id, count(*) AS days, first(close ORDER BY ts) AS first_close, last(close ORDER BY ts) AS last_close, min(low) AS lowest, max(high) AS highest, avg(CASE WHEN close > sma THEN 1.0::DOUBLE WHEN sma IS NOT NULL THEN 0 END) AS above_sma, avg(r) * 365 AS ann_return, stddev_samp(r) * sqrt(365) AS ann_vol, last(close ORDER BY ts) / first(open ORDER BY ts) - 1 AS buy_and_hold FROM s GROUP BY 1"""


@query("a34_market_context", _CONTEXT, "first_close last_close lowest highest above_sma ann_return ann_vol buy_and_hold")
def _(spark, d):
    """Context of a market and buy-and-hold."""
    x = B.daily_bars_of_orders(spark, d).withColumns({"sma": R.rolling(F.avg, "close", 200), "r": F.log(F.col("close") / F.lag("close").over(B.in_order()))})
    above = F.avg(F.when(F.col("sma").isNotNull(), (F.col("close") > F.col("sma")).cast("double")))
    return x.groupBy("series_id").agg(F.count("*").alias("days"), F.min_by("close", "ts").alias("first_close"), F.max_by("close", "ts").alias("last_close"), F.min("low").alias("lowest"), F.max("high").alias("highest"), above.alias("above_sma"), (F.avg("r") * 365).alias("ann_return"), (F.stddev_samp("r") * 365**0.5).alias("ann_vol"), (F.max_by("close", "ts") / F.min_by("open", "ts") - 1).alias("buy_and_hold"))


@query("i42_hmm")
def _(spark, d):
    """Three-state hidden Markov regimes, causal."""
    return hmm.regimes(B.daily_bars_of_orders(spark, d))


_CAUSAL = """WITH liq AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ts FROM orders) SELECT count(*) AS rows, count(day) AS matched, count(*) FILTER (day >= ts) AS violations FROM o LEFT JOIN liq ON ts = day + 1"""


@query("a36_causality", _CAUSAL)
def _(spark, d):
    """A lagged join never shows a day before it is over."""
    from tidebar.operators import joins as J

    liq = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct().withColumn("seen", F.col("day"))
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("ts")).distinct()
    return J.lagged_daily_join(o, liq, "day", ["seen"]).agg(F.count("*").alias("rows"), F.count("seen").alias("matched"), F.count_if(F.col("seen") >= F.col("ts")).alias("violations"))


_BEST = f"{taken_sql(3)} SELECT series_id, avg(r) AS ev FROM trades GROUP BY 1 ORDER BY ev DESC, series_id LIMIT 2"


@query("o2_best", _BEST, "ev")
def _(spark, d):
    """The best experiments by a metric."""
    return trades(spark, d, 3).groupBy("series_id").agg(F.avg("r").alias("ev")).orderBy(F.desc("ev"), "series_id").limit(2)


_FUND = f"""WITH {BASE}, f AS (SELECT *, volume / 7.3e5 - 5e-5 AS rate FROM base), g AS (SELECT *, {roll("avg", "rate", 24)} AS m24, {roll("sum", "rate", 12)} AS s12 FROM f) SELECT series_id, ts, CASE WHEN m24 > 1e-4 THEN 1 WHEN m24 < -5e-5 THEN -1 ELSE 0 END AS fund_regime, rate * 3 * 365 AS fund_annual, s12, atr / nullif(CASE WHEN count(atr) OVER (PARTITION BY series_id ORDER BY ts ROWS 49 PRECEDING) >= 10 THEN avg(atr) OVER (PARTITION BY series_id ORDER BY ts ROWS 49 PRECEDING) END, 0) AS atr_ratio,
(volume - lag(volume, 12) OVER ({W})) AS oi_diff_12, (volume - lag(volume, 12) OVER ({W})) / lag(volume, 12) OVER ({W}) AS oi_pct_12 FROM g"""


@query("i5_funding_oi", _FUND, "fund_annual s12 atr_ratio oi_diff_12 oi_pct_12")
def _(spark, d):
    """Funding regime, ATR ratio, open-interest changes."""
    x = base(spark, d).withColumn("rate", F.col("volume") / 7.3e5 - 5e-5)
    m = R.rolling(F.avg, "rate", 24)
    old = F.lag("volume", 12).over(B.in_order())
    return x.select("series_id", "ts", F.when(m > 1e-4, 1).when(m < -5e-5, -1).otherwise(0).alias("fund_regime"), (F.col("rate") * 3 * 365).alias("fund_annual"), R.rolling(F.sum, "rate", 12).alias("s12"), (F.col("atr") / F.nullif(R.rolling(F.avg, "atr", 50, 10), F.lit(0.0))).alias("atr_ratio"), (F.col("volume") - old).alias("oi_diff_12"), ((F.col("volume") - old) / old).alias("oi_pct_12"))


_REG40 = f"""{_ADX.replace("INTERVAL '1 hour'", "INTERVAL '15 minutes'").replace("SELECT series_id, ts, plus_di, minus_di, adx FROM q LEFT JOIN e USING (series_id, bar_idx)", "")}, ax AS (SELECT series_id, bar_idx, adx FROM q LEFT JOIN e USING (series_id, bar_idx)),
base AS (SELECT series_id, ts, bar_idx, {roll("avg", "t0", 14)} AS atr, 4 * ({roll("stddev_samp", "close", 20)}) / ({roll("avg", "close", 20)}) AS bb_width FROM y),
j AS (SELECT base.*, adx, {rank("atr", 96)} AS atr_rank, CASE WHEN count(bb_width) OVER w >= 96 THEN quantile_cont(bb_width, 0.75) OVER w END AS q75 FROM base JOIN ax USING (series_id, bar_idx) WINDOW w AS ({W} ROWS 95 PRECEDING))
SELECT series_id, ts, adx, bb_width, atr_rank, CASE WHEN adx IS NULL OR q75 IS NULL THEN NULL WHEN adx > 25 AND bb_width > q75 THEN 2 WHEN adx < 20 THEN 0 ELSE 1 END AS regime, atr_rank * adx AS adx_x_atr FROM j"""


@query("i40_adx_regime", _REG40, "adx bb_width atr_rank adx_x_atr")
def _(spark, d):
    """ADX composite regime and its interactions."""
    x = I.bands(I.adx(base(spark, d)))
    x = R.order_statistics(x, atr_rank=R.Rank("atr", 96), bb_q75=R.Quantile("bb_width", 0.75, -95, 0, 96))
    tag = F.when(F.col("adx").isNull() | F.col("bb_q75").isNull(), F.lit(None)).when((F.col("adx") > 25) & (F.col("bb_width") > F.col("bb_q75")), 2).when(F.col("adx") < 20, 0).otherwise(1)
    return x.select("series_id", "ts", "adx", "bb_width", "atr_rank", tag.alias("regime"), (F.col("atr_rank") * F.col("adx")).alias("adx_x_atr"))


_ADAPTIVE = f"""WITH {BASE}, r AS (SELECT *, {rank("atr", 96)} AS rank FROM base), l AS (SELECT *, CASE WHEN rank > 0.67 THEN 10 WHEN rank < 0.33 THEN 3 ELSE 5 END AS n, list(high) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS b, list(high) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS a FROM r),
s AS (SELECT *, list_concat(list_reverse(coalesce(b, []))[1:n], coalesce(a, [])[1:n]) AS near FROM l) SELECT series_id, ts, n, CAST(len(near) = 2 * n AND len(list_filter(near, lambda h: h > high)) = 0 AS INTEGER) AS swing_high FROM s"""


@query("m17_adaptive_swings", _ADAPTIVE)
def _(spark, d):
    """Swings whose width follows the ATR's percentile; centred windows look ahead, kept for comparison."""
    x = R.order_statistics(base(spark, d), rank=R.Rank("atr", 96))
    n = F.when(F.col("rank") > 0.67, 10).when(F.col("rank") < 0.33, 3).otherwise(5)
    x = x.withColumns({"n": n, "__b": F.collect_list(F.struct("high", "low")).over(B.rows(-10, -1)), "__a": R.ahead(["high", "low"], 10)})
    near = F.concat(F.slice(F.reverse("__b"), F.lit(1), F.col("n")), F.slice("__a", F.lit(1), F.col("n")))
    top = F.forall(near, lambda s: s["high"] <= F.col("high")) & (F.size(near) == 2 * F.col("n"))
    return x.select("series_id", "ts", "n", top.cast("int").alias("swing_high"))

