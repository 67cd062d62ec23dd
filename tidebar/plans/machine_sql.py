"""SQL that says what the ordered machines and other queries without a plain window do: recursion from bar to bar, list functions, and the normal
distribution's series."""

from __future__ import annotations

from tidebar.plans.q_indicators import W


def recursive(sql: str, first: str, step: str, out: str) -> str:
    """A scan over series: `sql` ends in a common table expression `x`; `first` are the state's columns at bar 0, `step` those at bar x from state m."""
    return f"""{sql.replace("WITH ", "WITH RECURSIVE ", 1)}, b AS MATERIALIZED (SELECT * FROM x), m AS (SELECT {first} FROM b WHERE bar_idx = 0 UNION ALL SELECT {step}) SELECT {out} FROM m JOIN b USING (series_id, bar_idx)"""


def normal_sql(z: str) -> str:
    """Phi: the odd powers over double factorials, by logarithms."""
    a = f"abs({z})"
    total = f"CASE WHEN {a} = 0 THEN 0 ELSE list_sum(list_transform(range(0, 250), lambda k: exp((2 * k + 1) * ln({a}) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)))) END"
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN {a} > 10 THEN CASE WHEN {z} > 0 THEN 1.0 ELSE 0.0 END ELSE 0.5 + sign({z}) * exp(-{a} * {a} / 2) / sqrt(2 * pi()) * ({total}) END)"


def supertrend_sql(sql: str) -> str:
    first = "series_id, bar_idx, NULL::DOUBLE AS up, NULL::DOUBLE AS low_, 1 AS trend, close AS before, NULL::DOUBLE AS supertrend, NULL::DOUBLE AS supertrend_dir, NULL::DOUBLE AS supertrend_flip"
    step = """series_id, bar_idx, CASE WHEN ok THEN nu ELSE up END, CASE WHEN ok THEN nl ELSE low_ END, CASE WHEN ok THEN nt ELSE trend END, close, CASE WHEN ok THEN CASE WHEN nt > 0 THEN nl ELSE nu END END, CASE WHEN ok THEN nt END, CASE WHEN ok THEN CASE WHEN up IS NOT NULL AND nt <> trend THEN 1 ELSE 0 END END
FROM (SELECT *, CASE WHEN up IS NULL OR u < up OR before > up THEN u ELSE up END AS nu, CASE WHEN low_ IS NULL OR l > low_ OR before < low_ THEN l ELSE low_ END AS nl, CASE WHEN up IS NULL THEN CASE WHEN close >= (high + low) / 2 THEN 1 ELSE -1 END WHEN close > up THEN 1 WHEN close < low_ THEN -1 ELSE trend END AS nt
FROM (SELECT b.series_id, b.bar_idx, b.high, b.low, b.close, coalesce(b.atr > 0, false) AS ok, (b.high + b.low) / 2 + 2.5 * b.atr AS u, (b.high + b.low) / 2 - 2.5 * b.atr AS l, m.up, m.low_, m.trend, m.before FROM m JOIN b ON b.series_id = m.series_id AND b.bar_idx = m.bar_idx + 1))"""
    return recursive(sql, first, step, "series_id, ts, bar_idx, supertrend, supertrend_dir, supertrend_flip")


def liquidity_sql(sql: str) -> str:
    def kept(levels: str, new: str, level: str, sign: str) -> str:
        return f"list_filter((CASE WHEN {new} = 1 THEN list_append({levels}, {level}) ELSE {levels} END)[-50:], lambda p: p {sign} close)"

    none = "[]::DOUBLE[]"
    first = f"series_id, bar_idx, {kept(none, 'swing_high', 'last_high', '>')} AS highs, {kept(none, 'swing_low', 'last_low', '<')} AS lows"
    step = f"series_id, bar_idx, {kept('highs', 'swing_high', 'last_high', '>')}, {kept('lows', 'swing_low', 'last_low', '<')} FROM (SELECT b.*, m.highs, m.lows FROM m JOIN b ON b.series_id = m.series_id AND b.bar_idx = m.bar_idx + 1)"
    pct = lambda v: f"abs({v} - close) / close * 100"
    equal = lambda levels, v: f"CASE WHEN len({levels}) > 0 AND atr > 0 AND len(list_filter({levels}, lambda p: abs(p - {v}) <= 0.1 * atr)) >= 2 THEN 1.0 ELSE 0.0 END"
    hi, lo = "list_min(highs)", "list_max(lows)"
    return recursive(sql, first, step, f"series_id, ts, bar_idx, {pct(hi)} AS liq_above_pct, {pct(lo)} AS liq_below_pct, {equal('highs', hi)} AS liq_equal_high, {equal('lows', lo)} AS liq_equal_low")


def level_sweeps_sql(sql: str) -> str:
    fields = "swept_high, swept_low, swept_high_level, swept_low_level"

    def of(highs: str, lows: str) -> str:
        h, l = f"list_filter({highs}, lambda p: high > p AND p > close)", f"list_filter({lows}, lambda p: low < p AND p < close)"  # noqa: E741
        keep = lambda levels, test, new, level: f"list_concat(list_filter({levels}, lambda p: {test}), CASE WHEN {new} = 1 THEN [{level}] ELSE []::DOUBLE[] END)"
        return f"series_id, bar_idx, {keep(highs, 'high <= p', 'swing_high', 'last_high')} AS highs, {keep(lows, 'low >= p', 'swing_low', 'last_low')} AS lows, CASE WHEN len({h}) > 0 THEN 1.0 ELSE 0.0 END AS swept_high, CASE WHEN len({l}) > 0 THEN 1.0 ELSE 0.0 END AS swept_low, {h}[-1] AS swept_high_level, {l}[-1] AS swept_low_level"

    step = f"{of('highs', 'lows')} FROM (SELECT b.*, m.highs, m.lows FROM m JOIN b ON b.series_id = m.series_id AND b.bar_idx = m.bar_idx + 1)"
    return recursive(sql, of("[]::DOUBLE[]", "[]::DOUBLE[]"), step, f"series_id, ts, bar_idx, {fields}, CAST(len(highs) AS DOUBLE) AS intact_highs, CAST(len(lows) AS DOUBLE) AS intact_lows")


def one_shot_sql(sql: str) -> str:
    def of(bull: str, bear: str) -> str:
        return f"series_id, bar_idx, CASE WHEN close > {bull} THEN NULL ELSE {bull} END AS bull, CASE WHEN close < {bear} THEN NULL ELSE {bear} END AS bear, CASE WHEN close > {bull} THEN 1.0 ELSE 0.0 END AS fired_bull, CASE WHEN close < {bear} THEN 1.0 ELSE 0.0 END AS fired_bear"

    # the open of the last falling (rising) candle doesn't depend on the state
    with_last = sql.replace("x AS (SELECT *", f"x AS (SELECT *, last(CASE WHEN close < open THEN open END IGNORE NULLS) OVER ({W}) AS fell, last(CASE WHEN close > open THEN open END IGNORE NULLS) OVER ({W}) AS rose", 1)
    first = of("(CASE WHEN swing_low = 1 THEN fell END)", "(CASE WHEN swing_high = 1 THEN rose END)")
    step = f"{of('l', 'h')} FROM (SELECT b.*, CASE WHEN swing_low = 1 THEN fell ELSE m.bull END AS l, CASE WHEN swing_high = 1 THEN rose ELSE m.bear END AS h FROM m JOIN b ON b.series_id = m.series_id AND b.bar_idx = m.bar_idx + 1)"
    return recursive(with_last, first, step, "series_id, ts, bar_idx, fired_bull AS legacy_cisd_bull, fired_bear AS legacy_cisd_bear")


def delivery_sql(sql: str) -> str:
    def level(colour: str) -> str:
        newest = f"list_max(list_filter(range(2, len(past) + 1), lambda i: {colour.format('past[i]')} AND {colour.format('past[i - 1]')}))"
        return f"CASE WHEN {newest} IS NOT NULL THEN past[coalesce(list_max(list_filter(range(1, {newest}), lambda k: NOT {colour.format('past[k]')})), 0) + 1].o END"

    fire = lambda l, a, b: f"CASE WHEN close {a} {l} AND lag(close) OVER ({W}) {b} {l} THEN 1.0 ELSE 0.0 END"
    age = lambda s: f"CASE WHEN bar_idx - last(CASE WHEN cisd_{s} = 1 THEN bar_idx END IGNORE NULLS) OVER ({W}) <= 20 THEN CAST(bar_idx - last(CASE WHEN cisd_{s} = 1 THEN bar_idx END IGNORE NULLS) OVER ({W}) AS DOUBLE) END AS cisd_{s}_age"
    return f"""{sql}, p AS (SELECT *, list({{'o': open, 'c': close}}) OVER ({W} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS past FROM x), l AS (SELECT *, {level("({0}.c < {0}.o)")} AS over, {level("({0}.c > {0}.o)")} AS under FROM p),
f AS (SELECT *, {fire("over", ">", "<=")} AS cisd_bull, {fire("under", "<", ">=")} AS cisd_bear FROM l) SELECT series_id, ts, bar_idx, cisd_bull, cisd_bear, {age("bull")}, {age("bear")} FROM f"""


def breakers_sql(sql: str) -> str:
    found = lambda test: f"last(CASE WHEN {test} THEN {{'top': greatest(open, close), 'bot': least(open, close)}} END IGNORE NULLS) OVER ({W} ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)"
    with_candles = sql.replace("x AS (SELECT *", f"x AS (SELECT *, {found('open > close')} AS fell, {found('close > open')} AS rose", 1)
    zone = "NULL::STRUCT(top DOUBLE, bot DOUBLE)"
    dated = "NULL::STRUCT(top DOUBLE, bot DOUBLE, born BIGINT)"
    first = f"series_id, bar_idx, {zone} AS ob_bull, {zone} AS ob_bear, {dated} AS br_bull, {dated} AS br_bear"
    turn = "{{'top': {0}.top, 'bot': {0}.bot, 'born': bar_idx}}"
    step = f"""series_id, bar_idx, CASE WHEN close < ub.bot THEN NULL ELSE ub END, CASE WHEN close > ua.top THEN NULL ELSE ua END, CASE WHEN bar_idx - nb.born >= 200 OR close < nb.bot THEN NULL ELSE nb END, CASE WHEN bar_idx - na.born >= 200 OR close > na.top THEN NULL ELSE na END
FROM (SELECT *, CASE WHEN close > ua.top THEN {turn.format("ua")} ELSE br_bull END AS nb, CASE WHEN close < ub.bot THEN {turn.format("ub")} ELSE br_bear END AS na
FROM (SELECT b.*, CASE WHEN b.bos = 1 AND b.fell IS NOT NULL THEN b.fell ELSE m.ob_bull END AS ub, CASE WHEN b.bos = -1 AND b.rose IS NOT NULL THEN b.rose ELSE m.ob_bear END AS ua, m.br_bull, m.br_bear FROM m JOIN b ON b.series_id = m.series_id AND b.bar_idx = m.bar_idx + 1))"""
    side = lambda s, sign: f"CAST(bar_idx - br_{s}.born AS DOUBLE) AS breaker_{s}_age, CASE WHEN atr > 0 THEN {sign} * (close - (br_{s}.top + br_{s}.bot) / 2) / atr END AS breaker_{s}_dist, CASE WHEN low <= br_{s}.top AND high >= br_{s}.bot THEN 1.0 ELSE 0.0 END AS breaker_{s}_in_zone"
    return recursive(with_candles, first, step, f"series_id, ts, bar_idx, {side('bull', 1)}, {side('bear', -1)}")
