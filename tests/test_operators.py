import datetime
import math
import random
from collections import namedtuple

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import backtest as T
from tidebar.operators import bars as B
from tidebar.operators import filters, hmm
from tidebar.operators import joins as J
from tidebar.operators import labels as L
from tidebar.operators import machines as M
from tidebar.operators import rolling as R
from tidebar.operators import structure as S
from tidebar.operators import sweeps as P
from tidebar.operators import validation as V
from tidebar.operators import zones as Z
from tidebar.sources import ingest


def walk(n, seed, series="a", flat=False):
    rnd = random.Random(seed)
    rows, price = [], 100.0
    for i in range(n):
        o = price
        c = o if flat else max(1.0, o + rnd.gauss(0, 1))
        h, l = max(o, c) + (0 if flat else rnd.random()), min(o, c) - (0 if flat else rnd.random())
        rows.append((series, i, float(o), h, l, c, 1.0 + rnd.random()))
        price = c
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "series_id string, bar_idx long, open double, high double, low double, close double, volume double")
    return df.withColumn("ts", F.timestamp_seconds(F.col("bar_idx") * 900).cast("timestamp_ntz")).withColumn("taker_buy", F.col("volume") / 2).withColumn("trade_count", F.lit(1).cast("long"))


@pytest.mark.parametrize(("alpha", "adjust"), [(1 / 14, True), (2 / 201, False), (0.5, False), (2 / 10, True), (0.95, False)])
def test_block_scan_equals_pandas(spark, alpha, adjust):
    rows = walk(1500, 1) + walk(700, 2, "b")
    got = R.ewm(frame(spark, rows), F.col("close"), "y", alpha=alpha, adjust=adjust).select("series_id", "bar_idx", "y").toPandas()
    for s in ("a", "b"):
        want = pd.Series([r[5] for r in rows if r[0] == s]).ewm(alpha=alpha, adjust=adjust).mean()
        mine = got[got.series_id == s].sort_values("bar_idx")["y"].to_numpy()
        assert np.allclose(mine, want, rtol=1e-10)


def test_wilder_holds_and_seeds(spark):
    rows = walk(600, 3)
    got = R.wilder(frame(spark, rows), F.when(F.col("bar_idx") > 0, F.col("close")), 14, "y").orderBy("bar_idx").toPandas()["y"]
    x = [r[5] for r in rows]
    assert got[:14].isna().all()
    y = sum(x[1:15]) / 14
    assert math.isclose(got[14], y)
    for t in range(15, 600):
        y = (y * 13 + x[t]) / 14
        assert math.isclose(got[t], y, rel_tol=1e-10)


CHAIN = ["trend", "bos", "choch", "last_high", "last_low", "disp_bull", "disp_bear", "ob_bull_top", "ob_bear_age", "range_place", "mss_bull", "mss_bear_age"]


def chain(df):
    return S.shifts(S.ranges(S.order_blocks(S.displacement(S.swings(S.with_atr(df))))))


def test_structure_is_causal(spark):
    """The whole chain on a prefix equals the chain on everything, for all rows of the prefix."""
    rows = walk(260, 5)
    whole = {r.bar_idx: r for r in chain(frame(spark, rows)).select("bar_idx", *CHAIN).collect()}
    for t in (40, 133, 201):
        for r in chain(frame(spark, rows[:t])).select("bar_idx", *CHAIN).collect():
            assert r == whole[r.bar_idx]


@pytest.mark.parametrize("machine", [Z.anchored_blocks, M.tracked_gaps, M.liquidity_levels, P.sweeps, M.delivery_change, M.breakers, M.supertrend])
def test_machines_are_causal_and_keep_series_apart(spark, machine):
    base = lambda rows: S.displacement(S.swings(S.with_atr(frame(spark, rows))))
    a, b = walk(220, 7), walk(180, 8, "b")
    both = {(r.series_id, r.bar_idx): str(r) for r in machine(base(a + b)).collect()}
    alone = {(r.series_id, r.bar_idx): str(r) for r in machine(base(a)).collect()}
    early = {(r.series_id, r.bar_idx): str(r) for r in machine(base(a[:150])).collect()}
    assert all(both[k] == v for k, v in alone.items()) and all(alone[k] == v for k, v in early.items())


@pytest.mark.parametrize("seed", [3, 11])
def test_anchored_blocks_equal_a_plain_loop(spark, seed):
    from tests.model_blocks import AnchoredBlocks

    rnd = random.Random(seed)
    rows = [(s, i, o, h, l, c + (rnd.choice((2.5, -2.5)) if rnd.random() < 0.1 else 0), v) for s, i, o, h, l, c, v in walk(420, seed)]
    rows = [(s, i, o, max(h, c), min(l, c), c, v) for s, i, o, h, l, c, v in rows]
    df = S.swings(S.with_atr(frame(spark, rows)))
    cap = 40  # so that zones also end by age
    got = {r.bar_idx: r.asDict() for r in Z.anchored_blocks(df, cap=cap).collect()}
    assert len(got) == 420 and len(got[0]) == 3 + 82
    bar = namedtuple("bar", "open high low close atr bos")
    model, seen = AnchoredBlocks(cap=cap), 0
    for r in sorted(df.collect(), key=lambda r: r.bar_idx):
        want = model.step(bar(r.open, r.high, r.low, r.close, math.nan if r.atr is None else r.atr, r.bos))
        for name, v in want.items():
            assert got[r.bar_idx][name] == (None if math.isnan(v) else pytest.approx(v, abs=1e-9)), (r.bar_idx, name)
        seen += want["ob_bull_count"] + want["ob_bear_count"]
    assert seen > 100


def test_gap_intervals_equal_a_plain_loop(spark):
    rows = walk(400, 9)
    got = {r.bar_idx: r for r in S.gaps(S.with_atr(frame(spark, rows)), "bull").collect()}
    atr = {r.bar_idx: r.atr for r in S.with_atr(frame(spark, rows)).collect()}
    alive = []
    for i, (_, _, _, h, l, c, _) in enumerate(rows):
        alive = [z for z in alive if z["age"] < 100 and c > z["top"]]
        if i >= 2 and l - rows[i - 2][3] > (atr[i] or 0) * 0.5:
            alive.append({"top": l, "bot": rows[i - 2][3], "age": 0})
        for z in alive:
            z["age"] += 1
        assert got[i].fvg_bull_count == len(alive)
        if alive:
            near = min(alive, key=lambda z: min(abs(z["top"] - c), abs(z["bot"] - c)))  # noqa: B023
            assert (got[i].fvg_bull_near_top, got[i].fvg_bull_age) == (near["top"], alive[-1]["age"])
            assert got[i].fvg_bull_in_zone == int(any(l <= z["top"] and h >= z["bot"] for z in alive))


@pytest.mark.parametrize("seed", [2, 12])
def test_sweeps_equal_a_plain_loop(spark, seed):
    from tests.model_sweeps import Sweeps

    rnd = random.Random(seed)
    rows = [(s, i, *(round(x * 2) / 2 for x in (o, h + rnd.choice((0, 0, 1)), l - rnd.choice((0, 0, 1)), c)), v) for s, i, o, h, l, c, v in walk(420, seed)]
    df = S.swings(S.with_atr(frame(spark, rows)))
    got = {r.bar_idx: r.asDict() for r in P.sweeps(df).collect()}
    bar = namedtuple("bar", "high low close atr swing_high swing_low last_high last_low")
    model, fired = Sweeps(), 0
    for r in sorted(df.collect(), key=lambda r: r.bar_idx):
        want = model.step(bar(r.high, r.low, r.close, math.nan if r.atr is None else r.atr, r.swing_high, r.swing_low, r.last_high, r.last_low))
        for name, v in want.items():
            assert got[r.bar_idx][name] == (None if math.isnan(v) else pytest.approx(v, abs=1e-9)), (r.bar_idx, name)
        fired += want["sweep_bsl_fired"] + want["sweep_ssl_fired"]
    assert fired > 10


def test_sweep_by_hand():
    bar = namedtuple("bar", "open high low close volume atr bos swing_high swing_low last_high last_low disp_bull disp_bear")
    from tests.model_sweeps import Sweeps

    m = Sweeps()
    quiet = dict(open=9, high=9.5, low=8.5, close=9, volume=1, atr=1, bos=0, swing_high=0, swing_low=0, last_high=10, last_low=5, disp_bull=0, disp_bear=0)
    for k in range(2):
        m.step(bar(**{**quiet, "swing_high": 1, "last_high": 10 + 0.05 * k}))
    assert m.step(bar(**{**quiet, "high": 11}))["sweep_bsl_fired"] == 0  # pierced, and closed below: waits for the next bar
    out = m.step(bar(**quiet))
    assert out["sweep_bsl_fired"] == 1 and out["sweep_bsl_age"] == 0 and math.isclose(out["sweep_bsl_pen_atr"], 11 - 10.025)


def test_flat_bars_and_both_barriers(spark):
    flat = S.with_atr(frame(spark, walk(40, 1, flat=True)))
    assert flat.agg(F.max("atr")).first()[0] == 0
    assert L.triple_barrier(flat, (12,), (1,)).filter("label_long_hit_1r_12c is not null").count() == 0
    rows = walk(30, 2)
    rows[20] = ("a", 20, *[rows[20][2], rows[20][2] + 50, rows[20][2] - 50, rows[20][2]], 1.0)  # touches both barriers
    got = {r.bar_idx: r.label_long_hit_1r_12c for r in L.triple_barrier(S.with_atr(frame(spark, rows)), (12,), (1,)).collect()}
    assert got[17] in (0, 1) and got[18] is None and got[5] is None


def test_asof_ties_and_nulls(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5), ("a", 3, None)], "k string, id int, t int")
    right = spark.createDataFrame([("a", 10, "ten"), ("a", 15, "fifteen"), ("a", None, "never"), ("b", 6, "later")], "k string, at int, v string")
    got = {r.id if r.k == "a" else "b": r.r_v for r in J.asof_join(left, right, "t", "at", ["k"], ["v"], "r_").collect()}
    assert got == {1: "ten", 2: "fifteen", 3: None, "b": None}


def test_asof_by_grain_equals_asof(spark):
    rnd = random.Random(4)
    stamp = lambda: f"2024-01-{rnd.randint(1, 9):02d} {rnd.randint(0, 23):02d}:{rnd.choice(['00', '30'])}:00"
    left = spark.createDataFrame([(rnd.choice("ab"), i, stamp() if i % 9 else None) for i in range(200)], "k string, id int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    right = spark.createDataFrame([(rnd.choice("ab"), stamp(), i if i % 5 else None) for i in range(25)], "k string, at string, v int").withColumn("at", F.col("at").cast("timestamp_ntz"))
    plain, cut = (sorted(J.asof_join(left, right, "t", "at", ["k"], ["v"], "r_", g).collect(), key=str) for g in (None, "day"))
    assert plain == cut and any(r.r_v is not None for r in cut)


def test_cooldown_is_strict(spark):
    df = spark.createDataFrame([("a", i) for i in (0, 3, 4, 5, 9, 10, 30)], "series_id string, bar_idx long")
    assert sorted(r.bar_idx for r in T.take(df, 4).collect()) == [0, 5, 10, 30]
    assert sorted(r.bar_idx for r in T.take(df, 4, strict=False).collect()) == [0, 4, 9, 30]


@pytest.mark.parametrize("block", [1, 8, 65_536])
@pytest.mark.parametrize(("gap", "strict"), [(0, True), (3, True), (3, False), (11, True), (0, False)])
def test_cooldown_in_blocks_equals_a_plain_loop(spark, monkeypatch, block, gap, strict):
    monkeypatch.setattr(T, "BLOCK", block)
    rnd = random.Random(gap)
    signals = {s: sorted(rnd.sample(range(200), n)) for s, n in (("a", 90), ("b", 12), ("c", 1))}
    df = spark.createDataFrame([(s, i, f"{s}{i}") for s, x in signals.items() for i in x], "series_id string, bar_idx long, name string").repartition(3)
    want = []
    for s, x in signals.items():
        last = None
        for i in x:
            if last is None or (i - last > gap if strict else i - last >= gap):
                want.append((s, i, f"{s}{i}"))
                last = i
    assert sorted(tuple(r) for r in T.take(df, gap, strict=strict).collect()) == sorted(want)


def test_cooldown_sweep_and_repeated_bars(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 4)
    df = spark.createDataFrame([("a", i, k) for k, i in enumerate([0, 0, 2, 5, 5, 9, 30])], "series_id string, bar_idx long, n int")
    got = {(c, r.bar_idx) for c in (1, 4) for r in T.sweep(df, [1, 4]).filter(f"cooldown = {c}").collect()}
    assert got == {(1, 0), (1, 2), (1, 5), (1, 9), (1, 30), (4, 0), (4, 5), (4, 30)}
    assert T.take(df.limit(0), 3).count() == 0


def test_percentile_rank_with_ties_and_nulls(spark):
    rows = [("a", i, v) for i, v in enumerate([1.0, None, 2.0, 2.0, 3.0, 0.5])]
    df = spark.createDataFrame(rows, "series_id string, bar_idx long, x double").withColumn("ts", F.col("bar_idx"))
    got = [r.p for r in df.withColumn("p", R.percentile_rank("x", 4, 1)).orderBy("ts").collect()]
    assert got == [1.0, None, 1.0, 2.5 / 3, 1.0, 0.25]


@pytest.mark.parametrize("size", [5, 4096])
def test_order_statistics_equal_plain_frames(spark, monkeypatch, size):
    monkeypatch.setattr(R, "SLICE", size)
    rnd = random.Random(8)
    values = {s: [None if rnd.random() < 0.15 else float(rnd.randint(0, 9)) for _ in range(60)] for s in ("a", "b")}
    rows = [(s, i, v, 1) for s, x in values.items() for i, v in enumerate(x)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "series_id string, bar_idx long, x double, keep int").withColumn("ts", F.col("bar_idx")).repartition(3)
    out = R.order_statistics(df, r=R.Rank("x", 7), few=R.Rank("x", 7, 1), q=R.Quantile("x", 0.3, -12, -1, 4), wide=R.Quantile("x", 0.75, -99, 0, 1))
    assert out.columns == [*df.columns, "r", "few", "q", "wide"]
    got = {(r.series_id, r.bar_idx): r for r in out.collect()}
    assert len(got) == 120
    for (s, i), r in got.items():
        frame = lambda a, b: [v for v in values[s][max(0, i + a) : max(0, i + b + 1)] if v is not None]  # noqa: B023, E731
        own, last = values[s][i], frame(-6, 0)
        rank = None if own is None else (sum(v < own for v in last) + (sum(v == own for v in last) + 1) / 2) / len(last)
        assert r.few == rank and r.r == (rank if len(last) == 7 else None)
        for name, x, q, least in (("q", frame(-12, -1), 0.3, 4), ("wide", frame(-99, 0), 0.75, 1)):
            assert r[name] == (pytest.approx(float(np.percentile(x, 100 * q))) if len(x) >= least else None)


def test_statistics(spark):
    z = [-8.0, -3.5, -1.0, 0.0, 0.3, 2.9, 3.0, 5.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", V.normal_cdf(F.col("z")).alias("p")).collect()
    assert all(math.isclose(r.p, V.PHI.cdf(r.z), rel_tol=1e-9, abs_tol=1e-15) for r in got)
    assert V.gt_score([], 10, 1) == V.gt_score([1.0, -0.6], 10, 1) == -999.0 and V.gt_score([1, 1, 1], 1000, 10) < 1
    assert V.deflated_sharpe(0.1, 1, 100) == 1.0 and V.deflated_sharpe(3.0, 100, 1000) > 0.9
    assert V.gates({"n": 12, "wr": 0.4}, {"n": 50, "wr": 0.3}, overrides={"n": 10}) == {"n": True, "wr": True}
    spec = V.folds(100, 40, 20, 5, 10, least=5)
    assert list(spec["test_start"]) == [45, 65, 85] and (spec["train_below"] <= spec["val_start"] - 10).all()


def test_hmm_finds_the_calm_and_the_wild():
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.normal(0, s, 150) for s in (0.5, 3.0, 0.5, 3.0)])
    p = hmm.GaussianHmm().fit(x).filtered(x)[0]
    assert p[100:150, 0].mean() > 0.9 and p[250:300, 1:].sum(axis=1).mean() > 0.9


def test_ingestion(spark, tmp_path):
    df = spark.createDataFrame([("1700000000000",), ("1700000000000000",), ("open_time",)], "t string")
    assert [r.ms for r in df.select(ingest.to_millis("t").alias("ms")).collect()] == [1700000000000, 1700000000000, None]
    with pytest.raises(ValueError):
        ingest.versioned(spark, ["x/holdout.parquet"])
    path = f"{tmp_path}/registry.json"
    ingest.upsert_registry(path, {"id": 1, "v": 1})
    assert ingest.upsert_registry(path, {"id": 1, "v": 2}) == [{"id": 1, "v": 2}]
    bars = frame(spark, walk(10, 1))
    ingest.write_bars(bars, f"{tmp_path}/bars", by_month=True)
    assert ingest.versioned(spark, [f"{tmp_path}/none", f"{tmp_path}/bars"]).count() == 10
    assert ingest.missing_columns(bars, ["open", "nope"]) == ["nope"]
    assert filters.drop_constant(bars, filters.feature_columns(bars)) == ["bar_idx", "close", "high", "low", "open", "taker_buy", "volume"]
    assert B.SECONDS["1h"] == 3600 and L.parse_name(L.name_of("long", 2, 48)) == ("long", 2, 48)


def test_model_folds_run_to_the_end_of_the_bars(spark, tmp_path, monkeypatch):
    from tidebar import catalog
    from tidebar.plans import q_validation

    at = datetime.datetime(2024, 1, 1)
    rows = [(k, at + datetime.timedelta(minutes=15 * (k // 2)), k % 9, "view", 10.0 + k % 7, None) for k in range(2 * 1000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    monkeypatch.setattr(q_validation.V, "boosted_folds", lambda df, features, label, spec, rounds: seen.append(spec) or df)
    catalog.queries()["v2_walk_forward_model"](spark, str(tmp_path))
    assert list(seen[0]["test_start"]) == [374, 524, 674, 824, 974] and list(seen[0]["test_end"]) == [524, 674, 824, 974, 1000]


def test_scratch_paths_are_released(spark, tmp_path):
    from tidebar import session

    before = session.made()
    a, b = session.scratch(spark, "a"), session.scratch(spark, "b")
    for p in (a, b):
        spark.range(3).write.parquet(p)
    session.release(spark, since=before, keep=(b,))
    assert spark.read.parquet(b).count() == 3 and session.made() == before + 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(a)
    session.release(spark, since=before)


def test_runs_that_fail_are_recorded(spark):
    from tidebar.operators import search

    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 2:
            raise RuntimeError("once")
        return {"auc": 0.7}

    assert search.safely(flaky) == {"status": "done", "attempts": 2, "auc": 0.7}
    assert search.safely(lambda: 1 / 0)["status"] == "failed"


def test_versions_and_caches(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/bars_v1.parquet")
    assert ingest.versioned(spark, [f"{tmp_path}/bars_v2.parquet", f"{tmp_path}/bars_v1.parquet"]).count() == 2
    for bad in ("holdout/x.parquet", "bars_v3_full.parquet"):
        with pytest.raises(ValueError, match="must not be read"):
            ingest.versioned(spark, [f"{tmp_path}/{bad}"])
    ingest.write_array(spark.range(5).selectExpr("id", "id / 2 AS p"), f"{tmp_path}/a", "id", "p")
    assert ingest.read_array(spark, f"{tmp_path}/a", 5).count() == 5
    with pytest.raises(ValueError, match="has 5 values"):
        ingest.read_array(spark, f"{tmp_path}/a", 6)


def test_next_event_and_forward_asof_are_linear(spark):
    n = 200_000
    b = spark.range(n).selectExpr("'a' AS series_id", "id AS ts", "id AS bar_idx")
    got = b.select("ts", J.next_event(F.col("bar_idx"), F.col("ts") % 1000 == 0, ["series_id"], "ts").alias("n"))
    assert got.filter("n IS NOT NULL").agg(F.sum("n")).first()[0] == sum(k * 1000 * 999 for k in range(1, n // 1000))
    e = spark.range(n // 2).selectExpr("'a' AS series_id", "id * 2 - 1 AS at")
    assert J.forward_asof(e, b.filter("ts % 10 = 0"), "at", ["series_id"]).filter("first_bar_idx <> ceil(at / 10) * 10").count() == 0


def pooled(pairs):
    """Pool adjacent violators over sorted (p, y): calibrated value by distinct p."""
    blocks = []
    for p in sorted({p for p, _ in pairs}):
        own = [y for q, y in pairs if q == p]
        blocks.append([sum(own), len(own), [p]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, ps = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + ps]
    return sorted({(p, round(s / n, 12)) for s, n, ps in blocks for p in (ps[0], ps[-1])})


@pytest.mark.parametrize("size", [1, 7, 10**6])
@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "ties"])
def test_isotonic_in_ranges_equals_pooling(spark, monkeypatch, size, kind):
    monkeypatch.setattr(V, "ISOTONIC_RANGE", size)
    monkeypatch.setattr(V, "ISOTONIC_FAN", 3)
    rnd = random.Random(4)
    p = [rnd.randint(0, 40) / 40 if kind == "ties" else rnd.random() for _ in range(60)]
    label = {"noise": lambda x: float(rnd.random() < x), "rising": lambda x: x, "falling": lambda x: 1 - x, "ties": lambda x: float(rnd.random() < 0.5)}[kind]
    pairs = [(x, label(x)) for x in p]
    got = V.isotonic(spark.createDataFrame([*pairs, (None, 1.0), (0.5, None)], "p double, y double"), "p", "y").collect()
    assert sorted((r.p, round(r.calibrated, 12)) for r in got) == pooled(pairs)


def test_isotonic_of_nothing(spark):
    assert V.isotonic(spark.createDataFrame([], "p double, y double"), "p", "y").count() == 0
