import math
import random

import pytest
from pyspark.sql import functions as F

from tidebar.operators import sampler as S

SPACE = (S.Number("x", 0.0, 1.0), S.Number("y", 1.0, 1000.0, log=True), S.Choice("k", ("a", "b", "c", "d")), S.Number("i", 0, 10, step=1))


def quality(x, y, k, i):
    return -((x - 0.3) ** 2) - 0.05 * (math.log10(y) - 2) ** 2 - 0.2 * (k != 2) - 0.01 * abs(i - 7)


def objective(df):
    p = lambda n: F.col("params")[n]
    v = -((p("x") - 0.3) ** 2) - 0.05 * (F.log10(p("y")) - 2) ** 2 - F.when(p("k") != 2, 0.2).otherwise(0.0) - 0.01 * F.abs(p("i") - 7)
    return df.select("trial", v.alias("value"))


def test_density_integrates_to_one(spark):
    """The mixture over numbers and options, by a fine grid."""
    space = (S.Number("x", 0, 1), S.Choice("k", (1, 2, 3)))
    kernels = S.Kernels(2, (0.07, 0.4))
    at = F.array(F.array(F.lit(0.02), F.lit(1.0)), F.array(F.lit(0.9), F.lit(0.0)))
    grid = spark.range(3 * 2000).select(F.array((F.floor(F.col("id") / 3) + 0.5) / 2000, (F.col("id") % 3).cast("double")).alias("x"))
    density = kernels.mixed(space, F.aggregate(at, F.lit(0.0), lambda a, b: a + kernels.density(space, F.col("x"), b)))
    assert grid.agg(F.sum(density) / 2000).first()[0] == pytest.approx(1, abs=1e-4)


def test_draws_follow_the_kernel():
    space, kernels = (S.Number("x", 0, 1), S.Choice("k", ("a", "b"))), S.Kernels(1, (0.1, 0.3))
    draws = [kernels.drawn(space, (0.95, 1.0), *([S.uniform(1, n, p, s) for p in "xk"] for s in "uv")) for n in range(4000)]
    assert all(0 <= x <= 1 for x, _ in draws)
    assert sum(k for _, k in draws) / 4000 == pytest.approx(0.85, abs=0.02)
    cdf = lambda x: S.logistic((x - 0.95) / 0.1)
    assert sum(x < 0.8 for x, _ in draws) / 4000 == pytest.approx((cdf(0.8) - cdf(0)) / (cdf(1) - cdf(0)), abs=0.02)


def test_trials_are_a_journals_fold(spark):
    p = {"x": 0.5}
    events = [(0, "proposed", None, p), (0, "done", 1.5, None), (0, "done", 1.5, None), (1, "proposed", None, p), (2, "proposed", None, p), (2, "failed", None, None), (3, "proposed", None, p), (3, "done", None, None)]
    got = {(r.trial, r.status, r.value) for r in S.trials(spark.createDataFrame(events, S.EVENTS)).collect()}
    assert got == {(0, "done", 1.5), (1, "running", None), (2, "failed", None), (3, "failed", None)}


def test_beats_random_draws_and_resumes(spark, tmp_path):
    n, batch = 60, 12
    whole = S.search(spark, f"{tmp_path}/whole", SPACE, objective, n, batch, seed=3).collect()
    assert [r.trial for r in sorted(whole, key=lambda r: r.trial)] == list(range(n))
    assert all(r.params["i"] == int(r.params["i"]) and 1 <= r.params["y"] <= 1000 and r.params["k"] in range(4) for r in whole)
    rnd = random.Random(0)
    draws = sorted(max(quality(rnd.random(), 10 ** (3 * rnd.random()), rnd.randrange(4), rnd.randint(0, 10)) for _ in range(n)) for _ in range(400))
    assert max(r.value for r in whole) > draws[300]  # better than three of four random searches
    later = sorted(r.value for r in whole if r.trial >= 36)
    assert later[len(later) // 2] > sorted(r.value for r in whole if r.trial < 12)[6]

    # broken off after a batch was proposed and before it was run
    def breaks(df):
        raise RuntimeError("broken off")

    S.search(spark, f"{tmp_path}/part", SPACE, objective, 24, batch, seed=3)
    with pytest.raises(RuntimeError, match="broken off"):
        S.search(spark, f"{tmp_path}/part", SPACE, breaks, n, batch, seed=3)
    again = S.search(spark, f"{tmp_path}/part", SPACE, objective, n, batch, seed=3).collect()
    plain = lambda rows: sorted((r.trial, r.value, sorted(r.params.items())) for r in rows)
    assert plain(again) == plain(whole)


def test_failed_trials_are_recorded_and_left_out(spark, tmp_path):
    odd = lambda df: objective(df).filter("trial % 2 = 0")
    got = S.search(spark, f"{tmp_path}/j", SPACE, odd, 8, 4).collect()
    assert {r.trial: r.status for r in got} == {t: "failed" if t % 2 else "done" for t in range(8)}
    assert S.scored(S.trials(spark.read.parquet(f"{tmp_path}/j")), SPACE, [8]) is None
