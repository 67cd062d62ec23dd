import pytest

from tidebar.operators import proposals as P

REGISTRY = "id string, seq long, status string, tier string, question string, passed boolean, params map<string,double>, metrics map<string,double>"
GOOD = {"trades_per_yr": 150.0, "oos_auc": 0.8, "pbo": 0.01, "psr": 0.995, "sharpe_ann": 3.0, "win_rate": 0.6, "ev_r": 0.7, "max_drawdown": 0.1, "ece": 0.01}


def registry(spark, rows):
    return spark.createDataFrame(rows, REGISTRY)


def test_a_failed_gate_is_diagnosed(spark):
    rows = [("a", 1, "DONE", "standard", None, False, {}, {**GOOD, "win_rate": 0.5, "ece": None}), ("b", 2, "FAILED", "standard", None, False, {}, {}), ("c", 3, "DONE", "weekly", None, True, {}, GOOD), ("d", 4, "DONE", "weekly", None, False, {}, {**GOOD, "pbo": 0.2})]
    got = {(r.id, r.gate, r.action, r.parameter, r.step) for r in P.diagnoses(registry(spark, rows)).collect()}
    assert got == {("a", "MIN_WR", "higher threshold", "ml_threshold", 0.02), ("a", "MIN_WR", "filter by quality", None, None), ("a", "MAX_ECE", "calibrate", None, None), ("d", "MAX_PBO", None, None, None)}
    assert next(r.gap for r in P.diagnoses(registry(spark, rows)).collect() if r.gate == "MAX_PBO") == pytest.approx(3)


def test_mutations_stay_in_bounds_and_are_new(spark):
    low = {**GOOD, "trades_per_yr": 50.0, "max_drawdown": 0.3}
    best = ("best", 5, "DONE", "standard", None, False, {"ml_threshold": 0.56, "cooldown_bars": 288.0, "kelly_divisor": 50.0}, low)
    got = P.mutations(registry(spark, [best, ("worse", 6, "DONE", "standard", None, False, {}, {**low, "sharpe_ann": 1.0})])).collect()
    # both gates ask for a shorter cooldown; the threshold stops at its bound; the divisor is at its bound already
    assert [(r["rank"], r.parameter, r.old, r.new, r.gates) for r in sorted(got, key=lambda r: r["rank"])] == [(1, "cooldown_bars", 288.0, 192.0, 2), (2, "ml_threshold", 0.56, 0.55, 1)]
    tried = ("tried", 7, "DONE", "standard", None, False, {"ml_threshold": 0.56, "cooldown_bars": 192.0, "kelly_divisor": 50.0}, {**low, "sharpe_ann": 0.1})
    got = P.mutations(registry(spark, [best, tried])).collect()
    assert [(r["rank"], r.parameter) for r in got] == [(1, "ml_threshold")]
    elsewhere = (*tried[:3], "weekly", *tried[4:])
    assert {(r.tier, r.parameter) for r in P.mutations(registry(spark, [best, elsewhere])).collect()} >= {("standard", "cooldown_bars"), ("standard", "ml_threshold")}


def test_defaults_stand_for_missing_settings(spark):
    got = P.mutations(registry(spark, [("a", 1, "DONE", "standard", None, False, None, {**GOOD, "ev_r": 0.1})])).collect()
    assert [(r.parameter, r.old, r.new) for r in got] == [("ml_threshold", 0.6, 0.62)]


def test_open_questions(spark):
    done = lambda i, q, ok: (str(i), i, "DONE", "standard", q, ok, {}, {})
    reg = registry(spark, [done(1, "q1", False), done(2, "q1", False), done(3, None, True), done(4, "q2", False), done(5, "q2", None), ("6", 6, "FAILED", "standard", "q2", False, {}, {})])
    assert [r.question for r in P.given_up(reg).collect()] == ["q2"]
    questions = spark.createDataFrame([("q1", 1, None, []), ("a", 2, None, ["f"]), ("b", 1, "needs v3 data", []), ("c", 1, "needs ticks", []), ("d", 1, None, ["g"]), ("e", 2, None, None)], "question string, priority int, blocked string, needs array<string>")
    got = P.open_questions(questions, reg, spark.createDataFrame([("f",)], "feature string"), ("v3",), dead=8).collect()
    assert sorted((r["rank"], r.question) for r in got) == [(1, "b"), (2, "a"), (3, "e")]
    assert {r.question: r.minutes for r in got}["a"] == pytest.approx(1.5 * 11 * 501 / 500)


def test_empty_registry_and_untested_options(spark):
    empty = registry(spark, [])
    assert P.diagnoses(empty).count() == 0 and P.mutations(empty).count() == 0 and P.given_up(empty).count() == 0
    some = registry(spark, [("a", 1, "DONE", "standard", None, True, {"target_r": 2.0, "direction": 1.0}, {})])
    left = {(r.parameter, r.option) for r in P.untested(some).collect()}
    assert ("target_r", 2.0) not in left and ("target_r", 3.0) in left and ("direction", 0.0) in left and ("direction", 1.0) not in left
    assert len(left) == sum(len(o) for _, o in P.PARAMETERS.values()) - 2 and len(P.PARAMETERS) == 22
