import itertools
import math
import random

import pandas as pd
import pytest

from tidebar.operators import trees as T

NODE = "model long, tree int, node int, feature int, threshold double, left int, right int, cover double, value double"


def grown(rnd, depth, features, model, tree):
    """A random tree; features come again on a path."""
    rows = []

    def grow(level, cover):
        k = len(rows)
        rows.append(None)
        if level == depth or cover < 2 or (level and rnd.random() < 0.2):
            rows[k] = (model, tree, k, None, None, None, None, float(cover), rnd.uniform(-2, 2))
        else:
            part = rnd.randint(1, cover - 1)
            left, right = grow(level + 1, part), grow(level + 1, cover - part)
            rows[k] = (model, tree, k, rnd.randrange(features), rnd.uniform(0, 1), left, right, float(cover), 0.0)
        return k

    grow(0, 64)
    return rows


def expected(tree, x, known, node=0):
    """The prediction if only the features in `known` are: an unknown one goes both ways by cover."""
    _, _, _, f, cut, left, right, cover, value = tree[node]
    if f is None:
        return value
    if f in known:
        return expected(tree, x, known, left if x[f] <= cut else right)
    return sum(tree[c][7] / cover * expected(tree, x, known, c) for c in (left, right))


def by_subsets(tree, x, n):
    out = []
    for f in range(n):
        rest, total = [k for k in range(n) if k != f], 0.0
        for size in range(n):
            for own in itertools.combinations(rest, size):
                total += math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n) * (expected(tree, x, {*own, f}) - expected(tree, x, set(own)))
        out.append(total)
    return out


def test_equals_enumeration_of_all_subsets(spark):
    rnd, n = random.Random(5), 6
    models = {m: [grown(rnd, 6, n, m, t) for t in range(4)] for m in (1, 2)}
    nodes = spark.createDataFrame([r for trees in models.values() for tree in trees for r in tree], NODE)
    rows = [(k, 1 + k % 2, *(rnd.uniform(0, 1) for _ in range(n))) for k in range(30)]
    cut = next(r for r in models[1][0] if r[3] is not None)  # a value on a threshold goes left
    rows.append((99, 1, *(cut[4] if f == cut[3] else 0.5 for f in range(n))))
    names = [f"x{f}" for f in range(n)]
    df = spark.createDataFrame(rows, "id int, fold int, " + ", ".join(f"{c} double" for c in names))
    got = T.contributions(df, T.models(T.paths(nodes, 6), n), "fold", names).collect()
    assert len(got) == 31
    for r in got:
        x = [r[c] for c in names]
        own = [by_subsets(tree, x, n) for tree in models[r.fold]]
        assert r.phi == pytest.approx([sum(v) for v in zip(*own, strict=True)], abs=1e-9)
        assert r.bias + sum(r.phi) == pytest.approx(sum(expected(t, x, set(range(n))) for t in models[r.fold]), abs=1e-9)


def test_a_tree_that_is_a_leaf(spark):
    nodes = spark.createDataFrame([(1, 0, 0, None, None, None, None, 9.0, 0.25)], NODE)
    got = T.contributions(spark.createDataFrame([(1, 3.0)], "m int, a double"), T.models(T.paths(nodes, 3), 1), "m", ["a"]).first()
    assert got.bias == 0.25 and got.phi == [0.0]


def test_paths_with_too_many_tests_are_refused(spark):
    n = T.MOST_TESTS + 1
    rows = [(1, 0, 2 * k, k, 0.5, 2 * k + 1, 2 * k + 2, float(2 * n - k), 0.0) for k in range(n)] + [(1, 0, 2 * k + 1, None, None, None, None, 1.0, 1.0) for k in range(n)] + [(1, 0, 2 * n, None, None, None, None, 1.0, 1.0)]
    with pytest.raises(Exception, match="too many tests"):
        T.models(T.paths(spark.createDataFrame(rows, NODE), n), n).collect()


def test_boosted_contributions_sum_to_the_margin(spark):
    rnd = random.Random(2)
    rows = [("s", k, *(x := [rnd.random() for _ in range(3)]), float(x[0] * x[1] + rnd.gauss(0, 0.1) > 0.25)) for k in range(400)]
    df = spark.createDataFrame(rows, "series_id string, bar_idx long, a double, b double, c double, y double")
    spec = pd.DataFrame([(1, 200, 0, 0, 210, 300, 200, 0), (2, 290, 0, 0, 300, 400, 290, 0)], columns=["fold", "train_end", "val_start", "val_end", "test_start", "test_end", "train_below", "val_below"])
    out, ways = T.boosted_folds(df, ["a", "b", "c"], "y", spec, rounds=4, depth=3)
    got = out.collect()
    assert len(got) == 190 and {r.fold for r in got} == {1, 2}
    assert max(abs(r.bias + sum(r.phi) - r.margin) for r in got) < 1e-9
    assert ways.select("model", "tree").distinct().count() == 8
    s = {r.feature: r for r in T.summary(out, "fold", ["a", "b", "c"], 0.05, ("c",)).collect()}
    mean = sum(abs(r.phi[0]) for r in got) / 190
    assert s["a"].mean_abs == pytest.approx(mean) and {s["a"]["rank"], s["b"]["rank"]} == {1, 2} and s["c"]["rank"] == 3 and not s["c"].prune


def test_top_changes(spark):
    df = lambda names: spark.createDataFrame([(n, k + 1) for k, n in enumerate(names)], "feature string, rank int")
    got = {r.feature: r.change for r in T.top_changes(df("abcd"), df("bxay"), 2).collect()}
    assert got == {"a": "entered", "b": "stable", "x": "left"}


def test_mean_split_trees(spark):
    rows = [(1, float(a), float(b), float(a and b)) for a in (0, 1) for b in (0, 1) for _ in range(3)] + [(2, 1.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "m long, a double, b double, y double")
    ways = T.paths(T.mean_split_nodes(df, "m", ["a", "b"], [(0, 1)], "y"), 2)
    assert {(r.model, r.value) for r in ways.collect()} == {(1, 0.0), (1, 1.0), (2, 1.0)} and ways.count() == 5
    got = T.contributions(df.filter("m = 1 and a = 1 and b = 1").limit(1), T.models(ways, 2), "m", ["a", "b"]).first()
    assert got.bias == pytest.approx(0.25) and got.phi == pytest.approx([0.375, 0.375])


def test_folds_read_what_rows_come_from_once(spark):
    from tidebar.operators import validation as V

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("s", k, float(k * 7 % 13), float(k * 5 % 11), float(k * 3 % 17), k * 7 % 13 > 6) for k in range(600)]
    df = spark.createDataFrame(rows, "series_id string, bar_idx long, a double, b double, c double, y boolean").mapInArrow(counted, "series_id string, bar_idx long, a double, b double, c double, y boolean")
    spec = V.folds(600, 200, 150, 10, 10, least=20)
    out, _ = T.boosted_folds(df, ["a", "b", "c"], "y", spec, rounds=2, depth=2)
    assert out.select("fold").distinct().count() == len(spec) > 1 and seen.value == 600
    V.boosted_folds(df, ["a", "b", "c"], "y", spec, rounds=2).collect()
    assert seen.value == 1200
