"""Contributions of features to the predictions of tree ensembles: exact Shapley values of the path-dependent expectation.

A tree is a table of nodes, and becomes a table of root-to-leaf paths by one join a level. A path that tests a feature several times tests one interval of
it; `z` is the share of the training rows at the tests' nodes that go the path's way. What a path gives a feature depends on a row only through which of
the path's tests the row passes, so that it is worked out once for each path and pattern of passed tests, in tables of the model's size. The Shapley
weight of a subset of k of m - 1 other tests is the integral of t^k (1 - t)^(m - 1 - k), so the sum over all subsets is the integral of a product of one
linear factor for each test, which Gauss-Legendre quadrature with 8 points gives exactly for up to 16 tests.

Rows meet their model (a fold's, say) in one equi-join. They aren't multiplied: a row's patterns and sums are array expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.functions import finite
from tidebar.session import scratch

#: Tests on a path at most: a path has a row for each pattern of them.
MOST_TESTS = 12
#: Folds that are fitted at once, as their jobs are small.
FITS = 4
_POINTS, _WEIGHTS = ((x + 1) / 2 if k == 0 else x / 2 for k, x in enumerate(np.polynomial.legendre.leggauss(8)))
_QUADRATURE = "array(" + ", ".join(f"named_struct('t', {float(t)!r}D, 'w', {float(w)!r}D)" for t, w in zip(_POINTS, _WEIGHTS, strict=True)) + ")"
_TESTS = "array<struct<f: int, lo: double, hi: double, z: double>>"

NODES = ("model", "tree", "node", "feature", "threshold", "left", "right", "cover", "value")


def nodes_of_boosted(model, name: int) -> DataFrame:  # noqa: ANN001
    """NODES of a fitted boosted-tree classifier or regressor, as Spark writes it. A leaf's value has its tree's weight; the sum over trees is the margin."""
    spark = SparkSession.active()
    folder = scratch(spark, "boosted")
    model.write().save(folder)
    n = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*")
    weights = F.array(*map(F.lit, map(float, model.treeWeights)))
    inner = F.col("leftChild") >= 0
    return n.select(
        F.lit(name).cast("long").alias("model"), F.col("treeID").alias("tree"), F.col("id").alias("node"), F.when(inner, F.col("split.featureIndex")).alias("feature"), F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"), F.col("rawCount").cast("double").alias("cover"), (F.col("prediction") * F.get(weights, F.col("treeID"))).alias("value"),
    )


def mean_split_nodes(rows: DataFrame, model: str, features: list[str], trees: list[tuple[int, ...]], label: str) -> DataFrame:
    """NODES of trees that split every node of level k at the mean of the tree's k-th feature over the model's rows; a leaf's value is the label's mean,
    divided by the number of trees. All models are learned in two aggregates. Without rows in it, a leaf isn't there."""
    means = rows.groupBy(model).agg(*(F.avg(c).alias(f"__m{k}") for k, c in enumerate(features)))
    x = rows.join(means, model)
    bits = lambda tree: sum((F.when(F.col(features[f]) > F.col(f"__m{f}"), 1 << len(tree) - 1 - k).otherwise(0) for k, f in enumerate(tree)), F.lit(0))
    kinds = F.array(*(F.struct(F.lit(t).alias("tree"), bits(tree).alias("bits")) for t, tree in enumerate(trees)))
    leaves = x.select(model, F.explode(kinds).alias("k"), F.col(label).cast("double").alias("y")).groupBy(model, "k.tree", "k.bits").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("s"))
    depth = F.element_at(F.array(*(F.lit(len(t)) for t in trees)), F.col("tree") + 1)
    # a node of level l has the leaf's first l bits
    up = leaves.withColumn("depth", depth).withColumn("level", F.explode(F.expr("sequence(0, depth)"))).withColumn("node", F.expr("cast(shiftleft(1, level) - 1 + shiftright(bits, depth - level) AS int)"))
    n = up.groupBy(model, "tree", "node", "level", "depth").agg(F.sum("n").alias("cover"), F.sum("s").alias("s"))
    of = F.array(*(F.array(*map(F.lit, t)) for t in trees))
    feature = F.when(F.col("level") < F.col("depth"), F.get(F.get(of, F.col("tree")), F.col("level")))
    threshold = F.get(F.array(*(f"__m{k}" for k in range(len(features)))), feature)
    child = lambda k: F.when(F.col("level") < F.col("depth"), F.col("node") * 2 + k)
    return n.join(means, model).select(F.col(model).cast("long").alias("model"), "tree", "node", feature.alias("feature"), threshold.alias("threshold"), child(1).alias("left"), child(2).alias("right"), "cover", (F.col("s") / F.col("cover") / len(trees)).alias("value"))


def paths(nodes: DataFrame, depth: int) -> DataFrame:
    """(model, tree, node, value, tests): every leaf with the tests on its way, one for each feature; for nodes of at most this depth, written once."""
    spark, folder = nodes.sparkSession, scratch(nodes.sparkSession, "paths")
    nodes.select(*NODES).write.parquet(f"{folder}/nodes")
    n = spark.read.parquet(f"{folder}/nodes")
    covers = n.select("model", "tree", F.col("node").alias("child"), F.col("cover").alias("child_cover"))
    found, at = [], n.filter("node = 0").withColumn("tests", F.array().cast(_TESTS))
    for _ in range(depth):
        found.append(at.filter("left IS NULL").select("model", "tree", "node", "value", "tests"))
        ways = F.array(F.struct(F.col("left").alias("child"), F.lit(None).cast("double").alias("lo"), F.col("threshold").alias("hi")), F.struct(F.col("right").alias("child"), F.col("threshold").alias("lo"), F.lit(None).cast("double").alias("hi")))
        down = at.filter("left IS NOT NULL").select("model", "tree", "feature", "cover", "tests", F.inline(ways)).join(covers, ["model", "tree", "child"])
        test = F.array(F.struct(F.col("feature").alias("f"), "lo", "hi", (F.col("child_cover") / F.col("cover")).alias("z")).cast(_TESTS[6:-1]))
        at = down.select("model", "tree", F.col("child").alias("node"), F.concat("tests", test).alias("tests")).join(n, ["model", "tree", "node"])
    found.append(at.filter("left IS NULL").select("model", "tree", "node", "value", "tests"))
    leaves = found[0]
    for f in found[1:]:
        leaves = leaves.union(f)
    leaves.write.parquet(f"{folder}/leaves")
    leaves = spark.read.parquet(f"{folder}/leaves")
    key = ["model", "tree", "node"]
    one = leaves.select(*key, F.inline("tests")).groupBy(*key, "f").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.product("z").alias("z"))
    merged = one.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("f", "lo", "hi", "z"))).alias("own"))
    return leaves.join(merged, key, "left").select(*key, "value", F.coalesce("own", F.array().cast(_TESTS)).alias("tests"))


def models(paths_: DataFrame, features: int) -> DataFrame:
    """(model, bias, paths): a row for each model, of its own size: its mean prediction, and for each path its tests with what it gives each feature under
    each pattern of passed tests."""
    p = paths_.withColumn("pattern", F.explode(F.expr(f"sequence(0, IF(size(tests) > {MOST_TESTS}, raise_error('a path has too many tests'), shiftleft(1, size(tests))) - 1)")))
    p = p.withColumn("s", F.expr("transform(tests, (t, j) -> named_struct('f', t.f, 'z', t.z, 'o', CAST(shiftright(pattern, size(tests) - 1 - j) % 2 AS double)))"))
    others = f"aggregate({_QUADRATURE}, 0D, (a, q) -> a + q.w * aggregate(filter(s, (u, j) -> j <> i), 1D, (b, u) -> b * (u.z * (1 - q.t) + u.o * q.t)))"
    p = p.withColumn("phi", F.expr(f"transform(s, (t, i) -> named_struct('f', t.f, 'v', value * (t.o - t.z) * {others}))"))
    p = p.withColumn("phi", F.expr(f"transform(sequence(0, {features - 1}), k -> aggregate(phi, 0D, (a, x) -> a + IF(x.f = k, x.v, 0D)))"))
    by_path = p.groupBy("model", "tree", "node", "value", "tests").agg(F.expr("transform(array_sort(collect_list(struct(pattern, phi))), x -> x.phi)").alias("phi"))
    mean = F.expr("value * aggregate(tests, 1D, (a, t) -> a * t.z)")
    return by_path.groupBy("model").agg(F.sum(mean).alias("bias"), F.array_sort(F.collect_list(F.struct("tree", "node", F.expr("transform(tests, t -> named_struct('f', t.f, 'lo', t.lo, 'hi', t.hi))").alias("tests"), "phi"))).alias("paths"))


def contributions(rows: DataFrame, models_: DataFrame, model: str, features: list[str], out: str = "phi") -> DataFrame:
    """rows with `bias` and an array of every feature's contribution to their model's prediction; bias and contributions sum to it. Features aren't null."""
    m = models_.select(F.col("model").alias(model), "bias", F.col("paths").alias("__paths"))
    x = rows.withColumn("__x", F.array(*(F.col(c).cast("double") for c in features))).join(m, model)

    def pattern(p: Column) -> Column:
        # an open side passes all values: minus infinity isn't above itself, and NaN, which is above all, isn't below infinity
        passed = lambda t: (t["lo"].isNull() | (F.get("__x", t["f"]) > t["lo"])) & (t["hi"].isNull() | (F.get("__x", t["f"]) <= t["hi"]))
        return F.aggregate(p["tests"], F.lit(0), lambda a, t: a * 2 + passed(t).cast("int"))

    total = F.aggregate("__paths", F.array(*[F.lit(0.0)] * len(features)), lambda a, p: F.zip_with(a, F.get(p["phi"], pattern(p)), lambda u, v: u + v))
    return x.withColumn(out, total).drop("__x", "__paths")


def summary(contributed: DataFrame, fold: str, features: list[str], least: float = 0.010, protected: tuple[str, ...] = (), phi: str = "phi") -> DataFrame:
    """(feature, mean_abs, cv, rank, prune): the mean absolute contribution over all rows, how it varies between folds (population deviation by mean), its
    place, and whether the feature may go: its mean is under `least` and it isn't protected."""
    parts = F.array(*(F.struct(F.lit(c).alias("feature"), F.abs(F.get(phi, F.lit(k))).alias("v")) for k, c in enumerate(features)))
    per_fold = contributed.select(fold, F.inline(parts)).groupBy(fold, "feature").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    s = per_fold.groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("mean_abs"), F.coalesce(F.stddev_pop(F.col("s") / F.col("n")) / F.nullif(F.avg(F.col("s") / F.col("n")), F.lit(0.0)), F.lit(0.0)).alias("cv"))
    rank = F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature"))  # a row for each feature
    return s.withColumn("rank", rank).withColumn("prune", (F.col("mean_abs") < least) & ~F.col("feature").isin(*protected))


def top_changes(current: DataFrame, previous: DataFrame, top: int = 30) -> DataFrame:
    """(feature, change): which features entered or left the first `top` of two summaries, and which stayed."""
    at = lambda df, name: df.filter(F.col("rank") <= top).select("feature", F.lit(True).alias(name))
    both = at(current, "now").join(at(previous, "before"), "feature", "full")
    return both.select("feature", F.when(F.col("now").isNull(), "left").when(F.col("before").isNull(), "entered").otherwise("stable").alias("change"))


def fitted_folds(df: DataFrame, features: list[str], label: str, spec: pd.DataFrame, rounds: int, depth: int, each: Callable[[int, object, DataFrame], None]) -> int:
    """Boosted classifiers on walk-forward folds, FITS at once: each(fold, model, test rows with the vector __v) is called for every fold that has rows of
    both classes to learn from; how many there were. Rows with all features are written once, so a fold reads these and not what they come from."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    spark, folder = df.sparkSession, scratch(df.sparkSession, "folds")
    df.filter(F.col(label).isNotNull() & finite(features)).withColumn("__y", F.col(label).cast("double")).write.parquet(folder)
    x = VectorAssembler(inputCols=features, outputCol="__v").transform(spark.read.parquet(folder))
    first = sorted(r["at"] for r in x.groupBy("__y").agg(F.min("bar_idx").alias("at")).collect())  # where each class is first seen
    below = lambda f: min(f.train_end, f.train_below)
    fit = [f for f in spec.itertuples() if len(first) > 1 and first[1] < below(f)]

    def work(f) -> None:  # noqa: ANN001
        model = GBTClassifier(featuresCol="__v", labelCol="__y", maxIter=rounds, maxDepth=depth, seed=7).fit(x.filter(F.col("bar_idx") < int(below(f))))
        each(int(f.fold), model, x.filter((F.col("bar_idx") >= int(f.test_start)) & (F.col("bar_idx") < int(f.test_end))))

    with ThreadPool(FITS) as pool:
        pool.map(inheritable_thread_target(spark)(work), fit, chunksize=1)
    return len(fit)


def boosted_folds(df: DataFrame, features: list[str], label: str, spec: pd.DataFrame, rounds: int = 10, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Boosted classifiers on walk-forward folds: the test rows with their fold, margin and contributions; and the paths of all folds' trees. Contributions
    of all folds are one plan."""
    from pyspark.ml.functions import vector_to_array

    spark, folder = df.sparkSession, scratch(df.sparkSession, "boosted-folds")

    def each(fold: int, model, own: DataFrame) -> None:  # noqa: ANN001
        own = model.transform(own).withColumns({"fold": F.lit(fold).cast("long"), "margin": vector_to_array("rawPrediction")[1]})
        own.drop("__v", "rawPrediction", "probability", "prediction").write.parquet(f"{folder}/tests/{fold}")
        nodes_of_boosted(model, fold).write.parquet(f"{folder}/nodes/{fold}")

    if not fitted_folds(df, features, label, spec, rounds, depth, each):
        raise ValueError("no fold has rows of both classes to learn from")
    ways = paths(spark.read.parquet(f"{folder}/nodes/*"), depth)
    return contributions(spark.read.parquet(f"{folder}/tests/*"), models(ways, len(features)), "fold", features), ways
