"""What to try next, from a registry of experiments: open questions, diagnoses of failed gates, and settings changed by rules within bounded parameters.

A registry has a row for each experiment: id, seq (their order), status, tier, question (null: none), passed, params (map of numbers and option numbers)
and metrics (map). All steps are joins and aggregates on it; rules, gates, parameters and questions are small tables of their own.

Nulls: a missing or null metric fails its gate, with no distance; a setting that an experiment lacks has its parameter's default. Experiments that come
twice count twice in orders, once as tried settings. An empty registry leaves every open question and no changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the domain: parameters with their defaults and options, gates with their bounds, and what a failed gate asks for.
PARAMETERS: dict[str, tuple[object, tuple]] = {
    "ml_threshold": (0.60, (0.55, 0.57, 0.60, 0.62, 0.65, 0.70, 0.75, 0.80)),
    "cooldown_bars": (576, (144, 288, 576, 864, 1152, 2016, 4032, 8640)),
    "target_r": (2.0, (1.0, 1.5, 2.0, 2.5, 3.0)),
    "max_bars": (36, (12, 24, 36, 48, 96, 144, 288)),
    "stop_atr_mult": (1.0, (0.5, 0.75, 1.0, 1.25, 1.5, 2.0)),
    "entry_type": ("market", ("market", "limit_ob_mid", "limit_fvg_edge")),
    "direction": ("long", ("long", "short")),
    "ob_age_cap": (200, (96, 144, 200, 288, 576)),
    "ob_mitigation": ("50pct", ("wick_touch", "50pct", "close_through")),
    "fvg_min_size_atr": (0.50, (0.10, 0.20, 0.35, 0.50, 0.75)),
    "fvg_age_cap": (100, (24, 48, 100, 144, 288)),
    "swing_n_internal": (5, (3, 5, 7, 10)),
    "swing_n_external": (10, (7, 10, 15, 20)),
    "displacement_atr_mult": (1.5, (1.0, 1.5, 2.0, 3.0)),
    "liq_tolerance_atr": (0.10, (0.05, 0.10, 0.20, 0.30)),
    "breaker_age_cap": (200, (96, 144, 200, 288, 576)),
    "pd_lookback": (96, (48, 96, 144, 288)),
    "ote_fib_low": (0.618, (0.50, 0.618, 0.65)),
    "ote_fib_high": (0.786, (0.786, 0.79, 0.85)),
    "hmm_bull_threshold": (0.60, (0.45, 0.50, 0.55, 0.60, 0.65, 0.70)),
    "kelly_divisor": (40.0, (20.0, 30.0, 40.0, 50.0)),
    "tier": ("standard", ("standard", "weekly", "monthly")),
}
#: metric, least or most, bound
GATES: dict[str, tuple[str, str, float]] = {
    "MIN_TRADES_PER_YEAR": ("trades_per_yr", "least", 100),
    "MIN_OOS_AUC": ("oos_auc", "least", 0.75),
    "MAX_PBO": ("pbo", "most", 0.05),
    "MIN_PSR": ("psr", "least", 0.99),
    "MIN_SHARPE": ("sharpe_ann", "least", 2.0),
    "MIN_WR": ("win_rate", "least", 0.55),
    "MIN_EV_R": ("ev_r", "least", 0.50),
    "MAX_DRAWDOWN": ("max_drawdown", "most", 0.20),
    "MAX_ECE": ("ece", "most", 0.05),
}
#: gate, what is asked for, parameter that changes (or none), by how much
RULES: tuple[tuple[str, str, str | None, float | None], ...] = (
    ("MIN_TRADES_PER_YEAR", "lower threshold", "ml_threshold", -0.02),
    ("MIN_TRADES_PER_YEAR", "shorter cooldown", "cooldown_bars", -96.0),
    ("MIN_WR", "higher threshold", "ml_threshold", 0.02),
    ("MIN_WR", "filter by quality", None, None),
    ("MAX_DRAWDOWN", "shorter cooldown", "cooldown_bars", -96.0),
    ("MAX_DRAWDOWN", "smaller fraction", "kelly_divisor", 10.0),
    ("MIN_OOS_AUC", "add a feature", None, None),
    ("MAX_ECE", "calibrate", None, None),
    ("MIN_SHARPE", "look into value or frequency", None, None),
    ("MIN_EV_R", "higher threshold", "ml_threshold", 0.02),
)
#: Failures in a row after which a question is given up; minutes a fold of 500 features by device; folds.
GIVEN_UP, MINUTES, FOLDS = 2, {"gpu": 1.5, "cpu": 4.0}, 11


def parameters(spark: SparkSession, space: dict[str, tuple[object, tuple]] = PARAMETERS) -> DataFrame:
    """(parameter, default, low, high): the bounds of every parameter; options that aren't numbers count by their place."""
    at = lambda options, v: float(v) if isinstance(v, (int, float)) else float(options.index(v))
    rows = [(name, at(o, default), min(at(o, v) for v in o), max(at(o, v) for v in o)) for name, (default, o) in space.items()]
    return spark.createDataFrame(rows, "parameter string, default double, low double, high double")


def diagnoses(registry: DataFrame, gates: dict[str, tuple[str, str, float]] = GATES, rules: Sequence[tuple] = RULES) -> DataFrame:
    """(id, seq, tier, gate, value, bound, gap, action, parameter, step): for every done experiment, each gate that it fails and what is asked for. The gap
    is the distance from the bound as a share of it. A gate without a rule has null actions."""
    spark = registry.sparkSession

    def failed(name: str) -> Column:
        metric, kind, bound = gates[name]
        v = F.col("metrics")[metric]
        holds = v >= bound if kind == "least" else v <= bound
        return F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("gate"), v.alias("value"), F.lit(float(bound)).alias("bound")))

    each = F.array_compact(F.array(*map(failed, gates)))
    f = registry.filter("status = 'DONE'").select("id", "seq", "tier", F.inline(each))
    table = spark.createDataFrame(list(rules), "gate string, action string, parameter string, step double")
    return f.withColumn("gap", F.abs(F.col("value") - F.col("bound")) / F.col("bound")).join(table, "gate", "left")


def mutations(registry: DataFrame, space: dict[str, tuple[object, tuple]] = PARAMETERS, gates: dict[str, tuple[str, str, float]] = GATES, rules: Sequence[tuple] = RULES, metric: str = "sharpe_ann") -> DataFrame:
    """(tier, rank, base, parameter, old, new, gates, gap): for the best done experiment of each tier, one changed setting a row, kept in its bounds. Settings
    that the tier has tried (all parameters of the rules equal) or that the bounds leave as they are aren't named; those that more failed gates ask for
    come first, then those with larger gaps together."""
    spark = registry.sparkSession
    bounds = {r.parameter: r for r in parameters(spark, space).collect()}  # a row for each parameter
    changed = sorted({r[2] for r in rules if r[2]})
    setting = lambda p: F.coalesce(F.col("params")[p], F.lit(bounds[p].default))
    settings = F.struct(*(F.round(setting(p), 6).alias(p) for p in changed))
    done = registry.filter("status = 'DONE'")
    best = done.groupBy("tier").agg(F.max_by("id", F.struct(F.coalesce(F.col("metrics")[metric], F.lit(float("-inf"))), -F.col("seq"))).alias("id"))
    bases = done.join(best, ["tier", "id"]).select("tier", "id", settings.alias("now"))
    asked = diagnoses(registry.join(best, ["tier", "id"], "left_semi"), gates, rules).filter("parameter IS NOT NULL")
    # gates may ask for opposite changes of one parameter: each direction is a proposal
    asked = asked.groupBy("tier", "id", "parameter", "step").agg(F.count_distinct("gate").alias("gates"), F.sum("gap").alias("gap"))
    new = lambda p: F.round(F.least(F.lit(bounds[p].high), F.greatest(F.lit(bounds[p].low), F.col("now")[p] + F.col("step"))), 6)
    moved = F.struct(*(F.when(F.col("parameter") == p, new(p)).otherwise(F.col("now")[p]).alias(p) for p in changed))
    x = asked.join(bases, ["tier", "id"]).withColumn("then", moved).filter(F.col("then") != F.col("now"))
    fresh = x.join(done.select("tier", settings.alias("then")).distinct(), ["tier", "then"], "left_anti")
    pick = lambda c: F.coalesce(*(F.when(F.col("parameter") == p, F.col(c)[p]) for p in changed))
    order = Window.partitionBy("tier").orderBy(F.desc("gates"), F.desc_nulls_last(F.round("gap", 9)), "parameter", "step")  # a row for each rule at most
    return fresh.select("tier", F.row_number().over(order).alias("rank"), F.col("id").alias("base"), "parameter", pick("now").alias("old"), pick("then").alias("new"), "gates", "gap")


def given_up(registry: DataFrame, failures: int = GIVEN_UP) -> DataFrame:
    """(question): those that failed so often since the last done experiment that passed."""
    done = registry.filter("status = 'DONE'")
    last = done.filter("passed").agg(F.coalesce(F.max("seq"), F.lit(-(2**63))).alias("last"))
    since = done.filter(~F.coalesce(F.col("passed"), F.lit(False))).crossJoin(F.broadcast(last)).filter(F.col("seq") > F.col("last"))  # one number
    return since.filter("question IS NOT NULL").groupBy("question").agg(F.count("*").alias("n")).filter(F.col("n") >= failures).select("question")


def open_questions(questions: DataFrame, registry: DataFrame, features: DataFrame, versions: Sequence[str] = (), dead: int = 0, all_features: int = 508, device: str = "gpu") -> DataFrame:
    """(rank, question, priority, minutes): questions (question, priority, blocked, needs) by priority that no experiment names, that aren't blocked (but
    by a version that is there), whose needed features all exist, and that weren't given up; with the estimated minutes of their run."""
    ready = F.col("blocked").isNull()
    for v in versions:
        ready = ready | F.col("blocked").contains(v)
    x = questions.filter(ready)
    x = x.join(registry.select("question").distinct(), "question", "left_anti").join(given_up(registry), "question", "left_anti")
    lacking = x.select("question", F.explode("needs").alias("feature")).join(features.select("feature").distinct(), "feature", "left_anti").select("question").distinct()
    x = x.join(lacking, "question", "left_anti")
    minutes = MINUTES[device] * FOLDS * (all_features - dead + F.coalesce(F.array_size("needs"), F.lit(0))) / 500.0
    ranked = x.select("question", "priority", minutes.alias("minutes"))
    counts = ranked.groupBy("priority").agg(F.count("*").alias("n"))  # priorities are few; questions of one priority are ranked among themselves
    above = counts.select("priority", F.coalesce(F.sum("n").over(Window.orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    return ranked.join(above, "priority").select((F.col("above") + F.row_number().over(Window.partitionBy("priority").orderBy("question"))).alias("rank"), "question", "priority", "minutes")


def untested(registry: DataFrame, space: dict[str, tuple[object, tuple]] = PARAMETERS) -> DataFrame:
    """(parameter, option): options, as numbers or places, that no experiment has had."""
    spark = registry.sparkSession
    coded = [(name, float(v) if isinstance(v, (int, float)) else float(k)) for name, (_, options) in space.items() for k, v in enumerate(options)]
    had = registry.select(F.explode("params").alias("parameter", "option")).select("parameter", F.round("option", 6).alias("option")).distinct()
    return spark.createDataFrame(coded, "parameter string, option double").join(had, ["parameter", "option"], "left_anti")
