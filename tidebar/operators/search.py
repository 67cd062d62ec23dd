"""Parameter search over tables of trials: pruning, proposals, tiers, and runs that may fail."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def median_pruned(steps: DataFrame, warm_up: int = 3) -> DataFrame:
    """From (trial, step, value): for each trial the first step at which its best value so far lies under the median that the trials before it reached at
    that step (null if it never does), and its last value that counts. The first `warm_up` trials of a step are never pruned."""
    best = F.max("value").over(Window.partitionBy("trial").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    x = steps.withColumn("best", best)
    before = Window.partitionBy("step").orderBy("trial").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({"median": F.percentile("best", F.lit(0.5)).over(before), "seen": F.count("best").over(before)})
    x = x.withColumn("low", (F.col("seen") >= warm_up) & (F.col("best") < F.col("median")))
    ends = x.groupBy("trial").agg(F.min(F.when(F.col("low"), F.col("step"))).alias("pruned_at"))
    return x.join(ends, "trial").filter(F.col("pruned_at").isNull() | (F.col("step") <= F.col("pruned_at"))).groupBy("trial", "pruned_at").agg(F.max_by("best", "step").alias("best"), F.count("*").alias("steps"))


def proposals(options: DataFrame, runs: DataFrame, option: str, failures: int = 2) -> DataFrame:
    """The options that are worth a run: not finished yet, and not failed `failures` times; those with fewer failures first."""
    seen = runs.groupBy(option).agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))
    open_ = options.join(seen, option, "left").na.fill(0, ["done", "failed"]).filter((F.col("done") == 0) & (F.col("failed") < failures))
    return open_.select(option, "failed")


def active(features: DataFrame, tiers: DataFrame, excluded: list[str]) -> DataFrame:
    """The features that are in none of the excluded tiers."""
    return features.join(tiers.filter(F.col("tier").isin(excluded)).select("feature").distinct(), "feature", "left_anti")


def safely(run: Callable[[], dict], retries: int = 1) -> dict:
    """What a run returns; a run that fails is tried again, and then recorded as failed with its error."""
    for attempt in range(retries + 1):
        try:
            return {"status": "done", "attempts": attempt + 1, **run()}
        except Exception as e:  # noqa: BLE001  whatever it is, it's the record
            error = f"{type(e).__name__}: {e}"
    return {"status": "failed", "attempts": retries + 1, "error": error}


def run_groups(df: DataFrame, by: list[str], run: Callable[[pd.DataFrame], dict], results: str, retries: int = 1) -> DataFrame:
    """safely() for every group, in parallel: its keys, status, attempts and error, and the run's results (a schema of columns; null where it failed). A
    group that fails takes no other one with it. A group is one run, and is held by a task."""
    kinds = T.StructType.fromDDL(results)
    schema = T.StructType([*(df.schema[c] for c in by), T.StructField("status", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType()), *kinds.fields])

    def work(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        row = safely(lambda: run(own), retries)
        return pd.DataFrame([(*key, row["status"], row["attempts"], row.get("error"), *(row.get(c) for c in kinds.names))], columns=schema.names)

    return df.groupBy(*by).applyInPandas(work, schema)
