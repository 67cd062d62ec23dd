"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line. Each time is the median of three runs after a warm-up."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from tidebar import catalog
from tidebar.session import local_session

HEADLINE = [
    "a1_resample", "a3_coarsen_completeness", "j1_asof_higher_timeframe", "j5_range_aggregate", "a7_previous_levels", "i1_atr", "i9_macd", "i17_adx", "i19_volume", "i21_volatility", "i22_bands", "i38_regimes",
    "m1_displacement", "m2_swings", "m4_order_blocks", "m6_gaps", "m5_anchored_blocks", "m10_sweeps", "l2_triple_barrier", "l5_limit_fills", "b1_cooldown", "b4_equity", "a8_win_rates", "a10_ratio_horizon_matrix", "v4_cscv", "a17_auc",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    for name in HEADLINE:
        taken = []
        for _ in range(4):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(median(taken[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}))
    spark.stop()


if __name__ == "__main__":
    main()
