"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.session import scratch


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """For links (a, b): every node with `root`, the least node that it reaches. Nulls and self-links are ignored; repeated links count once.

    Each round lets every node's larger neighbours (large star), then its smaller ones (small star), link to its least neighbour. A hub's
    neighbours are never collected: its least one is an aggregate that is written and joined back, so that the hub's partition can be split. Each
    round's links are written to the shared folder as well: lineage stays short and a lost executor costs one round at most.
    """
    spark = links.sparkSession
    folder = scratch(spark, "components")

    def written(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    edges, before = written("0", links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    for k in range(1, max_rounds + 1):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(f"{k}-least", both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(f"{k}-large", both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        below = written(f"{k}-below", large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(below, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(below.select("u", F.col("m").alias("v")))
        edges = written(str(k), small.distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
