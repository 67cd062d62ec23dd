"""Text ingestion: headerless or headed CSV lines, timestamps of either unit, sorted deduplication, versioned scans and small registries."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Above this a timestamp is in microseconds.
MICROS_FROM = 100_000_000_000_000


def parse_lines(lines: DataFrame, schema: str, column: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """CSV lines as columns of text, beside the columns to keep; casts are left to the caller, so that a header is just a row that doesn't parse."""
    return lines.select(*keep, F.from_csv(column, schema).alias("r")).select(*keep, "r.*")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=False)


def to_millis(raw: str) -> Column:
    """Epoch milliseconds of text in milli- or microseconds; null if it is no number."""
    x = F.expr(f"try_cast({raw} AS bigint)")
    return F.when(x >= MICROS_FROM, F.floor(x / 1000)).otherwise(x)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order (dropDuplicates doesn't say which row stays)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def versioned(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """The first candidate path that can be read; holdout data is refused."""
    for path in candidates:
        if "holdout" in path or "_full" in os.path.basename(path.rstrip("/")):
            raise ValueError(f"holdout and full data must not be read here: {path}")
    for path in candidates:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            continue
    raise FileNotFoundError(f"none of {candidates}")


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """From the schema alone."""
    return [c for c in wanted if c not in df.columns]


def write_bars(df: DataFrame, path: str, ts: str = "ts", by_month: bool = False) -> None:
    """zstd parquet, a folder for each month if asked for."""
    out = df.withColumn("ym", F.date_format(ts, "yyyy-MM")) if by_month else df
    writer = out.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy("ym") if by_month else writer).parquet(path)


def write_array(df: DataFrame, path: str, at: str, value: str) -> None:
    """A cached array as a table of places and values."""
    df.select(F.col(at).alias("at"), F.col(value).alias("value")).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_array(spark: SparkSession, path: str, length: int) -> DataFrame:
    """A cached array, if it has just this length; a cache of other data is refused."""
    found = spark.read.parquet(path)
    n = found.count()
    if n != length:
        raise ValueError(f"{path} has {n} values where {length} are due")
    return found


def upsert(registry: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The registry with these rows in place of those of the same key."""
    return registry.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def digests(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """For each part of a table its number of rows and a digest that doesn't depend on their order: the exclusive or of the first 60 bits of every row's
    SHA-256. Copies of a table agree part by part; a row that comes twice cancels out, which the number of rows shows."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.bit_xor(F.conv(F.substring(row, 1, 15), 16, 10).cast("long")).alias("digest"))


def description(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row of ranges and counts of a table, in one pass."""
    return df.agg(F.count("*").alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def describe(df: DataFrame, ts: str = "ts") -> str:
    """Ranges and counts of a table as JSON."""
    r = df.agg(F.count("*").alias("rows"), F.min(ts).cast("string").alias("first"), F.max(ts).cast("string").alias("last")).first()
    return json.dumps({**r.asDict(), "columns": len(df.columns)})


def upsert_registry(path: str, row: dict, key: str = "id") -> list[dict]:
    """Replaces or adds a row of a JSON registry, which is small and belongs to the driver; the file is replaced at once."""
    rows = json.load(open(path)) if os.path.exists(path) else []  # noqa: SIM115
    rows = [r for r in rows if r.get(key) != row[key]] + [row]
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w") as f:
        json.dump(rows, f)
    os.replace(temporary, path)
    return rows
