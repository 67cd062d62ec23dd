"""Registration of queries with the SQL they must agree with. Doubles that are compared are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.session import ensure_semantics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None, floats: str = "") -> Callable:
    """Registers a query; `floats` names the columns that are rounded on both sides."""
    columns = floats.split()

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_semantics(spark, bars=True)
            out = f(spark, sf_dir)
            return out.withColumns({c: F.round(c, DIGITS) + F.lit(0.0) for c in columns}) if columns else out

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, {DIGITS}) + 0.0 AS {c}' for c in columns)}) FROM ({sql})" if columns else sql
        return f

    return keep


def bars_sql(interval: str = "15 minutes", by: str = "event_type") -> str:
    """A common table expression `bars` over events, as bars_of_events() makes them; by: the series column or a quoted constant."""
    return f"""bars AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS bar_idx FROM (
SELECT {by} AS series_id, time_bucket(INTERVAL '{interval}', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
sum(value) AS volume, count(*) AS trade_count, coalesce(sum(CASE WHEN user_id % 2 = 0 THEN value END), 0.0) AS taker_buy
FROM events WHERE value IS NOT NULL GROUP BY 1, 2))"""


def daily_sql() -> str:
    """A common table expression `bars` over orders: one bar a day of o_totalprice, in one series for each priority."""
    return """bars AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS bar_idx FROM (
SELECT o_orderpriority AS series_id, o_orderdate AS ts, first(o_totalprice ORDER BY o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderkey) AS close,
sum(o_totalprice) AS volume, count(*) AS trade_count, coalesce(sum(CASE WHEN o_custkey % 2 = 0 THEN o_totalprice END), 0.0) AS taker_buy
FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1, 2))"""
