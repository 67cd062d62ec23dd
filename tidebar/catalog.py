"""The registered queries of the bar engine and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidebar.plans import q_bars, q_catalog, q_indicators, q_models, q_more, q_structure, q_trading, q_validation  # noqa: F401
from tidebar.plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["a8_win_rates"](spark, sf_dir)
