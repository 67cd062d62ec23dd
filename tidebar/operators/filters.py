"""Predicates and feature selection from declarations and schemas."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {"min": lambda c, v: c >= v, "max": lambda c, v: c <= v, "eq": lambda c, v: c == v}


def declarative(df: DataFrame, spec: dict[str, dict[str, float]]) -> Column:
    """All of {column: {min, max, eq}}; what is unknown is skipped with a warning, and a null never passes."""
    out = F.lit(True)
    for column, tests in spec.items():
        if column not in df.columns:
            warnings.warn(f"no column {column}; its filter is skipped", stacklevel=2)
            continue
        for op, value in tests.items():
            if op not in _OPS:
                warnings.warn(f"no filter operator {op}; it is skipped", stacklevel=2)
                continue
            out = out & F.coalesce(_OPS[op](F.col(column), value), F.lit(False))
    return out


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = (), prefixes: tuple[str, ...] = ("meta_", "label_")) -> list[str]:
    """Numeric columns that are no meta data, label or excluded, sorted."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return sorted(c for c, t in df.dtypes if t in numeric and not c.startswith(prefixes) and c not in exclude)


def drop_constant(df: DataFrame, columns: list[str]) -> list[str]:
    """Those columns that have two values at least, in one pass."""
    if not columns:
        return []
    r = df.agg(*(F.min(c).alias(f"a{k}") for k, c in enumerate(columns)), *(F.max(c).alias(f"b{k}") for k, c in enumerate(columns))).first()
    return [c for k, c in enumerate(columns) if r[f"a{k}"] is not None and r[f"a{k}"] != r[f"b{k}"]]
