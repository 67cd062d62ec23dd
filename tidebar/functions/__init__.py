"""Column functions that Spark doesn't have."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient(a: Column, b: Column) -> Column:
    """a / b as doubles have it: a division by zero is infinite, or NaN for 0 / 0, where Spark's / is null; null only where a or b is."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def natural_log(x: Column) -> Column:
    """ln(x) as doubles have it: minus infinity at zero and NaN below, where Spark's is null."""
    return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(F.log(x))


def finite(columns: list[str]) -> Column:
    """Whether all of these columns are there and are neither NaN nor infinite."""
    return reduce(Column.__and__, (F.coalesce(F.abs(F.col(c)) < math.inf, F.lit(False)) for c in columns))


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation of columns that are null together; null where one of them doesn't vary."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def normal_cdf(z: Column) -> Column:
    """Phi by Spark's own functions: there is no erf, so the tail's continued fraction for large z and the series for small ones (both to 1e-12)."""
    a = F.abs(z)
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    step = lambda acc, k: F.struct((acc["term"] * a * a / (2 * k + 1)).alias("term"), (acc["total"] + acc["term"] * a * a / (2 * k + 1)).alias("total"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(a.alias("term"), a.alias("total")), step)["total"]
    fraction = F.aggregate(F.sequence(F.lit(40), F.lit(1), F.lit(-1)), a, lambda acc, k: a + k / acc)
    low = F.when(a < 3, 0.5 - density * total).otherwise(density / fraction)
    return F.when(z < 0, low).otherwise(1 - low)
