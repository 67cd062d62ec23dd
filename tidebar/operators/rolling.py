"""Rolling, cumulative and recursive operators over bars."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.operators.bars import in_order, rows
from tidebar.operators.slicing import SLICE, sliced

#: Bars in a block of the recursive scan.
BLOCK = 256


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def guarded(aggregate: Column, x: Column | str, w: Window, least: int) -> Column:
    """The aggregate over a frame, null where fewer than `least` values are there."""
    return F.when(F.count(_col(x)).over(w) >= least, aggregate.over(w))


def rolling(f, x: Column | str, n: int, least: int | None = None) -> Column:  # noqa: ANN001
    """f of the last n values; by default all n must be there."""
    return guarded(f(_col(x)), x, rows(1 - n, 0), n if least is None else least)


def zscore(x: Column | str, n: int, least: int | None = None) -> Column:
    sd = rolling(F.stddev_samp, x, n, least)
    return F.when(sd != 0, (_col(x) - rolling(F.avg, x, n, least)) / sd)


def percentile_rank(x: Column | str, n: int, least: int | None = None) -> Column:
    """Rank (ties averaged) of the last value among the last n, as a share; for short frames, as it lists each (order_statistics() doesn't)."""
    w = rows(1 - n, 0)
    seen = F.collect_list(F.when(_col(x).isNotNull(), _col(x))).over(w)
    below, equal = F.size(F.filter(seen, lambda v: v < _col(x))), F.size(F.filter(seen, lambda v: v == _col(x)))
    return F.when(_col(x).isNotNull() & (F.size(seen) >= (n if least is None else least)), (below + (equal + 1) / 2) / F.size(seen))


class Rank(NamedTuple):
    """The rank (ties averaged) of a bar's value among the last n, as a share of those that are there; null for a null, or for fewer than `least`."""

    x: str
    n: int
    least: int | None = None

    @property
    def frame(self) -> tuple[int, int]:
        return 1 - self.n, 0

    def of(self, seen: list[float], own: float | None) -> float | None:
        if own is None or len(seen) < (self.n if self.least is None else self.least):
            return None
        below, upto = bisect_left(seen, own), bisect_right(seen, own)
        return (below + (upto - below + 1) / 2) / len(seen)


class Quantile(NamedTuple):
    """A quantile, by linear interpolation, of the values from `first` to `last` bars on (negative: back); null for fewer than `least`."""

    x: str
    q: float
    first: int
    last: int
    least: int

    @property
    def frame(self) -> tuple[int, int]:
        return self.first, self.last

    def of(self, seen: list[float], own: float | None) -> float | None:
        if len(seen) < max(self.least, 1):
            return None
        at = self.q * (len(seen) - 1)
        k = int(at)
        return seen[k] if at == k else (k + 1 - at) * seen[k] + (at - k) * seen[k + 1]


def order_statistics(df: DataFrame, **wanted: Rank | Quantile) -> DataFrame:
    """df with ranks and quantiles of moving frames, which must not look ahead.

    Slices of the series are worked on in parallel. In a slice, each frame is one sorted list: a bar puts its value in and takes the oldest one out by
    bisection, so the cost of a bar doesn't grow with the frame's width (but for moving a part of the list), and no frame is ever built for a bar.
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in wanted)])

    def work(whole: pa.Table) -> pa.Table:
        whole = whole.take(pc.sort_indices(whole.column("bar_idx")))
        frames: dict[tuple, list[tuple[str, Rank | Quantile]]] = {}
        for c, w in wanted.items():
            frames.setdefault((w.x, *w.frame), []).append((c, w))
        made: dict[str, list[float | None]] = {c: [] for c in wanted}
        for (x, first, last), own in frames.items():
            values, seen = whole.column(x).to_pylist(), []
            for i, v in enumerate(values):
                enters, leaves = i + last, i + first - 1
                if enters >= 0 and values[enters] is not None:
                    insort(seen, values[enters])
                if leaves >= 0 and values[leaves] is not None:
                    del seen[bisect_left(seen, values[leaves])]
                for c, w in own:
                    made[c].append(w.of(seen, v))
        for c in wanted:
            whole = whole.append_column(c, pa.array(made[c], pa.float64()))
        return whole

    back = max(-w.frame[0] for w in wanted.values())
    inner = lambda x: x.groupBy("series_id", "__slice").applyInArrow(work, T.StructType([*x.schema.fields, *schema.fields[len(df.columns) :]]))
    return sliced(df, inner, back, size=SLICE).select(*schema.names)


def covariance(x: Column | str, y: Column | str, n: int) -> Column:
    """Of the population, over n pairs."""
    w = rows(1 - n, 0)
    return F.when(F.count(_col(x) * _col(y)).over(w) >= n, F.avg(_col(x) * _col(y)).over(w) - F.avg(_col(x)).over(w) * F.avg(_col(y)).over(w))


def running(f, x: Column | str) -> Column:  # noqa: ANN001
    return f(_col(x)).over(rows(None, 0))


def island(x: Column | str) -> Column:
    """A number that grows by one wherever x changes; nulls equal each other."""
    before = F.lag(_col(x)).over(in_order())
    first = F.row_number().over(in_order()) == 1
    changed = F.when(first | ~_col(x).eqNullSafe(before), 1).otherwise(0)
    return changed


def filled(x: Column | str) -> Column:
    return F.last(_col(x), ignorenulls=True).over(rows(None, 0))


def bars_since(event: Column) -> Column:
    """Bars since the event last held, 0 on it; null before the first."""
    return F.col("bar_idx") - F.last(F.when(event, F.col("bar_idx")), ignorenulls=True).over(rows(None, 0))


def within(event: Column, k: int) -> Column:
    """Whether the event held on this bar or one of the k before."""
    return F.coalesce(F.max(F.when(event, 1).otherwise(0)).over(rows(-k, 0)) == 1, F.lit(False))


def ahead(columns: list[str], n: int, start: int = 1) -> Column:
    """The rows from `start` to n ahead as an array of structs; a struct is kept whatever is null in it, so places are offsets."""
    return F.collect_list(F.struct(*columns)).over(rows(start, n))


def first_true(values: Column, test) -> Column:  # noqa: ANN001
    """The first place (from 1) in an array where the test holds, null if nowhere."""
    place = F.array_position(F.transform(values, lambda v: F.coalesce(test(v), F.lit(False))), True)
    return F.nullif(place, F.lit(0).cast("long"))


def top_k(items: Column, k: int, score, distance) -> Column:  # noqa: ANN001
    """The k items of an array with the greatest scores, the nearest first where scores tie, and the first in the array where both do."""
    keyed = F.transform(items, lambda s, i: F.struct((-score(s)).alias("a"), distance(s).alias("b"), i.alias("c"), s.alias("item")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["item"])


def affine_scan(df: DataFrame, b: Column, a: float, out: str) -> DataFrame:
    """y_t = a * y_{t-1} + b_t along each series (b null counts as 0), without a sequential pass.

    Bars are cut into blocks of BLOCK. In a block, y is a scaled running sum (a ** -i stays far from overflow there). What a block hands on is its last
    value; since a ** BLOCK shrinks quickly, it matters in double precision to a few blocks only: the last bar of a block is sent to these as a guest, and
    guests are dropped afterwards. Both windows are partitioned by block, so a long series is spread over many tasks, and the plan below is read once.
    """
    size = min(BLOCK, max(1, math.floor(250 / -math.log10(a)))) if 0 < a < 1 else BLOCK  # a block may not be scaled beyond what doubles hold
    reach = max(1, min(64 if size == BLOCK else 10**6, math.ceil(math.log(1e-18) / (size * math.log(a))))) if 0 < a < 1 else 1
    placed = df.withColumns({"__b": F.coalesce(b, F.lit(0.0)), "__block": F.floor(F.col("bar_idx") / size), "__k": (F.col("bar_idx") % size).cast("double")})
    inside = Window.partitionBy("series_id", "__block").orderBy("bar_idx")
    up = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({"__y": F.pow(F.lit(a), F.col("__k")) * F.sum(F.col("__b") * F.pow(F.lit(a), -F.col("__k"))).over(up), "__last": F.lead("bar_idx").over(inside).isNull()})
    blocks = F.when(F.col("__last"), F.sequence(F.col("__block"), F.col("__block") + reach)).otherwise(F.array("__block"))
    dealt = local.withColumn("__to", F.explode(blocks))
    # from the last bar of the guest's block to the end of the block before this one
    decay = F.pow(F.lit(a), size * (F.col("__to") - F.col("__block")) - 1 - F.col("__k"))
    carry = F.sum(F.when(F.col("__to") != F.col("__block"), F.col("__y") * decay)).over(Window.partitionBy("series_id", "__to"))
    carried = dealt.withColumn("__carry", F.coalesce(carry, F.lit(0.0))).filter(F.col("__to") == F.col("__block"))
    return carried.withColumn(out, F.col("__y") + F.pow(F.lit(a), F.col("__k") + 1) * F.col("__carry")).drop("__b", "__block", "__k", "__y", "__last", "__to", "__carry")


def ewm(df: DataFrame, x: Column, out: str, alpha: float | None = None, span: int | None = None, adjust: bool = False, least: int = 0) -> DataFrame:
    """Exponentially weighted mean of a column without gaps. adjust: weights of the finite history are normalised; else the first value is the seed."""
    alpha = alpha if alpha is not None else 2 / (span + 1)
    a = 1 - alpha
    i = F.col("bar_idx")
    if adjust:
        y = affine_scan(df, x, a, out)
        y = y.withColumn(out, F.col(out) * alpha / (1 - F.pow(F.lit(a), i + 1)))
    else:
        y = affine_scan(df, F.when(i == 0, x).otherwise(x * alpha), a, out)
    return y.withColumn(out, F.when(i + 1 >= least, F.col(out))) if least else y


def wilder(df: DataFrame, x: Column, n: int, out: str) -> DataFrame:
    """Wilder's smoothing: the mean of the first n values (from the first that isn't null) is the seed, then y = (y * (n - 1) + x) / n; a null holds."""
    df = df.withColumn("__x", x).withColumn("__start", F.min(F.when(F.col("__x").isNotNull(), F.col("bar_idx"))).over(Window.partitionBy("series_id")))
    at = F.col("bar_idx") - F.col("__start")
    seed = F.avg("__x").over(rows(1 - n, 0))
    y = affine_scan(df, F.when(at == n - 1, seed).when(at >= n, F.col("__x") / n), (n - 1) / n, out)
    return y.withColumn(out, F.when(at >= n - 1, F.col(out))).drop("__x", "__start")
