"""Trade simulation: cooldown, returns, equity, sizing, costs, and the statistics of trades.

Only the greedy cooldown depends on order in a way that windows can't express; it sees signals alone, not bars, in blocks of a series.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.functions import natural_log, quotient
from tidebar.operators import rolling as R
from tidebar.operators.bars import rows


#: Bars in a block of the cooldown (more if the cooldown is longer).
BLOCK = 65_536


def chained(at: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted bars of signals: the place of the next one that may be taken after each (len(at): none), and the last one taken if that one is."""
    following = np.maximum(np.searchsorted(at, at + gap), np.arange(len(at)) + 1)
    last = list(range(len(at)))
    for k in range(len(at) - 1, -1, -1):
        if following[k] < len(at):
            last[k] = last[following[k]]
    return following, np.array(last, dtype=np.int64)


def take(signals: DataFrame, cooldown: int | None = None, by: tuple[str, ...] = ("series_id",), strict: bool = True) -> DataFrame:
    """The signals that are taken: a bar more than `cooldown` (a column of that name, the same for all of a group, if None) after the last one taken, or at
    least so many if not strict. Of signals of one bar the first that comes is taken.

    A series is cut into blocks of bars. What happens before a block matters to it only through the signal that it is entered by, which is one of those in
    its first `cooldown` bars or the first after them: for each of these a block says which signal it takes last. A fold over the blocks, of which a
    series has a row each, finds by which signal each one is really entered, and the blocks then take theirs. Both passes over signals are spread over
    blocks; the fold sees at most `cooldown` numbers for each BLOCK bars.
    """
    if cooldown is not None and cooldown + strict < 1:
        return signals
    keys, names = [*by, "__block"], signals.columns
    gap = (F.lit(cooldown) if cooldown is not None else F.col("cooldown")).cast("long") + (1 if strict else 0)
    x = signals.withColumn("__gap", F.greatest(gap, F.lit(1))).withColumn("__block", F.floor(F.col("bar_idx") / F.greatest("__gap", F.lit(BLOCK))))
    kinds = [signals.schema[c] for c in by]

    def ways(key: tuple, own: pa.Table) -> pa.Table:
        at, gap = np.sort(own.column("bar_idx").to_numpy()), own.column("__gap")[0].as_py()
        _, last = chained(at, gap)
        start = key[-1].as_py() * max(gap, BLOCK)
        n = min(int(np.searchsorted(at, start + gap)) + 1, len(at))
        row = {c: [k.as_py()] for c, k in zip(keys, key, strict=True)} | {"__gap": [gap], "__in": [at[:n].tolist()], "__out": [at[last[:n]].tolist()]}
        return pa.Table.from_pydict(row, schema=pa.schema([*((c, k.type) for c, k in zip(keys, key, strict=True)), ("__gap", pa.int64()), ("__in", pa.list_(pa.int64())), ("__out", pa.list_(pa.int64()))]))

    def entered(key: tuple, own: pa.Table) -> pa.Table:
        own, taken, blocks, first = own.sort_by("__block"), None, [], []
        for block, gap, ins, outs in zip(*(own.column(c).to_pylist() for c in ("__block", "__gap", "__in", "__out")), strict=True):
            k = 0 if taken is None else bisect_left(ins, taken + gap)
            if k < len(ins):
                taken = outs[k]
                blocks.append(block)
                first.append(ins[k])
        return pa.Table.from_arrays([*(pa.array([k.as_py()] * len(blocks), k.type) for k in key), pa.array(blocks, pa.int64()), pa.array(first, pa.int64())], names=[*by, "__block", "__first"])

    def greedy(key: tuple, own: pa.Table, first: pa.Table) -> pa.Table:
        if not first.num_rows:
            return own.slice(0, 0).select(names)
        own = own.take(pa.array(np.argsort(own.column("bar_idx").to_numpy(), kind="stable")))
        at, gap = own.column("bar_idx").to_numpy(), own.column("__gap")[0].as_py()
        following, _ = chained(at, gap)
        kept, k = [], int(np.searchsorted(at, first.column("__first")[0].as_py()))
        while k < len(at):
            kept.append(k)
            k = int(following[k])
        return own.take(pa.array(kept, pa.int64())).select(names)

    block = T.StructField("__block", T.LongType())
    longs = T.ArrayType(T.LongType())
    maps = x.select(*keys, "bar_idx", "__gap").groupBy(*keys).applyInArrow(ways, T.StructType([*kinds, block, T.StructField("__gap", T.LongType()), T.StructField("__in", longs), T.StructField("__out", longs)]))
    first = maps.groupBy(*by).applyInArrow(entered, T.StructType([*kinds, block, T.StructField("__first", T.LongType())]))
    return x.groupBy(*keys).cogroup(first.groupBy(*keys)).applyInArrow(greedy, signals.schema)


def sweep(signals: DataFrame, cooldowns: list[int]) -> DataFrame:
    """A run of take() for each cooldown, all in parallel."""
    grid = signals.withColumn("cooldown", F.explode(F.array(*map(F.lit, cooldowns))))
    return take(grid, by=("series_id", "cooldown"))


def trade_return(won: Column, r: float = 2.0, cost: float = 0.05) -> Column:
    return F.when(won, r - cost).otherwise(-(1 + cost))


def kelly(p: Column, odds: float = 2.0, divisor: float = 40.0, floor: float = 0.0025, cap: float = 0.02) -> Column:
    return F.least(F.lit(cap), F.greatest(F.lit(floor), F.greatest(F.lit(0.0), p - (1 - p) / odds) / divisor))


def equity(trades: DataFrame, risk: Column, r: str = "r", start: float = 1.0) -> DataFrame:
    """Compounded equity and drawdown from the running peak (the start included), per series in bar order; needs 1 + risk * r > 0."""
    w = rows(None, 0)
    out = trades.withColumn("equity", start * F.exp(F.sum(F.log(1 + risk * F.col(r))).over(w)))
    peak = F.greatest(F.lit(start), F.max("equity").over(w))
    return out.withColumn("drawdown", 1 - F.col("equity") / peak)


def costs(df: DataFrame, hold: int = 48, impact: float = 0.1) -> DataFrame:
    """Latency against the next open, square-root impact with a regime multiplier, funding over the hold."""
    ahead = rows(1, hold)
    out = df.withColumns({"next_open": F.lead("open").over(Window.partitionBy("series_id").orderBy("ts")), "sigma": R.rolling(F.stddev_samp, natural_log(quotient(F.col("close"), F.col("open"))), 20), "adv": R.rolling(F.avg, "volume", 96, 10)})
    return out.withColumns({"latency_cost": quotient(F.abs(F.col("next_open") - F.col("close")), F.col("close")), "impact_cost": impact * F.col("sigma") * F.sqrt(F.lit(1.0) / F.nullif(F.col("adv"), F.lit(0.0))) * F.when(F.col("sigma") > 1, 1.5).otherwise(1.0), "funding_sum": F.sum("funding").over(ahead) if "funding" in df.columns else F.lit(None).cast("double")})


def metrics(trades: DataFrame, by: tuple[str, ...], years: float, r: str = "r") -> DataFrame:
    """Trades, win rate, expectancy, profit factor, yearly Sharpe ratio."""
    x = F.col(r)
    out = trades.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(x > 0).alias("wins"), F.avg(x).alias("ev"), F.sum(F.when(x > 0, x)).alias("__won"), F.sum(F.when(x < 0, -x)).alias("__lost"), F.stddev_samp(x).alias("__sd"))
    return out.withColumns({"win_rate": F.col("wins") / F.col("n"), "profit_factor": F.col("__won") / F.nullif(F.col("__lost"), F.lit(0.0)), "sharpe": F.col("ev") / F.nullif(F.col("__sd"), F.lit(0.0)) * F.sqrt(F.col("n") / years)}).drop("__won", "__lost", "__sd")


def streaks(trades: DataFrame, by: tuple[str, ...] = ("series_id",), r: str = "r") -> DataFrame:
    """Runs of losses by length, and the share of wins among the trades right after the win that ended them."""
    w = Window.partitionBy(*by).orderBy("bar_idx")
    x = trades.withColumn("__w", (F.col(r) > 0).cast("int"))
    x = x.withColumns({"__run": F.sum("__w").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__after": F.lead("__w", 1).over(w)})
    runs = x.groupBy(*by, "__run").agg(F.count_if(F.col("__w") == 0).alias("length"), F.max(F.when(F.col("__w") == 1, F.col("__after"))).alias("__first"))
    nxt = F.lead("__first").over(Window.partitionBy(*by).orderBy("__run"))
    return runs.withColumn("__then", nxt).filter("length > 0").groupBy(*by, "length").agg(F.count("*").alias("runs"), F.avg("__then").alias("win_rate_after"))
