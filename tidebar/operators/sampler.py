"""Parameter search by density ratio, over an append-only journal.

The journal is a Parquet folder to which every event of a trial is appended: its parameters when it is proposed, its value when it is done, or that it
failed. A search's state is an aggregate of the journal, so any session can go on with it. A proposal follows from the finished and running trials, the
seed and the trial's number alone: a search that was interrupted proposes what an uninterrupted one would have.

A proposal takes the best trials (at most GOOD) as one density and all others, running ones included, as another. Each is a mixture of a uniform
component and one product kernel for each trial: numbers have a logistic kernel cut off at their bounds, choices one that keeps the option or picks any.
Candidates are drawn from the first density, and the one with the highest ratio of the two is proposed. What grows with the journal (state, ranking,
deviations, the second density's sums over all trials) is Spark's work; the driver holds the best trials and the candidates, both of fixed number.

Values are maximised. A done trial with a null value counts as failed; failed trials are left out. Events that come twice count once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The share of trials that are good and their greatest number; trials that are drawn at random before densities are used; candidates of a proposal.
GOOD_SHARE, GOOD, START, CANDIDATES = 0.25, 25, 10, 24
#: The least width of a number's kernel, as a share of its range.
LEAST_WIDTH = 0.1
#: The deviation of a logistic kernel of width 1.
DEVIATION = math.pi / math.sqrt(3)

EVENTS = "trial long, event string, value double, params map<string,double>"


@dataclass(frozen=True)
class Number:
    """A number in [low, high], on a logarithmic scale or in steps from `low` if asked for."""

    name: str
    low: float
    high: float
    log: bool = False
    step: float | None = None

    def unit(self, v: Column) -> Column:
        f = F.log if self.log else (lambda x: x)
        low, high = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)
        return (f(v) - F.lit(low)) / F.lit(high - low)

    def value(self, u: float) -> float:
        v = math.exp(math.log(self.low) + u * math.log(self.high / self.low)) if self.log else self.low + u * (self.high - self.low)
        return float(min(self.high, self.low + round((v - self.low) / self.step) * self.step) if self.step else v)


@dataclass(frozen=True)
class Choice:
    """One of the options; the journal has its number."""

    name: str
    options: tuple

    def unit(self, v: Column) -> Column:
        return v

    def value(self, u: float) -> float:
        return float(u)


Space = Sequence[Number | Choice]


def uniform(seed: int, *key: object) -> float:
    """A number in (0, 1) that the key fixes."""
    return (int(hashlib.sha256(":".join(map(str, (seed, *key))).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


@dataclass(frozen=True)
class Kernels:
    """The kernels of a density over n trials: a width for each number, the chance of any option for each choice."""

    n: int
    widths: tuple[float, ...]

    @classmethod
    def of(cls, space: Space, n: int, deviations: Sequence[float | None]) -> Kernels:
        scale = max(n, 1) ** (-1 / (len(space) + 4))
        return cls(n, tuple(len(p.options) / (len(p.options) + n) if isinstance(p, Choice) else max((s or 0.0) * scale / DEVIATION, LEAST_WIDTH) for p, s in zip(space, deviations, strict=True)))

    def drawn(self, space: Space, at: Sequence[float] | None, u: Sequence[float], v: Sequence[float]) -> list[float]:
        """A draw from the kernel at a trial, or from the uniform component."""
        out = []
        for k, p in enumerate(space):
            if isinstance(p, Choice):
                keep = at is not None and u[k] >= self.widths[k]
                out.append(float(at[k] if keep else math.floor(v[k] * len(p.options))))
            elif at is None:
                out.append(u[k])
            else:
                low, high = logistic(-at[k] / self.widths[k]), logistic((1 - at[k]) / self.widths[k])
                q = low + u[k] * (high - low)
                out.append(min(1.0, max(0.0, at[k] + self.widths[k] * math.log(q / (1 - q)))))
        return out

    def density(self, space: Space, x: Column, at: Column) -> Column:
        """The product kernel of the trial `at` at x, both arrays."""
        total = F.lit(1.0)
        cdf = lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        for k, (p, h) in enumerate(zip(space, self.widths, strict=True)):
            a, b = F.get(x, F.lit(k)), F.get(at, F.lit(k))
            if isinstance(p, Choice):
                total = total * (F.when(a == b, 1 - h).otherwise(0.0) + h / len(p.options))
            else:
                f = cdf((a - b) / h)
                total = total * f * (1 - f) / h / (cdf((1 - b) / h) - cdf(-b / h))
        return total

    def mixed(self, space: Space, kernels: Column) -> Column:
        """The mixture's density from the sum of the kernels."""
        flat = math.prod(1 / len(p.options) for p in space if isinstance(p, Choice))
        return (kernels + flat) / (self.n + 1)


def record(spark: SparkSession, journal: str, events: DataFrame) -> None:
    """Appends events (trial, event, value, params) to a journal."""
    events.select("trial", "event", F.col("value").cast("double").alias("value"), "params").write.mode("append").parquet(journal)


def trials(events: DataFrame) -> DataFrame:
    """(trial, status, value, params): a journal's trials; status is done, failed or running."""
    done = F.col("event") == "done"
    t = events.groupBy("trial").agg(F.max_by("params", F.when(F.col("event") == "proposed", 1)).alias("params"), F.max(F.when(done, F.col("value"))).alias("value"), F.max(F.col("event").isin("done", "failed")).alias("ended"))
    return t.select("trial", F.when(F.col("value").isNotNull(), "done").when(F.col("ended"), "failed").otherwise("running").alias("status"), "value", "params")


def _at_random(space: Space, seed: int, number: int) -> list[float]:
    return [float(math.floor(uniform(seed, number, p.name) * len(p.options))) if isinstance(p, Choice) else uniform(seed, number, p.name) for p in space]


def scored(known: DataFrame, space: Space, numbers: Sequence[int], seed: int = 0, candidates: int = CANDIDATES) -> DataFrame | None:
    """(trial, candidate, x, good, other, score) of every candidate of the trials to come with these numbers, from trials(); x is in units of the ranges
    (the option's number for choices) and the score is the logarithm of the densities' ratio. None while there are too few trials."""
    spark = known.sparkSession
    used = known.filter("status <> 'failed'").select("trial", "status", "value", F.array(*(p.unit(F.col("params")[p.name]) for p in space)).alias("x"))
    n = used.filter("status = 'done'").count()
    if n < START:
        return None
    n_good = min(math.ceil(GOOD_SHARE * n), GOOD)
    best = used.filter("status = 'done'").orderBy(F.desc("value"), "trial").limit(n_good).select("trial", "x").collect()
    others = used.filter(~F.col("trial").isin([r.trial for r in best]))
    spread = others.agg(F.count("*"), *(F.stddev_pop(F.get("x", F.lit(k))) for k in range(len(space)))).first()
    columns = list(zip(*(r.x for r in best), strict=True))
    deviations = [math.sqrt(sum((v - sum(c) / len(c)) ** 2 for v in c) / len(c)) for c in columns]
    good, other = Kernels.of(space, n_good, deviations), Kernels.of(space, spread[0], spread[1:])
    rows = []
    for number in numbers:
        for c in range(candidates):
            pick = math.floor(uniform(seed, number, c, "component") * (n_good + 1))
            draws = ([uniform(seed, number, c, p.name, side) for p in space] for side in "uv")
            rows.append((number, c, good.drawn(space, best[pick - 1].x if pick else None, *draws)))
    made = F.array(*(F.struct(F.lit(t).cast("long").alias("trial"), F.lit(c).alias("candidate"), F.array(*map(F.lit, x)).alias("x")) for t, c, x in rows))
    near = F.array(*(F.array(*map(F.lit, r.x)) for r in best))
    # every other trial adds to each candidate's density: sums over the journal, of a fixed number of rows
    sums = others.select(F.col("x").alias("at"), F.explode(made).alias("c")).groupBy("c.trial", "c.candidate").agg(F.sum(other.density(space, F.col("c.x"), F.col("at"))).alias("s"))
    all_ = spark.range(1).select(F.inline(made))
    ln_good = F.log(good.mixed(space, F.aggregate(near, F.lit(0.0), lambda a, b: a + good.density(space, F.col("x"), b))))
    ln_other = F.log(other.mixed(space, F.coalesce("s", F.lit(0.0))))
    return all_.join(sums, ["trial", "candidate"], "left").select("trial", "candidate", "x", ln_good.alias("good"), ln_other.alias("other"), (ln_good - ln_other).alias("score"))


def propose(known: DataFrame, space: Space, numbers: Sequence[int], seed: int = 0, candidates: int = CANDIDATES) -> list[tuple[int, dict[str, float]]]:
    """(number, parameters) of the trials to come with these numbers."""
    found = scored(known, space, numbers, seed, candidates)
    if found is None:
        units = {t: _at_random(space, seed, t) for t in numbers}
    else:
        best = found.groupBy("trial").agg(F.max_by("x", F.struct("score", -F.col("candidate"))).alias("x"))
        units = {r.trial: r.x for r in best.collect()}
    return [(t, {p.name: p.value(u) for p, u in zip(space, units[t], strict=True)}) for t in numbers]


def search(spark: SparkSession, journal: str, space: Space, objective: Callable[[DataFrame], DataFrame], n: int, batch: int = 4, seed: int = 0) -> DataFrame:
    """Runs trials up to number n - 1, in batches, and returns trials(). The objective turns (trial, params) into (trial, value) for a batch in one plan. A
    journal that is there already is gone on with: trials that were proposed and not ended are run again first."""
    record(spark, journal, spark.createDataFrame([], EVENTS))  # so that there is a journal to read
    while True:
        known = trials(spark.read.schema(EVENTS).parquet(journal))
        running = known.filter("status = 'running'").select("trial", "params").collect()  # at most a batch
        if not running:
            first = (known.agg(F.max("trial")).first()[0] or 0) + 1 if known.limit(1).count() else 0
            if first >= n:
                return known
            numbers = range(first, min(n, (first // batch + 1) * batch))
            rows = [(t, "proposed", None, params) for t, params in propose(known, space, numbers, seed)]
            record(spark, journal, spark.createDataFrame(rows, EVENTS))
            continue
        asked = spark.createDataFrame([(r.trial, r.params) for r in running], "trial long, params map<string,double>")
        found = asked.select("trial").join(objective(asked).select("trial", "value"), "trial", "left")
        record(spark, journal, found.select("trial", F.when(F.col("value").isNull(), "failed").otherwise("done").alias("event"), "value", F.lit(None).cast("map<string,double>").alias("params")))
