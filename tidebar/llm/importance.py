"""Importance resampling towards a target's distribution, over hashed runs of words.

One scan of each text keeps a ring of running CRC states, one for each of the last n starts of a run. A word opens a start of its own and extends the
others by a space and itself; each state is then the CRC-32 of a run that ends at this word, and its remainder is the run's bucket. The scan writes every
document's buckets and how often it has each. From these come the corpus's counts, by bucket; the target's texts are scanned alike.

A bucket's gain is the logarithm of its share in the target over its share in the corpus (add-one smoothed, in thousandths, rounded down), a document's
weight the floored mean of its runs' gains. Gumbel noise that the document's id and the seed fix makes the highest scores a weighted draw without
replacement. The draw needs no global sort: scores are integers of a bounded range, so that a count for each score (at most some hundred thousand)
says how many rows stand above it, and rows of one score are ordered among themselves.

Nulls: a null text has no words; a null doc_id counts as empty text in the noise and comes last among ties. Repeated rows are rows of their own (equal
scores, ranks one after another). An empty corpus has no rows; an empty target has gains from smoothing alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.llm.terms import SQL, terms
from tidebar.session import scratch

RUN, BUCKETS, SEED, SHARE, LEAST_WORDS = 2, 10_000, 7, 25, 20


class Ring:
    """Running CRC states of the last n starts."""

    def __init__(self, n: int):
        self.n, self.states = n, ()

    def scan(self, words: list[bytes]) -> list[int]:
        """The CRCs of all runs that end at these words, which go on where the last ones ended."""
        out, add, states, n = [], self.out_of, self.states, self.n
        if n == 2:  # the usual length, without an inner loop
            before = states[0] if states else None
            for w in words:
                own = crc32(w)
                out.append(own)
                if before is not None:
                    out.append(crc32(w, crc32(b" ", before)))
                before = own
            self.states = () if before is None else (before,)
            return out
        for w in words:
            states = add(w, states)
            out.extend(states)
            states = states[: n - 1]
        self.states = states
        return out

    @staticmethod
    def out_of(word: bytes, states: tuple[int, ...]) -> tuple[int, ...]:
        """The states after a word: its own start first, then the older starts."""
        return (crc32(word), *(crc32(word, crc32(b" ", s)) for s in states))


def features(text: bytes | None, n: int, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of words, buckets in ascending order, how often each comes) of a text."""
    ring, n_words, total = Ring(n), 0, None
    for words in terms(text):
        n_words += len(words)
        own = np.array(ring.scan(words), dtype=np.int64) % buckets
        if total is None and len(own) < buckets:
            found = np.unique(own, return_counts=True)
            total = found if len(words) < 100_000 else None
            if total is not None:
                continue
        counts = np.bincount(own, minlength=buckets)
        if isinstance(total, tuple):
            counts[total[0]] += total[1]
            total = counts
        else:
            total = counts if total is None else total + counts
    if total is None:
        return 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if isinstance(total, np.ndarray):
        at = np.flatnonzero(total)
        total = at, total[at]
    return n_words, *total


_SCANNED = [*(T.StructField(c, T.LongType()) for c in ("row_key", "n_words", "n_features")), *(T.StructField(c, T.BinaryType()) for c in ("buckets", "counts"))]


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), n: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """docs' `keep` columns, a key of the row, its numbers of words and features, and its distinct buckets (steps from one to the next) and their counts,
    as unsigned 32-bit integers. A row has at most `buckets` of them, however long its text is."""
    schema = T.StructType([*(docs.schema[k] for k in keep), *_SCANNED])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found = [features(t.as_buffer() if t.is_valid else None, n, buckets) for t in b.column(len(keep)).cast(pa.binary())]
                steps = [np.diff(f[1], prepend=0).astype("<u4").tobytes() for f in found]
                columns = [pa.array(np.arange(key, key + len(found))), pa.array([f[0] for f in found], pa.int64()), pa.array([int(f[2].sum()) for f in found], pa.int64()), pa.array(steps, pa.binary()), pa.array([f[2].astype("<u4").tobytes() for f in found], pa.binary())]
                key += len(found)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *columns], names=schema.names)

    return docs.select(*(docs[k] for k in keep), docs[text].alias("__text")).mapInArrow(work, schema)


def _decoded(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for steps, counts in zip(b.column("buckets").to_pylist(), b.column("counts").to_pylist(), strict=True):
        yield np.cumsum(np.frombuffer(steps, dtype="<u4"), dtype=np.int64), np.frombuffer(counts, dtype="<u4").astype(np.int64)


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all rows are in each bucket that has any."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for own, counts in _decoded(b):
                total[own] += counts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return scanned.select("buckets", "counts").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, from two tables of bucket_counts(). The tables have at most `buckets` rows each."""
    s, t = np.zeros(buckets, dtype=object), np.zeros(buckets, dtype=object)
    for total, df in ((s, corpus), (t, target)):
        for r in df.collect():
            total[r.bucket] = r.n
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log((x + 1) * (all_s + buckets) / ((y + 1) * (all_t + buckets)))) for x, y in zip(t, s, strict=True)], dtype=np.int64)


def noise(seed: int, doc_id: object) -> int:
    """Gumbel noise in thousandths, from the first eight hex digits of a digest of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(scanned: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Every row with its `weight` and `score`, without its buckets."""
    kept = [c for c in scanned.columns if c not in ("buckets", "counts")]
    schema = T.StructType([*(scanned.schema[c] for c in kept), T.StructField("weight", T.LongType()), T.StructField("score", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights = [int((gain[own] * counts).sum()) // n if n else 0 for (own, counts), n in zip(_decoded(b), b.column("n_features").to_pylist(), strict=True)]
            scores = [w + noise(seed, i) for w, i in zip(weights, b.column(doc_id).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(weights, pa.int64()), pa.array(scores, pa.int64())], names=schema.names)

    return scanned.mapInArrow(work, schema)


def draw(weighed: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, doc_id: str = "doc_id") -> DataFrame:
    """weighed (a written table) with `rank` 1, 2, 3 ... for the `share` per cent of highest scores among rows of enough words, null for all others."""
    can = F.col("n_words") >= least_words
    by_score = weighed.filter(can).groupBy("score").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each score: a bounded range of integers
    above = by_score.select("score", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("above"), F.sum("n").over(Window.partitionBy()).alias("all"))
    above = above.select("score", "above", F.floor(F.col("all") * share / 100).alias("drawn"))
    x = weighed.join(F.broadcast(above), "score", "left")
    near = can & (F.col("above") < F.col("drawn"))
    rank = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last(doc_id), "row_key"))
    drawn = x.filter(near).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    rest = x.filter(~F.coalesce(near, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("above", "drawn")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = RUN, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, row_key, n_words, n_features, weight, score, rank) of every document; rank is null for documents that aren't drawn."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "importance")
    scan(docs.select(docs[doc_id], docs[text]), text, (doc_id,), n, buckets).write.option("compression", "zstd").parquet(f"{folder}/scanned")
    scanned = spark.read.parquet(f"{folder}/scanned")
    gain = gains(bucket_counts(scanned, buckets), bucket_counts(scan(target.select(target[text]), text, (), n, buckets), buckets), buckets)
    weigh(scanned, gain, doc_id, seed).write.parquet(f"{folder}/weighed")
    return draw(spark.read.parquet(f"{folder}/weighed"), share, least_words, doc_id)


def oracle() -> str:
    """The registered query in DuckDB's SQL. The CRC is a fold over bytes with a table that is made by its rule."""
    counts = lambda source, name: f"SELECT bucket, sum(n) AS {name} FROM {source} GROUP BY 1"
    return f"""WITH crc AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, x)) AS t),
texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark), words AS (SELECT kind, id, coalesce({SQL}, []) AS w FROM texts),
runs AS (SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words), counted AS (SELECT kind, id, f, count(*) AS n FROM runs GROUP BY ALL),
hex AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)), bytes AS (SELECT f, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || h[2 * i - 1 : 2 * i])::BIGINT) AS b FROM hex),
hashed AS (SELECT f, xor(list_reduce(b, lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket FROM bytes, crc),
feats AS (SELECT kind, id, bucket, n FROM counted JOIN hashed USING (f)), s AS ({counts("feats WHERE kind = 'd'", 's')}), t AS ({counts("feats WHERE kind = 't'", 't')}),
gains AS (SELECT b AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM range({BUCKETS}) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
docs AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight FROM feats JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY 1),
x AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM words LEFT JOIN docs USING (id) WHERE kind = 'd'),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {SHARE} * n // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)"""
