"""Token ids in training order, as fixed-stride shards.

Every document's ids are cut into sequences of LENGTH ids and written once, each document with its place in its partition. A sum for each partition then
numbers all sequences without a sort, and a keyed Feistel permutation with cycle-walking gives each number a global slot: a bijection of 0 .. n-1 without
a table. Slots are dealt by range: shard s has the slots from s * records on, and a task writes a range of neighbouring shards. Shards have one size,
whatever the corpus's, and stand in folders of SHARDS_IN_FOLDER; there are RANGES tasks at most, so that the driver's work stays bounded.

Shards are written in WAVES jobs, each for neighbouring shards. A job takes from all written ids the sequences of its own shards, and what it has shuffled is
removed when its shards are there, so that the whole shuffle never stands on the disk beside the ids and the shards.

Each shard is one file of equal records, so that record r of shard s is slot s * records + r, at byte r * stride: reads are sequential and can resume at
any slot. A record is: doc_id (8 bytes, signed), place of the sequence in its document (4), number of ids (3), whether there is a doc_id (1), the record's
number in its shard (4), LENGTH ids of `width` bytes padded with zeros, a line feed (which Spark's text sink ends each value with); all little-endian.
Rows are sorted by shard and slot after the last Python step, so that the sink finds the order it needs and adds no sort of its own; read() compares each
record's number with its place and fails if they differ.

Nulls: a document without ids (null or empty) has no sequence; a null doc_id is flagged. Repeated rows are written as often as they come.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.memory import returning
from tidebar.session import scratch

LENGTH = 512
#: Records in a shard; shards in a folder; the most tasks that write them.
RECORDS, SHARDS_IN_FOLDER, RANGES = 16_384, 1_000, 20_000
#: Jobs that write the shards, one after the other.
WAVES = 3
ROUNDS = 6
HEAD = 20
#: Sequences built at once, and documents encoded at once.
AT_ONCE, ROWS_AT_ONCE = 8192, 256

#: Makes, once in each task, what turns a text (or null) into the bytes of its ids.
Encoder = Callable[[], Callable[[str | None], bytes]]


def _mixed(x: np.ndarray, key: int, r: int) -> np.ndarray:
    x = (x + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1342543DE82EF95) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def slots(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of these numbers below n: a permutation of 0 .. n-1 that the key picks."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x = numbers.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():  # a value beyond n walks along its cycle until it is below
        left, right = x[todo] >> np.uint64(half), x[todo] & low
        for r in range(ROUNDS):
            left, right = right, left ^ (_mixed(right, key, r) & low)
        x[todo] = (left << np.uint64(half)) | right
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


def _placed(docs: DataFrame, unit: int, encoder: Encoder | None) -> DataFrame:
    """(part, at, n, doc_id, ids) of every document with ids: how many sequences its partition has before it, and how many it has, of `unit` bytes each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        encode = encoder() if encoder else None
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                ids = [encode(x) if encode else x or b"" for x in batch.column(1).to_pylist()]
                size = np.array([len(x) for x in ids], dtype=np.int64)
                own = np.flatnonzero(size)
                n = -(-size[own] // unit)
                begin = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), part, dtype=np.int32)), pa.array(begin), pa.array(n), batch.column(0).take(pa.array(own)), pa.array([ids[k] for k in own], pa.binary())], names=["part", "at", "n", "doc_id", "ids"]
                )

    return docs.mapInArrow(returning(work), "part int, at long, n long, doc_id long, ids binary")


def _sequences(placed: DataFrame, begins: dict[int, int], n: int, key: int, unit: int, width: int, low: int, high: int) -> DataFrame:
    """(slot, record) of every sequence with a slot from low to below high; ids are deflated on their way through the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def built(at: list[int], ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
            size = np.array([len(t) for t in texts], dtype=np.int64)
            count = -(-size // unit)
            total = int(count.sum())
            doc = np.repeat(np.arange(len(texts)), count)
            place = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            slot = slots(np.array(at, dtype=np.int64)[doc] + place, n, key)
            own = np.flatnonzero((slot >= low) & (slot < high))
            slot, doc, place, total = slot[own], doc[own], place[own], len(own)
            own = np.minimum(unit, size[doc] - place * unit) // width
            head = np.zeros((total, HEAD - 4), dtype=np.uint8)
            head[:, :8] = np.array([i or 0 for i in ids], dtype="<i8")[doc].view(np.uint8).reshape(total, 8)
            head[:, 8:12] = place.astype("<u4").view(np.uint8).reshape(total, 4)
            head[:, 12:16] = (own + (np.array([i is not None for i in ids], dtype=np.int64)[doc] << 24)).astype("<u4").view(np.uint8).reshape(total, 4)
            packed = [h.tobytes() + zlib.compress(texts[d][p * unit : p * unit + unit], 1) for h, d, p in zip(head, doc.tolist(), place.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(packed, pa.binary())], names=["slot", "value"])

        for batch in batches:
            at, ids, texts, weight = [], [], [], 0
            for part, begin, count, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at.append(begins[part] + begin)
                ids.append(i)
                texts.append(t)
                weight += count
                if weight >= AT_ONCE:
                    yield built(at, ids, texts)
                    at, ids, texts, weight = [], [], [], 0
            if texts:
                yield built(at, ids, texts)

    return placed.select("part", "at", "n", "doc_id", "ids").mapInArrow(returning(work), "slot long, value binary")


def _inflated(dealt: DataFrame, unit: int, records: int) -> DataFrame:
    """The records as they are written, without their line feed, with their slots, shards and folders."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                own = batch.slice(at, AT_ONCE)
                slot = own.column(0).to_numpy(zero_copy_only=False)
                shard = slot // records
                number = (slot - shard * records).astype("<u4").tobytes()
                whole = [v[: HEAD - 4] + number[4 * k : 4 * k + 4] + zlib.decompress(v[HEAD - 4 :]).ljust(unit, b"\0") for k, v in enumerate(own.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard // SHARDS_IN_FOLDER), pa.array(shard), pa.array(slot), pa.array(whole, pa.binary())], names=["folder", "shard", "slot", "value"])

    return dealt.mapInArrow(returning(work), "folder long, shard long, slot long, value binary")


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, what a job has shuffled is removed at its end, not when the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Shards:
    """A written training order: its folder and what is needed to read it."""

    def __init__(self, spark: SparkSession, folder: str, n: int, length: int, width: int, records: int):
        self.spark, self.folder, self.n, self.length, self.width, self.records = spark, folder, n, length, width, records

    @property
    def stride(self) -> int:
        return HEAD + self.length * self.width + 1

    def read(self, start: int = 0) -> DataFrame:
        """(slot, shard, doc_id, place, n_tokens, ids) from slot `start` on. Shards before it aren't opened; its own is entered at its record. A task
        holds one shard."""
        stride, records, width = self.stride, self.records, self.width

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    shard, data = batch.column(0)[k].as_py(), np.frombuffer(batch.column(1)[k].as_buffer(), dtype=np.uint8)
                    if len(data) % stride:
                        raise ValueError(f"shard {shard} isn't whole")
                    rows = data.reshape(-1, stride)
                    if (np.ascontiguousarray(rows[:, HEAD - 4 : HEAD]).view("<u4").ravel() != np.arange(len(rows))).any():
                        raise ValueError(f"shard {shard} isn't in order")
                    for at in range(max(0, start - shard * records), len(rows), AT_ONCE):
                        own = rows[at : at + AT_ONCE]
                        column = lambda a, b, kind: np.ascontiguousarray(own[:, a:b]).view(kind).ravel()  # noqa: B023, E731
                        last = column(12, 16, "<u4").astype(np.int64)
                        size, known = last & 0xFFFFFF, (last >> 24) == 1
                        ids = [r[HEAD : HEAD + s * width].tobytes() for r, s in zip(own, size.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard * records + at + np.arange(len(own))), pa.array(np.full(len(own), shard, dtype=np.int64)), pa.array(column(0, 8, "<i8"), mask=~known), pa.array(column(8, 12, "<u4").astype(np.int64)), pa.array(size), pa.array(ids, pa.binary())],
                            names=["slot", "shard", "doc_id", "place", "n_tokens", "ids"],
                        )

        schema = "slot long, shard long, doc_id long, place long, n_tokens long, ids binary"
        if not self.n:
            return self.spark.createDataFrame([], schema)
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(self.folder)
        # folders and shards are named by their numbers, so partition pruning leaves earlier ones alone
        return files.filter((F.col("folder") >= start // records // SHARDS_IN_FOLDER) & (F.col("shard") >= start // records)).select(F.col("shard").cast("long"), "content").mapInArrow(returning(work), schema)


def materialise(docs: DataFrame, key: int, length: int = LENGTH, width: int = 4, records: int = RECORDS, doc_id: str = "doc_id", ids: str = "ids", encoder: Encoder | None = None, folder: str | None = None) -> Shards:
    """Writes the shards of a binary column of ids of `width` bytes each, little-endian, or of a text column that the encoder turns into such ids (in the
    same Python worker). Slots follow from the key, the input's rows and how these are dealt over partitions."""
    spark = docs.sparkSession
    folder, unit = folder or scratch(spark, "shards"), length * width
    _placed(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[ids].alias("ids")), unit, encoder).write.option("compression", "zstd").parquet(f"{folder}/ids")
    placed = spark.read.parquet(f"{folder}/ids")
    begins, n = {}, 0
    for r in placed.groupBy("part").agg(F.sum("n").alias("c")).orderBy("part").collect():  # a number for each partition of the input
        begins[r.part] = n
        n += r.c
    shards = -(-n // records)
    edges = sorted({shards * k // WAVES for k in range(WAVES + 1)})
    for low, high in zip(edges, edges[1:], strict=False):
        made = _sequences(placed, begins, n, key, unit, width, low * records, high * records)
        ranges = min(high - low, RANGES)
        # a range is a number of neighbouring shards
        dealt = made.repartitionById(ranges, F.floor((F.floor(F.col("slot") / records) - low) * ranges / (high - low)).cast("int"))
        ordered = _inflated(dealt, unit, records).sortWithinPartitions("folder", "shard", "slot").select("folder", "shard", F.col("value").cast("string").alias("value"))
        with _shuffles_removed(spark):
            ordered.write.mode("append" if low else "errorifexists").option("lineSep", "\n").partitionBy("folder", "shard").text(f"{folder}/shards")
    return Shards(spark, f"{folder}/shards", n, length, width, records)
