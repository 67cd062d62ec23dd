"""Packing of tokenised documents into sequences of bounded length, by hierarchical best fit.

A document is its ids and an end id; only one that is longer than a sequence is cut, its first piece being the shorter one. The pieces, without their ids,
are dealt at random over groups of bounded size, so that every group has the corpus's mixture of lengths. A group packs its pieces, longest first,
each into the open bin with the least room that it fits into: open bins stand by their room, and one bit for each room says whether there is such a bin,
so a piece costs one look-up.

Nearly full bins are done. Underfull bins are then items themselves: groups are merged FAN at a time in a tree, and best fit runs again over the bins of
each merged group. Best fit leaves at most one bin of a group half empty, and no two others can be joined; so a group hands on that bin and as many of
its roomiest others as there are groups to send them a half-empty one, and what it doesn't hand on could not have been used. A task at the tree's root
thus has a few bins of each group below it, never the corpus.

Nulls: a null text is empty and is one end id; a null doc_id stays null. Repeated rows are packed as often as they come. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.llm import byte_bpe
from tidebar.session import scratch

CAPACITY = 2048
#: The id that ends a document.
END_ID = 0
#: Pieces in a group at most (on average) and at least; groups that are merged at once.
GROUP, SMALL_GROUP, FAN = 65_536, 2_048, 8
#: A bin with at most this much room is nearly full.
NEARLY_FULL = 8
#: Ids in a batch of pieces.
IDS_AT_ONCE = 1_000_000


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one, or whole ones after a first one that has the rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of items in descending order: for each item the item that opened its bin, its offset there, and (where it opened one) the bin's fill."""
    n = len(sizes)
    into, offset, fill = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: there is an open bin with room for r
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            offset[k] = capacity - room
        else:
            own, room = k, capacity
        into[k] = own
        room -= size
        fill[own] = capacity - room
        if room:
            by_room[room].append(own)
            rooms |= 1 << room
    return into, offset, fill


def handed_on(fill: np.ndarray, capacity: int, others: int) -> np.ndarray:
    """Which bins (0: not a bin) a group hands on if there are so many other groups: those at most half full, and the roomiest of the rest."""
    out = (fill > 0) & (2 * fill <= capacity)
    rest = np.flatnonzero((2 * fill > capacity) & (fill < capacity - NEARLY_FULL))
    out[rest[np.argsort(fill[rest], kind="stable")[:others]]] = True
    return out


def _pieces(docs: DataFrame, doc_id: str, text: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """(piece_key, doc_id, piece, start, length, ids_crc32, ids) of every piece; ids have two bytes."""
    schema = T.StructType([T.StructField("piece_key", T.LongType()), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")), T.StructField("ids", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, key, rows, weight, last = byte_bpe.encoder(path), TaskContext.get().partitionId() << 40, [], 0, np.array([end_id], dtype=np.uint32)

        def batch(template: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), template, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        kind = None
        for b in batches:
            kind = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.concatenate([encode(t.as_py()), last])
                if int(ids.max()) >= 1 << 16:
                    raise ValueError("ids need more than two bytes")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((key, i, k, start, length, zlib.crc32(own.astype("<u4").tobytes()), own.astype("<u2").tobytes()))
                    key, weight = key + 1, weight + length
                    if weight >= IDS_AT_ONCE:
                        yield batch(kind)
                        rows.clear()
                        weight = 0
        if rows:
            yield batch(kind)

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(work, schema)


def _packed(items: DataFrame, capacity: int, groups: int) -> DataFrame:
    """items (each partition is a group) with `bin`, the key of the item that opened its bin, `offset` in it, and for openers the bin's `fill` and
    whether it is handed on (`open`)."""
    schema = T.StructType([*items.schema.fields, *(T.StructField(c, T.LongType()) for c in ("bin", "offset", "fill")), T.StructField("open", T.BooleanType())])
    key, size = items.columns.index("piece_key"), items.columns.index("length")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(own) if (own := [b for b in batches if b.num_rows]) else None
        if whole is None:
            return
        whole = whole.take(pa.array(np.argsort(keys := whole.column(key).to_numpy())))  # the order of arrival doesn't matter
        keys = np.sort(keys)
        into, offset, fill = best_fit(whole.column(size).to_numpy(), capacity)
        made = [pa.array(keys[into]), pa.array(offset), pa.array(fill, mask=fill == 0), pa.array(handed_on(fill, capacity, groups - 1))]
        for name, a in zip(schema.names[-4:], made, strict=True):
            whole = whole.append_column(name, a)
        yield from whole.combine_chunks().to_batches(max_chunksize=20_000)

    return items.mapInArrow(work, schema)


class Packed:
    """Written pieces and their places. `places` has piece_key, doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""

    def __init__(self, pieces: DataFrame, places: DataFrame, rounds: int):
        self.pieces, self.places, self.rounds = pieces, places, rounds

    def sequences(self) -> DataFrame:
        """(sequence_id, n_ids, ids): the packed sequences themselves, ids of two bytes, little-endian."""
        own = self.places.select("piece_key", "sequence_id", "offset").join(self.pieces.select("piece_key", "length", "ids"), "piece_key")
        parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most as many pieces as a sequence has ids
        return own.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("parts")).select("sequence_id", "n_ids", F.expr("aggregate(parts, cast('' AS binary), (a, p) -> concat(a, p.ids))").alias("ids"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> Packed:
    """Packs every document into sequences of at most `capacity` ids. Pieces and every round's bins are written to the shared folder."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "packing")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    pieces = written(_pieces(docs, doc_id, text, path or byte_bpe.default_path(), capacity, end_id), "pieces")
    n = pieces.count()
    groups = max(1, -(-n // GROUP), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // SMALL_GROUP))
    dealt = pieces.drop("ids").withColumn("grp", F.pmod(F.xxhash64("piece_key"), F.lit(groups)).cast("int"))
    first = written(_packed(dealt.repartitionById(groups, "grp"), capacity, groups), "round-1")
    last, moved, rounds = first, [], 1
    while groups > 1:
        groups, rounds = -(-groups // FAN), rounds + 1
        bins = last.filter("open").select(F.col("bin").alias("piece_key"), F.col("fill").alias("length"), F.floor(F.col("grp") / FAN).cast("int").alias("grp"))
        last = written(_packed(bins.repartitionById(groups, "grp"), capacity, groups), f"round-{rounds}")
        moved.append(last.filter("piece_key <> bin").select(F.col("piece_key").alias("from"), F.col("bin").alias("to"), F.col("offset").alias("by")))
    # where a bin ends up after all rounds: later moves are applied to earlier ones
    ends = None
    for m in reversed(moved):
        if ends is not None:
            further = ends.select(F.col("from").alias("to"), F.col("to").alias("end"), F.col("by").alias("more"))
            ends = m.join(further, "to", "left").select("from", F.coalesce("end", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by")).union(ends)
        else:
            ends = m
    places = first.select("piece_key", "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("from"), "offset")
    if ends is not None:
        places = places.join(written(ends, "moves"), "from", "left").select("piece_key", "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("to", "from").alias("from"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
    return Packed(pieces, places.withColumnRenamed("from", "sequence_id"), rounds)
