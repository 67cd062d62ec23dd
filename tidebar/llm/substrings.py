"""Removal of long word sequences that an earlier document already has.

The words' de Bruijn graph has an edge for every `width` consecutive words (a window) between its first and its last `width - 1` words. Building all edges
would shuffle more than the text, so only edges that can repeat are built: a window is named by its anchor, the least hash of the EDGE-word k-mers in it,
and equal windows have equal anchors.

1. Documents that equal an earlier one as a whole are settled by their hash and leave the graph.
2. Anchors of at least two documents are found by a join of documents on anchors; windows of all other anchors are unrepeated.
3. The windows of repeated anchors become edges, keyed by 128 bits. An aggregate gives each edge its least holder (document and place) and whether all its
   occurrences go on to one next edge and come from one previous edge: its node degrees.
4. A join of edges with their next ones finds the joints without a branch. Edges that no joint leads to begin a compacted path, which has one
   source: all occurrences of a path's first edge are followed by the whole path.
5. Occurrences of first edges are joined with the paths and give spans. A span counts if its own words have the digest of the words at the source's
   coordinates.

Nulls: a null text has no words. A row without doc_id is neither a source nor cut. Repeated rows are cut alike; equal doc_ids are no source for each
other. Documents with fewer than `width` words stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm import words
from tidebar.session import scratch

#: Words of a k-mer that can be an anchor.
EDGE = 12
_OTHER = np.uint64(0xA0761D6478BD642F)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(values: list[np.ndarray], kind: type) -> pa.Array:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, dtype=kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind, copy=False)))


def _whole(h: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For each window the hash of its least k-mer."""
    k = min(EDGE, width)
    return words.sliding_min(words.runs(h, k), width - k + 1)


def _paths(docs: DataFrame, width: int) -> DataFrame:
    """For each row its number of words, digest, 128-bit content hash and distinct anchors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(1))
            for lo, hi in words.blocks(texts):
                data, begin, end, first = words.of_block(texts[lo:hi])
                h = words.hashes(data, begin, end)
                sizes, shas, whole, anchors = [], [], [], []
                for i in range(hi - lo):
                    own = h[first[i] : first[i + 1]]
                    sizes.append(len(own))
                    shas.append(hashlib.sha256(b" ".join(texts[lo + i].split())).hexdigest())
                    whole.append(_whole(own))
                    anchors.append(np.unique(_anchors(own, width)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(shas), pa.array([w[0] for w in whole], pa.int64()), pa.array([w[1] for w in whole], pa.int64()), _lists(anchors, np.int64)],
                    names=["doc_id", "n_words", "sha", "h1", "h2", "anchors"],
                )

    return docs.mapInArrow(work, "doc_id long, n_words long, sha string, h1 long, h2 long, anchors array<long>")


def _windows(joined: DataFrame, width: int) -> DataFrame:
    """For rows (doc_id, h1, text, hits): the text with the places and 128-bit keys of the windows whose anchors are among the hits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(1))
            hits = batch.column(2)
            for lo, hi in words.blocks(texts):
                data, begin, end, first = words.of_block(texts[lo:hi])
                h = words.hashes(data, begin, end)
                h1s, places, k1, k2 = [], [], [], []
                for i in range(hi - lo):
                    own = h[first[i] : first[i + 1]]
                    hit = hits[lo + i].values.to_numpy(zero_copy_only=False)
                    at = np.flatnonzero(np.isin(_anchors(own, width).view(np.int64), hit))
                    h1s.append(_whole(own)[0])
                    places.append(at)
                    k1.append(words.runs(own, width)[at].view(np.int64))
                    k2.append(words.runs(words.mix(own ^ _OTHER), width)[at].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(h1s, pa.int64()), batch.column(1).slice(lo, hi - lo), _lists(places, np.int32), _lists(k1, np.int64), _lists(k2, np.int64)],
                    names=["doc_id", "h1", "text", "places", "k1", "k2"],
                )

    return joined.mapInArrow(work, "doc_id long, h1 long, text string, places array<int>, k1 array<long>, k2 array<long>")


def _digest(own: list[bytes], a: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(own[a : a + n]), digest_size=16).digest()


def _digests(asked: DataFrame) -> DataFrame:
    """For rows (doc_id, h1, text, asked array of (a, n)): the digest of the n words from word a on, for each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h1s = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = _texts(batch.column(2))
            out: list[tuple] = []
            for i, wanted in enumerate(batch.column(3).to_pylist()):
                own = texts[i].split()
                out += [(ids[i], h1s[i], x["a"], x["n"], _digest(own, x["a"], x["n"])) for x in wanted]
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["source", "source_h1", "source_a", "n", "digest"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["source", "source_h1", "source_a", "n", "digest"])

    return asked.mapInArrow(work, "source long, source_h1 long, source_a long, n long, digest binary")


class Repeats:
    """The repeated spans of a set of documents, kept as tables in the shared folder."""

    def __init__(self, docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text"):
        spark = docs.sparkSession
        self.docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
        self.width, self.folder = width, scratch(spark, "substrings")
        _paths(self.docs, width).write.parquet(f"{self.folder}/paths")
        paths = self.paths = spark.read.parquet(f"{self.folder}/paths")

        # 1. whole copies of an earlier document
        long_ones = paths.filter((F.col("n_words") >= width) & F.col("doc_id").isNotNull())
        # what a join looks up is written first: both sides are then exchanges of their own, and a hot key's partition can be split
        copied = self._written("copied", long_ones.groupBy("h1", "h2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).filter("source < last").drop("last"))
        self.copies = long_ones.join(copied, ["h1", "h2"]).filter("doc_id > source").select("doc_id", "h1", "source").distinct()

        # 2. repeated anchors, and the rows that have them
        rest = long_ones.select("doc_id", "h1", "anchors").join(self.copies.select("doc_id", "h1"), ["doc_id", "h1"], "left_anti")
        edges = rest.select("doc_id", F.explode("anchors").alias("anchor"))
        repeated = self._written("repeated", edges.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor"))
        hits = edges.join(repeated, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("hits"))

        # 3. their windows as edges, with the least holder and the degrees of their nodes
        _windows(self.docs.join(hits, "doc_id"), width).write.option("compression", "zstd").parquet(f"{self.folder}/windows")
        self.held = spark.read.parquet(f"{self.folder}/windows")
        beside = lambda p, i, step: F.when(F.get("places", i + step) == p + step, F.get("k1", i + step)).otherwise(0)  # noqa: E731  0 where the window one word on isn't there
        each = F.transform("places", lambda p, i: F.struct(p.alias("at"), F.get("k1", i).alias("k1"), F.get("k2", i).alias("k2"), beside(p, i, 1).alias("next"), beside(p, i, -1).alias("prev")))
        at = self.held.select("doc_id", "h1", F.explode(each).alias("w")).select("doc_id", "h1", "w.*")
        one = lambda c: F.when((F.min(c) == F.max(c)) & (F.min(c) != 0), F.min(c)).alias(c)  # noqa: E731  null at a branch or an end
        holder = F.min(F.struct("doc_id", "h1", "at")).alias("s")
        edges = self._written("edges", at.groupBy("k1", "k2").agg(holder, F.max("doc_id").alias("hi"), one("next"), one("prev")).filter("s.doc_id < hi").select("k1", "k2", "s.*", "next", "prev"))

        # 4. joints without a branch, and the paths that they make; their edges lie side by side in the path's source
        before = edges.filter("next is not null").select(F.col("k1").alias("prev"), F.col("next").alias("k1"), "doc_id", "h1", (F.col("at") + 1).alias("at"), F.lit(True).alias("goes_on"))
        jointed = edges.join(before.distinct(), ["k1", "prev", "doc_id", "h1", "at"], "left")
        along = Window.partitionBy("doc_id", "h1").orderBy("at")
        numbered = jointed.withColumn("path", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(along))
        first = F.min_by(F.struct("k1", "k2"), "at").alias("first")
        paths_of = numbered.groupBy("doc_id", "h1", "path").agg(first, F.min("at").alias("at"), F.count("*").alias("edges"))
        compact = self._written("compact", paths_of.select("first.k1", "first.k2", F.col("doc_id").alias("source"), F.col("h1").alias("source_h1"), F.col("at").cast("long").alias("source_a"), (F.col("edges") + width - 1).alias("n")))

        # 5. the paths' occurrences in later documents
        later = at.select("doc_id", "h1", "at", "k1", "k2").join(compact, ["k1", "k2"]).filter("doc_id > source")
        spans = self._written("spans", later.select("doc_id", "h1", F.col("at").cast("long").alias("a"), "n", "source", "source_h1", "source_a").distinct())
        self.spans = spans.join(self._sources(spans), ["source", "source_h1", "source_a", "n"])

    def _written(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return df.sparkSession.read.parquet(f"{self.folder}/{name}")

    def _sources(self, spans: DataFrame) -> DataFrame:
        """The digests of the words at the spans' source coordinates."""
        asked = spans.select(F.col("source").alias("doc_id"), F.col("source_h1").alias("h1"), F.col("source_a").alias("a"), "n").distinct().groupBy("doc_id", "h1").agg(F.collect_list(F.struct("a", "n")).alias("asked"))
        texts = self.held.select("doc_id", "h1", "text").dropDuplicates(["doc_id", "h1"])
        return self._written("digests", _digests(texts.join(asked, ["doc_id", "h1"]).select("doc_id", "h1", "text", "asked")))

    def cut(self) -> DataFrame:
        """For rows with spans: (doc_id, h1, n_removed, kept): the words outside all spans that have their source's digest, joined by one space."""
        listed = self.spans.groupBy("doc_id", "h1").agg(F.collect_list(F.struct("a", "n", "digest")).alias("spans"))
        texts = self.held.select("doc_id", "h1", "text").dropDuplicates(["doc_id", "h1"])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, removed, kept = _texts(batch.column(2)), [], []
                for t, found in zip(texts, batch.column(3).to_pylist(), strict=True):
                    own = t.split()
                    gone = np.zeros(len(own), dtype=bool)
                    for s in found:
                        if _digest(own, s["a"], s["n"]) == s["digest"]:
                            gone[s["a"] : s["a"] + s["n"]] = True
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join(w for w, g in zip(own, gone.tolist(), strict=True) if not g).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "h1", "n_removed", "kept"])

        return texts.join(listed, ["doc_id", "h1"]).select("doc_id", "h1", "text", "spans").mapInArrow(work, "doc_id long, h1 long, n_removed long, kept string")

    def digest(self) -> DataFrame:
        """For every row: doc_id, n_words, n_removed and the SHA-256 of the kept words."""
        cut = self.cut().select("doc_id", "h1", F.col("n_removed").alias("cut"), F.sha2("kept", 256).alias("cut_sha"))
        copies = self.copies.select("doc_id", "h1", F.lit(True).alias("copy"))
        return (
            self.paths.select("doc_id", "n_words", "sha", "h1")
            .join(copies, ["doc_id", "h1"], "left")
            .join(cut, ["doc_id", "h1"], "left")
            .select(
                "doc_id",
                "n_words",
                F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
                F.when(F.col("copy"), F.lit(_EMPTY_SHA)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
            )
        )


def oracle(table: str = "documents", width: int = 50) -> str:
    """What digest() returns for documents with distinct ids, in DuckDB's SQL."""
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM {table}),
spots AS (SELECT doc_id, words, unnest(range(1, len(words) - {width - 2})) AS i FROM w WHERE len(words) >= {width}),
g AS (SELECT doc_id, i, md5(array_to_string(words[i:i + {width - 1}], ' ')) AS h FROM spots),
cut AS (SELECT DISTINCT doc_id, i + k.range AS pos FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM g), range({width}) k WHERE first < doc_id),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
kept AS (SELECT doc_id, count(*) FILTER (c.pos IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (c.pos IS NULL) AS text FROM each LEFT JOIN cut c USING (doc_id, pos) GROUP BY 1)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
