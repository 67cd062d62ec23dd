"""Ranked lexical search: an inverted index in shards of documents, and document-at-a-time evaluation of queries over it.

Index: a task cuts its documents into shards of bounded size. In a shard, documents are numbered in the order of their ids, and each term has one row: its
postings in that order, as variable-length bytes of (step to the next document, occurrences). One more row of a shard, with the empty term, has the
documents' ids and lengths.

Search: queries are taken in blocks. A term's postings are read once for a block, with the block's queries that hold it. For each shard and block, a task
merges each query's postings document by document with a heap of the lists' heads; a result heap keyed by score and then document keeps the best so far,
and lists whose greatest contributions together can't reach its least score are only looked up, not merged. The shards' results are merged by rank.

Scores are integers, so they don't depend on the order of addition. Nulls: a null text has no terms, as a document and as a query; a null doc_id comes
last among ties. Repeated rows are documents, and queries, of their own. Without documents or terms there are no results.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.terms import SQL, terms
from tidebar.session import scratch

TOP = 10
#: Documents and postings in a shard at most (one document more than fits may pass the second). Queries in a block.
SHARD_DOCS, SHARD_POSTINGS, BLOCK = 16_384, 1_000_000, 256
#: How much a document's length counts, in per cent, and eight times its share of the saturation (fixed values of the score).
LENGTH_SHARE, SATURATION, SCALE = 90, 8, 1_000_000_000


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the lowest first, the top bit set on all but a value's last byte; and every value's number of bytes."""
    size = np.ones(len(values), dtype=np.int64)
    for k in range(1, 9):
        size += values >= 1 << 7 * k
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[begin[own] + k] = (values[own] >> 7 * k) & 127 | np.where(size[own] > k + 1, 128, 0)
    return out, size


def unvarint(data: bytes) -> np.ndarray:
    """The values of varint()."""
    raw = np.frombuffer(data, dtype=np.uint8)
    last = np.flatnonzero(raw < 128)
    begin = np.concatenate([[0], last[:-1] + 1])
    out = np.zeros(len(last), dtype=np.int64)
    for k in range(int((last - begin).max(initial=-1)) + 1):
        own = begin + k <= last
        out[own] |= (raw[begin[own] + k].astype(np.int64) & 127) << 7 * k
    return out


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if offsets[-1] >= 1 << 31:
        raise ValueError("a shard is too large")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class _Shard:
    """A shard in the making."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.term, self.tf, self.doc, self.n = [], [], [], 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        counted = Counter()
        for words in terms(text):
            counted.update(words)
        if not counted:
            return
        self.term.append(np.fromiter(map(self.numbers.__getitem__, counted), dtype=np.int64, count=len(counted)))
        self.tf.append(np.fromiter(counted.values(), dtype=np.int64, count=len(counted)))
        self.doc.append(len(self.ids))
        self.ids.append(doc_id)
        self.lengths.append(int(self.tf[-1].sum()))
        self.n += len(counted)

    def rows(self, shard: int) -> pa.RecordBatch:
        """(shard, term, df, total, postings): the row of documents first."""
        known = np.array([i is not None for i in self.ids])
        ids, lengths = np.array([i or 0 for i in self.ids], dtype=np.int64), np.array(self.lengths, dtype=np.int64)
        order = np.lexsort((ids, ~known))  # null ids last
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        doc = np.repeat(number, [len(t) for t in self.term])
        term, tf = np.concatenate(self.term), np.concatenate(self.tf)
        place = np.argsort(term * len(order) + doc)
        term, tf, doc = term[place], tf[place], doc[place]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        step = np.diff(doc, prepend=0)
        step[first] = doc[first]
        data, size = varint(np.stack([step, tf], axis=1).ravel())
        bounds = np.append(first, len(term))
        total = np.concatenate([[0], np.cumsum(size)])[2 * bounds]
        head = np.concatenate([known[order].astype("<i8"), ids[order].astype("<i8"), lengths[order].astype("<i8")]).tobytes()
        postings = _binary(np.concatenate([np.frombuffer(head, dtype=np.uint8), data]), np.concatenate([[len(head)], np.diff(total)]))
        names = pa.array([b"", *self.numbers], pa.binary()).cast(pa.string())
        occurrences = np.concatenate([[int(lengths.sum())], np.add.reduceat(tf, first)])
        df = np.concatenate([[len(order)], np.diff(bounds)])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(df), shard)), names, pa.array(df), pa.array(occurrences), postings], names=["shard", "term", "df", "total", "postings"])


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(shard, term, df, total, postings): every term of every shard, with its documents and occurrences there. Each shard has a row with the empty term,
    for its documents and all their terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()

        def rows() -> Iterator[pa.RecordBatch]:
            made = shard.rows(number)
            for at in range(0, made.num_rows, 50_000):
                yield made.slice(at, 50_000)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                shard.add(i, t.as_buffer() if t.is_valid else None)
                if len(shard.ids) >= shard_docs or shard.n >= shard_postings:
                    yield from rows()
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield from rows()

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(work, "shard long, term string, df long, total long, postings binary")


def query_terms(queries: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(query, item_id, term): the distinct terms of every row, with a key of the row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 32
        for b in batches:
            for i, t in zip(b.column(0), b.column(1).cast(pa.binary()), strict=True):
                own = pa.array(sorted({w for words in terms(t.as_buffer() if t.is_valid else None) for w in words}), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), key)), pa.array([i.as_py()] * len(own), b.column(0).type), own], names=["query", "item_id", "term"])
                key += 1

    kind = queries.schema[item_id].dataType.simpleString()
    return queries.select(queries[item_id].alias("item_id"), queries[text].alias("text")).mapInArrow(work, f"query long, item_id {kind}, term string")


class _List:
    """A term's postings in a shard: documents in ascending order, and what each contributes to a score."""

    def __init__(self, weight: int, postings: bytes, m: np.ndarray):
        values = unvarint(postings)
        docs = np.cumsum(values[::2])
        gains = weight * (SCALE * values[1::2] // (1000 * values[1::2] + SATURATION * m[docs]))
        self.docs, self.gains, self.most = docs.tolist(), gains.tolist(), int(gains.max())


def best(lists: list[_List], top: int) -> list[tuple[int, int]]:
    """(score, document) of the `top` best documents with a score above 0, by merging the lists document by document.

    Lists are in ascending order of their greatest contributions; the first `out` of them can't lift a document over the least kept score alone and are
    looked up only. Documents come in ascending order, so one that merely equals the least kept score is behind it.
    """
    lists = sorted((x for x in lists if x.most > 0), key=lambda x: x.most)
    reach = [0]
    for x in lists:
        reach.append(reach[-1] + x.most)
    at, out, least = [0] * len(lists), 0, 0
    heads = [(x.docs[0], k) for k, x in enumerate(lists)]
    heapq.heapify(heads)
    kept: list[tuple[int, int]] = []
    while heads:
        doc, score = heads[0][0], 0
        while heads and heads[0][0] == doc:
            k = heads[0][1]
            x, p = lists[k], at[k]
            score += x.gains[p]
            at[k] = p = p + 1
            if p < len(x.docs):
                heapq.heapreplace(heads, (x.docs[p], k))
            else:
                heapq.heappop(heads)
        for k in range(out - 1, -1, -1):
            if score + reach[k + 1] <= least:
                break
            x = lists[k]
            at[k] = p = bisect_left(x.docs, doc, at[k])
            if p < len(x.docs) and x.docs[p] == doc:
                score += x.gains[p]
        if score > least:
            if len(kept) == top:
                heapq.heapreplace(kept, (score, -doc))
            else:
                heapq.heappush(kept, (score, -doc))
            if len(kept) == top:
                least = kept[0][0]
                if reach[out + 1] <= least:
                    while out < len(lists) and reach[out + 1] <= least:
                        out += 1
                    heads = [h for h in heads if h[1] >= out]
                    heapq.heapify(heads)
    return [(s, -d) for s, d in kept]


def _searched(n_docs: int, n_terms: int, top: int):  # noqa: ANN202
    """What finds the best documents of one shard for one block's queries."""

    def work(whole: pa.Table) -> pa.Table:
        head, own = None, defaultdict(list)
        for term, weight, postings, queries in zip(*(whole.column(c).to_pylist() for c in ("term", "weight", "postings", "queries")), strict=True):
            if not term:
                head = postings
            else:
                own[term] = (weight, postings, queries)
        known, ids, lengths = np.frombuffer(head, dtype="<i8").reshape(3, -1)
        m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms for n in lengths.tolist()], dtype=np.int64)
        by_query: dict[int, list[_List]] = defaultdict(list)
        for weight, postings, queries in own.values():
            made = _List(weight, postings, m)
            for q in queries:
                by_query[q].append(made)
        found = [(q, int(ids[d]) if known[d] else None, s) for q, lists in by_query.items() for s, d in best(lists, top)]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query", "doc_id", "score"), columns, strict=True)})

    return work


def search(indexed: DataFrame, queries: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(query, item_id, rank, doc_id, score): the `top` best documents of every query row over a written index."""
    spark, folder = indexed.sparkSession, scratch(indexed.sparkSession, "search")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    asked = written(query_terms(queries, item_id, text), "asked")
    n_docs, n_terms = indexed.filter("term = ''").agg(F.sum("df"), F.sum("total")).first()
    if not n_docs:
        return asked.select("query", "item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    # a term's weight, from all shards
    df = indexed.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = written(df.select("term", weight.alias("weight")), "weights")
    # each block's terms, with its queries that hold them; and the row of documents for each block
    in_blocks = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.ceil(F.lit(asked.select("query").distinct().count() / block))))
    needed = in_blocks.join(weighed.filter("weight > 0"), "term").groupBy("block", "term", "weight").agg(F.collect_list("query").alias("queries"))
    heads = in_blocks.select("block").distinct().select("block", F.lit("").alias("term"), F.lit(0).cast("long").alias("weight"), F.array().cast("array<bigint>").alias("queries"))
    wanted = written(needed.unionByName(heads), "wanted")
    lists = indexed.select("shard", "term", "postings").join(wanted, "term")
    found = lists.groupBy("shard", "block").applyInArrow(_searched(n_docs, n_terms, top), "query long, doc_id long, score long")
    # the best of each shard meet; the least of a shard go before the shuffle
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(asked.select("query", "item_id").distinct(), "query").select("query", "item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """Indexes all documents in the shared folder and searches them for all queries."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "index")
    index(docs, doc_id, text).write.option("compression", "zstd").parquet(folder)
    return search(spark.read.parquet(folder), queries, item_id, text, top)


def oracle() -> str:
    """The registered query in DuckDB's SQL."""
    return f"""WITH d AS (SELECT doc_id, unnest({SQL}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), len AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len),
q AS (SELECT DISTINCT item_id, unnest({SQL}) AS term FROM benchmark), w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
m AS (SELECT doc_id, {100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * docs) // terms AS m FROM len, s), x AS (SELECT item_id, doc_id, CAST(sum(w * (({SCALE} * tf) // (1000 * tf + {SATURATION} * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= {TOP}"""
