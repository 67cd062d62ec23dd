"""WARC archives written and read back through Spark, with a globally ordered capture history.

Writing: records are made by column expressions (SHA-1 payload digests in base 32 among them); each is a gzip member of its own, and a file begins with
a warcinfo record. Files are written by Spark's text sink, whose line end is an empty gzip member, so any store that Spark can write will do, a lost
executor's file is written anew, and the files are whole multi-member archives. Of records with equal payloads, that with the largest page id is a
response and the others are revisits that refer to it. Each file is one run of captures, sorted by URL key, time and page id.

Reading: each file's members give a sorted run of index entries with the place of each member in its file, by which fetch() reads single captures. Runs
are dealt by ranges of (URL key, time, page id) of about ENTRIES entries each, so that one URL with very many captures is spread as well. In a range the
entries stay in the order of their runs, and a loser tree merges the runs: the result is in global order, and a task holds one range.

The time of a capture is EPOCH plus its page id in seconds, which is held between 0 and LATEST: later page ids have equal times and stay in order of
their ids.

Nulls: a null payload is empty, a null URL has the empty key. Equal page ids with equal payloads are all responses. Page ids may be null: such a record
is named by `-`. Repeated rows are written as often as they come.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.session import scratch

#: Payload bytes in a file, about.
FILE_BYTES = 32 * 2**20
#: The time of the record of page 0; page ids count seconds from it where no times are given.
EPOCH = 1_704_067_200
LATEST = 2**32
#: Entries in a range that one task merges, about.
ENTRIES = 100_000
#: A gzip member without content: what ends each record's member.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
#: Packed bytes that are given to the inflater at once: what it reads beyond a member is copied.
PIECE = 16_384


def base32(hexadecimal: Column) -> Column:
    """The base-32 text of a hexadecimal column whose length is a multiple of five digits."""
    groups = [F.lpad(F.conv(F.substring(hexadecimal, k + 1, 5), 16, 32), 4, "0") for k in range(0, 40, 5)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """The host's names from the last to the first, and the path, in lower case: what captures are ordered by."""
    low = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(low, r"^[^:/?#]*://([^/?#:]*)", 1)
    rest = F.regexp_extract(low, r"(?s)^[^:/?#]*://[^/?#]*(.*)", 1)
    return F.regexp_replace(F.when(host == "", low).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)), r"[\s]+", F.lit("%20"))


def planned(pages: DataFrame, page_id: str, url: str, payload: str, at_least: int, files: int) -> DataFrame:
    """Each page with its digest and the response that it refers to (null for responses), dealt over `files` partitions.

    What is joined on the digest, which may be hot, are ids alone; payloads move once, by page id.
    """
    spark = pages.sparkSession
    own = pages.select(pages[page_id].cast("long").alias("page_id"), F.coalesce(pages[url], F.lit("")).alias("url"), F.coalesce(pages[payload], F.lit("")).alias("payload"))
    own = own.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": base32(F.sha1(F.col("payload").cast("binary"))), "pid": F.coalesce(F.col("page_id").cast("string"), F.lit("-"))})
    folder = scratch(spark, "warc-groups")
    ids = own.filter(F.col("bytes") >= at_least).select("page_id", "pid", "digest")
    # sums in each task come first, so a digest of very many pages is no hot key; written, so that its partition can be split in the join
    ids.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null").select("digest", "last").write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    ids.join(groups, "digest").filter(F.col("page_id").isNull() | (F.col("page_id") != F.col("last"))).select("pid", "digest", F.col("last").alias("refers_to")).distinct().write.parquet(f"{folder}/revisits")
    dealt = own.repartition(files, "pid", "digest")
    return dealt.join(spark.read.parquet(f"{folder}/revisits"), ["pid", "digest"], "left").select("page_id", "url", "payload", "bytes", "digest", "refers_to")


def target_of(url: Column) -> Column:
    """The URL as a header can hold it."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]+", F.lit("%20"))


def records(plan: DataFrame) -> DataFrame:
    """Each planned page as the bytes of its record."""
    name = lambda i: F.concat(F.lit("urn:page:"), F.coalesce(i.cast("string"), F.lit("-")))
    time = F.lit(EPOCH) + F.least(F.greatest(F.coalesce("page_id", F.lit(0)), F.lit(0)), F.lit(LATEST))
    when = F.date_format(F.timestamp_seconds(time), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    target = target_of(F.col("url"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: <"), name(F.col("page_id")), F.lit(">\r\nWARC-Date: "), when,
        F.lit("\r\nWARC-Target-URI: "), target, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <"), name(F.col("refers_to")), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
    )
    body = F.concat(head, F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"))
    return plan.select(url_key(target).alias("key"), time.alias("time"), "page_id", body.cast("binary").alias("value"))


def _warcinfo(part: int) -> bytes:
    fields = b"software: tidebar\r\nformat: WARC File Format 1.1\r\n"
    date = datetime.fromtimestamp(EPOCH, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:{part}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(fields)}\r\n\r\n".encode() + fields + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", at_least: int = 0) -> None:
    """Writes a record for every page; each file is sorted by URL key, time and page id."""
    total = pages.agg(F.sum(F.octet_length(payload))).first()[0] or 0
    plan = planned(pages, page_id, url, payload, at_least, max(1, -(-total // FILE_BYTES)))
    runs = records(plan).sortWithinPartitions("key", "time", "page_id").select("value")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = lambda b: gzip.compress(b, compresslevel=6, mtime=0)
        first = True
        for batch in batches:
            if first and batch.num_rows:
                first = False
                yield pa.RecordBatch.from_arrays([pa.array([member(_warcinfo(TaskContext.get().partitionId()))], pa.binary())], names=["value"])
            yield pa.RecordBatch.from_arrays([pa.array([member(v.as_buffer()) for v in batch.column(0)], pa.binary())], names=["value"])

    # the sink writes bytes as they are; the encoding is that of the line end
    members = runs.mapInArrow(packed, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)


def record_at(data: bytes | memoryview, offset: int) -> tuple[int, bytes]:
    """The record whose gzip member begins at this place, and the member's length."""
    view, at, out, inflater = memoryview(data), offset, [], zlib.decompressobj(wbits=31)
    while not inflater.eof:
        if at >= len(view):
            raise ValueError(f"the member at {offset} isn't closed")
        out.append(inflater.decompress(view[at : at + PIECE]))
        at += PIECE
    return min(at, len(view)) - len(inflater.unused_data) - offset, b"".join(out)


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    end = record.index(b"\r\n\r\n")
    lines = record[:end].decode("utf-8", "surrogateescape").split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    stop = end + 4 + int(headers["Content-Length"])
    if lines[0] != "WARC/1.1" or record[stop:] != b"\r\n\r\n":
        raise ValueError("a member isn't one whole record")
    return headers, record[end + 4 : stop]


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Place and length of its member, headers and block of each record of an archive."""
    at = 0
    while at < len(data):
        length, record = record_at(data, at)
        if record:
            yield at, length, *parsed(record)
        at += length


class LoserTree:
    """k-way merge of sorted runs: each inner node keeps the loser of its match, so the next winner costs one match for each level."""

    def __init__(self, runs: Sequence[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) <= (y, b))

    def _play(self, i: int) -> None:
        """Takes run i from its leaf to the root; an empty place waits for the other side."""
        winner, node = i, (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (best := self.losers[0]) >= 0 and self.heads[best] is not None:
            yield self.heads[best]
            self.heads[best] = next(self.runs[best], None)
            self.losers[0] = -1
            winner, node = best, (best + self.k) // 2
            while node > 0:
                if self._beats(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.losers[0] = winner


_ENTRY = "key string, time timestamp, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long"
_ORDER = ("key", "time", "page_id")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def index_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The index entries of each archive, in the order of its records: one sorted run a file. Digests are made anew from the payloads read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for offset, length, headers, block in parse(content.as_buffer()):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    http = block.index(b"\r\n\r\n")
                    payload, stated = block[http + 4 :], int(block[:http].rpartition(b"Content-Length: ")[2])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if headers["WARC-Type"] == "response" and (len(payload) != stated or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{path}: the payload at {offset} isn't what its digest says")
                    number = lambda h: int(headers[h][1:-1].rpartition(":")[2]) if h in headers and headers[h][1:-1].rpartition(":")[2] != "-" else None  # noqa: B023, E731
                    when = datetime.strptime(headers["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
                    rows.append((headers["WARC-Target-URI"].encode("utf-8", "surrogateescape").decode("utf-8", "replace"), when, number("WARC-Record-ID"), headers["WARC-Type"], stated, digest, number("WARC-Refers-To"), path.as_py(), offset, length))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.string(), pa.timestamp("us", tz="UTC"), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _ENTRY.split(", ")])

    return _files(spark, folder).mapInArrow(work, _ENTRY).withColumn("key", url_key(F.col("key")))


def fetch(entries: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload) of index entries, each read by the place of its member alone; a revisit has no payload of its own."""
    wanted = entries.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("page_id", "offset", "record_type")).alias("wanted"))  # a file's records at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, listed in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                blocks = [parsed(record_at(content.as_buffer(), w["offset"])[1])[1] for w in listed]
                payloads = [None if w["record_type"] == "revisit" else b[b.index(b"\r\n\r\n") + 4 :] for w, b in zip(listed, blocks, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([w["page_id"] for w in listed], pa.int64()), pa.array(payloads, pa.binary())], names=["page_id", "payload"])

    return _files(entries.sparkSession, folder).join(wanted, "path").select("content", "wanted").mapInArrow(work, "page_id long, payload binary")


def histories(runs: DataFrame, entries_at_once: int = 20_000) -> DataFrame:
    """All runs merged in the order of URL key, time and page id: rows are in order within partitions, and partitions follow each other. runs must be a
    table, as it is counted, sampled for the ranges and read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        whole = pa.Table.from_batches(table)
        files = whole.column("file").to_pylist()
        keys = list(zip(whole.column("key").to_pylist(), whole.column("time").cast(pa.int64()).to_pylist(), ((i is not None, i or 0) for i in whole.column("page_id").to_pylist()), range(len(files)), strict=True))
        # the runs of a range: entries come one file after the other, each in its run's order
        begins = [0, *(k for k in range(1, len(files)) if files[k] != files[k - 1]), len(files)]
        order = list(LoserTree([iter(keys[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]))
        if any(a[:3] > b[:3] for a, b in pairwise(order)):
            raise ValueError("a run isn't sorted")
        for at in range(0, len(order), entries_at_once):
            yield from whole.take(pa.array([x[-1] for x in order[at : at + entries_at_once]])).combine_chunks().to_batches()

    ranges = max(1, -(-runs.count() // ENTRIES))
    return runs.repartitionByRange(ranges, *_ORDER, F.col("file")).sortWithinPartitions("file", "offset").mapInArrow(work, _ENTRY)


def archive_and_index(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", at_least: int = 0) -> DataFrame:
    """Writes the pages' archives into the shared folder, reads them back and returns their capture history."""
    spark, folder = pages.sparkSession, scratch(pages.sparkSession, "warc")
    write(pages, f"{folder}/archives", page_id, url, payload, at_least)
    index_runs(spark, f"{folder}/archives").write.parquet(f"{folder}/index")
    return histories(spark.read.parquet(f"{folder}/index"))


def oracle(table: str = "pages", at_least: int = 0) -> str:
    """What op4 returns, in DuckDB's SQL."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    number = lambda k: f"CAST('0x' || substr(hex, {k}, 5) AS BIGINT)"
    digits = " || ".join(f"substr('{alphabet}', CAST(({number(k)} >> {shift}) & 31 AS INTEGER) + 1, 1)" for k in range(1, 41, 5) for shift in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM {table}),
q AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM p)
SELECT page_id, payload_bytes, {digits} AS payload_digest, CASE WHEN payload_bytes >= {at_least} AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= {at_least} AND last <> page_id THEN last END AS refers_to FROM q"""
