"""Paged, rate-limited histories as a Spark data source, to be read at once or as a stream.

    pages.register(spark)
    spark.readStream.format("pages").option("path", folder).option("rate", "10").load()

A history is numbered pages of JSON, `{"history": [...]}`; a transport knows how many there are and fetches one. The stream's offset is the number of the next
page and is kept in the stream's checkpoint, so that a stream that stops goes on where it was, and each page is read once. `rate` bounds the pages that are
fetched in a second: they are dealt over `tasks` tasks, and each takes a token for a page from a bucket that fills at its share of the rate.

A fetch that is told to wait (status 429) waits as long as it is told, once; then, and for other errors, the task fails and Spark tries it again. A page that
isn't there (400, 404) is empty. Rows are (page, place, payload), payload being one entry's JSON; entries that are null are left out.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidebar.sources.archives import filesystem

SCHEMA = "page long, place int, payload string"
#: Seconds that a fetch waits at most when it is told to.
LONGEST_WAIT = 120.0


class Transport(Protocol):
    def count(self) -> int: ...

    def fetch(self, page: int) -> tuple[int, bytes, float]:
        """Status, body, and the seconds to wait where the status is 429."""


class Folder:
    """Pages as files `<number>.json` without gaps; a file `<number>.wait` with a number of seconds says that the page is to be asked for again."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")

    def count(self) -> int:
        system, folder = filesystem(self.path)
        names = {f.base_name for f in system.get_file_info(pafs.FileSelector(folder))}
        n = 0
        while f"{n}.json" in names:
            n += 1
        return n

    def fetch(self, page: int) -> tuple[int, bytes, float]:
        system, folder = filesystem(self.path)
        wait = f"{folder}/{page}.wait"
        if system.get_file_info(wait).type != pafs.FileType.NotFound:
            with system.open_input_stream(wait) as f:
                seconds = float(f.read())
            system.delete_file(wait)
            return 429, b"", seconds
        try:
            with system.open_input_stream(f"{folder}/{page}.json") as f:
                return 200, f.read(), 0.0
        except FileNotFoundError:
            return 404, b"", 0.0


class Http:
    """Pages of a service: `path` has {page} in it, and `count_path` answers with the number of pages."""

    def __init__(self, options: dict[str, str]):
        self.path, self.count_path = options["path"], options.get("count_path", "")

    def count(self) -> int:
        with urllib.request.urlopen(self.count_path, timeout=20) as r:
            return int(json.load(r))

    def fetch(self, page: int) -> tuple[int, bytes, float]:
        try:
            with urllib.request.urlopen(self.path.format(page=page), timeout=20) as r:
                return r.status, r.read(), 0.0
        except urllib.error.HTTPError as e:
            return e.code, b"", float(e.headers.get("Retry-After") or 5)


TRANSPORTS: dict[str, Callable[[dict[str, str]], Transport]] = {"folder": Folder, "http": Http}


class TokenBucket:
    """Tokens that come in at a rate, up to a burst; the clock can be another one."""

    def __init__(self, rate: float, burst: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if rate <= 0 or burst < 1:
            raise ValueError("a bucket needs a rate above 0 and a burst of at least 1")
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = burst, clock()

    def take(self) -> float:
        """Takes a token if there is one; else how many seconds it is until then."""
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        if self.tokens >= 1:
            self.tokens -= 1
            return 0.0
        return (1 - self.tokens) / self.rate

    def wait(self) -> None:
        """Takes a token, when there is one."""
        while seconds := self.take():
            self.sleep(seconds)


class Pages(InputPartition):
    """Neighbouring pages that one task fetches, at its share of the rate."""

    def __init__(self, first: int, end: int, rate: float):
        super().__init__((first, end))
        self.first, self.end, self.rate = first, end, rate


def rows_of(transport: Transport, page: int, sleep: Callable[[float], None] = time.sleep) -> Iterator[pa.RecordBatch]:
    status, body, wait = transport.fetch(page)
    if status == 429:
        sleep(min(wait, LONGEST_WAIT))
        status, body, _ = transport.fetch(page)
    if status in (400, 404):
        return
    if status != 200:
        raise OSError(f"page {page}: status {status}")
    history = json.loads(body).get("history") or []
    own = [(k, json.dumps(x, ensure_ascii=False)) for k, x in enumerate(history) if x is not None]
    yield pa.RecordBatch.from_arrays([pa.array([page] * len(own), pa.int64()), pa.array([k for k, _ in own], pa.int32()), pa.array([x for _, x in own], pa.string())], names=["page", "place", "payload"])


class _Reader:
    def __init__(self, options: dict[str, str]):
        kind = options.get("transport", "folder")
        if kind not in TRANSPORTS:
            raise ValueError(f"no transport {kind}")
        self.transport = TRANSPORTS[kind](options)
        self.rate, self.tasks = float(options.get("rate", "10")), int(options.get("tasks", "4"))
        TokenBucket(self.rate, 1)  # refuses a rate that isn't one

    def dealt(self, first: int, end: int) -> list[Pages]:
        tasks = max(1, min(self.tasks, end - first))
        cuts = [first + (end - first) * k // tasks for k in range(tasks + 1)]
        return [Pages(a, b, self.rate / tasks) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        bucket = TokenBucket(partition.rate, 1)
        for page in range(partition.first, partition.end):
            bucket.wait()
            yield from rows_of(self.transport, page)


class PageReader(_Reader, DataSourceReader):
    """All pages that are there."""

    def partitions(self) -> list[Pages]:
        return self.dealt(0, self.transport.count()) or [Pages(0, 0, self.rate)]


class PageStream(_Reader, DataSourceStreamReader):
    """Offsets are numbers of pages. The latest one is the number of pages that there are, so it never falls behind a checkpoint."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"page": self.transport.count()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.dealt(start["page"], end["page"])


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:  # noqa: ANN001
        return PageReader(dict(self.options))

    def streamReader(self, schema) -> PageStream:  # noqa: ANN001, N802
        return PageStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)


def write(entries: DataFrame, folder: str) -> None:
    """A folder of pages from (page, place, payload), payload being an entry's JSON. Each page is a file that is moved into place when it is whole. A page is
    one task's work, as it is one answer of a service."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        system.create_dir(root)
        page, own, n = None, [], 0

        def finish() -> None:
            with system.open_output_stream(f"{root}/.{page}.part") as f:
                f.write(('{"history": [' + ", ".join(own) + "]}").encode())
            system.move(f"{root}/.{page}.part", f"{root}/{page}.json")

        for b in batches:
            for number, payload in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if number != page:
                    if page is not None:
                        finish()
                    page, own, n = number, [], n + 1
                own.append("null" if payload is None else payload)
        if page is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["pages"])

    ordered = entries.select("page", "place", "payload").repartition("page").sortWithinPartitions("page", "place")
    ordered.mapInArrow(work, "pages long").agg(F.sum("pages")).collect()
