"""Monthly archives of CSV lines, as a Spark data source: a zip for each month with a file beside it that has its SHA-256.

    archives.register(spark)
    spark.read.format("archives").option("path", folder).option("prefix", "ALL-15m").option("first", "2024-01").option("last", "2024-06").load()

Each archive is a partition. A task first reads the archive in pieces for its digest, then streams its CSV members line by line into Arrow batches, so that
it never holds an archive. Months that aren't there are skipped. An archive whose digest differs from its checksum file fails the query by name; one
without a checksum file fails too, unless the option `checksums` is `optional`. Broken zips and archives without a CSV member fail by name as well.

Rows are (archive, month, member, line_no, line); blank lines count but aren't returned. Paths are those of pyarrow's file systems (local, hdfs, s3, gs).
`write()` makes such archives from a table.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, month string, member string, line_no long, line string"
#: Bytes that are read at once for a digest; lines in a batch.
PIECE, LINES = 1 << 20, 20_000


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else "file://" + path.removeprefix("file:"))


class Archive(InputPartition):
    def __init__(self, path: str, name: str, month: str, checked: bool):
        super().__init__(name)
        self.path, self.name, self.month, self.checked = path, name, month, checked


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.prefix = options["path"].rstrip("/"), options.get("prefix", "")
        self.first, self.last = options.get("first", "0000-00"), options.get("last", "9999-99")
        self.kind = options.get("checksums", "required")
        if self.kind not in ("required", "optional"):
            raise ValueError(f"checksums is required or optional, not {self.kind}")

    def partitions(self) -> list[Archive]:
        """One for each archive that is there: a listing, not a look for each month."""
        system, folder = filesystem(self.folder)
        names = {f.base_name for f in system.get_file_info(pafs.FileSelector(folder))}
        found = []
        for name in sorted(names):
            m = re.fullmatch(r"(.+)-(\d{4}-\d\d)\.zip", name)
            if m and self.prefix in ("", m[1]) and self.first <= m[2] <= self.last:
                checked = f"{name}.CHECKSUM" in names
                if not checked and self.kind == "required":
                    raise ValueError(f"{name} has no checksum file")
                found.append(Archive(self.folder, name, m[2], checked))
        return found

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no archive
            return
        system, folder = filesystem(partition.path)
        path = f"{folder}/{partition.name}"
        if partition.checked:
            with system.open_input_stream(f"{path}.CHECKSUM") as f:
                expected = f.read().decode().split()
            digest = hashlib.sha256()
            with system.open_input_stream(path) as f:
                while piece := f.read(PIECE):
                    digest.update(piece)
            if not expected or digest.hexdigest() != expected[0].lower():
                raise ValueError(f"{partition.name}: its SHA-256 is {digest.hexdigest()}, not {expected[0] if expected else 'given'}")
        try:
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                members = [m for m in z.namelist() if m.endswith(".csv")]
                if not members:
                    raise ValueError(f"{partition.name} has no CSV member")
                for member in members:
                    with z.open(member) as raw:
                        yield from self._batches(partition, member, io.TextIOWrapper(raw, encoding="utf-8", newline=None))
        except (zipfile.BadZipFile, zlib.error) as e:
            raise ValueError(f"{partition.name} can't be unpacked: {e}") from e

    @staticmethod
    def _batches(partition: Archive, member: str, lines: Iterator[str]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            n = len(numbers)
            return pa.RecordBatch.from_arrays([pa.array([partition.name] * n), pa.array([partition.month] * n), pa.array([member] * n), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], names=["archive", "month", "member", "line_no", "line"])

        numbers, texts = [], []
        for k, line in enumerate(lines):
            text = line.rstrip("\n")
            if text.strip():
                numbers.append(k)
                texts.append(text)
            if len(numbers) >= LINES:
                yield batch()
                numbers, texts = [], []
        if numbers:
            yield batch()


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:  # noqa: ANN001
        return ArchiveReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def write(lines: DataFrame, folder: str, header: str | None = None) -> None:
    """Archives `<prefix>-<month>.zip` and their checksum files from (prefix, month, place, line): one for each prefix and month, its lines by place. A task
    streams its sorted lines into one archive after another; each is written under another name and moved when it is whole, so a task can run again."""
    columns = lines.select("prefix", "month", "place", "line")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        system.create_dir(root)
        key = sink = None
        made: list[tuple[str, str]] = []

        def begin(name: str) -> tuple:
            raw = system.open_output_stream(f"{root}/.{name}.part")
            z = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
            member = z.open(f"{name.removesuffix('.zip')}.csv", "w", force_zip64=True)
            if header:
                member.write(f"{header}\n".encode())
            return name, raw, z, member

        def finish(name: str, raw: pa.NativeFile, z: zipfile.ZipFile, member: io.IOBase) -> None:
            for x in (member, z, raw):
                x.close()
            digest = hashlib.sha256()
            with system.open_input_stream(f"{root}/.{name}.part") as f:
                while piece := f.read(PIECE):
                    digest.update(piece)
            with system.open_output_stream(f"{root}/{name}.CHECKSUM") as f:
                f.write(f"{digest.hexdigest()}  {name}\n".encode())
            system.move(f"{root}/.{name}.part", f"{root}/{name}")
            made.append((name, digest.hexdigest()))

        for b in batches:
            for prefix, month, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (prefix, month) != key:
                    if sink:
                        finish(*sink)
                    key, sink = (prefix, month), begin(f"{prefix}-{month}.zip")
                sink[3].write(f"{line}\n".encode())
        if sink:
            finish(*sink)
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.string()) for k in (0, 1)], names=["archive", "sha256"])

    ordered = columns.repartition("prefix", "month").sortWithinPartitions("prefix", "month", "place")
    ordered.mapInArrow(work, "archive string, sha256 string").agg(F.count("*")).collect()
