import hashlib
import json
import time
import zipfile

import pytest

from tidebar.sources import archives, pages


def put(folder, name, text, checksum=True, member=None):
    path = folder / name
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(member or name.replace(".zip", ".csv"), text)
    if checksum:
        (folder / f"{name}.CHECKSUM").write_text(f"{hashlib.sha256(path.read_bytes()).hexdigest().upper()}  {name}\n")


def scan(spark, folder, **options):
    archives.register(spark)
    return spark.read.format("archives").options(path=str(folder), **options).load()


def test_archives_are_read_by_month(spark, tmp_path, monkeypatch):
    put(tmp_path, "A-1h-2024-01.zip", "1,2\n3,4\n")
    put(tmp_path, "A-1h-2024-03.zip", "h\r\n5,6\r\n\r\n7,8")  # February isn't there
    put(tmp_path, "A-1h-2024-04.zip", "")
    put(tmp_path, "B-1h-2024-01.zip", "9\n")
    (tmp_path / "notes.txt").write_text("no archive")
    df = scan(spark, tmp_path, prefix="A-1h")
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r.month, r.member, r.line_no, r.line) for r in df.collect()) == [("2024-01", "A-1h-2024-01.csv", 0, "1,2"), ("2024-01", "A-1h-2024-01.csv", 1, "3,4"), ("2024-03", "A-1h-2024-03.csv", 0, "h"), ("2024-03", "A-1h-2024-03.csv", 1, "5,6"), ("2024-03", "A-1h-2024-03.csv", 3, "7,8")]
    assert {r.month for r in scan(spark, tmp_path, prefix="A-1h", first="2024-02", last="2024-03").collect()} == {"2024-03"}
    assert scan(spark, tmp_path).count() == 6
    assert scan(spark, tmp_path, prefix="none").count() == 0


def test_long_archives_come_in_batches(spark, tmp_path):
    put(tmp_path, "A-2024-01.zip", "\n".join(map(str, range(archives.LINES * 2 + 5))))
    df = scan(spark, tmp_path)
    assert df.count() == archives.LINES * 2 + 5 and df.filter("line <> CAST(line_no AS string)").count() == 0


def test_a_corrupted_archive_fails_by_name(spark, tmp_path):
    put(tmp_path, "A-2024-01.zip", "1,2\n")
    put(tmp_path, "A-2024-02.zip", "1,2\n" * 1000)
    path = tmp_path / "A-2024-02.zip"
    data = bytearray(path.read_bytes())
    data[60] ^= 255
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match=r"A-2024-02\.zip: its SHA-256 is"):
        scan(spark, tmp_path).collect()
    assert scan(spark, tmp_path, last="2024-01").count() == 1  # the rest is read by partition
    (tmp_path / "A-2024-02.zip.CHECKSUM").unlink()
    with pytest.raises(Exception, match=r"A-2024-02\.zip has no checksum file"):
        scan(spark, tmp_path).collect()
    with pytest.raises(Exception, match=r"A-2024-02\.zip can't be unpacked"):
        scan(spark, tmp_path, checksums="optional").collect()
    put(tmp_path, "A-2024-02.zip", "x", member="x.txt")
    with pytest.raises(Exception, match=r"A-2024-02\.zip has no CSV member"):
        scan(spark, tmp_path).collect()


def test_written_archives_are_read_back(spark, tmp_path):
    rows = [(p, m, k, f"{p},{m},{k}") for p in ("A", "B") for m in ("2024-01", "2024-02") for k in range(50)]
    archives.write(spark.createDataFrame(rows, "prefix string, month string, place long, line string").repartition(7), f"{tmp_path}/out", header="p,m,k")
    got = scan(spark, tmp_path / "out").collect()
    assert sorted(r.line for r in got if r.line_no) == sorted(r[3] for r in rows) and sum(r.line == "p,m,k" for r in got) == 4
    assert all(int(r.line.split(",")[2]) == r.line_no - 1 for r in got if r.line_no)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{p}-{m}.zip{s}" for p in "AB" for m in ("2024-01", "2024-02") for s in ("", ".CHECKSUM"))


def page(folder, n, *entries):
    (folder / f"{n}.json").write_text(json.dumps({"history": list(entries)}))


def test_pages_at_once(spark, tmp_path):
    pages.register(spark)
    load = lambda **o: spark.read.format("pages").options(path=str(tmp_path), rate="1000", **o).load()
    assert load().count() == 0
    page(tmp_path, 0, {"t": 1, "v": "é"}, None, {"t": 2})
    page(tmp_path, 1)
    page(tmp_path, 2, {"t": 3})
    page(tmp_path, 4, {"t": 9})  # beyond a gap: not there yet
    assert sorted((r.page, r.place, json.loads(r.payload)["t"]) for r in load(tasks="2").collect()) == [(0, 0, 1), (0, 2, 2), (2, 0, 3)]
    (tmp_path / "2.wait").write_text("0.01")
    assert load().count() == 3 and not (tmp_path / "2.wait").exists()
    with pytest.raises(Exception, match="no transport"):
        load(transport="pigeon").collect()


def test_a_fetch_waits_once_and_then_fails():
    class Busy:
        answers, slept = [(429, b"", 7.0), (200, b'{"history": [1]}', 0.0)], []

        def fetch(self, n):
            return self.answers.pop(0)

    busy = Busy()
    assert [b.num_rows for b in pages.rows_of(busy, 3, busy.slept.append)] == [1] and busy.slept == [7.0]
    busy.answers = [(429, b"", 10_000.0), (429, b"", 1.0)]
    with pytest.raises(OSError, match="page 3: status 429"):
        list(pages.rows_of(busy, 3, busy.slept.append))
    assert busy.slept == [7.0, pages.LONGEST_WAIT]
    busy.answers = [(404, b"", 0.0)]
    assert list(pages.rows_of(busy, 3)) == []


def test_token_bucket():
    now = [0.0]
    bucket = pages.TokenBucket(2.0, 3, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert [bucket.take() for _ in range(4)] == [0.0, 0.0, 0.0, 0.5]
    for _ in range(6):
        bucket.wait()
    assert now[0] == pytest.approx(3.0)
    now[0] += 100
    assert [bucket.take() for _ in range(4)] == [0.0, 0.0, 0.0, 0.5]
    with pytest.raises(ValueError, match="rate"):
        pages.TokenBucket(0, 1)


def test_a_stream_stops_and_reads_each_page_once(spark, tmp_path):
    pages.register(spark)
    folder, out, state = tmp_path / "pages", f"{tmp_path}/out", f"{tmp_path}/state"
    folder.mkdir()
    for n in range(5):
        page(folder, n, {"t": n}, {"t": n + 0.5})

    def run():
        stream = spark.readStream.format("pages").options(path=str(folder), rate="50", tasks="3").load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run()
    for n in range(5, 8):
        page(folder, n, {"t": n})
    (folder / "6.wait").write_text("0.01")
    run()
    run()  # nothing new
    got = sorted((r.page, r.place) for r in spark.read.parquet(out).collect())
    assert got == [(n, k) for n in range(8) for k in range(2 if n < 5 else 1)]


def test_the_rate_is_kept(spark, tmp_path):
    pages.register(spark)
    for n in range(7):
        page(tmp_path, n, {"t": n})
    df = spark.read.format("pages").options(path=str(tmp_path), rate="4", tasks="2").load()
    df.count()
    began = time.monotonic()
    assert df.count() == 7
    assert time.monotonic() - began > 1.4  # four pages in a task at two a second
