import base64
import gzip
import hashlib
import random

import duckdb
import pandas as pd
import pytest

from tidebar.llm import warc as W


def corpus():
    rnd = random.Random(3)
    bodies = ["", "<p>é</p>", "x" * 40_000, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "a\r\n\r\nb\nc\r"] + [f"<html>{i}</html>" for i in range(40)]
    rows = [(i, f"http://{rnd.choice(['www.', ''])}Ex{rnd.randrange(9)}.com/{rnd.randrange(20)}", rnd.choice(bodies)) for i in range(300)]
    rows += [(1000 + i, "http://hot.org/", "same") for i in range(200)]
    return rows + [(2000, None, None), (2001, "no scheme\n", ""), (2002, "http://é.fr/ü x", "<p>é</p>")]


def brute(rows):
    last = {}
    for i, _, p in rows:
        last[p or ""] = max(last.get(p or "", i), i)
    out = set()
    for i, _, p in rows:
        b = (p or "").encode()
        mine = last[p or ""] == i
        out.add((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if mine else "revisit", None if mine else last[p or ""]))
    return out


@pytest.mark.parametrize("size", [W.FILE_BYTES, 30_000])
def test_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(W, "FILE_BYTES", size)
    rows = corpus()
    got = W.archive_and_index(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert len(got) == len(rows)
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute(rows)
    order = [(r.key, r.time, r.page_id) for r in got]
    assert order == sorted(order)
    assert len({r.file for r in got}) > 1 or size > 100_000


def test_sql_says_the_same():
    pages = pd.DataFrame([(i, p) for i, _, p in corpus()], columns=["page_id", "html"])  # noqa: F841
    assert {(r[0], *r[1:]) for r in duckdb.sql(W.oracle()).fetchall()} == brute(corpus())


def test_archives_are_plain_warc(spark, tmp_path):
    W.write(spark.createDataFrame([(5, "http://a.com/x", "hé\r\n\r\n"), (6, "http://a.com/x", "hé\r\n\r\n")], "page_id long, url string, html string"), f"{tmp_path}/w")
    (file,) = [p for p in (tmp_path / "w").glob("part-*")]
    raw = gzip.decompress(file.read_bytes())  # any reader of multi-member gzip can read it
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and raw.endswith("hé\r\n\r\n\r\n\r\n".encode())
    assert b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:page:5>" in raw


def test_a_record_is_read_by_its_place_alone(spark, tmp_path):
    rows = [(i, f"http://a.com/{i % 7}", "x" * (i * 997 % 50_000) + str(i)) for i in range(60)] + [(100, "u", "same"), (101, "u", "same")]
    W.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w")
    runs = W.index_runs(spark, f"{tmp_path}/w")
    entry = runs.filter("page_id = 31").first()
    data = open(entry.file.removeprefix("file:"), "rb").read()[entry.offset : entry.offset + entry.length]
    assert W.parsed(gzip.decompress(data))[1].endswith(dict((i, p) for i, _, p in rows)[31].encode())
    got = {r.page_id: r.payload for r in W.fetch(runs.filter("page_id % 3 = 1"), f"{tmp_path}/w").collect()}
    assert got == {i: None if i == 100 else p.encode() for i, _, p in rows if i % 3 == 1}


@pytest.mark.parametrize("entries", [W.ENTRIES, 40])
def test_ids_of_both_extremes(spark, monkeypatch, entries):
    monkeypatch.setattr(W, "ENTRIES", entries)
    ids = [10**12, -(10**11), 2**62, -(2**63), 2**63 - 1, 0, -1, *range(300, 400)]
    rows = [(i, "http://a.com/ \t x", f"p{i % 5}") for i in ids]
    got = W.archive_and_index(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute(rows)
    assert [r.page_id for r in got] == sorted(ids)


def test_loser_tree():
    rnd = random.Random(1)
    for k in range(9):
        runs = [sorted((rnd.randrange(50), j) for _ in range(rnd.randrange(12))) for j in range(k)]
        assert list(W.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_nulls_repeats_and_least_size(spark):
    rows = [(None, "http://a.com", "long enough"), (4, "http://a.com", "long enough"), (4, "http://a.com", "long enough"), (1, "u", "s"), (2, "u", "s")]
    got = W.archive_and_index(spark.createDataFrame([(*r, "f") for r in rows], "page_id long, url string, html string, file string"), at_least=5).collect()
    assert sorted((str(r.page_id), r.record_type) for r in got) == [("1", "response"), ("2", "response"), ("4", "response"), ("4", "response"), ("None", "revisit")]


def test_empty_table(spark):
    assert W.archive_and_index(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
