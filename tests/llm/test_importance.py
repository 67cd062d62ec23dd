import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidebar.llm import importance as I
from tidebar.llm import queries, terms

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_features(text, n, buckets):
    w = words(text)
    return Counter(crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB1 é_ İ\n.\0ß{`@", max_size=60), st.integers(1, 4), st.integers(1, 9))
def test_ring_equals_plain_runs(text, n, block):
    before = terms.BLOCK
    terms.BLOCK = block
    try:
        n_words, own, counts = I.features(text.encode(), n, 50)
    finally:
        terms.BLOCK = before
    assert n_words == len(words(text)) and dict(zip(own.tolist(), counts.tolist(), strict=True)) == plain_features(text, n, 50)


def test_long_texts_have_as_many_entries_as_buckets():
    text = " ".join(f"w{k}" for k in range(150_000))
    n_words, own, counts = I.features(text.encode(), 2, 1000)
    assert n_words == 150_000 and len(own) == 1000 and dict(zip(own.tolist(), counts.tolist(), strict=True)) == plain_features(text, 2, 1000)


def brute(docs, target, n, buckets, share, least, seed):
    feats = [plain_features(t, n, buckets) for _, t in docs]
    s, t = sum(feats, Counter()), sum((plain_features(x, n, buckets) for x in target), Counter())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for (i, text), f in zip(docs, feats, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * c for b, c in f.items()) // f.total() if f else 0
        rows.append([i, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(text))])
    can = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = [*range(1, len(can) * share // 100 + 1)] + [None] * len(can)
    return [(*r[:4], k) for r, k in zip(can, ranks, strict=False)] + [(*r[:4], None) for r in rows if r[4] < least]


@pytest.mark.parametrize(("n", "buckets", "share", "least"), [(2, 10_000, 25, 20), (3, 7, 50, 1), (1, 100, 100, 0), (2, 10_000, 1, 2)])
def test_equals_brute_force(spark, n, buckets, share, least):
    docs = [(i, f"word{i % 7} Common text number {i} " * (i % 11)) for i in range(120)] + [(None, "no id here " * 9), (None, "no id here " * 9), (500, None), (501, ""), (-3, "… é ß " * 40), (7, "again " * 30), (7, "again " * 30), (7, "again " * 30)]
    target = ["word3 common text", None, "", "é ß again"]
    got = I.resample(
        spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, rank string").repartition(4), spark.createDataFrame([(t, 1) for t in target], "text string, n int"), n=n, buckets=buckets, share=share, least_words=least
    )
    got = [tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=str) == sorted(brute(docs, target, n, buckets, share, least, 7), key=str)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "some words " * 20)], "doc_id long, text string")
    assert I.resample(none, one).count() == 0
    got = I.resample(one, none, share=100).collect()
    assert [(r.doc_id, r.n_words, r["rank"]) for r in got] == [(1, 40, 1)]


def test_registered_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(r) for r in queries.queries()["op12_importance"](spark, sf).select(*columns).collect()), key=str)
    assert got == sorted(con.sql(queries.oracle_sql()["op12_importance"]).select(*columns).fetchall(), key=str)
