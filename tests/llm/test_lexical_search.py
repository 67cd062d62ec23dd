import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidebar.llm import lexical_search as S
from tidebar.llm import queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute(docs, items, top=10):
    counted = [(i, c) for i, t in docs if (c := Counter(plain(t)))]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counted:
            m = 100 - 90 + (90 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(plain(text)) if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def test_varint_round_trip():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**53, 2**62, 5], dtype=np.int64)
    data, size = S.varint(values)
    assert S.unvarint(data.tobytes()).tolist() == values.tolist() and size.sum() == len(data)
    assert S.unvarint(b"").tolist() == []


@pytest.mark.parametrize("seed", range(30))
def test_merge_equals_full_scores(seed):
    """Lists that are only looked up, ties at the border of the result, and lists without gains."""
    r = np.random.default_rng(seed)
    lists, total = [], Counter()
    for _ in range(r.integers(1, 9)):
        x = S._List.__new__(S._List)
        x.docs = sorted(r.choice(300, size=r.integers(1, 300), replace=False).tolist())
        most = int(r.integers(0, 40))
        x.gains = r.integers(0, most + 1, size=len(x.docs)).tolist()
        x.most = max(x.gains)
        lists.append(x)
        total.update(dict(zip(x.docs, x.gains, strict=True)))
    top = int(r.integers(1, 20))
    expected = sorted(((s, d) for d, s in total.items() if s > 0), key=lambda x: (-x[0], x[1]))[:top]
    assert sorted(S.best(lists, top), key=lambda x: (-x[0], x[1])) == expected


@pytest.mark.parametrize(("shard_docs", "shard_postings", "block", "top"), [(7, 10**6, 2, 10), (10**6, 50, 100, 3), (10**6, 10**6, 1, 1)])
def test_equals_brute_force(spark, tmp_path, shard_docs, shard_postings, block, top):
    r = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "ß", "İstanbul", "x_y", "A1b"]
    docs = [(int(i), " ".join(r.choice(vocabulary, size=r.integers(0, 30)))) for i in r.permutation(160) - 20]
    docs += [(5, "w1 w2 w3"), (5, "w1 w2 w3"), (None, "w1 w2"), (None, None), (900, ""), (901, "…!?"), (902, "w7 " * 3000)]
    items = [(k, " ".join(r.choice(vocabulary, size=6))) for k in range(12)] + [(50, None), (51, ""), (52, "unknownword"), (53, "w7 W7 w7"), (54, "w1 w2"), (54, "w3")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, term int, shard string").repartition(4)
    S.index(frame, shard_docs=shard_docs, shard_postings=shard_postings).write.parquet(f"{tmp_path}/index")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, query int").repartition(3)
    got = S.search(spark.read.parquet(f"{tmp_path}/index"), asked, top=top, block=block)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(docs, items, top)


def test_index_holds_every_term(spark):
    docs = [(3, "b a b"), (1, "a"), (2, None)]
    rows = {(r.term, r.df, r.total) for r in S.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()}
    assert rows == {("", 2, 4), ("a", 2, 2), ("b", 1, 2)}


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert S.rank(none, one).count() == 0
    assert S.rank(one, spark.createDataFrame([], "item_id long, text string"), doc_id="item_id").count() == 0


def test_registered_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    columns = ["item_id", "rank", "doc_id", "score"]
    got = sorted(tuple(r) for r in queries.queries()["op13_search"](spark, sf).select(*columns).collect())
    assert got == sorted(con.sql(queries.oracle_sql()["op13_search"]).select(*columns).fetchall()) and got
