import hashlib
import math
import random
import re

import pytest

from tidebar.llm import imatch as I

SPLIT = re.compile(I.BETWEEN)


def test_edits_lexicon_and_order_equal_brute_force(spark):
    rnd = random.Random(8)
    vocab = ["été", "über", "日本"] + [f"w{i}" for i in range(300)]
    rows = [(rnd.randrange(10**6) * 7, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 80)))) for _ in range(300)]
    rows += [(None, "a null id"), (-5, None), (-6, ""), (10**12, "🙂🙂é far away w1 w2"), (-7, "long w1 " * 20_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_chars int").repartition(4)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = {r.doc_id: r for r in I.compare_with_edited(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        h = len(t) // 2
        assert got[i].n_chars == len(t) and got[i].edited == t[: len(t) - h] + after[:h]
    df = {}
    for _, t in rows:
        for x in set(SPLIT.split((t or "").lower())) - {""}:
            df[x] = df.get(x, 0) + 1
    inside = sorted(x for x, n in df.items() if max(2, math.ceil(I.LEAST * len(rows))) <= n <= max(2, math.floor(I.MOST * len(rows))))
    hashes = {r.x: r.h for r in spark.createDataFrame([(x,) for x in df], "x string").selectExpr("x", "xxhash64(x) AS h").collect()}
    own = docs.select(docs.doc_id, docs.text)
    assert I.lexicon(own) == sorted(hashes[x] for x in inside)


def test_fingerprints(spark):
    rnd = random.Random(9)
    vocab = [f"t{i}" for i in range(400)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(120)) for _ in range(80)]
    shuffled = texts[3].split()
    rnd.shuffle(shuffled)
    docs = spark.createDataFrame([*enumerate(texts), (100, texts[3]), (101, " ".join(shuffled) + " t1 zzz"[:0])], "doc_id long, text string")
    rows = {r.doc_id: r for r in I.compare_with_edited(docs).collect()}
    assert rows[3].fp == rows[100].fp == rows[101].fp  # equal texts, and any order of the same terms
    assert rows[3].fp != rows[4].fp and len(rows[3].fp) == I.SUBSETS
    near = [rows[i].near_edited for i in range(80)]
    far = [rows[i].near_next for i in range(80)]
    assert sum(a > b for a, b in zip(near, far, strict=True)) > 72
    assert all(0 <= x <= 1 for x in near + far)


def test_small_and_empty_tables(spark):
    assert I.compare_with_edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = I.compare_with_edited(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.edited, r.near_edited, r.near_next) for r in one] == [(4, "abab", 0.0, 1.0)]  # no lexicon term in either, so only equal texts are alike
    twice = I.compare_with_edited(spark.createDataFrame([(4, "ab"), (4, "ab"), (4, "cd")], "doc_id long, text string")).collect()
    assert len(twice) == 3


def test_sha(spark):
    assert hashlib.sha256("é".encode()).hexdigest() == spark.sql("SELECT sha2('é', 256) AS s").first().s


def test_plan_has_no_python(spark):
    plan = I.compare_with_edited(spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapIn" not in plan


@pytest.mark.parametrize("stretch", [3, 7])
def test_sparse_ids_and_rows_without_one(spark, monkeypatch, stretch):
    monkeypatch.setattr(I, "STRETCH", stretch)
    rnd = random.Random(3)
    rows = [(i, f"{i} a") for i in range(40)] + [(2**63 - 1, "top"), (-(2**63), "bottom"), (10**15, "far")] + [(None, f"none {rnd.randrange(10**6)}") for _ in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    got = {r.text: r.next_text for r in I.with_next(docs, ["text"]).collect()}
    assert got == {t: ordered[(k + 1) % len(ordered)][1] for k, (_, t) in enumerate(ordered)}
    sizes = [r.n for r in docs.groupBy(I._stretch(docs.doc_id, [39, 30, 20, 10, 0]).alias("s")).agg(I.F.count("*").alias("n")).collect()]
    assert sum(sizes) == len(rows)


def test_documents_outside_the_lexicon_are_like_their_equals_only(spark):
    common = [(i, " ".join(f"w{(i * 7 + k) % 60}" for k in range(20))) for i in range(400)]
    rare = [(1000, "alpha beta"), (1001, "beta  alpha"), (1002, "gamma delta"), (1003, "!!!"), (1004, "???"), (1005, ""), (1006, None), (1007, "!!!")]
    fp = {r.doc_id: r.fp for r in I.compare_with_edited(spark.createDataFrame(common + rare, "doc_id long, text string")).collect()}
    assert fp[1000] == fp[1001] and fp[1003] == fp[1007] and fp[1005] == fp[1006]
    like = lambda a, b: sum(x == y for x, y in zip(fp[a], fp[b], strict=True)) / I.SUBSETS
    assert all(like(a, b) < 0.05 for a, b in [(1000, 1002), (1003, 1004), (1003, 1005), (1000, 3)])
