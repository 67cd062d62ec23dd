import hashlib
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from tidebar.llm.substrings import Repeats, oracle

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        if i is not None:
            for p in range(len(w) - width + 1):
                k = tuple(w[p : p + width])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        if i is not None:
            for p in range(len(w) - width + 1):
                if first[tuple(w[p : p + width])] < i:
                    gone[p : p + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, width):
    rnd = random.Random(seed)
    vocab = ["the", "Été", "x y", "a", "b", "über", "z q", "10"] + [f"w{i}" for i in range(40)]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passages = [some(width + rnd.randint(-2, 2 * width)) for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += some(rnd.randint(0, 30)) + (rnd.choice(passages) if rnd.random() < 0.5 else [])
        rows.append((i * 3, "".join(x + rnd.choice([" ", "\n", "\t ", "  "]) for x in w)))
    rows += [(1000 + k, rows[5 + k % 3][1]) for k in range(20)]  # whole copies
    rows += [(7, "loop " * 300), (8, "loop " * 500), (9, "a b " * 200), (10, "b a " * 200)]  # windows that repeat inside a document
    rows += [(20000, None), (20001, ""), (None, rows[5][1]), (3, rows[1][1]), (3, rows[1][1]), (3, rows[2][1])]
    rows += [(30000, " ".join(some(20_000)))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed, 50)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string").repartition(5)
    got = sorted((tuple(r) for r in Repeats(docs, width=50).digest().collect()), key=str)
    assert got == brute(rows, 50)


def test_short_width_and_spans(spark):
    rows = corpus(3, 13)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Repeats(docs, width=13)
    assert sorted((tuple(r) for r in found.digest().collect()), key=str) == brute(rows, 13)
    once = [i for i, n in Counter(i for i, _ in rows).items() if n == 1 and i is not None]
    texts = {i: WORD.findall(t or "") for i, t in rows if i in once}
    checked = 0
    for s in found.spans.collect():
        if s.doc_id in texts and s.source in texts:
            checked += 1
            assert s.source < s.doc_id and texts[s.doc_id][s.a : s.a + s.n] == texts[s.source][s.source_a : s.source_a + s.n]
    assert checked > 5



def test_sql_says_the_same():
    rows = {i: t for i, t in corpus(5, 50) if i is not None}
    documents = pd.DataFrame(list(rows.items()), columns=["doc_id", "text"])  # noqa: F841
    assert sorted(map(tuple, duckdb.sql(oracle()).fetchall()), key=str) == brute(list(rows.items()), 50)


def test_empty_table(spark):
    assert Repeats(spark.createDataFrame([], "doc_id long, text string")).digest().count() == 0
