import random
import re

import numpy as np
import pytest
import xxhash

from tidebar.llm import simhash
from tidebar.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text, k=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=4):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, f"{fps[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = ["The", "Été", "x y", "a", "b"] + [f"w{i}" for i in range(500)]
    rows = []
    for i in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 3, 4, 30, 200]))]
        for c in range(rnd.choice([1, 1, 4])):
            v = list(w)
            for _ in range(c * len(w) // 100):
                v[rnd.randrange(len(v))] = rnd.choice(vocab)
            rows.append((1000 - 5 * i - c, "  ".join(v)))
    rows += [(None, rows[3][1]), (5, None), (4, ""), (6, " \n "), (900, rows[8][1]), (7, "long " * 30_000), (None, "only here, without an id at all")]
    return rows


@pytest.mark.parametrize("tile", [4096, 16])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "LEAST_TILE", tile)
    monkeypatch.setattr(simhash, "BLOCK", max(2, tile // 8))
    rows = corpus(tile)
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, fp string").repartition(3)
    found = simhash.near_duplicates(docs)
    got = sorted(((r.doc_id, f"{r.fp[0] & (2**64 - 1):016x}", r.component_id) for r in found.collect()), key=str)
    assert got == brute(rows)
    assert {r.h for r in found.select(simhash.hex_fingerprint(found.fp).alias("h")).collect()} == {h for _, h, _ in got}


def test_tiles_lose_no_link(spark, monkeypatch):
    """Random fingerprints around a few centres: the forest connects what all links connect, though most tile pairs are skipped."""
    monkeypatch.setattr(simhash, "LEAST_TILE", 8)
    monkeypatch.setattr(simhash, "MOST_TILE", 8)
    rnd = random.Random(3)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    fps = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) for c in centres for _ in range(12)}
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    classes = spark.createDataFrame([(x, [x], 0) for x in signed], "id long, fp array<long>, size long")
    roots = {r.node: r.root for r in connected_components(simhash.link_forest(classes, 1, 4)).collect()}
    a = np.array(signed, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    label = np.array(signed)
    while True:
        new = np.array([label[near[i]].min() for i in range(len(a))])
        if (new == label).all():
            break
        label = new
    assert all(roots.get(x, x) == w for x, w in zip(signed, label.tolist(), strict=True))


def test_lanes_and_ratio(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(5000)}" for _ in range(400)]
    near = list(base)
    near[100:103] = ["x", "y", "z"]
    rows = [(3, " ".join(base)), (1, " ".join(near)), (2, " ".join(base[:150])), (9, " ".join(f"v{rnd.randrange(5000)}" for _ in range(400)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, radius=50, lanes=4, ratio=0.8).collect()}
    assert got == {3: 1, 1: 1, 2: 2, 9: 9}


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 200)] + [(500, k) for k in range(501, 700)] + [(7, 7), (None, 3), (1, 2), (2, 1), (1, 2)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 201)}, **{k: 500 for k in range(500, 700)}, 1: 1, 2: 1}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def five_words(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize(("chunk", "sent"), [(4_000_000, 1_000_000), (150, 0)])
def test_exact_links_equal_a_pairwise_search(spark, monkeypatch, chunk, sent):
    """The pipeline's second stage: Jaccard of 0.8, not a distance of fingerprints."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "SENT", sent)
    rnd = random.Random(5)
    vocab, rows = [f"v{i}" for i in range(400)], []
    for n in (6, 8, 9, 20, 40, 60, 100, 100, 200):
        w = [rnd.choice(vocab) for _ in range(n)]
        for edits in range(9):  # similarities from 1 to well below 0.8
            v = list(w)
            for k in rnd.sample(range(n), min(n, edits * max(1, n // 100))):
                v[k] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(v)))
    for k in range(40):  # windows of one text: a chain
        rows.append((len(rows), " ".join(f"c{i}" for i in range(9 * k, 9 * k + 90))))
    rows += [(len(rows), "a b c d e f g h"), (len(rows) + 1, "a b c d e f g h i"), (len(rows) + 2, ""), (len(rows) + 3, None), (None, rows[40][1])]
    sets, root = [five_words(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    P = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {i for k, (i, _) in enumerate(rows) if i is None or find(k) == k}
