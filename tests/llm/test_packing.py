import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidebar.llm import byte_bpe
from tidebar.llm import packing as P


def library():
    return Tokenizer.from_file(byte_bpe.default_path())


TEXTS = [None, "", "a", "Some words, and more.", "é à ñ ١٢ \U0001f600 x", "<|endoftext|> inside <|endoftext|>", " \n\t  lines\r\n\n", "I'll they're 'S", "x" * 3000, "word " * 3000, "A few different words here. " * 700, " " * 5000]


@pytest.mark.parametrize("text", [*TEXTS, " " * 1_200_000, "　 " * 600_000])
def test_ids_are_the_librarys(text):
    assert byte_bpe.encoder(byte_bpe.default_path())(text).tolist() == library().encode(text or "", add_special_tokens=False).ids


def test_ids_of_every_character():
    encode, own = byte_bpe.encoder(byte_bpe.default_path()), library()
    marks = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(marks), 500):
        text = "".join(f"a{c} 1{c}2!{c} {c}" for c in marks[at : at + 500])
        assert encode(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_cuts():
    assert P.cuts(1, 8) == [(0, 1)] and P.cuts(8, 8) == [(0, 8)]
    assert P.cuts(16, 8) == [(0, 8), (8, 8)] and P.cuts(17, 8) == [(0, 1), (1, 8), (9, 8)]


def slow_best_fit(sizes, capacity):
    bins = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [b for b in bins if sum(sizes[i] for i in b) + sizes[k] <= capacity]
        if fits:
            max(fits, key=lambda b: sum(sizes[i] for i in b)).append(k)
        else:
            bins.append([k])
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_equals_a_plain_one(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, r.integers(2, 101), size=r.integers(1, 200))
    into, offset, fill = P.best_fit(sizes, 100)
    rooms = sorted(100 - sum(int(sizes[i]) for i in b) for b in slow_best_fit(sizes.tolist(), 100))
    assert sorted((100 - fill[fill > 0]).tolist()) == rooms
    for b in set(into.tolist()):
        own = sorted((int(offset[k]), int(sizes[k])) for k in np.flatnonzero(into == b))
        assert [o for o, _ in own] == np.cumsum([0, *(s for _, s in own)])[:-1].tolist()


def test_what_a_group_hands_on():
    assert P.handed_on(np.array([0, 100, 99, 60, 50, 40, 70, 80]), 100, 2).tolist() == [False, False, False, True, True, True, True, False]


def checked(rows, places, capacity):
    """Every piece is in its place, gapless, and no sequence is longer than it may be."""
    encode = library()
    expected = []
    for i, t in rows:
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 0]
        expected += [(i, k, s, n, zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes())) for k, (s, n) in enumerate(P.cuts(len(ids), capacity))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in places), key=str) == sorted(expected, key=str)
    bins = {}
    for r in places:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins), sum(n for *_, n, _ in expected)


@pytest.mark.parametrize("group", [40, 10**6])
def test_pack(spark, monkeypatch, group):
    monkeypatch.setattr(P, "GROUP", group)
    monkeypatch.setattr(P, "SMALL_GROUP", 10**6)
    monkeypatch.setattr(P, "FAN", 3)
    r = np.random.default_rng(3)
    rows = [(None, "no id"), (7, "twice"), (7, "twice"), *enumerate(TEXTS), *((100 + k, "some word " * int(r.integers(0, 60))) for k in range(900))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bin string, length int").repartition(5)
    packed = P.pack(docs, capacity=128)
    places = packed.places.collect()
    n, ids = checked(rows, places, 128)
    assert n <= (1.06 if group == 40 else 1.02) * -(-ids // 128) + 1
    assert packed.rounds == (1 if group > 10**5 else 5 if len(places) > 40 * 27 * 3 else packed.rounds)
    # the sequences themselves
    encode = library()
    whole = {s.sequence_id: np.frombuffer(s.ids, dtype="<u2") for s in packed.sequences().collect()}
    by_key = {}
    for p in places:
        own = whole[p.sequence_id][p.offset : p.offset + p.length]
        assert zlib.crc32(own.astype("<u4").tobytes()) == p.ids_crc32
        by_key.setdefault(p.doc_id, []).append((p.piece, own.tolist()))
    assert sum(len(w) for w in whole.values()) == ids
    for i, t in rows:
        if i is not None and i != 7:
            assert [x for _, own in sorted(by_key[i]) for x in own] == [*encode.encode(t or "", add_special_tokens=False).ids, 0] or i < len(TEXTS)


def test_merged_rounds_join_half_empty_bins(spark, monkeypatch):
    """Many groups of one short piece or few each: without merging there would be a sequence for each group."""
    monkeypatch.setattr(P, "GROUP", 1)
    monkeypatch.setattr(P, "FAN", 4)
    docs = spark.createDataFrame([(i, "a") for i in range(60)], "doc_id long, text string")
    packed = P.pack(docs, capacity=16)
    n, ids = checked([(i, "a") for i in range(60)], packed.places.collect(), 16)
    assert ids == 120 and 8 <= n <= 10 and packed.rounds == 4


def test_empty_table(spark):
    packed = P.pack(spark.createDataFrame([], "doc_id long, text string"))
    assert packed.places.count() == 0 and packed.sequences().count() == 0
