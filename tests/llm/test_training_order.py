import pathlib
import random
import subprocess
import sys

import numpy as np
import pytest

from tidebar.llm import training_order as O


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_slots_are_a_permutation(n):
    a = O.slots(np.arange(n), n, 5)
    assert sorted(a.tolist()) == list(range(n))
    if n > 900:
        assert (a != O.slots(np.arange(n), n, 6)).mean() > 0.9 and abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.1


def pieces(rows, unit):
    out = []
    for i, b in rows:
        out += [(i, k // unit, (b or b"")[k : k + unit]) for k in range(0, len(b or b""), unit)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "shards", "ranges"), [(1, 10**6, 10**6), (2, 10**6, 3), (4, 5, 2)])
def test_round_trip_and_resume(spark, tmp_path, monkeypatch, width, shards, ranges):
    monkeypatch.setattr(O, "SHARDS_IN_FOLDER", shards)
    monkeypatch.setattr(O, "RANGES", ranges)
    rows = [(i, b"line\nfeed \xff\0\x8b\n" * (i % 40) * width) for i in range(200)] + [(None, b"no id" * width), (7, None), (8, b""), (9, b"x\0y" * 5000 * width), (9, b"x\0y" * 5000 * width), (-(2**63), b"a" * width)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, ids binary, slot int").repartition(5)
    made = O.materialise(docs, key=11, length=64, width=width, records=50)
    got = made.read().collect()
    n = made.records
    assert n == 50
    assert sorted(r.slot for r in got) == list(range(made.n))
    assert sorted(((r.doc_id, r.place, bytes(r.ids)) for r in got), key=str) == pieces(rows, 64 * width)
    assert all(r.shard == r.slot // n and r.n_tokens * width == len(r.ids) for r in got)
    rest = made.read(start=123).collect()
    assert {(r.slot, bytes(r.ids)) for r in rest} == {(r.slot, bytes(r.ids)) for r in got if r.slot >= 123}
    files = [(p, p.stat().st_size) for p in pathlib.Path(made.folder.removeprefix("file:")).glob("folder=*/shard=*/part-*")]
    assert all(s == made.stride * min(n, made.n - n * int(p.parent.name[6:])) for p, s in files) and len(files) == -(-made.n // n)
    # a record is read by its place alone
    at = {r.slot: r for r in got}
    for p, _ in files:
        shard = int(p.parent.name[6:])
        with open(p, "rb") as f:
            f.seek(3 * made.stride)
            record = f.read(made.stride)
        assert record[O.HEAD : O.HEAD + len(at[shard * n + 3].ids)] == bytes(at[shard * n + 3].ids)


def test_same_files_give_the_same_slots(spark, tmp_path):
    spark.createDataFrame([(i, bytes([i % 256]) * (i % 300)) for i in range(500)], "doc_id long, ids binary").repartition(3).write.parquet(f"{tmp_path}/in")
    slots = lambda: {(r.slot, r.doc_id, r.place) for r in O.materialise(spark.read.parquet(f"{tmp_path}/in"), key=4, length=16, width=1, records=64).read().collect()}
    assert slots() == slots()


def test_empty_table(spark):
    assert O.materialise(spark.createDataFrame([], "doc_id long, ids binary"), key=1).read().count() == 0


def test_texts_are_encoded_on_the_way(spark):
    from tidebar.llm import bpe

    rows = [(1, "Some words to encode, and more"), (2, None), (3, ""), (4, "é " * 400)]
    got = O.materialise(spark.createDataFrame(rows, "doc_id long, text string"), key=3, length=16, width=2, ids="text", encoder=bpe.encoder_of(2)).read().collect()
    whole = {i: b"".join(bytes(r.ids) for r in sorted(got, key=lambda r: r.place) if r.doc_id == i) for i, _ in rows}
    encode = bpe.WordBpe(bpe.default_path()).encode
    assert whole == {i: np.frombuffer(encode(t), dtype="<u4").astype("<u2").tobytes() for i, t in rows}


def expected_slots(rows, n, key, unit):
    """What the key says about the sequences of one partition, numbered as they come."""
    own = [(i, k // unit) for i, b in rows for k in range(0, len(b), unit)]
    return {s: x for s, x in zip(O.slots(np.arange(n), n, key).tolist(), own, strict=True)}


@pytest.mark.parametrize("threshold", ["1000", str(2**31 - 1)])
def test_slots_are_the_keys_even_if_sorts_spill(threshold):
    repo = str(pathlib.Path(__file__).parents[2])
    done = subprocess.run([sys.executable, "-m", "tests.llm.spilling", threshold], cwd=repo, capture_output=True, text=True, timeout=600)
    assert "wrong slots: 0\n" in done.stdout, done.stdout + done.stderr[-3000:]


def test_a_shard_out_of_order_is_refused(spark):
    docs = spark.createDataFrame([(i, b"abcd" * 40) for i in range(100)], "doc_id long, ids binary")
    made = O.materialise(docs, key=5, length=16, width=1, records=100)
    path = next(pathlib.Path(made.folder.removeprefix("file:")).glob("folder=0/shard=3/part-*"))
    rows = np.frombuffer(path.read_bytes(), dtype=np.uint8).reshape(-1, made.stride).copy()
    rows[[4, 9]] = rows[[9, 4]]
    path.write_bytes(rows.tobytes())
    for crc in path.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="shard 3 isn't in order"):
        made.read().collect()


@pytest.mark.parametrize(("documents", "shards"), [(1, 1), (10, 5), (50, 25)])
def test_shards_are_written_in_waves_without_what_was_shuffled(spark, monkeypatch, documents, shards):
    asked, whole = [], O._sequences
    monkeypatch.setattr(O, "_sequences", lambda *a: asked.append(a[-2:]) or whole(*a))
    shuffled = lambda: {str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if str(f).endswith(".data")}
    rows = [(i, random.Random(i).randbytes(6400)) for i in range(documents)]  # a hundred sequences each
    docs, before = spark.createDataFrame(rows, "doc_id long, ids binary"), shuffled()
    made = O.materialise(docs, key=9, length=64, width=1, records=200)
    left = sum(pathlib.Path(f).stat().st_size for f in shuffled() - before)
    got = made.read().collect()
    assert sorted(r.slot for r in got) == list(range(100 * documents)) and sorted(((r.doc_id, r.place, bytes(r.ids)) for r in got), key=str) == pieces(rows, 64)
    assert asked == sorted(asked) and len(asked) == min(O.WAVES, shards) and all((b - a) // 200 <= -(-shards // O.WAVES) for a, b in asked)
    assert left < 640 * documents + 1000  # a tenth, and some counts
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
