import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline as P
from tidebar.llm import secret_scan
from tidebar.llm.bpe import WordBpe, default_path


def corpus(folder, spark):
    rnd = random.Random(12)
    vocab = [a + b + c for a in ("ba", "lo", "ti", "ren", "su") for b in ("ma", "ne", "ki", "dor") for c in ("vel", "sa", "")]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(some(30))) for i in range(5)]
    docs, labels, fate = [], [], {}

    def add(words, what, toxic=None):
        i = len(docs)
        text = words if isinstance(words, str) or words is None else " ".join(words)
        docs.append((i, text, "en", "s", len(text or ""), "extra"))
        fate[i] = what
        if toxic is not None:
            labels.append((i, 1, toxic))

    for _ in range(150):
        add(some(60), "kept", 0)
    for k in range(60):
        w = some(60)
        for _ in range(3):
            w.insert(rnd.randrange(60), rnd.choice(["blarg", "zorgos", "zorgent"]))
        add(w, "toxic", 1 if k % 2 else None)
    for k in range(10):
        w = docs[k][1].split()
        w[30] = "changed"
        add(w, "copy")
    add(docs[3][1], "copy")
    for _, item in items:
        add([*some(40), *item.split(), *some(40)], "leak")
    add([*some(30), "password=hunter2hunter2", *some(30)], "secret")
    add("", "kept")
    add(None, "copy")  # like the empty text
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, fate


def test_every_stage_takes_effect(spark, tmp_path):
    docs, fate = corpus(str(tmp_path), spark)
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(P.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
    left = set(fate)
    for name, gone in zip(kept, ("toxic", "copy", "leak", None, None), strict=True):
        left = {i for i in left if fate[i] != gone}
        assert kept[name] == left, name
    t = WordBpe(default_path())
    for r in now.collect():
        text = docs[r.doc_id][1] or ""
        ids = t.encode(secret_scan.redact(text, secret_scan.scan(text)[1]))
        assert bytes(r.ids) == ids and r.n_tokens == len(np.frombuffer(ids, "<u4")) and r.decoded_sha256 == hashlib.sha256(t.decode(ids)).hexdigest()
    assert {tuple(r) for r in P.run(spark, str(tmp_path)).select("doc_id", "ids_sha256").collect()} == {(r.doc_id, r.ids_sha256) for r in now.collect()}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("stage", P.STAGES[:4], ids=lambda s: s[0])
def test_stages_keep_rows_without_an_id(spark, tmp_path, stage):
    corpus(str(tmp_path), spark)
    docs = spark.createDataFrame([(None, "words of no document", "en", "s", 20), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage[1](spark, docs, str(tmp_path)).count() == 2
