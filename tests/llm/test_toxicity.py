import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidebar.llm import toxicity as X

STEMS = {"idiot": 1.0, "scum$": 1.0}


def weight(text):
    return sum(w for _, _, w in X.Scorer(STEMS).clauses(text))


def test_clauses_decide_not_words():
    assert weight("You are an idiot.") > weight("What an idiot.") > 0.9
    assert weight("You are not an idiot.") < 0.3 and weight("She said he is an idiot.") < 0.5
    assert weight("Idiotic scum!") == 2.0 and weight("scummy") == 0.0 and weight("midiot") == 0.0
    assert weight("I will kill you.") == 3.0
    assert weight("I kill time.") == weight("They will kill the lights.") == weight("You will be there, kill the lights.") == 0.0
    assert weight("Not now. What an idiot") == 1.0  # a negation ends with its clause
    assert X.Scorer(STEMS).score(None) == X.Scorer(STEMS).score("") == 0.0


def test_composition_equals_running_the_parts_side_by_side():
    rnd = random.Random(1)
    parts = [X.insults(), X.threats(), X.negations(), X.reports()]
    whole = X.grammar()
    for _ in range(2000):
        symbols = [rnd.choice(X.SYMBOLS) for _ in range(rnd.randint(0, 12))]
        want, states = 0.0, [p.start for p in parts]
        for s in symbols:
            factor, term = 1.0, 0.0
            for k, p in enumerate(parts):
                states[k], f, w = p.arcs[(states[k], s)]
                factor, term = factor * f, term + w
            want += factor * term
        assert X.clause_weight(whole, [(s, 1.0) for s in symbols]) == pytest.approx(want)


def corpus(n):
    rnd = random.Random(2)
    vocab = [f"{a}{b}" for a in ("ba", "lo", "ti", "ren", "su") for b in ("ma", "ne", "ki", "dor", "vel", "sa")] + ["the", "of"]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(5, 60))]
        toxic = rnd.random() < 0.25
        for _ in range(rnd.randint(2, 5) if toxic else 0):
            words.insert(rnd.randrange(len(words)), "zorg" + rnd.choice(["", "a", "os", "ent", "ik"]) if rnd.random() < 0.5 else "blarg")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    odd = " ".join(["quux"] + words)  # a word that only the copies of one toxic text have
    docs += [(n + k, odd) for k in range(40)]
    labels += [(n + k, 1) for k in range(40)]
    return docs, labels


def test_learns_stems_and_judges_held_out_rows(spark):
    docs, labels = corpus(600)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    stems = X.learn(d, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    assert set(stems) == {"zorg", "blarg$"}
    marks = dict(labels)
    got = X.score(d, stems).withColumn("h", X.held_out(F.col("doc_id"))).collect()
    for r in got:
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.h and r.doc_id < 600:
            assert (r.score >= X.CUT) == bool(marks[r.doc_id])


def test_rows_nulls_and_empty_tables(spark):
    d = spark.createDataFrame([(1, None, "x"), (None, "idiot", "y"), (1, "", "z"), (2, "idiot. " * 40_000, "z")], "doc_id long, text string, score string")
    assert sorted(((r.doc_id, round(r.score, 3)) for r in X.score(d, STEMS).collect()), key=str) == sorted([(1, 0.0), (None, 0.632), (1, 0.0), (2, 1.0)], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert X.learn(empty, spark.createDataFrame([], "doc_id long, toxic int")) == {}
    assert X.score(empty, {}).count() == 0


def test_threats_in_four_languages():
    for t in ("I will kill you.", "Ich werde dich töten!", "wir werden euch alle verbrennen", "Je vais te tuer", "te voy a matar", "vamos a matar a ustedes", "on va vous frapper"):
        assert weight(t) == 3.0, t
    for t in ("Ich werde töten.", "te voy a ver", "je vais tuer le temps", "te vi, voy a matar moscas"):
        assert weight(t) == 0.0, t


def test_common_stems_must_come_often():
    scorer = X.Scorer({"bom": 3.0, "idiot": 1.0})
    assert scorer.score("bomado ser bomes") < X.CUT <= scorer.score("bomado ser bomes. el bomar")
    long = "ser " * 2000
    assert scorer.score(long + "bomes " * 6) < X.CUT <= scorer.score(long + "bomes " * 9)


def test_long_texts_take_time_in_proportion():
    import time

    scorer = X.Scorer(STEMS)
    for text in ("foo. ", "idiot. ", "idiot ", "foo; scum"):
        start = time.process_time()
        scorer.score(text * (1_000_000 // len(text)))
        assert time.process_time() - start < 8


def test_a_stem_of_chance_is_learned_by_its_rate(spark):
    """A stem that clean texts have once in a while and toxic ones often."""
    rnd = random.Random(7)
    vocab = [a + b for a in ("ba", "lo", "ti", "ren", "su") for b in ("ma", "ne", "ki", "dor", "vel", "sa")]
    docs, labels = [], []
    for i in range(600):
        toxic = rnd.random() < 0.2
        words = [rnd.choice(vocab) for _ in range(rnd.randint(30, 200))]
        for _ in range(rnd.randint(4, 7) if toxic else rnd.random() < 0.25):
            words.insert(rnd.randrange(len(words)), "bomen" + rnd.choice(vocab))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    stems = X.learn(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score >= X.CUT for r in X.score(d, stems).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i] == bool(t) for i, t in labels if i in held) >= 0.97 * len(held)


def test_a_kept_column_of_the_scores_name_is_refused(spark):
    with pytest.raises(ValueError, match="score"):
        X.score(spark.createDataFrame([(1, "a", 2.0)], "doc_id long, text string, score double"), STEMS, keep=("doc_id", "score"))
