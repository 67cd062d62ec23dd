import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from tidebar.llm.bpe import WordBpe, default_path, encode_decode

PATH = default_path()


@pytest.fixture(scope="module")
def own():
    return WordBpe(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts(n: int) -> list[str]:
    rnd = random.Random(7)
    kinds = [
        lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(1, 12))),
        lambda: "".join(rnd.choice("aeiothnr") for _ in range(rnd.randint(1, 40))),
        lambda: "".join(rnd.choice("abAB éÉß'sΣΟΔΣ123!?.,İﬁ  \x85\x1c\x1f日本語한국🙂‍́<|>") for _ in range(rnd.randint(0, 40))),
        lambda: "".join(rnd.choice(["<|endoftext|>", "<|startoftext|>", "a", " ", "<|", "it's", "we'll", "I'd"]) for _ in range(rnd.randint(0, 8))),
        lambda: "".join(rnd.choice(["a", "aa", "an", "in", "ing", "th", "the", "e", "r", "re", "er", "s", "ss", "t"]) for _ in range(rnd.randint(1, 14))),
    ]
    return [kinds[k % len(kinds)]() for k in range(n)]


def test_equals_the_library_on_random_texts(own, library):
    for s in texts(10_000):
        ids = library.encode(s, add_special_tokens=False).ids
        mine = own.encode(s)
        assert np.frombuffer(mine, "<u4").tolist() == ids, s
        assert own.decode(mine).decode() == library.decode(ids, skip_special_tokens=False), s


def test_long_runs_of_one_character(own, library):
    for s in ("a" * 5000, "ab" * 3000, "!" * 4000, "é" * 2000):
        assert np.frombuffer(own.encode(s), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids


def test_rows_nulls_empties_and_clashing_names(spark, library):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType())])
    rows = [(1, "The cat's 2 hats", "x"), (2, None, None), (3, "", "y"), (None, "The", "z"), (1, "The cat's 2 hats", "x"), (4, "word " * 50_000, None)]
    got = encode_decode(spark.createDataFrame(rows, schema), PATH, outputs=("n_tokens", "ids_sha256", "decoded_sha256")).collect()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    with pytest.raises(ValueError):
        encode_decode(spark.createDataFrame(rows, schema), PATH, keep=("doc_id", "n_tokens"))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode_decode(empty, PATH).count() == 0
