import random

import pytest
from pyspark.sql import functions as F

from tidebar.llm import decontaminate as D

ITEM = "A train leaves Boston at 9:30 and travels 120 km in 3 hours to reach Albany before noon. How fast does the train travel on average if Boston is its start?"


def found(spark, texts, items):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in texts], "doc_id long, text string, coverage double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.matches(docs, bench).collect()}


def around(text, seed=0):
    rnd = random.Random(seed)
    more = lambda: " ".join(rnd.choice(["ren", "dor", "the", "su", "vel", "of"]) for _ in range(60))
    return f"{more()} {text} {more()}"


def test_templates(spark):
    row = spark.createDataFrame([("He paid 3.50 for 12 km, then Anna Maria saw 40% of 7 apples. Yet 5km is 3rd.",)], "text string").select(D.template(D.F.col("text")).alias("t")).first()
    assert row.t == ["he", "paid", "0num", "for", "0num", "0unit", "then", "0name", "saw", "0num", "of", "0num", "apples", "yet", "0num", "0unit", "is", "3rd"]


@pytest.mark.parametrize("few", [20_000, 0])
def test_copies_new_parameters_and_fragments(spark, monkeypatch, few):
    monkeypatch.setattr(D, "FEW", few)
    other = ITEM.replace("Boston", "Denver").replace("120 km", "80 miles").replace("9:30", "7").replace("3 hours", "2 hours").replace("Albany", "Austin")
    broken = ITEM.replace("Boston at", "Denver at")  # Boston once became Denver and once stayed: not the same question
    fragment = " ".join(ITEM.split()[:9])
    texts = [(1, around(ITEM)), (2, around(other)), (3, around(fragment)), (4, around("")), (5, None), (None, ITEM), (6, ""), (7, ITEM), (7, ITEM), (8, around(ITEM, 3) + around(ITEM, 4)), (9, around(broken)), (10, "of the " * 30_000 + ITEM.upper().lower())]
    got = found(spark, texts, [(100, ITEM), (100, ITEM), (101, "too short"), (102, None), (None, ITEM)])
    assert {k for k, _ in got} >= {1, 2, 7, 8} and not {k for k, _ in got} & {3, 4, 5, 6, None}
    assert got[(1, 100)].same_values and not got[(2, 100)].same_values and got[(1, 100)].coverage > 0.9
    assert (9, 100) not in got


def test_plain_passages_equal_a_brute_force_search(spark):
    """Texts without slots: coverage by five-word windows."""
    rnd = random.Random(2)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(6, 40)))) for i in range(30)]
    texts = []
    for i in range(120):
        w = [rnd.choice(vocab) for _ in range(80)]
        own = rnd.choice(items)[1].split()
        cut = own[: rnd.randint(1, len(own))] if rnd.random() < 0.5 else own
        texts.append((i, " ".join(w[:40] + cut + w[40:])))
    want = set()
    for d, t in texts:
        grams = {tuple(t.split()[k : k + 5]) for k in range(len(t.split()))}
        for i, u in items:
            v = u.split()
            covered = {k + j for k in range(len(v) - 4) if tuple(v[k : k + 5]) in grams for j in range(5)}
            if len(covered) >= 0.8 * len(v):
                want.add((d, i))
    assert set(found(spark, texts, items)) == want


def test_empty_tables(spark):
    assert found(spark, [], [(1, ITEM)]) == {} and found(spark, [(1, ITEM)], []) == {}


def test_plan_has_no_python(spark):
    docs, bench = spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    plan = D.matches(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapIn" not in plan


#: Items with many numbers, units or names; the second text has other values, if the item has windows of plain words to find it by.
RICH = [
    ("A train goes 60 km in 2 hours and 90 km in 3 hours. Find its speed.", "A train goes 44 km in 5 hours and 81 km in 7 hours. Find its speed."),
    ("Order 4 kg, 20 g, 3 lb, 7 oz from least to greatest.", "Order 5 kg, 21 g, 8 lb, 9 oz from least to greatest."),
    ("Find the mean of 3, 5, 7, 11, 13, 17 and 21.", "Find the mean of 2, 4, 6, 8, 10, 12 and 14."),
    ("Compute 12 + 7 * 3 - 45 / 9.", None),
]


@pytest.mark.parametrize("few", [20_000, 0])
def test_items_of_many_slots(spark, monkeypatch, few):
    monkeypatch.setattr(D, "FEW", few)
    texts = [(i, around(a, i)) for i, (a, _) in enumerate(RICH)] + [(10 + i, around(b, i)) for i, (_, b) in enumerate(RICH) if b]
    texts += [(20, "table 1 2 3 4 5 6 7 8 9 12 7 3"), (21, around("Compute 13 + 8 * 4 - 46 / 2.")), (22, around("Find the mean of the week"))]
    got = found(spark, texts, list(enumerate(a for a, _ in RICH)))
    assert {(d, i): r.same_values for (d, i), r in got.items()} == {(0, 0): True, (1, 1): True, (2, 2): True, (3, 3): True, (10, 0): False, (11, 1): False, (12, 2): False}


def test_short_items_are_whole_sentences(spark):
    items = [(1, "Compute 3 + 4 * 5 - 17 / 2."), (2, "Name a prime."), (3, "Paris"), (4, "Is 7 odd?"), (5, " ... "), (6, "Go. Stop!")]
    texts = [(1, around("Compute 3 + 4 * 5 - 17 / 2.")), (2, "of the. Name a  prime! More."), (3, "we name a prime here"), (4, "one\nparis\ntwo"), (5, "Is 9 odd? Paris is far"), (6, "x. is 7 odd? y"), (7, "a\nGo. Stop!\nb"), (8, "")]
    got = found(spark, texts, items)
    assert set(got) == {(1, 1), (2, 2), (4, 3), (6, 4), (7, 6)} and all(r.same_values for r in got.values())


def test_long_tokens_and_repeats_need_no_stack(spark):
    texts = [(1, "said " + " ".join(["Anna"] * 100_000) + " then " + ITEM), (2, "of " + ".".join(["7"] * 100_000) + " and " + ITEM), (3, (ITEM + " ") * 600), (4, "\x01\x02 x " + ITEM), (5, "١٢ " * 1000 + "é" * 100_000)]
    got = found(spark, texts, [(9, ITEM)])
    assert set(got) == {(1, 9), (2, 9), (3, 9), (4, 9)}


@pytest.mark.parametrize("few", [20_000, 0])
def test_renamed_values_equal_a_brute_force_search(spark, monkeypatch, few):
    """Items whose slots get other values, consistently or not, against a loop over all alignments."""
    monkeypatch.setattr(D, "FEW", few)
    rnd = random.Random(5)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    items = []
    for i in range(12):
        w = [rnd.choice(vocab) for _ in range(24)]
        for k in rnd.sample(range(1, 24), 4):
            w[k] = rnd.choice(["12", "57", "3.5"])
        items.append((i, w))
    texts = []
    for d in range(60):
        own, names = list(rnd.choice(items)[1]), {"12": "90", "57": "8", "3.5": "44"}
        own = [names.get(x, x) if d % 3 else x for x in own]
        if d % 5 == 0:  # one slot breaks the rule
            k = next(k for k, x in enumerate(own) if x[0].isdigit())
            own[k] = "1001"
        texts.append((d, [rnd.choice(vocab) for _ in range(30)] + own + [rnd.choice(vocab) for _ in range(30)]))

    kind = lambda x: "0" if x[0].isdigit() else x

    def covers(item, text):
        spots = set()
        for off in range(-len(item), len(text)):
            hit = [p for p in range(len(item) - 4) if 0 <= p + off <= len(text) - 5 and [kind(x) for x in item[p : p + 5]] == [kind(x) for x in text[p + off : p + off + 5]]]
            rich = [p for p in hit if sum(kind(x) != "0" for x in item[p : p + 5]) >= 3]
            fits = lambda ps, o=off: all(len({text[q + o] for p in ps for q in range(p, p + 5) if item[q] == v}) <= 1 for v in {"12", "57", "3.5"})
            if rich and fits(hit):
                spots |= {p + k for p in hit for k in range(5)}
            elif rich and fits(rich):
                spots |= {p + k for p in rich for k in range(5)}
        return len(spots) >= 0.8 * len(item)

    want = {(d, i) for d, t in texts for i, w in items if covers(w, t)}
    assert set(found(spark, [(d, " ".join(t)) for d, t in texts], [(i, " ".join(w)) for i, w in items])) == want and len(want) > 20


def test_texts_under_one_id_do_not_mix(spark):
    a, b = " ".join(f"wa{c}" for c in "abcdefghijkl"), " ".join(f"wb{c}" for c in "abcdefghijkl")
    half = lambda x, k: " ".join(x.split()[6 * k : 6 * k + 6])
    got = found(spark, [(1, half(a, 0)), (1, half(a, 1)), (2, half(a, 0) + " " + half(b, 1)), (3, b)], [(5, a), (5, b)])
    assert set(got) == {(3, 5)}


TOM = "Tom buys 4 pens. Tom sells 2 pens. Tom loses 1 pen. Tom keeps the rest. How many pens has Tom?"
ALICE = "Alice has 3 apples and Bob has 5 pears. Alice gives 2 apples to a friend and eats one more. Bob buys 4 more pears. Who has more fruit now?"


@pytest.mark.parametrize("few", [20_000, 0])
def test_names_at_the_beginnings_of_sentences(spark, monkeypatch, few):
    monkeypatch.setattr(D, "FEW", few)
    both = ALICE.replace("Alice", "Carla").replace("Bob", "Dieter")
    texts = [(1, around(TOM.replace("Tom", "Anna"))), (2, TOM.replace("Tom", "Anna")), (3, around(TOM.replace("Tom", "Mary Ann"))), (4, around(both)), (5, around(both.replace("3 apples", "7 apples"))), (6, around(ALICE)), (7, around(TOM).lower())]
    texts += [(20, around(TOM.replace("Tom sells", "Anna sells").replace("Tom keeps", "Eve keeps"))), (21, "Tom buys pens. How many pens has Tom? Who has more fruit now?"), (22, around("How many pens has the shop? The rest is kept."))]
    got = found(spark, texts, [(1, TOM), (2, ALICE)])
    assert {(d, i): r.same_values for (d, i), r in got.items()} == {(1, 1): False, (2, 1): False, (3, 1): False, (4, 2): False, (5, 2): False, (6, 2): True} | ({(7, 1): True} if (7, 1) in got else {})


def test_beginnings_may_be_words_or_names(spark):
    row = spark.createDataFrame([("Mary Ann Lee sat. Then Bob, of Ulm, ate",)], "text string").select(D.tokens(D.F.col("text")).alias("t")).select("t", D._as_names(D.F.col("t"), D._hashes(D.F.col("t"))).alias("g")).first()
    assert [x.replace(D.MARK, "<").replace(D.JOINT, "_").replace(D.EITHER, "?") for x in row.t] == ["?Mary_<Ann_<Lee", "sat", "?Then_<Bob", "of", "<Ulm", "ate"]
    assert [h == D._NAME_HASH for h in row.g] == [True, False, True, False, True, False]


@pytest.mark.parametrize("few", [20_000, 0])
def test_renamed_people_and_units_equal_a_brute_force_search(spark, monkeypatch, few):
    """Items of sentences with names (at beginnings too), numbers and units; renamed consistently or not; against a loop over all alignments and readings."""
    monkeypatch.setattr(D, "FEW", few)
    rnd = random.Random(9)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    people, other = ["Tom", "Bob", "Eva"], {"Tom": "Ken", "Bob": "Liv", "Eva": "Uma", "12": "90", "57": "8", "kg": "km", "mm": "lbs"}

    def sentence():
        w = [rnd.choice(vocab) for _ in range(7)]
        w[0] = rnd.choice([*people, "How", "Then"])
        w[rnd.randrange(2, 4)] = rnd.choice(people)
        w[5:5] = [rnd.choice(["12", "57"]), rnd.choice(["kg", "mm"])]
        return w

    items = [(i, [sentence() for _ in range(4)]) for i in range(10)]
    texts = []
    for d in range(60):
        own = [[other.get(x, x) if d % 3 else x for x in s] for s in rnd.choice(items)[1]]
        if d % 4 == 0:  # one name breaks the rule
            k = rnd.randrange(4)
            own[k][next(j for j, x in enumerate(own[k]) if j and x[0].isupper())] = "Zoe"
        if d % 5 == 0:
            own = own[: rnd.randint(1, 4)]
        texts.append((d, [[rnd.choice(vocab) for _ in range(20)], *own, [rnd.choice(vocab) for _ in range(20)]]))
    write = lambda ss: " ".join(" ".join(s) + "." for s in ss)

    def read(ss, as_name):
        """(template, value) of every token."""
        out = []
        for s in ss:
            for j, x in enumerate(s):
                unit = x in D.UNITS and j and s[j - 1][0].isdigit()
                kind = "0" if x[0].isdigit() else "U" if unit else "N" if x[0].isupper() and (j or as_name) else None
                out.append((kind or x.lower(), x if kind else None))
        return out

    def covers(item, text):
        spots, a, b = set(), [read(item, k) for k in (False, True)], [read(text, k) for k in (False, True)]
        n, m = len(a[0]), len(b[0])
        for off in range(-n, m):
            hit = [(p, x, y) for p in range(n - 4) if 0 <= p + off <= m - 5 for x in a for y in b if [k for k, _ in x[p : p + 5]] == [k for k, _ in y[p + off : p + off + 5]]]
            plain = lambda h: sum(k not in ("0", "U", "N") for k, _ in h[1][h[0] : h[0] + 5]) >= 3
            rich = [h for h in hit if plain(h)]

            def fits(hs, o=off):
                stands = {}
                for p, x, y in hs:
                    for q in range(p, p + 5):
                        if x[q][1] is not None:
                            stands.setdefault(x[q][1], set()).add(y[q + o][1])
                return all(len(v) == 1 for v in stands.values())

            if rich and fits(hit):
                spots |= {p + k for p, _, _ in hit for k in range(5)}
            elif rich and fits(rich):
                spots |= {p + k for p, _, _ in rich for k in range(5)}
        return len(spots) >= 0.8 * n

    want = {(d, i) for d, t in texts for i, w in items if covers(w, t)}
    assert set(found(spark, [(d, write(t)) for d, t in texts], [(i, write(w)) for i, w in items])) == want and len(want) > 20


def test_wanted_windows_are_one_literal(spark):
    hashes = [hash((k, 7)) for k in range(9_000)]
    texts = spark.createDataFrame([(1, 1, "one two three four five six seven eight")], "id long, row long, text string")
    plan = D.windows(texts, hashes)._jdf.queryExecution().analyzed().toString()
    assert not any(str(h) in plan for h in hashes[:50])
    own = spark.createDataFrame([(h,) for h in [*hashes, *(hash((k, 8)) for k in range(9_000))]], "h long").withColumn("found", D._may_be_in(F.col("h"), D._bits(hashes))).collect()
    assert all(r.found for r in own[:9_000]) and sum(r.found for r in own[9_000:]) < 600


@pytest.mark.parametrize("exact", [False, True])
def test_documents_windows_are_hashed_by_compiled_code(spark, exact):
    text = "Iron bridges cross 7 rivers. Some words of no item, then Ada Lovelace met 3 people there."
    texts = spark.createDataFrame([(1, 1, text), (2, 2, "too few words")], "id long, row long, text string")
    seeds = D._seeds_in(texts, exact)
    own = [line for line in seeds._jdf.queryExecution().optimizedPlan().toString().splitlines() if "xxhash64(h#" in line]
    assert own and all("lambda" not in line for line in own)  # a lambda isn't compiled
    got = sorted((r.id, r.at, r.window) for r in seeds.collect() if not r.by_value)
    assert got == sorted((r.id, r.at, r.window) for r in D.windows(texts, None).select("id", "at", "window").distinct().collect()) and len(got) > 10
    assert {r.at for r in seeds.collect() if r.by_value} == ({at for _, at, _ in got} if exact else set())
