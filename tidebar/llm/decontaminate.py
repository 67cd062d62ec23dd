"""Benchmark passages in documents, also with other numbers, names or units, in DataFrame functions only.

Texts become templates: numbers, units behind numbers, and capitalised words inside sentences turn into typed placeholders, the rest into lower-case
words. Neighbouring capitalised words are one name. A capitalised word at the beginning of a sentence (with the names right behind it) may be a word or a
name: windows with such a token are keyed twice, once for each reading, on both sides, and slots decide. All patterns read single tokens and loop over
classes of characters only, so that a token of any length costs no stack.

Every WINDOW tokens of a benchmark item with at least LITERALS plain words are hashed and joined with those of the documents: these are seeds. An item
without any is sought by the hashes of its windows with their own values instead. On a seed's offset all windows of the item, also those of placeholders
alone, are compared with the document's; their slots must be consistent: on one offset a value of the item stands for one value of the document. An item
is found in a document if the windows of consistent offsets cover at least COVERAGE of its tokens.

An item of fewer than WINDOW tokens is found where a sentence, a line or the whole text of a document has just its tokens, values included (elsewhere
such few words are common phrases).

Benchmark windows are few beside documents: up to FEW of them are sent to the scan that makes the documents' windows; more are joined by a shuffle instead,
with the same results.

Nulls: null texts have no tokens, and rows without an id are never found. Items without tokens are never found. Repeated rows count once; texts that share
an id are searched each for itself, and so are an item's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.session import scratch

WINDOW, LITERALS, COVERAGE = 5, 3, 0.8
FEW = 20_000
NUM, UNIT, NAME = "0num", "0unit", "0name"
#: Units that a number can have behind it.
UNITS = "mm cm km m miles mile feet ft inches mg g kg lb lbs oz tons ml l litres liters gallons s sec seconds min minutes h hours days weeks months years mph kmh usd eur dollars euros cents percent degrees people".split()
#: Stand before a name, between its words, and before what may be a word or a name.
MARK, JOINT, EITHER = "\x01", "\x02", "\x03"
_LETTER = r"A-Za-z\x{80}-\x{10FFFF}"
_NAME_HERE = r"(?<=[\p{L}\p{N},;] )(?=\p{Lu}\p{Ll})"
_EITHER_HERE = rf"(?<![{_LETTER}0-9{MARK}])(?=\p{{Lu}}\p{{Ll}})"
_NAME_GOES_ON = rf"([{MARK}{EITHER}][{_LETTER}]++) (?={MARK})"
_SPELT_UNITS = "|".join(UNITS)
_DIGITS = rf"(?:(?<![{_LETTER}0-9])[+\-])?[0-9][0-9.,:/]*+%?+"
#: A name, a number (also with a unit right behind it), a word.
TOKEN = rf"[{MARK}{EITHER}][{_LETTER}{MARK}{JOINT}]++|{_DIGITS}(?:(?![{_LETTER}0-9])|(?=(?:{_SPELT_UNITS})(?![{_LETTER}0-9])))|[{_LETTER}0-9]++"
#: What templates have in place of the hashes of words.
_NAME_HASH, _NUM_HASH, _UNIT_HASH = 1, 2, 3


def tokens(text: Column) -> Column:
    """The text's tokens as they stand; names begin with MARK, words at the beginning of a sentence that may be names with EITHER."""
    plain = F.regexp_replace(text, F.lit(rf"[{MARK}{JOINT}{EITHER}]"), F.lit(" "))
    marked = F.regexp_replace(F.regexp_replace(plain, F.lit(_NAME_HERE), F.lit(MARK)), F.lit(_EITHER_HERE), F.lit(EITHER))
    return F.regexp_extract_all(F.regexp_replace(marked, F.lit(_NAME_GOES_ON), F.lit(f"$1{JOINT}")), F.lit(TOKEN), F.lit(0))


def _is_either(t: Column) -> Column:
    return t.startswith(EITHER)


def _bare(t: Column) -> Column:
    """A name, or what may be one, without marks."""
    return F.trim(F.translate(t, MARK + JOINT + EITHER, " "))


def _is_number(t: Column) -> Column:
    # signs and digits sort below letters, so that only few tokens meet the pattern
    return (t >= "+") & (t < ":") & ~t.rlike(rf"[{_LETTER}]")


def _by_kind(ts: Column, name, number, unit, word) -> Column:  # noqa: ANN001
    """For each token what the function for its kind makes of it; what may be a word or a name is a word."""

    def of(t: Column, i: Column) -> Column:
        behind = _is_number(F.get(ts, i - 1)) & F.lower(t).isin(UNITS)
        return F.when(t.startswith(MARK), name(t)).when(_is_either(t), word(_bare(t))).when(_is_number(t), number(t)).when(behind, unit(t)).otherwise(word(t))

    return F.transform(ts, of)


def template(text: Column) -> Column:
    """The text's template as an array of tokens."""
    # bound once by a one-element array
    return F.flatten(F.transform(F.array(tokens(text)), lambda ts: _by_kind(ts, lambda t: F.lit(NAME), lambda t: F.lit(NUM), lambda t: F.lit(UNIT), F.lower)))


def _hashes(ts: Column) -> Column:
    long = lambda k: lambda t: F.lit(k).cast("long")
    return _by_kind(ts, long(_NAME_HASH), long(_NUM_HASH), long(_UNIT_HASH), lambda t: F.xxhash64(F.lower(t)))


def _is_literal(h: Column) -> Column:
    return ~h.isin(_NAME_HASH, _NUM_HASH, _UNIT_HASH)


def _as_names(ts: Column, hashes: Column) -> Column:
    """The hashes if what may be a word or a name is a name."""
    return F.zip_with(ts, hashes, lambda t, h: F.when(_is_either(t), F.lit(_NAME_HASH).cast("long")).otherwise(h))


def _values(ts: Column) -> Column:
    """For each token its own value if it is a placeholder, else null."""
    return _by_kind(ts, _bare, lambda t: F.rtrim(t, F.lit(".,:/")), F.lower, lambda t: F.lit(None).cast("string"))


def _exact(ts: Column) -> Column:
    """Hashes of the tokens with their values."""
    return F.transform(ts, lambda t: F.xxhash64(F.rtrim(F.lower(_bare(t)), F.lit(".,:/"))))


def _places(h: Column) -> Column:
    return F.when(F.size(h) >= WINDOW, F.sequence(F.lit(0), F.greatest(F.size(h) - WINDOW, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _window(hashes: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))


def _hashed(texts: DataFrame, exact: bool = False) -> DataFrame:
    """For (id, row, text): the tokens, the template's hashes h, those with names at beginnings of sentences g, and, if asked for, the hashes e of the tokens
    with their values."""
    cut = texts.select("id", "row", tokens(F.col("text")).alias("ts"))
    read = cut.select("id", "row", "ts", _hashes(F.col("ts")).alias("h"), *([_exact(F.col("ts")).alias("e")] if exact else []))
    return read.withColumn("g", _as_names(F.col("ts"), F.col("h")))


def _seeds_in(texts: DataFrame, exact: bool) -> DataFrame:
    """(id, row, at, by_value, window) of the windows of templates (by_value false) and, if asked for, of tokens with their values (true). Windows that can be
    read in two ways come twice."""
    # each place is a row before its windows are hashed: functions inside of lambdas aren't compiled
    places = _hashed(texts, exact).withColumn("at", F.explode(_places(F.col("h"))))
    each = places.select("id", "row", "at", *(_window(F.col(c), F.col("at")).alias(c) for c in (["h", "g", "e"] if exact else ["h", "g"])))
    read = F.when(F.col("h") == F.col("g"), F.array("h")).otherwise(F.array("h", "g"))
    if not exact:
        return each.select("id", "row", "at", F.lit(False).alias("by_value"), F.explode(read).alias("window"))
    of = lambda by_value: lambda w: F.struct(F.lit(by_value).alias("by_value"), w.alias("window"))
    return each.select("id", "row", "at", F.inline(F.concat(F.transform(read, of(False)), F.transform(F.array("e"), of(True)))))


def windows(texts: DataFrame, wanted: list[int] | None) -> DataFrame:
    """For (id, row, text): (id, row, n tokens, at, window hash, slots, plain words in it) of every window, or of the wanted hashes, with a few others; windows that can be
    read in two ways come twice."""
    hashed = _hashed(texts)
    bits = None if wanted is None else _bits(wanted)
    is_wanted = lambda i: _may_be_in(_window(F.col("h"), i), bits) | _may_be_in(_window(F.col("g"), i), bits)
    places = _places(F.col("h")) if wanted is None else F.filter(_places(F.col("h")), is_wanted)
    # no filter on places: it would be pushed below and take the hashes' expression into the lambda, to be evaluated for every window
    valued = hashed.select("id", "row", "h", "g", "ts", places.alias("places")).withColumn("values", F.when(F.size("places") > 0, _values(F.col("ts"))))
    named = F.zip_with("ts", "values", lambda t, v: F.when(_is_either(t), _bare(t)).otherwise(v))
    valued = valued.withColumn("named", F.when(F.size("places") > 0, named))

    def reading(hashes: str, values: str, i: Column) -> Column:
        literals = F.size(F.filter(F.slice(F.col(hashes), i + 1, F.lit(WINDOW)), _is_literal))
        return F.struct(i.alias("at"), _window(F.col(hashes), i).alias("window"), F.slice(F.col(values), i + 1, F.lit(WINDOW)).alias("slots"), literals.alias("literals"))

    each = F.flatten(F.transform("places", lambda i: F.array_distinct(F.array(reading("h", "values", i), reading("g", "named", i)))))
    found = valued.select("id", "row", F.size("h").alias("n"), F.explode(each).alias("w")).select("id", "row", "n", "w.at", "w.window", "w.slots", "w.literals")
    return found if wanted is None else found.filter(_may_be_in(F.col("window"), bits))


def _bits(hashes: list[int]) -> bytes:
    """A small Bloom filter of hashes, two bits for each: bytes of six bits above 0x40, so that each is a character."""
    size = 1 << max(10, (len(hashes) - 1).bit_length())
    found = bytearray(b"\x40" * size)
    for h in hashes:
        for byte, bit in _PROBES:
            found[(h >> byte) % size] |= 1 << (h >> bit & 0xFF) % 6
    return bytes(found)


#: From which bits of a hash a probe takes its byte and its bit.
_PROBES = ((0, 20), (28, 48))


def _may_be_in(h: Column, bits: bytes) -> Column:
    """Whether the filter has the hash; of those that it doesn't have, a few in a hundred pass. One literal, where a list of thousands of hashes is as many
    objects of every plan that the driver makes of it."""

    def probe(byte: int, bit: int) -> Column:
        own = F.ascii(F.substring(F.lit(bits), (F.shiftright(h, byte).bitwiseAND(F.lit(len(bits) - 1)) + 1).cast("int"), F.lit(1)).cast("string"))
        return F.call_function("shiftright", own, (F.shiftright(h, bit).bitwiseAND(F.lit(0xFF)) % 6).cast("int")).bitwiseAND(F.lit(1)) == 1

    return probe(*_PROBES[0]) & probe(*_PROBES[1])


def _few(listed: DataFrame, *columns: str) -> list | None:
    """The rows if they are few enough to be sent to a scan."""
    found = listed.select(*columns).limit(FEW + 1).collect()
    return found if len(found) <= FEW else None


def _short(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where a sentence, a line or a whole text is an item of fewer than WINDOW tokens."""
    key = lambda text: F.flatten(F.transform(F.array(tokens(text)), lambda ts: F.when((F.size(ts) > 0) & (F.size(ts) < WINDOW), F.array(F.xxhash64(_exact(ts)))).otherwise(F.array().cast("array<bigint>"))))
    parts = F.array_distinct(F.concat(F.split("text", r"[.!?\n]+"), F.split("text", r"\n"), F.array("text")))
    sought = items.select(F.col("id").alias("item_id"), F.explode(key(F.col("text"))).alias("key")).distinct()
    own = texts.select(F.col("id").alias("doc_id"), F.explode(F.array_distinct(F.flatten(F.transform(parts, key)))).alias("key"))
    return own.join(sought, "key").select("doc_id", "item_id").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, same_values) of every benchmark item found in a document; same_values: whether no slot differs."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "decontaminate")
    of = lambda df, i: df.select(df[i].alias("id"), df[text].alias("text")).filter("id is not null and text is not null").withColumn("row", F.xxhash64("text"))
    items, texts = of(benchmark, item_id).distinct(), of(docs, doc_id)
    # of benchmark size: written, as every step reads it
    every = windows(items, None).select(F.col("id").alias("item_id"), F.col("row").alias("item_row"), "n", F.col("at").alias("p"), "window", F.col("slots").alias("theirs"), "literals")
    every.write.parquet(f"{folder}/items")
    every = spark.read.parquet(f"{folder}/items")
    most = F.max("literals").over(Window.partitionBy("item_id", "item_row"))
    rich = every.withColumn("most", most)
    seeds = rich.filter(F.col("literals") >= LITERALS).select("item_id", "item_row", "p", F.lit(False).alias("by_value"), "window")
    poor = rich.filter(F.col("most") < LITERALS).select(F.col("item_id").alias("id"), F.col("item_row").alias("row")).distinct()
    exact = not poor.isEmpty()
    if exact:
        valued = _seeds_in(items.join(poor, ["id", "row"], "left_semi"), True).filter("by_value")
        seeds = seeds.union(valued.select(F.col("id").alias("item_id"), F.col("row").alias("item_row"), F.col("at").alias("p"), "by_value", "window"))
    own = _seeds_in(texts, exact).withColumnsRenamed({"id": "doc_id", "row": "doc_row", "at": "q"})
    met = own.join(seeds if _few(seeds, "window") is None else F.broadcast(seeds), ["by_value", "window"])  # FEW rows at most, if they are sent
    met.select("doc_id", "doc_row", "item_id", "item_row", (F.col("q") - F.col("p")).alias("offset"), (~F.col("by_value")).alias("seeded")).distinct().write.parquet(f"{folder}/hits")
    hits = spark.read.parquet(f"{folder}/hits")
    # all windows of the item along the seeds' offsets, of documents with seeds only
    few = _few(every, "window")
    near = windows(texts.join(hits.select(F.col("doc_id").alias("id"), F.col("doc_row").alias("row")).distinct(), ["id", "row"], "left_semi"), None if few is None else sorted({r.window for r in few}))
    near = near.select(F.col("id").alias("doc_id"), F.col("row").alias("doc_row"), F.col("at").alias("q"), "window", F.col("slots").alias("own")).distinct()
    expected = hits.join(every, ["item_id", "item_row"]).withColumn("q", F.col("p") + F.col("offset"))
    # what an item's values stand for, on one offset
    pairs = F.filter(F.arrays_zip("theirs", "own"), lambda z: z["theirs"].isNotNull())
    keys = ["doc_id", "doc_row", "item_id", "item_row", "n"]
    offset = near.join(expected, ["doc_id", "doc_row", "q", "window"]).select(*keys, "offset", "seeded", "p", pairs.alias("pairs"), (F.col("literals") >= LITERALS).alias("rich"))
    sets = lambda only, ps, out: (F.collect_set(F.when(only, F.col("p"))).alias(ps), F.array_distinct(F.flatten(F.collect_set(F.when(only, F.col("pairs"))))).alias(out))
    along = offset.groupBy(*keys, "offset", "seeded").agg(*sets(F.lit(True), "ps", "pairs"), *sets(F.col("rich"), "rich_ps", "rich_pairs"))  # an item's windows at most
    one = lambda c: F.size(c) == F.size(F.array_distinct(F.transform(c, lambda z: z["theirs"])))
    equal = lambda c: F.forall(c, lambda z: z["theirs"].eqNullSafe(z["own"]))
    # where values of placeholder-rich windows conflict, the others still count alone; an item without seeds needs its own values
    usable = along.withColumn("whole", one("pairs") & (F.col("seeded") | equal("pairs"))).filter(F.col("whole") | (F.col("seeded") & one("rich_pairs")))
    kept = usable.select(*keys, F.when(F.col("whole"), F.col("ps")).otherwise(F.col("rich_ps")).alias("ps"), equal("pairs").alias("same"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(F.flatten(F.collect_set("ps"))), lambda p: F.sequence(p, p + WINDOW - 1)))))
    found = kept.groupBy(*keys).agg((covered / F.first("n")).alias("coverage"), F.bool_and("same").alias("same_values")).filter(F.col("coverage") >= COVERAGE)
    short = items.filter((F.size(tokens(F.col("text"))) > 0) & (F.size(tokens(F.col("text"))) < WINDOW))
    if not short.isEmpty():
        found = found.select("doc_id", "item_id", "coverage", "same_values").union(_short(texts, short).withColumns({"coverage": F.lit(1.0), "same_values": F.lit(True)}))
    return found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.bool_and("same_values").alias("same_values"))
