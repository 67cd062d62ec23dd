"""I-Match fingerprints of documents, in DataFrame functions only.

The lexicon holds the terms whose document frequency lies within a band (shares LEAST to MOST of all documents, both counted over the whole table).
It has at most (mean distinct terms of a document) / LEAST terms, whatever the size of the corpus, and so may be sent to all executors. A document's
distinct terms in the lexicon are sorted, and SUBSETS random subsets of the lexicon (a quarter each keeps a 16th, 64th, 128th and 256th of it) each
give a hash of the sorted terms that they keep, or 0 if they keep none. A document of which no subset keeps a term (a language or a source that is rare
in the corpus, say) has hashes of all its sorted terms instead, or of its text if it has none: it is like documents with the same terms only. The likeness
of two fingerprints is the share of equal hashes among those that either has.

Nulls: a null text is empty. Order for the next document: descending doc_id, null ids last, equal ids by a hash of their texts. Repeated rows stay rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST, MOST = 0.01, 0.3
SUBSETS = 64
#: What splits terms: ASCII white space, signs and control characters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents in a stretch of ids that one task puts in order, and the most stretches; beyond, stretches grow (and spill).
STRETCH, STRETCHES = 2000, 16384


def terms(text: Column) -> Column:
    """Hashes of a text's distinct terms."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), BETWEEN), lambda t: t != ""), lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, text: str = "text") -> list[int]:
    """Hashes of the terms within the band; at least two documents must have a term."""
    each = docs.select(F.explode(terms(docs[text])).alias("term"))
    n = docs.count()
    found = each.groupBy("term").count().filter((F.col("count") >= max(2, math.ceil(LEAST * n))) & (F.col("count") <= max(2, math.floor(MOST * n))))
    return sorted(r.term for r in found.collect())  # bounded, see above


def _mask(h: Column) -> Column:
    """A bit for each subset: whether it keeps the term. Every further hash that must agree halves a subset."""
    r = [F.xxhash64(h, F.lit(k)) for k in range(8)]
    quarter = SUBSETS // 4
    bits = lambda k: F.lit(_signed((1 << quarter * (k + 1)) - 1))
    first = r[0].bitwiseAND(r[1]).bitwiseAND(r[2]).bitwiseAND(r[3])
    inner = bits(2).bitwiseOR(r[7])
    inner = bits(1).bitwiseOR(r[6].bitwiseAND(inner))
    return first.bitwiseAND(bits(0).bitwiseOR(r[4].bitwiseAND(r[5]).bitwiseAND(inner)))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _short(h: Column) -> Column:
    return (F.pmod(h, F.lit(65535)) + 1).cast("int")


def fingerprint(text: Column, own_terms: Column, kept: list[int]) -> Column:
    """SUBSETS numbers below 2 ** 16 of a text and of the terms of it that terms() made."""
    inside = F.filter(own_terms, lambda h: h.isin(kept)) if kept else F.filter(own_terms, lambda h: F.lit(False))
    masked = F.filter(F.transform(F.sort_array(inside), lambda h: F.struct(h.alias("h"), _mask(h).alias("m"))), lambda p: p["m"] != 0)

    def of(pairs: Column, j: int) -> Column:
        mine = F.filter(pairs, lambda p: p["m"].bitwiseAND(F.lit(_signed(1 << j))) != 0)
        return F.when(F.size(mine) > 0, _short(F.xxhash64(F.transform(mine, lambda p: p["h"])))).otherwise(0)

    whole = F.when(F.size(own_terms) > 0, F.xxhash64(F.sort_array(own_terms))).otherwise(F.xxhash64(text))
    alone = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda j: _short(F.xxhash64(whole, j)))
    # bound once by a one-element array, so that the pairs aren't made again for every subset
    return F.flatten(F.transform(F.array(masked), lambda pairs: F.when(F.size(pairs) > 0, F.array(*(of(pairs, j) for j in range(SUBSETS)))).otherwise(alone)))


def likeness(a: Column, b: Column) -> Column:
    seen = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda s: s))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) & (x == y)), lambda s: s))
    return same / seen


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def _stretch(ids: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds lie above the id, by bisection: bounds[k] is the least id of stretch k."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    listed = F.array(*(F.lit(b) for b in bounds)).cast("array<bigint>")
    further = lambda at, step: F.coalesce(F.get(listed, at + step - 1) > ids, F.lit(False))  # noqa: E731  null beyond the last bound
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, and the given columns, one of them text) with `next_<column>` of the next document.

    Ids are cut into stretches at their quantiles, so that sparse and outlying ids make no difference; rows without an id are cut by a hash of their texts,
    which orders them. Every stretch is put in order by one task. The first document of a stretch is also sent to the stretch before it (of the first one,
    to the last), where it comes after all others: so each document finds its next one in its own stretch.
    """
    spark = docs.sparkSession
    ends = docs.agg(F.count("doc_id").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    count, of_nulls = (max(1, min(STRETCHES, math.ceil(n / STRETCH))) for n in (ends.n, ends.nulls))
    bounds: list[int] = []
    if count > 1:
        shares = [k / count for k in range(count - 1, 0, -1)]
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 10 * count).alias("q")).first().q), reverse=True)
    text_hash = F.xxhash64("text")
    null_stretch = F.floor((text_hash.cast("double") + 2.0**63) / 2.0**64 * of_nulls)
    id_stretch = _stretch(F.col("doc_id"), bounds) if bounds else F.lit(0)
    placed = docs.withColumn("stretch", F.when(F.col("doc_id").isNotNull(), id_stretch).otherwise(F.lit(len(bounds) + 1) + F.least(null_stretch, F.lit(of_nulls - 1))).cast("int"))
    # the first of a stretch in order, by what tells it from others: texts of equal hashes count as equal
    first = F.min(F.struct((-F.col("doc_id").cast("decimal(20,0)")).alias("a"), text_hash.alias("b")))
    heads = sorted(placed.groupBy("stretch").agg(first.alias("first")).collect(), key=lambda r: r.stretch)  # 2 * STRETCHES + 1 at most
    before = [(r.stretch, None if r.first.a is None else -int(r.first.a), r.first.b, heads[k - 1].stretch) for k, r in enumerate(heads)]
    sent = spark.createDataFrame(before, "s int, head long, head_hash long, before int")
    is_head = (F.col("stretch") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("head")) & (text_hash == F.col("head_hash"))
    both = placed.join(F.broadcast(sent), is_head, "left")
    targets = F.when(F.col("before").isNull(), F.array(F.struct(F.col("stretch").alias("at"), F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct(F.col("stretch").alias("at"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("at"), F.lit(1).alias("guest")))
    )
    dealt = both.withColumn("target", F.explode(targets)).select("doc_id", *columns, F.col("target.at").alias("at"), F.col("target.guest").alias("guest"))
    order = Window.partitionBy("at").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter("guest = 0").drop("at", "guest")


def compare_with_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_chars, its edited text (the last half replaced by the beginning of the next document), both fingerprints, and the likeness of
    the document to its edited text and to the next document."""
    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    kept = lexicon(own)
    marked = own.select("doc_id", "text", terms(F.col("text")).alias("terms")).select("doc_id", "text", fingerprint(F.col("text"), F.col("terms"), kept).alias("fp"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    follow = with_next(marked, ["text", "fp"])
    edited = follow.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    termed = edited.withColumn("edited_terms", terms(F.col("edited")))
    return termed.withColumn("edited_fp", fingerprint(F.col("edited"), F.col("edited_terms"), kept)).select("doc_id", "n_chars", "edited", "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
