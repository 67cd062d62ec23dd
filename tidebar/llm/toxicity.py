"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult (learned), threat, intent, target, object (a target that may stand before the threat), negation, reported speech, other. Four
transducers (insult in reach of a target, threat against a target, negation, reported speech) each read all symbols and carry a factor; their composition
reads a clause once and gives its weight. Words alone decide nothing: a negated or merely reported insult weighs little, a threat weighs only with intent
and target.

The insult lexicon is learned from labelled rows: word beginnings that many toxic and next to no clean documents have at least m times, for the least m
from 1 to MOST_TIMES for which that holds. A beginning of m = 1 is an insult by itself; one of a larger m is common enough to come up by chance, and
weighs so much that m of them reach the cut, or in long texts a share RATE of all words. Each is grown to the stem at which its words part. The
lexicon is bounded by the labelled sample alone; labels, lang, source and doc_id are never read by the score.

Documents are judged by the summed weight of their clauses, 1 - exp(-weight), in one pass over the text. Null and empty texts score 0. Rows stay rows. A
kept column with the score's name is refused.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.memory import returning

#: Labelled rows that the lexicon is learned from, the least hashes of all that may be used.
SAMPLE = 20_000
#: The least share of toxic documents (and two at least), and the least number of places with different neighbours in them (copies share their
#: neighbours), that a stem must be seen in; and the least log-odds that it must have. A share bounds what can be a candidate by the sample's text length, not by a cap.
SHARE, PLACES, LOG_ODDS = 0.005, 8, 3.0
#: The most times that a stem may have to come, and the share of a text's words that such stems must reach in long texts.
MOST_TIMES, RATE = 5, 0.004
#: Like SHARE, for stems that have to come more than once.
COMMON_SHARE = 0.02
#: Lengths of the word beginnings that are counted.
SHORTEST, LONGEST = 3, 12
CUT = 0.3
#: The summed weight that scores CUT, and a little more.
ENOUGH = -math.log(1 - CUT) * 1.05
#: Word beginnings that a task counts before it hands its counts on.
BUFFERED = 50_000
#: Texts that are scored at once.
ROWS_AT_ONCE = 256

INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, OBJECT, OTHER = range(8)
SYMBOLS = range(8)
#: Words with a fixed symbol. An insult that was learned goes before these.
FIXED = {
    THREAT: "kill murder shoot stab strangle hurt beat destroy burn smash hang töten umbringen erschießen schlagen verprügeln verbrennen zerstören tuer frapper brûler détruire battre poignarder matar golpear quemar destruir apuñalar disparar".split(),
    INTENT: "will shall gonna going should must i'll we'll they'll let's werde werden wird sollte sollten muss vais va vont dois devrait allons voy vamos debe debería".split(),
    TARGET: "you your yours yourself he him she her they them their people everyone du ihn ihm elle lui tu toi tú usted ustedes ella ellos".split(),
    OBJECT: "dich euch sie te vous os".split(),
    NEGATION: "not no never nobody neither nor isn't aren't wasn't weren't don't doesn't didn't hardly nicht kein keine nie pas jamais nunca tampoco".split(),
    REPORT: "said says say claimed claims wrote writes called calls accused alleged reportedly quoted heard sagte schrieb dit écrit dijo escribió".split(),
}
_WORD = re.compile(r"\w+(?:['’]\w+)*")
_CLAUSE = re.compile(r"[.!?;:\n]+|,\s")


@dataclass(frozen=True)
class Transducer:
    """Deterministic and complete over SYMBOLS. Each arc carries a factor for what the clause has gathered and a term added to it."""

    start: object
    arcs: dict = field(hash=False)  # (state, symbol) -> (state, factor, weight of the symbol itself)

    def compose(self, other: Transducer) -> Transducer:
        """Both at once: factors multiply. Only states that can be reached are made."""
        arcs, todo, seen = {}, [(self.start, other.start)], {(self.start, other.start)}
        while todo:
            a, b = todo.pop()
            for s in SYMBOLS:
                na, fa, wa = self.arcs[(a, s)]
                nb, fb, wb = other.arcs[(b, s)]
                arcs[((a, b), s)] = ((na, nb), fa * fb, wa + wb)
                if (na, nb) not in seen:
                    seen.add((na, nb))
                    todo.append((na, nb))
        return Transducer((self.start, other.start), arcs)

    def numbered(self) -> Transducer:
        number = {s: k for k, s in enumerate(dict.fromkeys([self.start, *(s for s, _ in self.arcs)]))}
        return Transducer(0, {(number[s], x): (number[t], f, w) for (s, x), (t, f, w) in self.arcs.items()})


def insults(reach: int = 4, boost: float = 1.5) -> Transducer:
    """An insult counts once; it counts `boost` times if a target stood at most `reach` words before."""
    arcs = {}
    for left, s in product(range(reach + 1), SYMBOLS):
        to = reach if s in (TARGET, OBJECT) else max(0, left - 1)
        arcs[(left, s)] = (to, boost if s == INSULT and left else 1.0, 1.0 if s == INSULT else 0.0)
    return Transducer(0, arcs)


def threats(reach: int = 4) -> Transducer:
    """Intent, then a threat within reach, and a target within reach of the threat: only the arc that completes them counts, threefold. A target comes
    after the threat; an object may also come before it (dich töten, te matar)."""
    arcs = {}
    states = product(range(reach + 1), repeat=3)  # how far intent, object and threat still reach
    for (intent, ahead, threat), s in product(states, SYMBOLS):
        to, weight = [max(0, intent - 1), max(0, ahead - 1), max(0, threat - 1)], 0.0
        if s == INTENT:
            to[0] = reach
        elif s == THREAT and intent:
            to, weight = ([0, 0, 0], 3.0) if ahead else ([0, 0, reach], 0.0)
        elif s in (TARGET, OBJECT):
            if threat:
                to, weight = [0, 0, 0], 3.0
            elif s == OBJECT:
                to[1] = reach
        arcs[((intent, ahead, threat), s)] = (tuple(to), 1.0, weight)
    return Transducer((0, 0, 0), arcs)


def negations(reach: int = 3, left_over: float = 0.1) -> Transducer:
    """After a negation, what counts within reach counts for `left_over` only."""
    arcs = {}
    for left, s in product(range(reach + 1), SYMBOLS):
        arcs[(left, s)] = (reach if s == NEGATION else max(0, left - 1), left_over if left else 1.0, 0.0)
    return Transducer(0, arcs)


def reports(left_over: float = 0.25) -> Transducer:
    """After a verb of saying, the rest of the clause counts for `left_over`."""
    return Transducer(0, {(k, s): (1 if k or s == REPORT else 0, left_over if k else 1.0, 0.0) for k, s in product((0, 1), SYMBOLS)})


def grammar() -> Transducer:
    return insults().compose(threats()).compose(negations()).compose(reports()).numbered()


def clause_weight(machine: Transducer, symbols: Iterable[tuple[int, float]]) -> float:
    """Of a clause given as (symbol, own weight): the sum over its arcs of weight times factor."""
    state, total, arcs = machine.start, 0.0, machine.arcs
    for s, own in symbols:
        state, factor, weight = arcs[(state, s)]
        if weight:
            total += weight * factor * (own if s == INSULT else 1.0)
    return total


class Scorer:
    """A grammar with a learned lexicon: stems and their weights (of 1 at most), or the number of times, from 2 on, that they must come. A stem that ends
    in `$` is a whole word, others begin words."""

    def __init__(self, stems: dict[str, float]):
        self.machine = grammar()
        self.whole = {s[:-1]: w for s, w in stems.items() if s.endswith("$")}
        self.begin = {s: w for s, w in stems.items() if not s.endswith("$")}
        self.lengths = sorted({len(s) for s in self.begin}, reverse=True)
        self.fixed = {w: symbol for symbol, listed in FIXED.items() for w in listed}
        self.alarm = ahocorasick.Automaton()
        for w in {*self.whole, *self.begin, *FIXED[THREAT]}:
            self.alarm.add_word(w, len(w))
        self.alarm.make_automaton()

    def symbol(self, word: str, n_words: int = 0) -> tuple[int, float]:
        """The word's symbol, and its own weight in a text of so many words."""
        weight = self.whole.get(word, 0.0) or next((self.begin[word[:n]] for n in self.lengths if word[:n] in self.begin), 0.0)
        if not weight:
            return self.fixed.get(word, OTHER), 0.0
        return INSULT, weight if weight <= 1 else ENOUGH / max(weight, RATE * n_words)

    def clauses(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Places and weights of the clauses that weigh anything. Only clauses in which a word that can count begins are read."""
        low = text.lower() if text.isascii() or len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        borders, start, n_words = _CLAUSE.finditer(low), 0, 0
        border, done = next(borders, None), -1
        for end, n in self.alarm.iter(low):
            at = end - n + 1
            if at < done or (at and (low[at - 1].isalnum() or low[at - 1] == "_")):
                continue
            while border and border.end() <= at:  # borders and places both go forward: one pass for all clauses
                start, border = border.end(), next(borders, None)
            n_words = n_words or low.count(" ") + low.count("\n") + 1
            done = stop = border.start() if border else len(low)
            weight = clause_weight(self.machine, (self.symbol(w, n_words) for w in _WORD.findall(low, start, stop)))
            if weight:
                yield start, stop, weight

    def score(self, text: str | None) -> float:
        if not text:
            return 0.0
        return 1.0 - math.exp(-sum(w for _, _, w in self.clauses(text)))


def beginnings(text: str) -> Iterator[str]:
    """The word beginnings of a text, and its words with an end mark; with a number m behind a space, those that come at least m times, and as often as a
    share RATE of all words."""
    out: Counter = Counter()
    n_words = 0
    for w, times in Counter(_WORD.findall(text.lower())).items():
        n_words += times
        out[w + "$"] += times
        for n in range(SHORTEST, min(LONGEST, len(w)) + 1):
            out[w[:n]] += times
    for b, times in out.items():
        yield b
        if times > 1 and times >= RATE * n_words:
            yield from (f"{b} {m}" for m in range(2, min(times, MOST_TIMES) + 1))


def telling_of(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, tuple[int, float]]:
    """From (toxic, clean) document counts of beginnings: of those that many toxic and next to no clean documents have at least m times, the least such m
    and its log-odds."""
    out: dict[str, tuple[int, float]] = {}
    for key, (t, c) in counts.items():
        b, _, m = key.partition(" ")
        odds = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        least = max(2, SHARE * n_toxic) if not m else max(3, COMMON_SHARE * n_toxic)
        if odds >= LOG_ODDS and t >= least and t > 20 * c and int(m or 1) < out.get(b, (MOST_TIMES + 1,))[0]:
            out[b] = (int(m or 1), odds)
    return out


def stems_of(telling: dict[str, tuple[int, float]], counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """The telling beginnings that most toxic documents have, of equal ones the shortest, each grown while one longer beginning has all its documents. Of
    beginnings of one another, only the first counts."""
    toxic = lambda b: counts[b if telling[b][0] == 1 else f"{b} {telling[b][0]}"][0]
    longer: dict[str, list[str]] = {}
    for b in telling:
        if len(b) > 1:
            longer.setdefault(b[:-1], []).append(b)
    out: dict[str, tuple[int, float, float]] = {}
    covered: set[str] = set()
    for b in sorted(telling, key=lambda b: (-toxic(b), len(b), b)):
        if b in covered or any(b[:n] in out for n in range(SHORTEST, len(b))):
            continue
        stem = b
        while True:
            all_of = [x for x in longer.get(stem, []) if telling[x][0] <= telling[stem][0] and toxic(x) >= 0.98 * toxic(stem)]
            if len(all_of) != 1:
                break
            stem = all_of[0]
        times, odds = telling[stem]
        out[stem] = (times, odds, min(1.0, odds / 6.0) if times == 1 else float(times))
        covered.update(stem[:n] for n in range(SHORTEST, len(stem)))
    return {s: out[s][2] for s in sorted(out, key=lambda s: (-toxic(s) * out[s][1], s))}


def held_out(doc_id) -> F.Column:  # noqa: ANN001
    """Whether a row's label is kept from learning: crc32 of the doc_id as text leaves 2 when divided by 4. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def learn(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Stems from at most SAMPLE labelled rows outside the held-out part; none if there are no labels of both kinds. Rows of labels with a null label
    are ignored, and repeated ones count as toxic if any is."""
    usable = labels.select(labels["doc_id"].alias("k"), labels["toxic"].alias("toxic")).filter("toxic is not null and k is not null").filter(~held_out(F.col("k")))
    chosen = usable.groupBy("k").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).filter("text is not null")
    # the sample is bounded, so its keys may be sent to all
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("k")).select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(sums[0].keys() | sums[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[1][x] for x in names], pa.int64()), pa.array([sums[0][x] for x in names], pa.int64())], names=["b", "toxic", "clean"])
            sums[0].clear()
            sums[1].clear()
            return batch

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[bool(toxic)].update(beginnings(text))
                sums[bool(toxic)][""] += 1
                if len(sums[0]) + len(sums[1]) > BUFFERED:
                    yield out()
        if sums[0] or sums[1]:
            yield out()

    counted = rows.mapInArrow(returning(count), "b string, toxic long, clean long").groupBy("b").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    kinds = {r.toxic != 0: r.n for r in rows.groupBy((F.col("toxic") != 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = kinds.get(True, 0), kinds.get(False, 0)
    # each candidate is in a share of the toxic rows, so there are at most as many as a row has beginnings on average, divided by that share
    found = counted.filter((F.col("b") != "") & (F.col("toxic") >= max(2, SHARE * n_toxic)) & (F.col("toxic") > 20 * F.col("clean"))).toPandas()
    counts = {b: (int(t), int(c)) for b, t, c in found.itertuples(index=False)}
    telling = telling_of(counts, n_toxic, n_clean) if n_toxic and n_clean else {}
    if not telling:
        return {}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[str, int]] = set()
            for text in batch.column(0).to_pylist():
                own = ["", *_WORD.findall(text.lower()), ""]
                for k, w in enumerate(own):
                    for b in (w + "$", *(w[:n] for n in range(SHORTEST, min(LONGEST, len(w)) + 1))):
                        if b in telling:
                            out.add((b, zlib.crc32(f"{own[k - 1]} {w} {own[k + 1]}".encode())))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.string()), pa.array([c for _, c in out], pa.int64())], names=["b", "place"])

    seen = rows.filter("toxic <> 0").mapInArrow(returning(places), "b string, place long").groupBy("b").agg(F.countDistinct("place").alias("n")).filter(F.col("n") >= PLACES).toPandas()
    wide = {b for b, n in seen.itertuples(index=False) if 2 * n >= counts.get(b, counts.get(f"{b} {telling[b][0]}"))[0]}
    return stems_of({b: o for b, o in telling.items() if b in wide}, counts)


def score(docs: DataFrame, stems: dict[str, float], keep: tuple[str, ...] = ("doc_id",), text: str = "text", out: str = "score") -> DataFrame:
    """docs' `keep` columns with each whole text's score between 0 and 1."""
    if out in keep:
        raise ValueError(f"a kept column has the score's name: {out}")
    schema = docs.select(*(docs[k] for k in keep)).schema.add(out, "double")
    n = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(stems)
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            got = np.array([scorer.score(t) for t in batch.column(n).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(got)], names=[*keep, out])

    return docs.select(*(docs[k] for k in keep), docs[text].alias("__text")).mapInArrow(returning(work), schema)
