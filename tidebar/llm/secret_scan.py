"""Secrets in texts: known shapes, and literals that source or configuration syntax assigns to sensitive names.

Known shapes are searched as given (`base`). The assignment lexer then reads name-literal pairs:

* `name = "x"`, `name: x`, `"name": "x"`, `name := x`, `name => x`, `cfg["name"] = "x"`, `name: type = "x"`, `name?: type = "x"`,
* strings of one line with escapes, prefixed ones (`b"x"`), triple-quoted ones, back-quoted ones, strings side by side or added, also in parentheses,
* values on the next line, and indented blocks (`name: |`), as in YAML,
* `<name>x</name>`, `<add key="name" value="x"/>` and `<entry key="name">x</entry>`.

Strings are read where a value is due and nowhere else, so an apostrophe in a comment or in prose opens none; comments between a name and its value are
skipped, and assignments that are commented out are read like others. A name stands for what it was last assigned before, or else for what it is first
assigned afterwards; an assignment of anything else than literals and names (a call, say) leaves it without a literal. Every literal is scored by the
sensitive words of the names that it ends up in. A literal that scores at least THRESHOLD and lies outside all base spans adds a span of kind `literal`;
a block adds one for each line.

Spans are (kind, start, end) in code points, end exclusive. Literals and names have any length. Null texts count as empty. Rows stay rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The patterns of known shapes and the least lengths that they must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # as runs of any length of which those under 32 are dropped
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = {"assign": 0, "access": 1, "hex": 2, "literal": 3}

#: How sensitive a word of a name is, as a share of certainty; words side by side (api key) count together.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api key": 1.0, "private key": 1.0,
    "access key": 1.0, "secret key": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "authorization": 0.8, "bearer": 0.8, "signing key": 0.9,
    "encryption key": 1.0, "client secret": 1.0, "pin": 0.5, "salt": 0.5,
}
#: Words that mark a literal as a stand-in.
STAND_INS = ("example", "changeme", "your_", "your-", "placeholder", "dummy", "redacted", "xxxx", "****", "todo", "none", "null", "true", "false")
THRESHOLD = 0.5

_OPERATOR = re.compile(r":=|=>|={1,3}|:{1,2}")
_FIRST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$")
_INNER = _FIRST | frozenset("0123456789.-")
# possessive: literals of any length in one pass; a later opening quote of a kind closes an earlier one, so that a line has one failing pass for each kind
_STRING = re.compile(r"""(?:"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|`([^`]*+)`)""")
_PREFIX = re.compile(r"[rbufRBUF@]{1,2}(?=[\"'])")
_REFERENCE = re.compile(r"\$\{?([A-Za-z_]\w*+)\}?", re.ASCII)
_BARE = re.compile(r"""[^\s,;(){}\[\]"'`<>]++""")
_PLUS = re.compile(r"[ \t]*+(?:\+|\.\.)[ \t]*+\n?[ \t]*+")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$.]*\Z", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_BLANKS = re.compile(r"[ \t]*+")
_WHITE = re.compile(r"\s*+")
#: What stands between the colon and the equals sign of `name: type = value`.
_TYPE = re.compile(r"[ \t]*+([A-Za-z_][\w.]*+)(?:\[[^\]\n]*+\])?(?:[ \t]*+\|[ \t]*+[A-Za-z_][\w.]*+)*+[ \t]*+=(?![=>])", re.ASCII)
#: The rest of a line whose value begins on the next one.
_BLOCK = re.compile(r"[ \t]*+([|>][+\-0-9]*+)?[ \t]*+(?:#[^\n]*+)?\r?\n")
_LINE = re.compile(r"([ \t]*+)([^\n]*+)(?:\n|\Z)")
_TAG = re.compile(r"<([A-Za-z_][\w.:-]*+)([^<>]*+)>", re.ASCII)
_ATTRIBUTE = re.compile(r"""([\w.:-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""", re.ASCII)

Span = tuple[str, int, int]


def base(text: str) -> list[Span]:
    """Spans of the known shapes, leftmost and without overlap for each kind."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS[s[0]], s[2]))


def sensitivity(name: str) -> float:
    """Of the most sensitive word, or pair of words, in a name."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *pairs, "".join(parts)]), default=0.0)


def randomness(literal: str) -> float:
    """Between 0 and 1: how little a literal looks like words, paths or stand-ins. A stand-in word must be a sixth of it, as long ones hold it by chance."""
    if "-----BEGIN" in literal and "PRIVATE KEY-----" in literal:
        return 1.0
    literal = re.sub(r"\s*\n\s*", "", literal)
    low = literal.lower()
    if len(literal) < 8 or any(s in low and 6 * len(s) >= len(low) for s in STAND_INS) or re.search(r"\s|://|^[./~]|^<|\$\{", literal):
        return 0.0
    counts = Counter(literal)
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    classes = sum(bool(re.search(c, literal)) for c in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, 0.22 * entropy) * (1.0 if classes >= 2 else 0.6)


def name_before(text: str, end: int) -> str | None:
    """The name, quoted or not and of any length, that ends before a place, blanks aside; of a subscript, the name in it."""
    while end and text[end - 1] in " \t":
        end -= 1
    subscript = end > 1 and text[end - 1] == "]" and text[end - 2] in "\"'"
    if subscript or (end > 1 and text[end - 1] in "?!" and text[end - 2] in _INNER):
        end -= 1
    quote = text[end - 1] if end and text[end - 1] in "\"'" else ""
    stop = start = end - len(quote)
    while start and text[start - 1] in _INNER:
        start -= 1
    if start == stop or text[start] not in _FIRST or (quote and (not start or text[start - 1] != quote)):
        return None
    if subscript and (start < 2 or text[start - 2] != "["):
        return None
    return text[start:stop]


Place = tuple[int, int]


class Assignments:
    """All assignments of a text: their targets, and what is assigned: places of literals, and the names of others."""

    def __init__(self, text: str):
        self.text, self.closed = text, {'"""': True, "'''": True, "*/": True}
        #: (targets, parts); a part is a place, or (name, its last assignment before or -1, place if it may be a literal itself)
        self.found: list[tuple[list[str], list]] = []
        self.first: dict[str, int] = {}
        self.last: dict[str, int] = {}
        self._read()
        if "<" in text and ">" in text:
            self._read_tags()

    def _until(self, mark: str, at: int) -> int:
        """Where the mark comes next, or -1; once it comes no more, it isn't looked for again."""
        end = self.text.find(mark, at) if self.closed[mark] else -1
        while end > 0 and mark != "*/":
            k = end
            while k > at and self.text[k - 1] == "\\":
                k -= 1
            if (end - k) % 2 == 0:
                break
            end = self.text.find(mark, end + 1)
        self.closed[mark] = end >= 0
        return end

    def _string(self, at: int) -> tuple[Place, int] | None:
        """The place of the content of the string that begins here, and where it ends."""
        prefix = _PREFIX.match(self.text, at)
        at = prefix.end() if prefix else at
        mark = self.text[at : at + 3]
        if mark in ('"""', "'''") and (end := self._until(mark, at + 3)) >= 0:
            return (at + 3, end), end + 3
        m = _STRING.match(self.text, at)
        return ((m.start(m.lastindex), m.end(m.lastindex)), m.end()) if m else None

    def _value(self, at: int, bare: bool) -> tuple[list, int]:
        """The parts of the value that begins here (none if it isn't made of literals and names), and where it ends."""
        text, parts, depth = self.text, [], 0
        at = _BLANKS.match(text, at).end()
        if text.startswith("/*", at) and (end := self._until("*/", at + 2)) >= 0:
            at = _BLANKS.match(text, end + 2).end()
        while text.startswith("(", at):
            depth, at = depth + 1, _WHITE.match(text, at + 1).end()
        blanks = _WHITE if depth else _BLANKS
        while True:
            if (s := self._string(at)) is not None:
                parts.append(s[0])
                at = s[1]
                behind = blanks.match(text, at).end()
                if self._string(behind) is not None:  # strings side by side
                    at = behind
                    continue
            elif m := _REFERENCE.match(text, at):
                parts.append((m[1], self.last.get(m[1], -1), None))
                at = m.end()
            elif m := _BARE.match(text, at):
                word = m[0].rstrip(".,:!?")
                at = m.end()
                if text[at : at + 1] in ("(", "["):  # a call or a part of something
                    return [], at
                place = (m.start(), m.start() + len(word))
                name = bool(_IDENTIFIER.match(word))
                if name and (word in self.last or sum(c.isdigit() for c in word) < 2):
                    parts.append((word, self.last.get(word, -1), None))
                elif bare and word:
                    parts.append((word, -1, place) if name else place)
            else:
                break
            plus = _PLUS.match(text, blanks.match(text, at).end())
            if not plus:
                break
            at = blanks.match(text, plus.end()).end()
        return parts, at

    def _below(self, op: int, at: int, block: bool) -> tuple[list, int]:
        """The value on the lines below the name's line: a whole block, or one value."""
        text = self.text
        line = text.rfind("\n", 0, op) + 1
        indent = len(_BLANKS.match(text, line)[0])
        parts: list = []
        while at < len(text) and (m := _LINE.match(text, at)):
            content = m[2].rstrip("\r")
            if content and len(m[1]) <= indent and not (not block and content[0] in "\"'"):
                break
            if content and not block:
                if content.startswith("- ") or (content[0] not in "\"'" and re.search(r"[:=](?:\s|\Z)", content)):
                    break
                return self._value(m.start(2), True)
            if content:
                parts.append((m.start(2), m.start(2) + len(content.rstrip())))
            at = m.end()
        return parts, at

    def _add(self, targets: list[str], parts: list) -> None:
        for t in targets:
            self.first.setdefault(t, len(self.found))
            self.last[t] = len(self.found)
        self.found.append((targets, parts))

    def _read(self) -> None:
        text, done = self.text, 0
        for op in _OPERATOR.finditer(text):
            if op.start() < done or op[0] in ("==", "===", "::"):
                continue
            target = name_before(text, op.start())
            if not target:
                continue
            targets, at = [target], op.end()
            if op[0] == ":" and (kind := _TYPE.match(text, at)):
                targets, at = [target, kind[1]], kind.end()
            if op[0] == ":" and (m := _BLOCK.match(text, at)):
                parts, end = self._below(op.start(), m.end(), bool(m[1]))
            else:
                parts, end = self._value(at, op[0] != "=>")
            done = max(done, at, end if parts else 0)
            self._add(targets, parts)

    def _read_tags(self) -> None:
        for tag in _TAG.finditer(self.text):
            named, value = [tag[1]], None
            for a in _ATTRIBUTE.finditer(self.text, tag.start(2), tag.end(2)):
                place = (a.start(a.lastindex), a.end(a.lastindex))
                if a[1].lower() in ("key", "name", "id"):
                    named.append(a[a.lastindex])
                elif a[1].lower() in ("value", "val", "content"):
                    value = place
            if value and len(named) > 1:
                self.found.append((named[1:], [value]))
            end = self.text.find("<", tag.end())
            if end >= 0 and self.text.startswith("</", end) and not self.text[tag.end() : end].isspace() and end > tag.end():
                inside = self.text[tag.end() : end]
                start = tag.end() + len(inside) - len(inside.lstrip())
                self.found.append((named, [(start, start + len(inside.strip()))]))

    def literals(self, k: int) -> list[Place]:
        """The places that the k-th assignment ends up with, names followed; each once."""
        out: dict[Place, None] = {}
        seen, todo = {k}, list(reversed(self.found[k][1]))
        while todo:
            part = todo.pop()
            if isinstance(part[0], int):
                out[part] = None
                continue
            name, before, place = part
            at = before if before >= 0 else self.first.get(name, -1)
            if at < 0 and place:
                out[place] = None
            elif at >= 0 and at not in seen:
                seen.add(at)
                todo += reversed(self.found[at][1])
        return list(out)


def pairs(text: str) -> Iterator[tuple[str, list[Place]]]:
    """Sensitive names with the places of the literals that are assigned to them, constants followed."""
    read = Assignments(text)
    for k, (targets, _) in enumerate(read.found):
        name = max(targets, key=sensitivity)
        if sensitivity(name) and (literals := read.literals(k)):
            yield name, literals


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans."""
    if not text:
        return [], []
    first = base(text)
    added = set()
    if "=" in text or ":" in text or "</" in text:
        for name, literals in pairs(text):
            weight = sensitivity(name)
            if weight and weight * randomness("".join(text[a:b] for a, b in literals)) >= THRESHOLD:
                added |= {("literal", a, b) for a, b in literals if b > a and not any(s < b and a < e for _, s, e in first)}
    return first, in_order([*first, *added]) if added else first


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each run of touching spans replaced by the mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: What find() can add to each row.
OUTPUTS = {"n_assign": T.LongType(), "n_access": T.LongType(), "n_hex": T.LongType(), "base": T.StringType(), "base_sha256": T.StringType(), "spans": T.StringType(), "redacted": T.StringType()}


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """docs' `keep` columns with the chosen OUTPUTS of each whole text; a null text's redacted text is null. Clashing names are refused."""
    if set(keep) & set(outputs):
        raise ValueError(f"kept columns clash with outputs: {sorted(set(keep) & set(outputs))}")
    schema = T.StructType([*(docs.schema[k] for k in keep), *(T.StructField(o, OUTPUTS[o]) for o in outputs)])
    kept, n = list(keep), len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n).to_pylist()
            found = [scan(t) for t in texts]
            bases = [listed(f) for f, _ in found]
            count = lambda kind: pa.array([sum(s[0] == kind for s in f) for f, _ in found], pa.int64())  # noqa: B023, E731
            made = {
                "n_assign": lambda: count("assign"),  # noqa: B023
                "n_access": lambda: count("access"),  # noqa: B023
                "n_hex": lambda: count("hex"),  # noqa: B023
                "base": lambda: pa.array(bases, pa.string()),  # noqa: B023
                "base_sha256": lambda: pa.array([hashlib.sha256(b.encode()).hexdigest() for b in bases], pa.string()),  # noqa: B023
                "spans": lambda: pa.array([listed(a) for _, a in found], pa.string()),  # noqa: B023
                "redacted": lambda: pa.array([redact(t, a) if t is not None else None for t, (_, a) in zip(texts, found, strict=True)], pa.string()),  # noqa: B023
            }
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(made[o]() for o in outputs)], names=[*kept, *outputs])

    return docs.select(*(docs[k] for k in keep), docs[text].alias("__text")).mapInArrow(work, schema)
