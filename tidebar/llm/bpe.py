"""Byte-pair encoding and decoding of whole texts.

Encoder: a longest-match automaton proposes a token, a table of compatible token pairs accepts or rejects its neighbourhood, and a rejected token
gives way to its next shorter prefix. Each position is settled once (a bit per position marks dead ends), so a word costs linear time, and the
result equals that of replaying the merges in order. Words repeat, so results are kept by white-space-free chunk in a bounded table.

Decoder: one byte string holds all tokens, an offset table says where each begins, and ids are decoded by a single gather.

The splitting pattern runs on the regex module: characters that Unicode assigned after the tokenizers library was built may split differently.

Null texts count as empty; empty texts have no ids. Repeated rows, ties and extra columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Marks the end of a word inside the automaton; private use, never a byte-level glyph.
END = "\ue000"
#: Chunks, and words in them, whose ids are kept in a generation.
KEPT_CHUNKS, KEPT_WORDS = 40_000, 120_000
#: Pairs of tokens whose compatibility is kept.
KEPT_PAIRS = 300_000
#: Whether the machine writes integers as ids are written.
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Separators that str.split() knows and the tokenizer's \s doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_glyphs() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: printable Latin-1 stands for itself, the rest from U+0100 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


class WordBpe:
    """The tokenizer of a tokenizers-library file with byte-level BPE inside words and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.space = regex.compile(r"\s+")
        self.glyphs = dict(enumerate(byte_glyphs()))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")").split if self.special else None
        self._load(model)
        self.chunks = _Kept(self.encode_chunk, KEPT_CHUNKS)
        #: ids of words; chunks are words with signs around them
        self.kept = _Kept(self.encode_kept, KEPT_WORDS)

    def _marked(self, token: str) -> str:
        return token[: -len(self.suffix)] + END if self.suffix and token.endswith(self.suffix) else token

    def _load(self, model: dict) -> None:
        vocab: dict[str, int] = model["vocab"]
        self.ids = {self._marked(t): i for t, i in vocab.items()}
        self.sizes = {i: len(t) for t, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[left + right]
            key = (vocab[left], vocab[right])
            self.rank[key], self.merged[key] = r, whole
            self.parts.setdefault(whole, key)
        # tokens that no merge makes and that are longer than a symbol can't come out of the merges
        self.automaton = ahocorasick.Automaton()
        usable = [(t, i) for t, i in self.ids.items() if i in self.parts or len(t.rstrip(END)) == 1]
        for t, i in usable:
            self.automaton.add_word(t, (len(t) - 1, i))
        self.automaton.make_automaton()
        #: for each token the longest usable token that is a proper prefix of it, or -1
        known = dict(usable)
        self.shorter = {i: next((known[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in known), -1) for t, i in usable}
        #: whether tokens can stand side by side, by both ids in one number
        self.fits: dict[int, bool] = {}
        # decoding: every token with a space behind it, in one byte string
        highest = max([*vocab.values(), *self.special.values()])
        names = [b""] * (highest + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            names[i] = t.encode() + b" "
        self.offsets = np.concatenate([[0], np.cumsum([len(n) for n in names])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(names), dtype=np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side: no merge across their border would have come before those that made them."""
        known = self.fits.get(left << 20 | right)
        if known is None:
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            known = self.fits[left << 20 | right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undoes the merges of the pair from the last to the first; a border merge that ranks before the one being undone would have won."""
        limit = len(self.rank) + 1
        a, b = left, right
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < limit:
                return False
            pa_, pb = self.parts.get(a), self.parts.get(b)
            ra = self.rank[pa_] if pa_ else -1
            rb = self.rank[pb] if pb else -1
            if ra < 0 and rb < 0:
                return True
            if ra >= rb:  # at equal ranks the left one is merged first, so the right one is undone first
                if ra == rb:
                    limit, b = rb + 0, pb[0]
                    # the left token of the same rank was complete by then: its border merge loses only to lower ranks
                    continue
                limit, a = ra, pa_[1]
            else:
                limit, b = rb + 1, pb[0]

    def longest(self, word: str) -> list[int]:
        """For each position the longest token that begins there: matches come by their ends, so of one beginning the longest comes last."""
        best = [-1] * len(word)
        for end, (back, token) in self.automaton.iter(word):
            best[end - back] = token
        return best

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word given in byte glyphs, without its end mark."""
        marked = word + END if self.suffix else word
        whole = self.ids.get(marked)
        if whole is not None and (whole in self.parts or len(word) == 1) and self._reachable(whole):
            return [whole]
        first, n = self.longest(marked), len(marked)
        sizes, shorter, fits, compatible = self.sizes, self.shorter, self.fits, self.compatible
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token, last = 0, first[0], -1
        while True:
            while token >= 0:
                end = at + sizes[token]
                if alive[end]:
                    if last < 0:
                        break
                    known = fits.get(last << 20 | token)
                    if known or (known is None and compatible(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, first[end]
                continue
            # nothing fits here: the position is dead, and the token before gives way to a shorter one
            alive[at] = 0
            if not out:
                raise ValueError(f"word can't be encoded: {word!r}")
            gone = out.pop()
            last = out[-1] if out else -1
            at -= sizes[gone]
            token = shorter[gone]

    @lru_cache(maxsize=100_000)  # noqa: B019  one tokenizer lives as long as its worker
    def _reachable(self, token: int) -> bool:
        """Whether the merges turn the token's own text into that token."""
        if token not in self.parts:
            return True
        left, right = self.parts[token]
        return self._reachable(left) and self._reachable(right) and self._joins(left, right)

    def _joins(self, left: int, right: int) -> bool:
        """Whether nothing across the border is merged before the pair itself is."""
        limit, a, b = self.rank[(left, right)], left, right
        first = True
        bound = len(self.rank) + 1
        while True:
            r = self.rank.get((a, b))
            if not first and r is not None and r < min(bound, limit):
                return False
            first = False
            pa_, pb = self.parts.get(a), self.parts.get(b)
            ra = self.rank[pa_] if pa_ else -1
            rb = self.rank[pb] if pb else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                bound, a = ra, pa_[1]
            else:
                bound, b = rb + (ra != rb), pb[0]

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit integers, of a normalised chunk without white space."""
        own = self.words(chunk)
        return self.kept[own[0]] if len(own) == 1 else b"".join(map(self.kept.__getitem__, own))

    def forget(self) -> None:
        """Empties what is kept between texts, so that an idle worker holds the vocabulary alone."""
        for kept in (self.chunks, self.chunks.older, self.kept, self.kept.older, self.fits):
            kept.clear()

    def encode_kept(self, word: str) -> bytes:
        ids = self.encode_word(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.glyphs))
        return array("I", ids).tobytes() if LITTLE else np.array(ids, dtype="<u4").tobytes()

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character alone: no final sigma
        return text.lower()

    def _encode_plain(self, text: str) -> bytes:
        text = self.normalise(text)
        chunks = self.space.split(text) if _ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; special tokens in the text count as such."""
        if not text:
            return b""
        if self.split_special is None or "<|" not in text:
            return self._encode_plain(text)
        parts = self.split_special(text)
        return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if k % 2 else self._encode_plain(p) for k, p in enumerate(parts))

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        """The tokens' own texts, joined by one space, in UTF-8."""
        ids = np.frombuffer(ids, dtype="<u4") if isinstance(ids, bytes) else np.asarray(ids)
        if not len(ids):
            return b""
        ids = ids.astype(np.int64)
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        begin = np.cumsum(size) - size
        total = int(begin[-1] + size[-1])
        where = np.repeat(start - begin, size)
        where += np.arange(total)
        return self.blob[where[:-1]].tobytes()


class _Kept(dict):
    """Results by text, in two generations: when the younger one is full it becomes the older one, of which what is still in use comes back."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.make(text)
            if len(text) >= 100:
                return ids
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[text] = ids
        return ids


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """One tokenizer for each worker and file."""
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder_of(width: int = 4, path: str | None = None) -> Callable[[], Callable[[str | None], bytes]]:
    """Makes what encodes a text to ids of `width` bytes, little-endian; ids must fit. To be called in a task."""
    path = path or default_path()

    def made() -> Callable[[str | None], bytes]:
        encode = tokenizer(path).encode
        if width == 4:
            return encode
        if len(tokenizer(path).offsets) - 1 > 1 << 8 * width:
            raise ValueError(f"the vocabulary's ids need more than {width} bytes")
        return lambda text: np.frombuffer(encode(text), dtype="<u4").astype(f"<u{width}").tobytes()

    return made


#: What encode_decode() can add to each row.
OUTPUTS = {"n_tokens": T.LongType(), "ids": T.BinaryType(), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
#: Rows worked on at once, so that a batch of very long texts stays small.
ROWS_AT_ONCE = 256


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """docs' `keep` columns with the chosen OUTPUTS of each whole text: ids are little-endian unsigned 32-bit, decoded is the ids' own text.

    Rows stay rows (null text: no ids). A kept column that has an output's name is refused.
    """
    if set(keep) & set(outputs):
        raise ValueError(f"kept columns clash with outputs: {sorted(set(keep) & set(outputs))}")
    path = path or default_path()
    schema = T.StructType([*(docs.schema[k] for k in keep), *(T.StructField(o, OUTPUTS[o]) for o in outputs)])
    decodes = "decoded" in outputs or "decoded_sha256" in outputs
    kept = list(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                    batch = whole.slice(at, ROWS_AT_ONCE)
                    ids = [bpe.encode(t) for t in batch.column(len(kept)).to_pylist()]
                    back = [bpe.decode(i) for i in ids] if decodes else []
                    made = {
                        "n_tokens": lambda i=ids: pa.array([len(x) // 4 for x in i], pa.int64()),
                        "ids": lambda i=ids: pa.array(i, pa.binary()),
                        "decoded": lambda b=back: pa.array([x.decode() for x in b], pa.string()),
                        "ids_sha256": lambda i=ids: pa.array([hashlib.sha256(x).hexdigest() for x in i], pa.string()),
                        "decoded_sha256": lambda b=back: pa.array([hashlib.sha256(x).hexdigest() for x in b], pa.string()),
                    }
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(made[o]() for o in outputs)], names=[*kept, *outputs])
        finally:
            bpe.forget()

    return docs.select(*(docs[k] for k in keep), docs[text].alias("__text")).mapInArrow(work, schema)
