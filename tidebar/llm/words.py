"""Words of whole texts as numpy arrays: their places in the bytes, 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: The separators: space and U+0009 to U+000D. All else belongs to words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUN_BASE = np.uint64(0xD1342543DE82EF95)
_SALT = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _inverse(odd: int) -> np.uint64:
    return np.uint64(pow(odd, -1, 2**64))


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as far as asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, _inverse(int(base))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, b, dtype=np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTES, _RUNS = _Powers(_BASE), _Powers(_RUN_BASE)


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words in these bytes."""
    space = np.empty(len(data) + 2, dtype=bool)
    space[0] = space[-1] = True
    np.take(_IS_SPACE, data, out=space[1:-1])
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    up, down = _BYTES.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_SALT[data] * up[:-1], out=total[1:])
    own = (total[end] - total[begin]) * down[begin]
    return mix(own + (end - begin).astype(np.uint64) * _RUN_BASE)


def runs(word: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words; none if there are fewer."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _RUNS.upto(len(word) + 1)
    total = np.zeros(len(word) + 1, dtype=np.uint64)
    np.cumsum(word * up[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    span, out = 1, x
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[width - span : width - span + n])


def blocks(texts: Sequence[bytes], size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` bytes together, at least one text each."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > size:
            yield at, i
            at, total = i, 0
        total += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def of_block(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, one space between them; begins and ends of all words; for each text the index of its first word, and one more for the end."""
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    begin, end = spans(data)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    first = np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))
    return data, begin, end, first
