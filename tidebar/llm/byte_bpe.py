"""Byte-level BPE ids of whole texts, as the tokenizers library gives them.

tiktoken encodes with the same vocabulary several times as fast; texts that its backtracking can't split (a million spaces in a row, say) go through the
tokenizers library, as all do where there are no ranks of the vocabulary. Both give equal ids (`tests/llm/test_packing.py` compares them). Special
tokens' strings in a text are special tokens.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Turns a text (null: empty) into its ids.
Encode = Callable[[str | None], np.ndarray]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_beside(path: str) -> str | None:
    """The file of the same vocabulary as ranks, if there is one beside the tokenizers library's file."""
    beside = path.removesuffix(".json") + ".tiktoken"
    return beside if os.path.exists(beside) else None


@lru_cache(maxsize=2)
def encoder(path: str) -> Encode:
    """One encoder for each worker and file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    library = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))
    by_library = lambda text: np.array(library().encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    beside = ranks_beside(path)
    if beside is None:
        return lambda text: by_library(text or "")
    import public_tokenizers
    import tiktoken

    with open(beside, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    special = {t.content: i for i, t in library().get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special).encode_to_numpy

    def encode(text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        try:
            return fast(text, allowed_special="all")
        except ValueError:
            return by_library(text)

    return encode


def bytes_of(width: int = 4, path: str | None = None) -> Callable[[], Callable[[str | None], bytes]]:
    """Makes, once in a task, what turns a text into the bytes of its ids of `width` bytes each, little-endian."""
    path = path or default_path()

    def made() -> Callable[[str | None], bytes]:
        encode, most = encoder(path), 1 << 8 * width

        def fitted(text: str | None) -> bytes:
            ids = encode(text)
            if len(ids) and int(ids.max()) >= most:
                raise ValueError(f"an id needs more than {width} bytes")
            return ids.astype(f"<u{width}").tobytes()

        return fitted

    return made
