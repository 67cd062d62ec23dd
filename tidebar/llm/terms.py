"""Terms of whole texts in UTF-8: runs of ASCII letters (A-Z lower-cased), ASCII digits and all characters beyond ASCII."""

from __future__ import annotations

from collections.abc import Iterator

#: What bytes become: A-Z a-z, other ASCII than letters and digits a space.
_KEPT = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
#: Bytes that are split at once, so that a very long text isn't held as a list of words.
BLOCK = 1 << 20


def terms(text: bytes | memoryview | None) -> Iterator[list[bytes]]:
    """The terms of a text in lists of about BLOCK bytes of it; none for null."""
    data = bytes(text or b"").translate(_KEPT)
    if len(data) <= BLOCK:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


#: The same terms for DuckDB, of a column `text`.
SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
