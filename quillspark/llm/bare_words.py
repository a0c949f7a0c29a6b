"""Words of letters and digits: A-Z lower-cased, ASCII punctuation, controls and space between words, all other code points part of them."""

from __future__ import annotations

#: The same as a pattern for texts that are lower-cased already.
BARE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def bare_words(raw: bytes) -> list[bytes]:
    """Words of UTF-8 bytes."""
    return raw.translate(TABLE).split()
