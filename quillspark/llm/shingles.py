"""Word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_ROWS = 400_000
MULT, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Bytes of a text -> sorted distinct hashes of its runs of `width` words; a shorter text is one shingle, one without words none."""

    def __init__(self, width: int = 5):
        self.width, self.cache = width, {}

    def words(self, text: bytes) -> np.ndarray:
        ws = text.split()
        if len(self.cache) > CACHE_ROWS:
            self.cache = {}
        cache = self.cache
        try:
            raw = b"".join([cache[w] for w in ws])
        except KeyError:
            new = {w: xxhash.xxh64_digest(w) for w in {w for w in ws if w not in cache}}
            cache.update((w, h) for w, h in new.items() if len(w) <= 64)
            raw = b"".join([cache[w] if w in cache else new[w] for w in ws])
        return np.frombuffer(raw, np.uint64)

    def __call__(self, text: bytes) -> np.ndarray:
        w = self.words(text)
        if not len(w):
            return w
        width = min(self.width, len(w))
        h = w[: len(w) - width + 1].copy()
        for k in range(1, width):
            h = h * MULT + w[k : len(w) - width + 1 + k]
        return np.unique(mixed(h + np.uint64(width)))
