"""Word shingles of a text as hashes, and their SimHash."""

from __future__ import annotations

from itertools import repeat

import numpy as np

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """The XXH64 of every word shingle (A-Z lower-cased), repeats included; a shorter text is one shingle, no words are none."""
    import xxhash

    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)])) if len(words) >= shingle else iter([b" ".join(words)])
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, max(1, len(words) - shingle + 1))


def simhash(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 without hashes."""
    n = len(hashes)
    rows = np.ascontiguousarray(hashes).view(np.uint8).reshape(n, 8)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 32_768):
        votes += np.unpackbits(rows[i : i + 32_768], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])
