"""Words as byte strings, and 64-bit hashes of words and word windows, with numpy.

These are the small pieces that run inside Spark's tasks. A word is what ASCII
white space separates; hashes do not depend on the process or the machine.
"""

from __future__ import annotations

import numpy as np
import xxhash

# Odd multipliers that spread bits (golden ratio, and the two of a well-known 64-bit mixer).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)

# A-Z to a-z; and the same with ASCII punctuation made into spaces.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PLAIN = bytes(
    c if c >= 128 else (ord(chr(c).lower()) if chr(c).isalnum() else 32) for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z folded; punctuation belongs to its word."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Words with A-Z folded, where ASCII punctuation separates."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Hashes of words, each computed once while a task runs (the memory is given back when it is full)."""

    LIMIT = 150_000

    def __init__(self):
        self._known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        if len(known) > self.LIMIT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words; a shorter text is one run of all its words."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = mixed(out * GOLDEN + hashes[i:i + n])
    return out
