"""Seeded randomness as a pure function of (seed, row key).

``rand()`` depends on how rows are laid out over partitions; an md5 digest of
seed and key does not, so a lost task or another cluster size draws the same
rows. Only integers and strings are hashed, never the text form of a double.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def digest(seed: object, key: Column) -> Column:
    """32 hex digits; their text order is a random order of the keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash32(seed: object, key: Column) -> Column:
    """Integer in [0, 2**32) from the first eight digits of the digest."""
    return F.conv(F.substring(digest(seed, key), 1, 8), 16, 10).cast("long")


def uniform(seed: object, key: Column) -> Column:
    """Double in [0, 1)."""
    return hash32(seed, key) / F.lit(float(HASH_RANGE))


def hash32_of(text: str) -> int:
    """The same integer as ``hash32`` for a value known on the driver."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
