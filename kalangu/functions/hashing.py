"""Seeded, engine-independent randomness derived from row keys.

A row's draw depends only on the seed and its key, so results do not change
with partitioning, retries or executor loss.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(key: Column, seed: int = 42) -> Column:
    """32 hex digits; sorting by them is a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def hash_to_unit(digest: Column) -> Column:
    """The first 32 bits of a hex digest as a double in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def seeded_uniform(key: Column, seed: int = 42) -> Column:
    return hash_to_unit(seeded_hash(key, seed))
