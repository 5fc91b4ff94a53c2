"""Stable hash fractions and split assignment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_fraction(c: Column) -> Column:
    """First 32 bits of the MD5 of a string as a fraction of their maximum, in [0, 1]."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)


def hash_split(c: Column, ratio: float, below: str, above: str) -> Column:
    """``below`` for the ``ratio`` of ids with the smallest fraction, else ``above``; null for a null id."""
    return F.when(md5_fraction(c) < F.lit(ratio), below).when(c.isNotNull(), above)


def seeded(c: Column, seed: int) -> Column:
    """Reproducible pseudo-random order of ids: the first 60 bits of an MD5 with the seed; null for a null id."""
    return F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 15), 16, 10).cast("long")
