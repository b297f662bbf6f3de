"""Seeded hashes: every draw in the package is a function of (seed, key) and of nothing else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int | str, *keys: Column | str) -> Column:
    """``md5('seed:key')`` as hex text: the same in any partitioning, order or engine. Never null."""
    parts: list[Column] = [F.lit(str(seed))]
    for key in keys:
        column = F.col(key) if isinstance(key, str) else key
        parts += [F.lit(":"), F.coalesce(column.cast("string"), F.lit(""))]
    return F.md5(F.concat(*parts))


def hash_number(hex_text: Column) -> Column:
    """The first 60 bits of a hex hash as a non-negative bigint."""
    return F.conv(F.substring(hex_text, 1, 15), 16, 10).cast("bigint")
