"""Seeded randomness that does not depend on partitioning.

``rand`` and ``randn`` draw from a per-partition generator, so their values
change with the layout of the data. Everything here hashes the row's own key,
so a row draws the same number under any layout and after any task retry.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# 8 hex digits of an md5 are 32 bits.
_HEX_DIGITS = 8
_RANGE = float(16**_HEX_DIGITS)


def key_hash(*parts) -> Column:
    """md5 of the parts joined by ``:``; columns or literals."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def uniform_from_hash(digest: Column, lane: int = 0) -> Column:
    """A uniform double in [0, 1) from one of the four 32-bit lanes of an md5."""
    start = lane * _HEX_DIGITS + 1
    return F.conv(F.substring(digest, start, _HEX_DIGITS), 16, 10).cast("double") / F.lit(_RANGE)


def uniform(*parts) -> Column:
    return uniform_from_hash(key_hash(*parts))


def hash_int(*parts) -> Column:
    """A non-negative 32-bit number, as bigint."""
    return F.conv(F.substring(key_hash(*parts), 1, _HEX_DIGITS), 16, 10).cast("bigint")
