"""Deterministic draws: every random choice is a hash of a seed and a stable key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts) -> Column:
    """An integer in [0, 2^32) from the MD5 of the parts joined by ``|``."""
    key = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def uniform01(*parts) -> Column:
    """A number in [0, 1)."""
    return hash32(*parts) / F.lit(4294967296.0)
