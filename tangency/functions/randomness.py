"""Uniform variates that are functions of a key: the same on every run, partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts: object) -> Column:
    """Parts joined by ':'; strings that are not columns are literals."""
    return F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts])


def digest(*parts: object) -> Column:
    """Hex digest to order by."""
    return F.md5(key(*parts).cast("binary"))


def uniform(*parts: object) -> Column:
    """In [0, 1): the first 32 bits of the digest."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
