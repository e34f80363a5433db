"""Bounded samples by hash: the same rows whatever a table's layout, and as many of a billion rows as of a thousand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(wanted: int, n: int) -> int | None:
    """The least 64-bit hash that is not taken, if about ``wanted`` of n rows are to be; none if all are. It uses the whole range of hashes, so the share of rows has no least step."""
    return None if wanted >= n else -(1 << 63) + (wanted << 64) // n


def below(h: Column, limit: int | None) -> Column:
    return F.lit(True) if limit is None else h < F.lit(limit).cast("long")
