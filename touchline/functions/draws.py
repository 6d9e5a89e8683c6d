"""Pseudo-random numbers that depend on their keys alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def drawn(*parts: Column | str) -> Column:
    """A non-negative long from the keys, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 15), 16, 10).cast("long")
