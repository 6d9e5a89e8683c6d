"""Time columns as numbers, so that strict frames can be RANGE frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch (a cast to long would cut to seconds)."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))
