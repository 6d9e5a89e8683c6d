"""As-of joins: for each left row, the last right row *strictly* earlier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.clock import DAY_US, micros
from touchline.operators.skew import HALO, attach_instants, busy_instants, dealt, has_hot_groups, split_hot, with_halo

_TS, _SIDE = "_us", "_side"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    grain: int = DAY_US,
    cold: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Left rows with the columns of the last earlier right row of the same keys.

    One union and one window, so one shuffle, and the result stays partitioned
    by the keys for windows that follow. A left row sorts before right
    rows of the same time and so never sees them. Of right rows with an equal
    time the greatest one wins. Where very many rows of a key share an instant, the
    join is done on one row per key and instant, and its result is handed to them.
    `parts` is the number of partitions of the window, if no key is hot.
    """
    keys = list(keys)
    values = [c for c in right.columns if c not in keys]
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    lefts = left.withColumns({_TS: micros(left_ts), _SIDE: F.lit(0)})
    rights = right.withColumns({_TS: micros(right_ts), _SIDE: F.lit(1)})
    both = lefts.unionByName(rights, allowMissingColumns=True)
    hot = not cold and has_hot_groups(both, keys)
    busy = busy_instants(both, keys, _TS) if hot else None
    if busy is None:
        both = both if hot else dealt(both, keys, parts)
        return _last_earlier(both, keys, values, grain, not hot).select(*left.columns, *values)
    at = [*keys, _TS]
    best = rights.groupBy(*at).agg(F.max(F.struct(*values)).alias("_best")).select(*at, "_best.*")
    instants = lefts.select(*at).distinct().withColumn(_SIDE, F.lit(0))
    collapsed = instants.unionByName(best.withColumn(_SIDE, F.lit(1)), allowMissingColumns=True)
    found = _last_earlier(collapsed, keys, values, grain, False).select(*at, *values)
    return attach_instants(lefts.drop(_SIDE), found, keys, _TS, busy).select(*left.columns, *values)


def _last_earlier(both: DataFrame, keys: Sequence[str], values: Sequence[str], grain: int, cold: bool) -> DataFrame:
    """The left rows (side 0) with the values of the last earlier right row (side 1)."""
    both, chunks = split_hot(both, keys, _TS, grain, cold)
    is_right = F.col(_SIDE) == 1
    rows = with_halo(both, chunks, [_SIDE, *values], 1, source=is_right)
    w = (
        W.partitionBy(*chunks.part)
        .orderBy(_TS, _SIDE, *values)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    hit = F.last(F.when(is_right, F.struct(*values)), ignorenulls=True).over(w)
    kept = [c for c in both.columns if c not in values]
    return (
        rows.withColumn("_hit", hit)
        .filter(~is_right & ~F.col(HALO))
        .select(*kept, *[F.col(f"_hit.{c}").alias(c) for c in values])
    )


def enrich_asof(m: DataFrame, feed: DataFrame, keys: Sequence[str], ts: str, prefix: str) -> DataFrame:
    """Attach an optional feed (weather, ratings, ...) known before kick-off.

    Whether the addition stays in the default model is for the ablation gate
    to say.
    """
    renamed = feed.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in feed.columns if c not in keys])
    return asof_join(m, renamed, keys, "kickoff", f"{prefix}{ts}")
