"""Building blocks that keep hot groups out of a single task.

A window over an entity, or a self-join on a shared item, puts a whole group
into one task. Groups above a configured size are found with one map-side
combined count and are then split: ordered groups into *chunks* of time with a
few rows of context in front, pair groups into salted parts. Groups below the
limit take the plain plan at no extra shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.session import BROADCAST_ROWS, HOT_ROWS, PAIR_ROWS, cut_lineage, setting

CHUNK = "_chunk"
HALO = "_halo"
_CELL = "_cell"
BEFORE = "_before"


def checked_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast hint if the frame is below the row limit, else the frame as it is."""
    limit = setting(df.sparkSession, BROADCAST_ROWS)
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys with more than `limit` rows and their row count `_rows`, or None."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > limit)
    small = setting(df.sparkSession, BROADCAST_ROWS)
    n = hot.limit(small + 1).count()
    if n == 0:
        return None
    return F.broadcast(hot) if n <= small else hot


TASK_ROWS = 50_000  # that windows and wide aggregates should meet in one task


@dataclass(frozen=True)
class Chunks:
    """How the hot groups of `keys` are cut along `order` (None: no hot group)."""

    keys: tuple[str, ...]
    order: str
    grain: int
    table: DataFrame | None

    @property
    def part(self) -> list[str]:
        """Window partition: without hot groups the keys alone, so that windows on
        the same or on longer keys share one shuffle."""
        return list(self.keys) if self.table is None else [*self.keys, CHUNK]

    def cell(self) -> Column:
        return F.floor(F.col(self.order) / F.lit(self.grain)).cast("long")

    def tag(self, df: DataFrame, how: str = "left") -> DataFrame:
        """Add the chunk number and the number of group rows before the chunk."""
        if self.table is None:
            zero = F.lit(0).cast("long")
            return df.withColumns({CHUNK: zero, BEFORE: zero})
        return (
            df.withColumn(_CELL, self.cell())
            .join(self.table, [*self.keys, _CELL], how)
            .withColumn(CHUNK, F.coalesce(CHUNK, F.lit(0).cast("long")))
            .withColumn(BEFORE, F.coalesce(BEFORE, F.lit(0).cast("long")))
            .drop(_CELL)
        )


def task_parts(rows: int) -> int | None:
    """Shuffle partitions for windows and wide aggregates over so many rows, or None for
    few rows. A given number is not merged to a few large tasks, whose sorts would grow with the input."""
    parts = rows // TASK_ROWS
    return parts if parts > 1 else None


def dealt(df: DataFrame, keys: Sequence[str], parts: int | None) -> DataFrame:
    """The rows by their keys in that many partitions; as they are for None."""
    return df if parts is None else df.repartition(parts, *keys)


def has_hot_groups(df: DataFrame, keys: Sequence[str]) -> bool:
    return hot_groups(df, keys, setting(df.sparkSession, HOT_ROWS)) is not None


def split_hot(
    df: DataFrame, keys: Sequence[str], order: str, grain: int, cold: bool = False
) -> tuple[DataFrame, Chunks]:
    """The rows and how their hot groups are cut. If there are any, the rows are stored
    first: cutting, context and windows all read them, and operators may follow each other."""
    if not cold and hot_groups(df, keys, setting(df.sparkSession, HOT_ROWS)) is not None:
        df = cut_lineage(df)
        return df, plan_chunks(df, keys, order, grain)
    return df, Chunks(tuple(keys), order, grain, None)


def plan_chunks(
    df: DataFrame, keys: Sequence[str], order: str, grain: int, cold: bool = False
) -> Chunks:
    """Cut every hot group into runs of about `hotGroupRows` rows.

    `order` is a long column. Rows of one group within one `grain` of it stay
    together, so rows with an equal order value always share a chunk; a grain
    that holds too many rows is made finer. `cold` says that the caller has checked these or shorter keys and found none hot.
    """
    keys = tuple(keys)
    if cold:
        return Chunks(keys, order, grain, None)
    limit = setting(df.sparkSession, HOT_ROWS)
    hot = hot_groups(df, keys, limit)
    if hot is None:
        return Chunks(keys, order, grain, None)
    rows = df.select(*keys, order).join(hot.drop("_rows"), list(keys), "left_semi")
    # One row per key and value of the order: all that the cuts depend on.
    counted = cut_lineage(rows.groupBy(*keys, order).agg(F.count("*").alias("_c")))
    while True:
        cell = F.floor(F.col(order) / F.lit(grain)).cast("long").alias(_CELL)
        cells = counted.groupBy(*keys, cell).agg(F.sum("_c").alias("_n"), F.count("*").alias("_values"))
        # A cell of one value cannot be cut, however fine the grain; others can.
        if grain <= 1 or cells.filter((F.col("_n") > limit) & (F.col("_values") > 1)).isEmpty():
            break
        grain = max(grain // 60, 1)  # too much happens within one grain
    # At most as many cells as the key has different values of the order.
    earlier = W.partitionBy(*keys).orderBy(_CELL).rowsBetween(W.unboundedPreceding, -1)
    table = cells.withColumn("_sum", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn(
        CHUNK, F.floor(F.col("_sum") / F.lit(limit)).cast("long")
    )
    table = table.withColumn(
        BEFORE, F.min("_sum").over(W.partitionBy(*keys, CHUNK)).cast("long")
    ).select(*keys, _CELL, CHUNK, BEFORE)
    return Chunks(keys, order, grain, checked_broadcast(cut_lineage(table)))


def busy_instants(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame | None:
    """Values of `order` that more than `hotGroupRows` rows of a key share, and `_parts`, over
    how many parts these are spread. Chunks cannot cut them. None if there are none."""
    limit = setting(df.sparkSession, HOT_ROWS)
    found = hot_groups(df.select(*keys, order), [*keys, order], limit)
    if found is None:
        return None
    return checked_broadcast(
        cut_lineage(found.select(*keys, order, F.ceil(F.col("_rows") / F.lit(limit)).cast("int").alias("_parts")))
    )


def attach_instants(
    df: DataFrame, values: DataFrame, keys: Sequence[str], order: str, busy: DataFrame
) -> DataFrame:
    """Each row with the values of its (keys, order), of which `values` has one row.

    Rows of a busy instant are spread over its parts by a hash of all their columns,
    and its one row of values is sent to every part. Null keys meet null keys.
    """
    on = [*keys, order]
    added = [c for c in values.columns if c not in on]
    renamed = {c: f"_on_{i}" for i, c in enumerate(on)}

    def parted(rows: DataFrame) -> DataFrame:
        known = busy.select(*[F.col(c).alias(f"_busy_{i}") for i, c in enumerate(on)], "_parts")
        same = [F.col(c).eqNullSafe(F.col(f"_busy_{i}")) for i, c in enumerate(on)]
        joined = rows.join(known, same, "left").drop(*[f"_busy_{i}" for i in range(len(on))])
        return joined.withColumn("_parts", F.coalesce("_parts", F.lit(1)))

    left = parted(df).withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.col("_parts")).cast("int"))
    right = parted(values).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    right = right.select(*[F.col(c).alias(n) for c, n in renamed.items()], F.col("_part").alias("_to"), *added)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in renamed.items()]
    return left.join(right, [*same, F.col("_part") == F.col("_to")], "left").select(*df.columns, *added)


def with_halo(
    df: DataFrame, chunks: Chunks, ties: Sequence[str], n: int, source: Column | None = None
) -> DataFrame:
    """Tag rows with their chunk and put the last `n` earlier rows in front of each chunk.

    Context rows carry `_halo = true` and are dropped by the caller once the
    window columns are computed. `source` restricts which rows serve as context.
    """
    tagged = chunks.tag(df).withColumn(HALO, F.lit(False))
    if chunks.table is None:
        return tagged
    columns = [c for c in tagged.columns if c not in (CHUNK, HALO)]
    part = [*chunks.keys, CHUNK]
    newest = [F.desc(chunks.order), *[F.desc(c) for c in ties]]
    context = chunks.tag(df, "inner")
    if source is not None:
        context = context.filter(source)
    # row_number() <= n is cut before the shuffle, so only n rows per chunk and task move.
    tail = context.withColumn(
        "_rn", F.row_number().over(W.partitionBy(*part).orderBy(*newest))
    ).filter(F.col("_rn") <= n)
    # Each chunk asks for the n tail rows in front of it. A marker row per chunk
    # also covers chunks that hold no context row themselves.
    marks = chunks.table.groupBy(*part).agg((F.min(_CELL) * chunks.grain).alias("_start"))
    rows = tail.select(
        *chunks.keys, F.col(CHUNK), F.struct(*columns).alias("_row"), F.lit(1).alias("_kind"),
        F.col(chunks.order).alias("_pos"), *[F.col(c).alias(f"_tie_{c}") for c in ties],
    )
    marks = marks.select(
        *chunks.keys, F.col(CHUNK), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"),
        F.lit(0).alias("_kind"), F.col("_start").alias("_pos"),
    )
    both = rows.unionByName(marks, allowMissingColumns=True)
    # Tail rows are numbered per key; a marker knows how many lie before its chunk.
    w = W.partitionBy(*chunks.keys).orderBy(CHUNK, "_kind", "_pos", *[f"_tie_{c}" for c in ties])
    both = both.withColumn(
        "_seq", F.sum("_kind").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    seen = both.filter("_kind = 1").withColumnRenamed("_seq", "_at")
    want = both.filter("_kind = 0").select(
        *chunks.keys, CHUNK, F.explode(F.sequence(F.col("_seq") - n + 1, F.col("_seq"))).alias("_at")
    )
    halo = want.join(seen.drop(CHUNK), [*chunks.keys, "_at"]).select(
        CHUNK, F.col("_row.*"), F.lit(True).alias(HALO)
    )
    return tagged.unionByName(halo)


def number_within(df: DataFrame, keys: Sequence[str], order: str, grain: int, name: str) -> DataFrame:
    """Row number from 0 within `keys` by the unique long `order`, hot groups split."""
    df, chunks = split_hot(df, keys, order, grain)
    w = W.partitionBy(*chunks.part).orderBy(order)
    return (
        chunks.tag(df)
        .withColumn(name, F.row_number().over(w).cast("long") - 1 + F.col(BEFORE))
        .drop(CHUNK, BEFORE)
    )


def totals_before(df: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """Add `<c>_before`: the sum of `c` over all rows with a lower `order` (unique, not null).

    The rows are stored in ranges of the order, one or more of about `hotGroupRows`
    rows; no task sorts them all, and the totals per range are carried over. NaN is
    the greatest value, infinities are values like any other.
    """
    limit = setting(df.sparkSession, HOT_ROWS)
    rows = cut_lineage(df)
    parts = rows.count() // limit + 1
    cut = cut_lineage(
        rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id())
    )
    w = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    out = cut.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(w), zero) for c in columns})
    # One row per part.
    sums = cut.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    over = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        "_part", *[F.coalesce(F.sum(f"_t_{c}").over(over), zero).alias(f"_o_{c}") for c in columns]
    )
    out = out.join(checked_broadcast(offsets), "_part")
    return out.withColumns(
        {f"{c}_before": F.col(f"{c}_before") + F.col(f"_o_{c}") for c in columns}
    ).drop("_part", *[f"_o_{c}" for c in columns])


def pairs_within(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Pairs a < b of rows that share `keys`; every other column comes as `<c>_a`, `<c>_b`.

    A key with many members is split: its left rows are spread over salts and
    its right rows are sent to every salt, so no task joins more than
    `pairGroupRows` left rows of one key.
    """
    keys = list(keys)
    limit = setting(df.sparkSession, PAIR_ROWS)
    others = [c for c in df.columns if c not in keys]
    left = df.select(*keys, *[F.col(c).alias(f"{c}_a") for c in others])
    right = df.select(*keys, *[F.col(c).alias(f"{c}_b") for c in others])
    hot = hot_groups(df, keys, limit)
    on = list(keys)
    if hot is not None:
        parts = hot.select(*keys, F.ceil(F.col("_rows") / F.lit(limit)).cast("int").alias("_parts"))
        n = F.coalesce("_parts", F.lit(1))
        left = left.join(parts, keys, "left").withColumn(
            "_salt", F.pmod(F.xxhash64(f"{member}_a"), n).cast("int")
        ).drop("_parts")
        right = right.join(parts, keys, "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
        ).drop("_parts")
        on.append("_salt")
    pairs = left.join(right, on).filter(F.col(f"{member}_a") < F.col(f"{member}_b"))
    return pairs.drop("_salt")

