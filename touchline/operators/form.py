"""Features of a team's past, all from rows strictly before the kick-off.

Every frame ends before the row's own time: ties at one kick-off do not see
each other. Hot teams are cut into chunks with the needed context in front.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.clock import DAY_US, micros
from touchline.functions.outcomes import points
from touchline.operators.skew import (
    BEFORE,
    CHUNK,
    HALO,
    attach_instants,
    busy_instants,
    dealt,
    has_hot_groups,
    split_hot,
    with_halo,
)

_TS = "_us"
MEASURES = ("points", "gf", "ga")


def last_n(
    t: DataFrame,
    keys: Sequence[str],
    spans: Sequence[int],
    measures: Sequence[str],
    tie: str = "match_id",
    prefix: str = "form",
    last_ts: str | None = None,
    grain: int = DAY_US,
    cold: bool = False,
) -> DataFrame:
    """Sums of `measures` over the last n earlier rows, for each n in `spans`.

    Adds `{prefix}{n}_{measure}` (null without history) and `{prefix}{n}_n_used`,
    and, if asked, the time of the latest earlier row. With running sums S by
    (time, tie) and k strictly earlier rows, the sum is S(k) - S(k - n).

    All rows of an instant have the same past, and of an instant only the last n rows
    can be in anyone's. So where very many rows share an instant, those n alone
    go through the windows, and the result is handed to every row of the instant.
    """
    rows = t.withColumn(_TS, micros("kickoff"))
    hot = not cold and has_hot_groups(rows, keys)
    busy = busy_instants(rows, keys, _TS) if hot else None
    if busy is not None:
        newest = W.partitionBy(*keys, _TS).orderBy(F.desc(tie))
        few = rows.withColumn("_at", F.row_number().over(newest)).filter(F.col("_at") <= max(spans)).drop("_at")
        done = _last_n(few, keys, spans, measures, tie, prefix, last_ts, grain, False)
        added = [c for c in done.columns if c not in rows.columns]
        past = done.groupBy(*keys, _TS).agg(*[F.first(c).alias(c) for c in added])
        return attach_instants(rows, past, keys, _TS, busy).select(*t.columns, *added)
    done = _last_n(rows, keys, spans, measures, tie, prefix, last_ts, grain, not hot)
    return done.select(*t.columns, *[c for c in done.columns if c not in rows.columns])


def _last_n(
    t: DataFrame, keys: Sequence[str], spans: Sequence[int], measures: Sequence[str], tie: str, prefix: str,
    last_ts: str | None, grain: int, cold: bool,
) -> DataFrame:
    rows, chunks = split_hot(t, keys, _TS, grain, cold)
    rows = with_halo(rows, chunks, [tie], max(spans))
    part = W.partitionBy(*chunks.part)
    in_order = part.orderBy(_TS, tie)
    by_time = part.orderBy(_TS)
    earlier = by_time.rangeBetween(W.unboundedPreceding, -1)
    peers = by_time.rangeBetween(0, 0)

    running = in_order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns(
        {"_rn": F.row_number().over(in_order)}
        | {f"_s_{m}": F.sum(m).over(running) for m in measures}
    )
    sums = F.struct(*[F.col(f"_s_{m}").alias(m) for m in measures])
    rows = rows.withColumns({f"_lag{n}": F.lag(sums, n + 1).over(in_order) for n in spans})
    rows = rows.withColumns(
        {"_k": (F.rank().over(by_time) - 1).cast("long")}
        | {f"_p_{m}": F.sum(m).over(earlier) for m in measures}
        # The first of the tied rows is the one whose lag ends at S(k - n).
        | {f"_b{n}": F.min_by(f"_lag{n}", "_rn").over(peers) for n in spans}
    )
    if last_ts:
        rows = rows.withColumn(last_ts, F.max("kickoff").over(earlier))
    rows = rows.filter(~F.col(HALO))
    out = {}
    for n in spans:
        for m in measures:
            base = F.coalesce(F.col(f"_b{n}.{m}"), F.lit(0))
            out[f"{prefix}{n}_{m}"] = F.when(F.col("_k") > 0, F.col(f"_p_{m}") - base)
        out[f"{prefix}{n}_n_used"] = F.least("_k", F.lit(n).cast("long"))
    rows = rows.withColumns(out)
    added = [*out, *([last_ts] if last_ts else [])]
    return rows.select(*t.columns, *added)


def _with_gd(df: DataFrame, spans: Sequence[int], prefix: str) -> DataFrame:
    gds = {f"{prefix}{n}_gd": F.col(f"{prefix}{n}_gf") - F.col(f"{prefix}{n}_ga") for n in spans}
    return df.withColumns(gds)


def rolling_form(
    t: DataFrame,
    n: int | Sequence[int],
    side: str | None = None,
    last_ts: str | None = None,
    cold: bool = False,
) -> DataFrame:
    """Points, goals for, against and difference over the last n matches.

    `side='H'` or `'A'` keeps that side's rows and counts only those;
    `side='own'` keeps all rows and counts, for each, the rows of its own side.
    """
    spans = [n] if isinstance(n, int) else list(n)
    keys, prefix = ["team"], "form"
    if side in ("H", "A"):
        t = t.filter(F.col("side") == side)
    elif side == "own":
        keys, prefix = ["team", "side"], "side"
    return _with_gd(last_n(t, keys, spans, MEASURES, prefix=prefix, last_ts=last_ts, cold=cold), spans, prefix)


def rest_days(t: DataFrame) -> DataFrame:
    """Days since the latest strictly earlier match; null without one."""
    rows = t.withColumn(_TS, micros("kickoff"))
    hot = has_hot_groups(rows, ["team"])
    busy = busy_instants(rows, ["team"], _TS) if hot else None
    if busy is None:
        return _rest(rows, not hot).select(*t.columns, "rest")
    instants = rows.groupBy("team", _TS).agg(F.max("kickoff").alias("kickoff")).withColumn("match_id", F.lit(0))
    found = _rest(instants, False).select("team", _TS, "rest")
    return attach_instants(rows, found, ["team"], _TS, busy).select(*t.columns, "rest")


def _rest(rows: DataFrame, cold: bool) -> DataFrame:
    rows, chunks = split_hot(rows, ["team"], _TS, DAY_US, cold)
    rows = with_halo(rows, chunks, ["match_id"], 1)
    earlier = W.partitionBy(*chunks.part).orderBy(_TS).rangeBetween(W.unboundedPreceding, -1)
    return rows.withColumn("rest", F.datediff("kickoff", F.max("kickoff").over(earlier)).cast("long")).filter(~F.col(HALO))


def matchday(t: DataFrame, cold: bool = False) -> DataFrame:
    """1 + matches of the team in the season strictly before this one."""
    keys = ["league", "season", "team"]
    rows = t.withColumn(_TS, micros("kickoff"))
    hot = not cold and has_hot_groups(rows, keys)
    busy = busy_instants(rows, keys, _TS) if hot else None
    if busy is not None:
        found = _counted_before(rows.groupBy(*keys, _TS).agg(F.count("*").alias("_c")), keys)
        found = found.select(*keys, _TS, (F.col("_earlier") + 1).alias("matchday"))
        return attach_instants(rows, found, keys, _TS, busy).select(*t.columns, "matchday")
    rows, chunks = split_hot(rows, keys, _TS, DAY_US, not hot)
    w = W.partitionBy(*chunks.part).orderBy(_TS)
    return (
        chunks.tag(rows)
        .withColumn("matchday", F.rank().over(w).cast("long") + F.col(BEFORE))
        .select(*t.columns, "matchday")
    )


def _counted_before(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`_earlier`: the sum of `_c` over the earlier instants of the key. Totals of chunks are carried on."""
    counts, chunks = split_hot(counts, keys, _TS, DAY_US)
    tagged = chunks.tag(counts)
    inside = W.partitionBy(*chunks.part).orderBy(_TS).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    out = tagged.withColumn("_earlier", F.coalesce(F.sum("_c").over(inside), zero))
    if chunks.table is None:
        return out
    sums = tagged.groupBy(*keys, CHUNK).agg(F.sum("_c").alias("_sum"))
    ahead = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(*keys, CHUNK, F.coalesce(F.sum("_sum").over(ahead), zero).alias("_carried"))
    return out.join(carried, [*keys, CHUNK]).withColumn("_earlier", F.col("_earlier") + F.col("_carried"))


def head_to_head(
    m: DataFrame, n: int = 3, last_ts: str | None = None, cold: bool = False, parts: int | None = None
) -> DataFrame:
    """Record over the last n meetings of the pair, from the home side's view."""
    first = F.least("home_team", "away_team")
    is_first = F.col("home_team") == first
    home_points, away_points = points("home_goals", "away_goals"), points("away_goals", "home_goals")
    pairs = m.withColumns(
        {
            "_p1": first,
            "_p2": F.greatest("home_team", "away_team"),
            # Sums are kept from the lower team's view, then turned.
            "pts1": F.when(is_first, home_points).otherwise(away_points),
            "pts2": F.when(is_first, away_points).otherwise(home_points),
            "g1": F.when(is_first, F.col("home_goals")).otherwise(F.col("away_goals")),
            "g2": F.when(is_first, F.col("away_goals")).otherwise(F.col("home_goals")),
        }
    )
    pairs = dealt(pairs, ["_p1", "_p2"], parts if cold else None)
    rows = last_n(pairs, ["_p1", "_p2"], [n], ["pts1", "pts2", "g1", "g2"], prefix="h2h", last_ts=last_ts, cold=cold)
    mine = F.col("home_team") == F.col("_p1")

    def turned(one: str, two: str):
        return F.when(mine, F.col(f"h2h{n}_{one}")).otherwise(F.col(f"h2h{n}_{two}"))

    return rows.select(
        *m.columns,
        turned("pts1", "pts2").alias(f"h2h{n}_points"),
        turned("g1", "g2").alias(f"h2h{n}_gf"),
        turned("g2", "g1").alias(f"h2h{n}_ga"),
        f"h2h{n}_n_used",
        *([last_ts] if last_ts else []),
    )


def promoted_flag(m: DataFrame) -> DataFrame:
    """(league, season, team, promoted): in the league now, not in the season before.

    Null if the league has no season right before, as in its first one.
    """
    now = m.select("league", "season", F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    before = now.select("league", (F.col("season") + 1).alias("season"), "team", F.lit(True).alias("_was"))
    held = m.select("league", (F.col("season") + 1).alias("season"), F.lit(True).alias("_held")).distinct()
    return (
        now.join(before, ["league", "season", "team"], "left")
        .join(held, ["league", "season"], "left")
        .select(
            "league",
            "season",
            "team",
            F.when(F.col("_held"), F.col("_was").isNull()).alias("promoted"),
        )
    )


def attach_sides(
    m: DataFrame, feats: DataFrame, columns: Sequence[str], diffs: Sequence[str] = (), parts: int | None = None
) -> DataFrame:
    """Put home and away features on the match row, with differences.

    `feats` has one row per (match_id, side). The two rows of a match meet in
    one aggregation, so both sides cost one shuffle.
    """
    sides = {"h": "H", "a": "A"}
    row = F.struct(*columns)
    packed = dealt(feats.select("match_id", "side", *columns), ["match_id"], parts).groupBy("match_id").agg(
        *[
            F.first(F.when(F.col("side") == code, row), ignorenulls=True).alias(f"_{s}")
            for s, code in sides.items()
        ]
    )
    wide = packed.select(
        "match_id", *[F.col(f"_{s}.{c}").alias(f"{c}_{s}") for c in columns for s in sides]
    )
    out = m.join(wide, "match_id", "left")
    return out.withColumns({f"{c}_diff": F.col(f"{c}_h") - F.col(f"{c}_a") for c in diffs})
