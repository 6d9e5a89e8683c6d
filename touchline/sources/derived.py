"""Domain tables derived from the test tables, in the same arithmetic as the checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BIN_HOURS = 24  # of the event panel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One match per order."""
    base = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS match_id",
        "o_orderdate AS kickoff",
        "CAST(year(o_orderdate) AS int) AS season",
        "o_orderkey % 5 AS league",
        "o_custkey % 18 AS hs",
        "(o_custkey % 18 + 1 + CAST(floor(o_orderkey / 5) AS bigint) % 17) % 18 AS aws",
        "CAST(round(o_totalprice * 100) AS bigint) AS c",
    )
    odd = "CASE WHEN c % 23 = 0 THEN NULL ELSE CAST({} + CAST(floor(c / {}) AS bigint) % {} AS double) / 100 END AS {}"
    return base.selectExpr(
        "match_id",
        "kickoff",
        "season",
        "league",
        "league * 100 + hs + 2 * (season - 1995) AS home_team",
        "league * 100 + aws + 2 * (season - 1995) AS away_team",
        "(c % 7) % 4 AS home_goals",
        "(CAST(floor(c / 7) AS bigint) % 5) % 3 AS away_goals",
        odd.format(120, 11, 200, "odds_h"),
        odd.format(250, 13, 130, "odds_d"),
        odd.format(140, 17, 300, "odds_a"),
    )


def ratings(m: DataFrame) -> DataFrame:
    """One rating per team and month of play."""
    return (
        m.select(
            F.explode(F.array("home_team", "away_team")).alias("team"),
            F.date_trunc("month", "kickoff").cast("timestamp_ntz").alias("valid_from"),
        )
        .distinct()
        .withColumn(
            "rating",
            F.expr("CAST(1400 + (team * 37 + month(valid_from) * 11 + year(valid_from)) % 200 AS double)"),
        )
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User x kind of event x day; time counts from a fixed date, so the panel grows with users and time."""
    hours = "datediff(ts, DATE '2024-01-01') * 24 + hour(ts)"
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("user_id").alias("subject"),
            F.col("event_type").alias("region"),
            F.expr(f"CAST(floor(({hours}) / {BIN_HOURS}) AS bigint)").alias("t"),
        )
        .agg(F.avg("value").alias("x"))
    )


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order (item) x supplier (member), a row per order line: `co_edges` counts a member of an item once."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("member"))


def shared_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part and month of shipping (item) x customer (member): customers share few items, at every size."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey"
    )
    month = "year(l_shipdate) * 12 + month(l_shipdate)"
    return lines.selectExpr(f"l_partkey * 100000 + {month} AS item", "o_custkey AS member").distinct()


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a register; every third one carries unfilled markers, some of them twice."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "CASE WHEN doc_id % 3 = 0 THEN concat('[FILL: key', doc_id % 5, '] ', text, ' [FILL: key', doc_id % 7, ']') ELSE text END AS text",
        "CASE doc_id % 3 WHEN 0 THEN 'cover' WHEN 1 THEN 'motivation' ELSE 'job' END AS register",
        "lang",
        "source",
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target texts, one per benchmark item."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("target_id"), F.col("text").alias("target_text")
    )


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded rows with a binary label: label 0 against the rest."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("features"),
        (F.col("label") == 0).cast("int").alias("label"),
    )
