"""Exact length histogram: what a corpus costs at every context limit.

Documents are aggregated by encoded length, per group on request. Suffix sums
over the lengths then answer, for every limit at once: how many documents and
tokens lie at or above it, and what is left of the corpus if every document is
cut there. Lengths are summed in ranges of 1024, and the ranges among each other,
so no task holds all lengths of a large corpus.

Rows: null text counts as empty, length 0; a null group is a group of its own;
repeated rows count each; an empty table gives an empty histogram; other columns
are not read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.byte_bpe import encoder
from touchline.llm.common import map_chunks, stored

RANGE = 1024


def lengths(docs: DataFrame, path: str, by: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the group (`grp`, null without `by`) of every document."""
    group = docs[by].cast("string") if by else F.lit(None).cast("string")
    rows = docs.select(
        F.struct(docs[id_col].cast("long").alias("doc_id"), group.alias("grp")).alias("key"),
        docs[text_col].alias("text"),
    )

    def make():
        to_ids = encoder(path)
        return lambda keys, texts: {"key": keys, "n_tokens": [len(p) // 4 for p in to_ids(texts)]}

    out = map_chunks(rows, make, "key struct<doc_id: bigint, grp: string>, n_tokens long")
    return out.select("key.doc_id", "key.grp", "n_tokens")


def histogram(counted: DataFrame) -> DataFrame:
    """Per group and distinct length: documents of it, and the suffix sums.

    at_least_docs and at_least_tokens count documents of this length or more;
    truncated_tokens is the size of the corpus if documents are cut at this
    length; share_within is the part of the documents that this limit holds
    whole, so the q-quantile is the first length whose share reaches q.
    """
    bins = counted.groupBy("grp", "n_tokens").agg(F.count("*").alias("docs"))
    # Stored, as both sides of the join below read it: the texts are encoded once.
    bins = stored(
        bins.withColumns({"tokens": F.col("n_tokens") * F.col("docs"), "_range": F.floor(F.col("n_tokens") / RANGE)})
    )
    # A row per range of lengths: small however many documents there are.
    ranges = bins.groupBy("grp", "_range").agg(F.sum("docs").alias("_d"), F.sum("tokens").alias("_t"))
    every = W.partitionBy("grp")
    above = every.orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    ranges = ranges.select(
        F.col("grp").alias("_g"), "_range",
        F.coalesce(F.sum("_d").over(above), zero).alias("_d_above"),
        F.coalesce(F.sum("_t").over(above), zero).alias("_t_above"),
        F.sum("_d").over(every).alias("_docs"), F.sum("_t").over(every).alias("_tokens"),
    ).withColumnRenamed("_range", "_r")
    own = W.partitionBy("grp", "_range").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    sums = bins.withColumns({"_d_in": F.sum("docs").over(own), "_t_in": F.sum("tokens").over(own)})
    joined = sums.join(ranges, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    docs, tokens = F.col("_d_in") + F.col("_d_above"), F.col("_t_in") + F.col("_t_above")
    return joined.select(
        "grp", "n_tokens", "docs", "tokens",
        docs.alias("at_least_docs"), tokens.alias("at_least_tokens"),
        (F.col("_tokens") - tokens + F.col("n_tokens") * docs).alias("truncated_tokens"),
        ((F.col("_docs") - docs + F.col("docs")) / F.col("_docs")).alias("share_within"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """Per group and any limits (not only lengths that occur): documents over the
    limit, truncated total, and total."""
    wanted = hist.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    pairs = hist.join(F.broadcast(wanted))  # the caller's few limits
    over = F.col("n_tokens") > F.col("context")
    return pairs.groupBy("grp", "context").agg(
        F.sum(F.when(over, F.col("docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.least("n_tokens", "context") * F.col("docs")).alias("truncated_tokens"),
        F.sum("tokens").alias("tokens"),
    )


def quantiles(hist: DataFrame, qs: list[float]) -> DataFrame:
    """Per group: the smallest length that holds the share q of the documents."""
    wanted = hist.sparkSession.createDataFrame([(float(q),) for q in qs], "q double")
    held = hist.join(F.broadcast(wanted), F.col("share_within") >= F.col("q"))
    return held.groupBy("grp", "q").agg(F.min("n_tokens").alias("n_tokens"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return histogram(lengths(docs, public_tokenizers.path("byte_bpe_50k.json"), by="lang"))
