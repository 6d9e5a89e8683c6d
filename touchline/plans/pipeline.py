"""From raw match files to reports, stage by stage; every stage is a table of its own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.quality import apply_exclusions, flag_repeats, input_rules
from touchline.operators.scoring import metric_table
from touchline.plans.backtest import MODELS, backtest
from touchline.plans.features import build_features
from touchline.sources.matches import MATCH_SCHEMA, mark_scope
from touchline.sources.stages import read_stage, write_report, write_stage

TABLES = ("matches", "ledger", "features", "scored")


def prepare(raw: DataFrame, leagues: Sequence[int] | None = None, n: int = 12) -> tuple[DataFrame, DataFrame]:
    """(kept, ledger) of match rows with `_malformed` and `source_file`. Every input row is in
    exactly one of both; the ledger has a row per reason."""
    good = F.col("_malformed").isNull()
    # A line that could not be read must not count as somebody's fixture or season.
    marked = flag_repeats(mark_scope(raw.filter(good), leagues, n)).unionByName(
        raw.filter(~good).withColumns({"in_scope": F.lit(True), "is_repeat": F.lit(False)})
    )
    kept, ledger = apply_exclusions(marked, input_rules(), ["match_id", "source_file", "_malformed"])
    return kept.select(*MATCH_SCHEMA.names), ledger.withColumnRenamed("_malformed", "line")


def run(
    raw: DataFrame,
    ratings: DataFrame,
    folder: str,
    leagues: Sequence[int] | None = None,
    n: int = 12,
    n_folds: int = 5,
    models: Sequence[str] = MODELS,
    grid: Sequence[Mapping[str, float]] = (),
) -> DataFrame:
    """Write all tables and the report below `folder`; returns the report's metric table."""
    spark = raw.sparkSession
    kept, ledger = prepare(raw, leagues, n)
    write_stage(kept, f"{folder}/matches")
    ledger.write.mode("overwrite").partitionBy("rule").parquet(f"{folder}/ledger")
    # Partition values come back as what they look like.
    types = {f.name: f.dataType for f in MATCH_SCHEMA.fields}
    m = read_stage(spark, f"{folder}/matches").select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])
    write_stage(build_features(m, ratings), f"{folder}/features")
    write_stage(backtest(m, ratings, n_folds, models, grid=grid), f"{folder}/scored", ["model"])
    report = metric_table(read_stage(spark, f"{folder}/scored"))
    write_report(report, f"{folder}/report")
    return report
