"""Session set-up and the few cluster settings that operators read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings, all overridable with spark.conf.set(...).
HOT_ROWS = "spark.touchline.hotGroupRows"  # a group above this is split over tasks
BROADCAST_ROWS = "spark.touchline.broadcastRows"  # largest side that may be broadcast
PAIR_ROWS = "spark.touchline.pairGroupRows"  # members of one group joined by one task
DEFAULTS = {HOT_ROWS: 1_000_000, BROADCAST_ROWS: 200_000, PAIR_ROWS: 2_000}


def build_session(cpus: str = "*", name: str = "touchline", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def setting(spark: SparkSession, key: str) -> int:
    return int(spark.conf.get(key, str(DEFAULTS[key])))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster.

    Only a local session without one gets a temporary folder: on a cluster a
    machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="touchline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for heavy row work if the input has fewer partitions than cores.

    Large inputs have more, and stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
