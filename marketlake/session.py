"""Session helpers: defaults every job in this package relies on.

Nothing here creates a global session behind the caller's back; ``build_session`` is
for tests, the bench and scripts, ``ensure_defaults`` pins what correctness needs
(UTC session time) on a session somebody else built.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "marketlake") -> SparkSession:
    """Session for tests / bench. On a cluster use the cluster's own builder."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # runtime (measured) broadcast decision for data-dependent small sides
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_defaults(spark)
    return spark


def ensure_defaults(spark: SparkSession) -> SparkSession:
    """Pin UTC: every timestamp in the lake is naive UTC (TIMESTAMP_NTZ)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that all machines share. Only a local session may go without: it has
    one machine, and a folder in its warehouse is used. On a cluster a missing setting is an error, since no other folder
    is known to be shared."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder for intermediate tables under the cluster's shared checkpoint folder."""
    return f"{_shared_root(spark)}/{name}"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point ``checkpoint()`` at the shared folder."""
    _shared_root(spark)
    return spark.sparkContext.getCheckpointDir()


#: Spark 4.1 on: when a query has ended, its shuffle files go (older versions keep them). Of a write they are found only
#: if it is not planned with a node of its own, which serves writes into partitions.
FREE_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.optimizer.plannedWrite.enabled": "false"}


@contextmanager
def freed_shuffles(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` for a write into one folder that nothing reads the shuffles of afterwards: their files go when it ends. Else they
    stay until the driver happens to collect its garbage, beside what the next jobs shuffle."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in FREE_SHUFFLES}
    try:
        for k, v in FREE_SHUFFLES.items():
            conf.set(k, v)
        yield df.select("*")
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
