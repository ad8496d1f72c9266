"""Input tables and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session (tests) may go without: a folder in its warehouse
    is used then. On a cluster a missing setting is an error, since no other folder is known to be shared."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a new shared folder and read it back: the lineage ends
    there, and any executor can read it after the loss of another."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, as ``--py-files`` does, once for each Spark context."""
    import marketlake

    context = spark.sparkContext
    if getattr(context, "_marketlake_shipped", False):
        return
    folder = Path(marketlake.__file__).parent
    target = Path(tempfile.mkdtemp()) / "marketlake.zip"  # read by the driver, which serves it to the executors
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(folder.rglob("*.py")):
            z.write(p, p.relative_to(folder.parent))
    context.addPyFile(str(target))
    context._marketlake_shipped = True
