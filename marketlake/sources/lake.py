"""The bar lake on Hive-partitioned Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.catalog import in_universe
from ..schemas import BAR_COLUMNS, OHLCV, PARTITION_COLUMNS, SYMBOL_BUCKET
from .versioned import VersionedLake, bucket_of, is_versioned, read_folders

MAX_ROWS_PER_FILE = 5_000_000

# writer settings (fixed values): snappy pages, dictionary encoding, ~100k-row groups
PARQUET_OPTIONS = {"compression": "snappy", "parquet.enable.dictionary": "true",
                   "parquet.block.size": str(16 * 1024 * 1024)}


def scan_bars(spark: SparkSession, root: str, extra_schema=None, discover: bool = False) -> DataFrame:
    """The lake as a DataFrame with an explicit schema (partition values stay
    strings, '0001' stays '0001'; absent columns read as null). Of a lake with versions, the
    committed folders of the newest one, with all extra columns. Those of a plain lake are named by ``extra_schema``
    or found by ``discover`` (one job over the footers of its files)."""
    if discover or is_versioned(spark, root):
        return VersionedLake(spark, root).scan(extra_schema=extra_schema)
    schema = StructType([*OHLCV.fields, *(extra_schema.fields if extra_schema is not None else [])])
    last = ["asset_class", "timeframe", "symbol", "year"]  # in one order, whichever of them are folder names
    try:
        found = read_folders(spark, root, schema, [""])
        return found.select(*[c for c in found.columns if c not in (*last, SYMBOL_BUCKET)], *last)
    except Exception as e:  # noqa: BLE001  (empty or missing lake)
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return empty_bars(spark)
        raise


def empty_bars(spark: SparkSession) -> DataFrame:
    """A typed empty relation so queries still run on an empty lake."""
    return spark.createDataFrame([], OHLCV)


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Expose frames to SQL under their names (``ohlcv``, ``symbols_metadata`` …)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def ranged_writer(df: DataFrame, order: Sequence[str]) -> DataFrameWriter:
    """A writer over rows dealt into ordered ranges of the whole sort key (leaf folder first, then time): small leaves share
    a task, a leaf with a third of all rows is written by many, each a time range of its own, in files of
    bounded length. There are at most as many files as leaves and tasks together. The ranges come from a
    sample, which is a first pass over the input."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
            .write.options(**PARQUET_OPTIONS).option("maxRecordsPerFile", MAX_ROWS_PER_FILE))


def bar_writer(df: DataFrame) -> DataFrameWriter:
    """Rows by bucket, symbol and time: a file's row groups hold few symbols each, so a filter on ``symbol`` or ``timestamp``
    skips the others by their bounds."""
    cols = [*BAR_COLUMNS, *(c for c in df.columns if c not in BAR_COLUMNS)]
    # symbols are stored upper-case, the form every read predicate uses (Q16)
    rows = df.select(*cols).withColumns({"symbol": F.upper("symbol"), "year": F.col("year").cast("int")})
    return ranged_writer(rows.withColumn(SYMBOL_BUCKET, bucket_of("symbol")), [*PARTITION_COLUMNS, "symbol", "timestamp"])


def write_bars(df: DataFrame, root: str, mode: str = "append") -> None:
    """K1: append bars under asset_class/timeframe/symbol_bucket; on a lake with versions, as one commit
    (``overwrite`` replaces its whole content then)."""
    if is_versioned(df.sparkSession, root):
        lake = VersionedLake(df.sparkSession, root)
        lake.rewrite(df) if mode == "overwrite" else lake.append(df)
        return
    bar_writer(df).mode(mode).partitionBy(*PARTITION_COLUMNS).parquet(root)


def replace_series(df: DataFrame, root: str) -> None:
    """K2: the series in ``df`` are replaced as a whole, with all their years; all other series stay as they
    are. One commit of a lake with versions; a plain lake becomes one."""
    VersionedLake(df.sparkSession, root).replace_series(df)


def rewrite_lake(lake: DataFrame, universe: DataFrame, new_root: str, stock_class: str = "stocks") -> DataFrame:
    """K3: upper-case symbols, keep non-stock series and the stock series in the universe (a
    null class counts as stock, as in the catalog's rule), write everything to ``new_root``
    (the caller swaps roots). Returns the new scan."""
    keep = in_universe(lake.withColumn("symbol", F.upper("symbol")),
                       universe.select(F.upper("symbol").alias("symbol")), stock_class)
    write_bars(keep, new_root, mode="overwrite")
    return scan_bars(lake.sparkSession, new_root)


def write_per_symbol(df: DataFrame, root: str, order: Sequence[str], mode: str = "overwrite") -> None:
    """One folder per symbol, rows ordered inside (financials, option chains); a symbol with many
    rows is several files, each a range of the order."""
    ranged_writer(df, ["symbol", *order]).mode(mode).partitionBy("symbol").parquet(root)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """K5: a single table (macro series partitioned by symbol, yield curve, actions …)."""
    w = df.write.mode(mode).options(**PARQUET_OPTIONS)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
