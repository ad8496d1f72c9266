"""Structured Streaming forms of the bar operators.

The reference has no streams; these are the incremental versions of batch operators
that already exist here, with the same results on the rows a stream can finalise:

* ``land_stream``: landed vendor files → canonical bars → the lake (K1), one
  micro-batch per new set of files, ``trigger(availableNow=True)`` for scheduled runs.
* ``resample_stream``: A3 with an event-time watermark; a bar is emitted (append mode)
  once the watermark passes its end, and equals the batch bar.
* ``dedup_stream``: key de-duplication within the watermark that lets the first arrival
  through at once; ``best_row_stream``: W3 with the batch rule, once the watermark has
  passed the bar.

Streams run on ``TIMESTAMP`` (``withWatermark`` refuses ``TIMESTAMP_NTZ``): the bar time
is cast on entry (the session zone is UTC, so wall time is unchanged) and back on exit.
Checkpoints live under the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bars import source_rank
from ..operators.resample import FIRST_COLS, KEY, LAST_COLS, RESAMPLE_MINUTES
from ..schemas import OHLCV
from ..session import shared_dir
from ..sources.versioned import VersionedLake

EVENT_TIME = "__event_time"


def with_event_time(stream: DataFrame, delay: str, ts: str = "timestamp") -> DataFrame:
    """Zoned event-time column (UTC wall time of ``ts``) with a watermark of ``delay``."""
    return stream.withColumn(EVENT_TIME, F.col(ts).cast("timestamp")).withWatermark(EVENT_TIME, delay)


def resample_stream(minute_bars: DataFrame, timeframe: str, delay: str = "10 minutes",
                    tie: Sequence[str] = ()) -> DataFrame:
    """Streaming A3 for one target timeframe (start one query per target).

    The same aggregates as the batch operator: first/last non-null by (timestamp, tie),
    max, min, sum; all partial-aggregatable, so the state holds one row per open
    (series, bar) and a hot symbol is pre-combined before the state shuffle.
    """
    if timeframe not in RESAMPLE_MINUTES:
        raise ValueError(f"unsupported resample target {timeframe!r}")
    src = minute_bars
    cols = set(src.columns)
    for c, default in (("adj_close", F.col("close")), ("adj_factor", F.lit(1.0)),
                       ("source", F.lit(None).cast("string")), ("asset_class", F.lit(None).cast("string"))):
        if c not in cols:
            src = src.withColumn(c, default)
    src = with_event_time(src, delay)
    order = F.struct(F.col("timestamp"), *[F.col(t) for t in tie])
    win = F.window(EVENT_TIME, f"{RESAMPLE_MINUTES[timeframe]} minutes")
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in FIRST_COLS]
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in LAST_COLS]
    aggs += [F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume")]
    bars = src.groupBy(*KEY, win.alias("__bar")).agg(*aggs)
    start = F.col("__bar.start").cast("timestamp_ntz")
    out = bars.select(
        start.alias("timestamp"), "symbol", "asset_class", F.lit(timeframe).alias("timeframe"),
        "open", "high", "low", "close", F.coalesce(F.col("volume"), F.lit(0.0)).alias("volume"),
        "adj_close", "adj_factor", "source", F.year(start).alias("year"))
    return out.filter(F.col("open").isNotNull() & F.col("close").isNotNull())


def dedup_stream(bars: DataFrame, keys: Sequence[str] = ("symbol", "timeframe", "timestamp"),
                 delay: str = "1 day") -> DataFrame:
    """Streaming W3: first arrival per key; state is dropped once the watermark passes."""
    d = with_event_time(bars, delay)
    return d.dropDuplicatesWithinWatermark(list(keys)).drop(EVENT_TIME)


def best_row_stream(bars: DataFrame, keys: Sequence[str] = ("symbol", "timeframe", "timestamp"), delay: str = "1 day",
                    source_priority: Sequence[str] | None = None) -> DataFrame:
    """Streaming W3 with the batch rule: of a key's rows, that of the best source, then of the smallest remaining columns.

    The keyed state holds one row, the best so far (an ordered minimum, combined before the shuffle), and is closed and
    emitted when the watermark passes the bar's time, so a better row may arrive up to ``delay`` later.
    ``keys`` must hold ``timestamp``. Rows later than the watermark are dropped, as in every stream."""
    rest = [c for c in bars.columns if c not in (*keys, "source")]
    rank = F.struct(source_rank(source_priority).alias("__rank"), "source", *rest)
    closed = with_event_time(bars, delay).groupBy(*keys, EVENT_TIME).agg(F.min(rank).alias("__best"))
    return closed.select(*[F.col(c) if c in keys else F.col(f"__best.{c}").alias(c) for c in bars.columns])


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """Stream checkpoint folder under the shared ``spark.checkpoint.dir``."""
    return shared_dir(spark, f"streams/{name}")


def land_stream(spark: SparkSession, landed_dir: str, lake_root: str, parse: Callable[[DataFrame], DataFrame],
                raw_schema, name: str, fmt: str = "csv", options: dict | None = None,
                available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """X-S1: new landed files → ``parse`` (a normaliser from ``sources``) → K1 append.

    ``foreachBatch`` commits each micro-batch to the lake under the stream's name and the
    batch's number (``sources.versioned``): a batch replayed after a failure finds its number
    committed and adds nothing. The file source remembers which files it has seen in the
    checkpoint, so every landed file is parsed once. The name belongs to one checkpoint: a
    stream started anew, from number 0, needs a new name.
    """
    reader = spark.readStream.schema(raw_schema).options(**(options or {}))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.format(fmt).load(landed_dir)
    bars = parse(raw).select(*[c for c in OHLCV.fieldNames()])

    def sink(batch: DataFrame, batch_id: int) -> None:
        VersionedLake(batch.sparkSession, lake_root).append(batch, f"stream-{name}", batch_id)

    writer = (bars.writeStream.foreachBatch(sink)
              .option("checkpointLocation", checkpoint_location(spark, name)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def write_stream(df: DataFrame, path: str, name: str, partition_by: Sequence[str] = ("timeframe",),
                 available_now: bool = True) -> StreamingQuery:
    """Append a streaming result to a Parquet table (exactly-once file sink)."""
    spark = df.sparkSession
    w = (df.writeStream.format("parquet").outputMode("append").partitionBy(*partition_by)
         .option("checkpointLocation", checkpoint_location(spark, name)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(path)
