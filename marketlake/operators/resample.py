"""A3: resample 1-minute bars to 15m / 1h / 4h for all series (symbol and asset class) in one job.

Per bar: open = first non-null, high = max, low = min, close = last non-null,
volume = sum (0 when all null), adj_close = last non-null, adj_factor = first non-null,
source = first non-null; bars whose open or close is null are dropped;
bars are left-closed and labelled by their start (epoch-aligned, which equals
midnight anchoring for lengths dividing a day).

The minute rows are read once: they become *partial* bars of the targets' common divisor (before
the null-open/close drop), and one more aggregate by (target, bar) rolls those up to all targets
together. All the aggregates are partial-aggregatable, so a hot symbol is pre-combined map-side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import epoch_seconds

# fixed values: target timeframe → bar length in minutes
RESAMPLE_MINUTES = {"15m": 15, "1h": 60, "4h": 240}

FIRST_COLS = ["open", "adj_factor", "source"]
KEY = ["symbol", "asset_class"]
LAST_COLS = ["close", "adj_close"]


def _partial(df: DataFrame, bucket_minutes: int, order) -> DataFrame:
    """Partial bars at ``bucket_minutes`` from 1m rows; ``order`` is the row order."""
    start = F.window("timestamp", f"{bucket_minutes} minutes").start
    aggs = [F.min_by(F.struct(order.alias("o"), F.col(c).alias("v")),
                     F.when(F.col(c).isNotNull(), order)).alias(c) for c in FIRST_COLS]
    aggs += [F.max_by(F.struct(order.alias("o"), F.col(c).alias("v")),
                      F.when(F.col(c).isNotNull(), order)).alias(c) for c in LAST_COLS]
    aggs += [F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume")]
    return df.groupBy(*KEY, start.alias("timestamp")).agg(*aggs)


def _rollup(part: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Bars of all targets from partial bars that every target's bars are made of: each partial goes to one group per
    target (a target and a bar of it), and one aggregate closes them all. ``timestamp`` and ``timeframe`` say the group."""
    seconds = F.explode(F.array(*[F.struct(F.lit(t).alias("tf"), F.lit(60 * RESAMPLE_MINUTES[t]).alias("s")) for t in targets]))
    each = part.select("*", seconds.alias("__t"))
    start = F.timestamp_add("SECOND", -F.pmod(epoch_seconds("timestamp"), F.col("__t.s")), F.col("timestamp"))
    aggs = [F.min_by(F.col(c), F.col(c)["o"]).alias(c) for c in FIRST_COLS]
    aggs += [F.max_by(F.col(c), F.col(c)["o"]).alias(c) for c in LAST_COLS]
    aggs += [F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume")]
    return each.groupBy(*KEY, F.col("__t.tf").alias("timeframe"), start.alias("timestamp")).agg(*aggs)


def _finish(part: DataFrame) -> DataFrame:
    out = part.select(
        "timestamp", "symbol", "asset_class", "timeframe",
        F.col("open")["v"].alias("open"), "high", "low", F.col("close")["v"].alias("close"),
        F.coalesce(F.col("volume"), F.lit(0.0)).alias("volume"),
        F.col("adj_close")["v"].alias("adj_close"), F.col("adj_factor")["v"].alias("adj_factor"),
        F.col("source")["v"].alias("source"), F.year("timestamp").alias("year"))
    return out.filter(F.col("open").isNotNull() & F.col("close").isNotNull())


def resample(minute_bars: DataFrame, targets: Sequence[str] = ("15m", "1h", "4h"),
             tie: Sequence[str] = ()) -> DataFrame:
    """Resampled bars of every symbol for every target timeframe (union, unordered).

    ``minute_bars`` are the 1m rows (any symbols). Rows of a series that share a timestamp
    are ordered by ``tie``; without it by all other bar columns, so that first and last
    never depend on the order of tasks.
    """
    for t in targets:
        if t not in RESAMPLE_MINUTES:
            raise ValueError(f"unsupported resample target {t!r}")
    targets = sorted(set(targets), key=RESAMPLE_MINUTES.get)
    cols = set(minute_bars.columns)
    src = minute_bars
    for c, default in (("adj_close", F.col("close")), ("adj_factor", F.lit(1.0)),
                       ("source", F.lit(None).cast("string")), ("asset_class", F.lit(None).cast("string"))):
        if c not in cols:
            src = src.withColumn(c, default)
    tie = list(tie) or [c for c in ("source", "open", "high", "low", "close", "volume", "adj_close", "adj_factor")
                        if c in src.columns]
    order = F.struct(F.col("timestamp"), *[F.col(t) for t in tie])
    base = math.gcd(*(RESAMPLE_MINUTES[t] for t in targets))
    part = _partial(src, base, order)
    if len(targets) == 1:
        return _finish(part.withColumn("timeframe", F.lit(targets[0])))
    return _finish(_rollup(part, targets))
