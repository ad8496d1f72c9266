"""Skew-safe sequential primitives over very long series.

A window ``partitionBy(symbol)`` puts a whole series into one task; when one symbol
holds a third of the lake that task holds a third of the lake. Every per-series
sequential operator here instead partitions by ``(series keys, time block)`` and
stitches block boundaries with a second pass over a *small* per-block table
(rows = series × blocks, independent of the row count). Results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import TIMEFRAME_SECONDS, epoch_seconds, timeframe_step_seconds

# A block spans BARS_PER_BLOCK bar lengths of its timeframe: small enough for one task
# whatever the series length, large against the lag / carry width so that only a thin
# edge of each block goes through the boundary tables.
BARS_PER_BLOCK = 2048
DAY = 86_400
MONTH_SECONDS = 31 * DAY            # calendar month bars have no fixed length


def block_seconds_for(timeframe: str | None) -> int:
    """Block length in seconds for a timeframe (daily when unknown)."""
    step = TIMEFRAME_SECONDS.get(timeframe or "D1", DAY) or MONTH_SECONDS
    return step * BARS_PER_BLOCK


def block_of(ts, seconds) -> Column:
    """Integer time block of a naive-UTC timestamp (epoch aligned). ``seconds`` may be a
    Column, e.g. a per-timeframe block length."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    secs = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.floor(epoch_seconds(ts) / secs).cast("long")


def block_seconds_column(timeframe="timeframe") -> Column:
    """Per-row block length from the row's timeframe (see ``block_seconds_for``)."""
    tf = F.col(timeframe) if isinstance(timeframe, str) else timeframe
    step = F.coalesce(timeframe_step_seconds(tf), F.lit(DAY))
    return F.when(step == 0, F.lit(MONTH_SECONDS)).otherwise(step) * F.lit(BARS_PER_BLOCK)


def _blocked(df: DataFrame, keys: list[str], ts: str, block_seconds, block_col: str | None) -> tuple[DataFrame, str]:
    """Input with a block column, hash-partitioned on (keys, block) exactly once."""
    if block_col is not None and block_col in df.columns:
        return df, block_col           # caller guarantees (keys, block) partitioning upstream
    blk = "__blk"
    return df.withColumn(blk, block_of(ts, block_seconds)).repartition(*keys, blk), blk


def previous_value(df: DataFrame, keys: Sequence[str], ts: str, value: str, out: str,
                   block_seconds, tie: Sequence[str] = (), block_col: str | None = None) -> DataFrame:
    """``lag(value, 1)`` over ``partitionBy(keys).orderBy(ts, *tie)`` computed per block.

    The first row of a block takes the last row of the nearest earlier non-empty block.
    """
    keys = list(keys)
    d, blk = _blocked(df, keys, ts, block_seconds, block_col)
    order = [F.col(ts)] + [F.col(t) for t in tie]
    w = Window.partitionBy(*keys, blk).orderBy(*order)
    # last row of each block (small table: one row per series and block): an aggregate of the
    # key, time and value columns alone, combined before its shuffle; it neither sorts nor
    # deals out the rows
    before = df if blk in df.columns else df.withColumn(blk, block_of(ts, block_seconds))
    last = F.max(F.col(ts)) if value == ts else F.max_by(F.col(value), F.struct(*order))
    tails = before.groupBy(*keys, blk).agg(last.alias("__tail"))
    d = d.withColumn("__lag", F.lag(value, 1).over(w)).withColumn("__rn", F.row_number().over(w))
    wb = Window.partitionBy(*keys).orderBy(blk)
    carry = tails.withColumn("__carry", F.lag("__tail", 1).over(wb)).drop("__tail")
    # left join on plain keys: nothing is inferred on the preserved big side, and its
    # (keys, block) partitioning satisfies the join, so it is not shuffled again
    d = d.join(carry, on=[*keys, blk], how="left")
    d = d.withColumn(out, F.when(F.col("__rn") == 1, F.col("__carry")).otherwise(F.col("__lag")))
    return d.drop("__lag", "__rn", "__carry", *([] if blk == block_col else [blk]))


def lag_n(df: DataFrame, keys: Sequence[str], ts: str, value: str, n: int, out: str,
          block_seconds, tie: Sequence[str] = (), block_col: str | None = None, edges: DataFrame | None = None) -> DataFrame:
    """``lag(value, n)`` over ``partitionBy(keys).orderBy(ts, *tie)``, exact across blocks.

    Each block is summed up in its last ``n`` values. Blocks that are there hold a row at least, so the ``n`` blocks
    before one hold the ``n`` values before it: one narrow window over the summaries (a row per block) gives every block the
    values that its first ``n`` rows look back to. The summaries share the rows' exchange, or come from ``edges``: the
    same rows (keys, block, time and value suffice) where they can be had for less than ``df``.
    """
    keys = list(keys)
    d, blk = _blocked(df, keys, ts, block_seconds, block_col)
    w = Window.partitionBy(*keys, blk).orderBy(F.col(ts), *[F.col(t) for t in tie])
    rows = d if edges is None else _blocked(edges, keys, ts, block_seconds, block_col)[0]
    last = (rows.withColumn("__r", F.row_number().over(w)).withColumn("__after", F.lead(F.lit(1), n).over(w))
            .filter(F.col("__after").isNull()))
    # the join takes the keys from aggregates: the isnotnull filters that Catalyst infers for it stop there and do not
    # reach the rows, whose exchange would be another one then and not be reused
    own = {c: f"__key{i}" for i, c in enumerate([*keys, blk])}
    tails = last.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("__r", F.col(value).alias("v")))).alias("__tail"),
                                   *[F.max(c).alias(name) for c, name in own.items()])
    wb = Window.partitionBy(*keys).orderBy(blk).rowsBetween(-n, -1)
    carry = tails.select(*[F.col(name).alias(c) for c, name in own.items()],
                         F.flatten(F.collect_list("__tail.v").over(wb)).alias("__before"))
    d = d.withColumn("__r", F.row_number().over(w)).withColumn("__lag", F.lag(value, n).over(w))
    d = d.join(carry, on=[*keys, blk], how="left")            # as in previous_value
    before = F.get("__before", F.size("__before") - n + F.col("__r") - 1)
    d = d.withColumn(out, F.when(F.col("__r") <= n, before).otherwise(F.col("__lag")))
    return d.drop("__r", "__lag", "__before", *([] if blk == block_col else [blk]))
