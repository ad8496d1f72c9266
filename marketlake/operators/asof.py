"""Backward as-of join with per-column forward fill (J7-J9, SURVEY §4.3).

Semantics: for each left row and each right column, the last non-null right value of
the same ``by`` key whose timestamp is ≤ the left timestamp (exact matches included,
no tolerance). That equals "forward-fill each right column, then backward as-of merge".

Plan: left and all rights are unioned (tagged by side) and one window runs over
``(by, time block)``; values that cross a block boundary come from a small per-block
carry table whose rows join the union as synthetic right rows at each block's start.
So there is one large exchange for any number of right tables, no join on the large
side, and no task ever holds a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocked import block_of

_EPOCH = "1970-01-01 00:00:00"


@dataclass
class Right:
    """One right-hand table: its frame, the value columns to bring, a tie order."""
    df: DataFrame
    columns: Sequence[str]
    ts: str = "timestamp"
    tie: Sequence[str] = field(default_factory=tuple)


def last_values(right: DataFrame, by: Sequence[str], ts: str, columns: Sequence[str], tie: Sequence[str], *also: Column) -> DataFrame:
    """One row per key (and ``also``): the last non-null value of each column by time, then ``tie``."""
    rank = F.struct(ts, *tie)
    return right.groupBy(*by, *also).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns])


def since(right: Right, by: str, start: Column) -> Right:
    """A right table for left rows from ``start`` on: what it says before is one row per key, with the last value of each column."""
    ts, tie = right.ts, list(right.tie)
    early = right.df.filter(F.col(ts) < start)
    columns = list(dict.fromkeys([*right.columns, *tie]))
    last = last_values(early, [by], ts, columns, tie or right.columns).withColumn(ts, F.timestamp_add("MICROSECOND", F.lit(-1), start))
    return Right(right.df.select(by, ts, *columns).filter(F.col(ts) >= start).unionByName(last.select(by, ts, *columns)), right.columns, ts, tie)


def asof_fill(left: DataFrame, rights: Sequence[Right], by: str | Sequence[str] = "symbol",
              ts: str = "timestamp", block_seconds: int = 32 * 86_400,
              keep: Sequence[str] | None = None, keep_block: bool = False,
              left_order: Sequence[str] = (), constants: DataFrame | None = None) -> DataFrame:
    """Left rows with every right column filled as-of backward. Order is not defined.

    The union of left and rights is hash-partitioned once on (key, block) for the
    window; the per-block right summaries and the set of left blocks are partial
    aggregates of narrow projections (rows = keys × blocks), whose carry values ride in
    the same exchange as synthetic rows, so the filled rows are never joined or moved
    again. ``keep_block`` returns the block as ``__blk`` so that callers can run further
    per-(key, block) work without another shuffle.

    ``left_order`` names left columns to sort by right after the timestamp (ascending,
    nulls first; they are null on right rows, so rights still precede lefts at equal
    times and the fill is unchanged). A caller whose next window is partitioned by
    (key, block, timestamp, ...) and ordered by those columns then needs no second sort.

    ``constants`` (a row per key) are brought to every left row of their key by the carry rows, so a table of the keys' own
    values that is too large to broadcast does not shuffle the filled rows again.
    """
    by = [by] if isinstance(by, str) else list(by)
    side, blk = "__side", "__blk"
    value_cols = [c for r in rights for c in r.columns]
    if len(set(value_cols)) != len(value_cols):
        raise ValueError(f"right columns overlap: {value_cols}")
    clash = set(value_cols) & set(left.columns)
    if clash:
        raise ValueError(f"right columns already on the left: {sorted(clash)}")
    left_cols = list(keep) if keep is not None else [c for c in left.columns if c not in by and c != ts]

    parts = [left.select(*by, ts, *left_cols, F.lit(1).alias(side), F.lit(None).cast("int").alias("__i"))]
    # carry-in per left block: the last non-null right values from strictly earlier blocks, from map-side-combined
    # aggregates of each right table alone (one row per key and block: the block's last values), and the set of left blocks
    ties: list[str] = []
    summaries = []
    for i, r in enumerate(rights):
        # without a tie order the values themselves are one: they are in the row already, and null in all other tables' rows
        own = {c: f"__t{i}_{k}" for k, c in enumerate(r.tie)}
        ties += list(own.values()) or list(r.columns)
        part = r.df.select(*by, F.col(r.ts).alias(ts), *r.columns, F.lit(0).alias(side), F.lit(i).alias("__i"),
                           *[F.col(c).alias(n) for c, n in own.items()])
        parts.append(part)
        summaries.append(last_values(part, by, ts, r.columns, list(own.values()) or list(r.columns), block_of(ts, block_seconds).alias(blk))
                         .withColumn(side, F.lit(1)))
    right_blocks = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), summaries)
    keys = (left.select(*by, block_of(ts, block_seconds).alias(blk)).distinct().withColumn(side, F.lit(0)))
    wc = (Window.partitionBy(*by).orderBy(F.col(blk), F.col(side))
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carry = (keys.unionByName(right_blocks, allowMissingColumns=True)
             .select(*by, blk, side, *[F.last(c, ignorenulls=True).over(wc).alias(c) for c in value_cols])
             .filter(F.col(side) == 0))
    # ... which enter the fill as one synthetic right row at the start of each block,
    # ranked before every real row there: the fill window picks them up, so the large
    # side is never joined (its (key, block) partitioning and sort stay intact)
    start = F.timestamp_add("SECOND", F.col(blk) * F.lit(block_seconds), F.lit(_EPOCH).cast("timestamp_ntz"))
    if constants is not None:
        carry = carry.join(constants, by, "left")
        value_cols += [c for c in constants.columns if c not in by]
    parts.append(carry.select(*by, start.alias(ts), *value_cols, F.lit(0).alias(side),
                              F.lit(-1).alias("__i")))

    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    union = union.withColumn(blk, block_of(ts, block_seconds)).repartition(*by, blk)

    # Per-column forward fill, last non-null up to and including the current row
    order = [F.col(ts), *[F.col(c).asc_nulls_first() for c in left_order], F.col(side), F.col("__i"),
             *[F.col(n) for n in ties]]
    w = Window.partitionBy(*by, blk).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = union.select(*by, ts, blk, side, *left_cols,
                          *[F.last(c, ignorenulls=True).over(w).alias(c) for c in value_cols])
    filled = filled.filter(F.col(side) == 1)
    return filled.select(*by, ts, *left_cols, *value_cols, *([blk] if keep_block else []))
