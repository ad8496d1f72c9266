"""Set-style merges: vendor range override (U2) and latest-wins upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bars import keep_last


def range_override_merge(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("symbol",),
                         ts: str = "timestamp", order: Sequence[str] = ()) -> DataFrame:
    """Per series, incoming rows replace every existing row inside the incoming
    [min, max] timestamp range; existing rows outside it are kept; then one row per
    (series, timestamp), incoming beating existing and later ``order`` beating earlier.

    The range table has one row per series (AQE broadcasts it at run time when small);
    the final keep-last window partitions on (series, timestamp), so no task holds a
    whole series.
    """
    keys = list(keys)
    rng = incoming.groupBy(*keys).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    outside = (existing.join(rng, on=keys, how="left")
               .filter(F.col("__lo").isNull() | (F.col(ts) < F.col("__lo")) | (F.col(ts) > F.col("__hi")))
               .drop("__lo", "__hi"))
    merged = outside.withColumn("__origin", F.lit(0)).unionByName(
        incoming.withColumn("__origin", F.lit(1)), allowMissingColumns=True)
    return keep_last(merged, [*keys, ts], ["__origin", *order]).drop("__origin")


def latest_wins(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Existing ++ new, keeping the new row per key (full-row replace)."""
    merged = existing.withColumn("__origin", F.lit(0)).unionByName(
        new.withColumn("__origin", F.lit(1)), allowMissingColumns=True)
    return keep_last(merged, list(keys), ["__origin", *order]).drop("__origin")


def coalesce_upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], replace: bool = False) -> DataFrame:
    """Partial upsert — columns the new rows carry overwrite, nulls keep the old value
    (``replace=True`` reproduces a plain full-row replace, nulls included: Q8)."""
    keys = list(keys)
    if replace:
        return latest_wins(existing, new, keys)
    new_cols = [c for c in new.columns if c not in keys]
    o = existing.alias("o")
    n = new.alias("n")
    j = o.join(n, on=keys, how="full")
    cols = []
    for c in existing.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in new_cols:
            cols.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.col(f"o.{c}"))
    extra = [F.col(f"n.{c}") for c in new_cols if c not in existing.columns]
    return j.select(*cols, *extra)
