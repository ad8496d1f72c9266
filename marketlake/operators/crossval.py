"""Cross-source validation of all series at once.

Works on the raw lake rows (not on de-duplicated bars, which would already have
dropped one of the two sources: Q1).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bars import filter_bars

KEYS = ["symbol", "timeframe"]
# fixed values: reliability loses 10 points per 1 % mean difference; > 1 % is a discrepancy
RELIABILITY_PER_PCT = 10.0
DISCREPANCY_PCT = 1.0
CLOSE_FLOOR = 1e-8


def _tag(source: str) -> str:
    return re.sub(r"[^0-9a-zA-Z_]", "_", source.lower())


def _picked(i: int, source: str) -> list[Column]:
    """Per (series, timestamp): does ``source`` have a row, and its de-duplicated close
    (a null close if any row has one, else the smallest: W3's order on close)."""
    mine = F.lower(F.col("source")) == source.lower()
    return [F.max(F.when(mine, F.lit(1))).alias(f"__has{i}"),
            F.max(F.when(mine & F.col("close").isNull(), F.lit(1))).alias(f"__null{i}"),
            F.min(F.when(mine, F.col("close"))).alias(f"__min{i}")]


def _by_timestamp(bars: DataFrame, source1: str, source2: str, keys: list[str]) -> DataFrame:
    """One row per (series, timestamp) with both sources' closes side by side.

    A single partial-aggregatable group-by (map-side combined, so a hot symbol is
    pre-reduced in every task) replaces a de-dup window per source plus a join: the
    lake is scanned and shuffled once, and no pair of rows within a group is formed.
    """
    # source match, case-insensitive
    d = bars.filter(F.lower(F.col("source")).isin(source1.lower(), source2.lower()))
    g = d.groupBy(*keys, "timestamp").agg(*_picked(1, source1), *_picked(2, source2))
    c1 = F.when(F.col("__null1") == 1, F.lit(None).cast("double")).otherwise(F.col("__min1"))
    c2 = F.when(F.col("__null2") == 1, F.lit(None).cast("double")).otherwise(F.col("__min2"))
    diff = F.abs(c1 - c2) / F.greatest(c1, F.lit(CLOSE_FLOOR)) * 100.0
    return g.select(*keys, "timestamp", F.col("__has1").isNotNull().alias("__in1"),
                    F.col("__has2").isNotNull().alias("__in2"), c1.alias("__c1"), c2.alias("__c2"),
                    diff.alias("diff_pct"))


def _within(bars: DataFrame, symbols=None, timeframe: str | None = None, start=None, end=None) -> DataFrame:
    return filter_bars(bars, symbols, timeframe, start, end)


def compare_sources(bars: DataFrame, source1: str, source2: str, keys: Sequence[str] = KEYS, **window) -> DataFrame:
    """The rows both sources have on the same (series, timestamp), one per source
    after de-duplication, with the % difference of close. ``window``: ``symbols``,
    ``timeframe``, ``start``, ``end``, as in ``filter_bars`` (all bars by default)."""
    keys = list(keys)
    a, b = _tag(source1), _tag(source2)
    t = _by_timestamp(_within(bars, **window), source1, source2, keys)
    return t.filter(F.col("__in1") & F.col("__in2")).select(
        *keys, "timestamp", F.col("__c1").alias(f"close_{a}"), F.col("__c2").alias(f"close_{b}"), "diff_pct")


def cross_validate(bars: DataFrame, source1: str, source2: str, keys: Sequence[str] = KEYS, **window) -> DataFrame:
    """Per series — rows per source, rows compared, mean/max/sample-std of the %
    difference (std 0 for one row), reliability max(0, 100 − 10 × mean), rows > 1 %.

    Series present in only one source get zero rows compared and reliability 0. The
    second group-by runs on the per-timestamp table, one row per (series, timestamp).
    ``window`` as in ``compare_sources`` (E6).
    """
    keys = list(keys)
    t = _by_timestamp(_within(bars, **window), source1, source2, keys)
    both = F.col("__in1") & F.col("__in2")
    d = F.when(both, F.col("diff_pct"))
    out = t.groupBy(*keys).agg(
        F.sum(F.when(F.col("__in1"), 1).otherwise(0)).alias("source1_rows"),
        F.sum(F.when(F.col("__in2"), 1).otherwise(0)).alias("source2_rows"),
        F.sum(F.when(both, 1).otherwise(0)).alias("rows_compared"),
        F.avg(d).alias("mean_difference_pct"), F.max(d).alias("max_difference_pct"),
        F.stddev_samp(d).alias("__sd"),
        F.sum(F.when(both & (F.col("diff_pct") > DISCREPANCY_PCT), 1).otherwise(0)).alias("discrepancies"))
    n = F.col("rows_compared")
    reliability: Column = F.coalesce(
        F.greatest(F.lit(0.0), F.lit(100.0) - F.col("mean_difference_pct") * RELIABILITY_PER_PCT), F.lit(0.0))
    return out.select(
        *keys, "source1_rows", "source2_rows", "rows_compared",
        "mean_difference_pct", "max_difference_pct",
        F.when(n > 1, F.col("__sd")).when(n == 1, F.lit(0.0)).alias("std_difference_pct"),
        F.when(n > 0, reliability).otherwise(F.lit(0.0)).alias("reliability_score"),
        "discrepancies")


def discrepancies(bars: DataFrame, source1: str, source2: str, keys: Sequence[str] = KEYS,
                  threshold_pct: float = DISCREPANCY_PCT, **window) -> DataFrame:
    """The compared rows whose difference exceeds ``threshold_pct``."""
    return compare_sources(bars, source1, source2, keys, **window).filter(F.col("diff_pct") > threshold_pct)
