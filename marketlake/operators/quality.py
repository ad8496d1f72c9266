"""Data quality: null scan, gap detection, scores, catalog statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import epoch_seconds
from .blocked import block_seconds_column, previous_value

SERIES = ["symbol", "timeframe"]
OHLC = ["open", "high", "low", "close"]
# fixed values of the scoring rules
D1_GAP_SECONDS = 4 * 86_400          # a daily gap is strictly more than 4 days
MINUTE_GAP_SECONDS = 15 * 60          # an intraday gap is strictly more than 15 minutes, same date
NULL_WEIGHT, NULL_CAP = 1.5, 50.0
GAP_WEIGHT, GAP_CAP = 5.0, 50.0


def _null_pct(c: str) -> Column:
    return F.lit(100.0) * F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)) / F.count(F.lit(1))


def null_scan(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = SERIES) -> DataFrame:
    """A2: per series, percentage of nulls of each column (``null_pct_<col>``)."""
    keys = list(keys)
    columns = list(columns) if columns is not None else [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[_null_pct(c).alias(f"null_pct_{c}") for c in columns])


def _is_gap() -> Column:
    """W1's rule on a row with its predecessor's time in ``gap_start`` (false when there
    is no predecessor or the timeframe has no rule)."""
    secs = epoch_seconds("timestamp") - epoch_seconds("gap_start")
    rule = (F.when(F.col("timeframe") == "D1", secs > D1_GAP_SECONDS)
            .when(F.col("timeframe") == "1m",
                  (secs > MINUTE_GAP_SECONDS) & (F.to_date("gap_start") == F.to_date("timestamp")))
            .otherwise(F.lit(False)))
    return F.col("gap_start").isNotNull() & rule


def detect_gaps(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Gaps between consecutive bars of a series.

    D1: difference strictly above 4 days, size in whole days (``gap_unit`` 'days').
    1m: difference strictly above 15 minutes within one calendar date, size in minutes
    (``gap_unit`` 'minutes'). Other timeframes have no gap rule.
    """
    keys = list(keys)
    d = bars.select(*keys, "timestamp").filter(F.col("timeframe").isin("D1", "1m"))
    d = previous_value(d, keys, "timestamp", "timestamp", "gap_start", block_seconds_column("timeframe"))
    secs = epoch_seconds("timestamp") - epoch_seconds("gap_start")
    return (d.filter(_is_gap())
            .select(*keys, "gap_start", F.col("timestamp").alias("gap_end"),
                    F.when(F.col("timeframe") == "D1", F.floor(secs / 86_400).cast("double"))
                    .otherwise(secs / 60.0).alias("gap_size"),
                    F.when(F.col("timeframe") == "D1", F.lit("days")).otherwise(F.lit("minutes")).alias("gap_unit")))


def quality_scores(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """A5: 100 − min(50, 1.5 × mean OHLC null %) − min(50, 5 × gaps), floored at 0.

    A missing OHLC column counts as 100 % null. One row per series.
    The null flags ride along the gap window's rows, so one aggregation per series gives
    both parts (the input is read by the window and by its small block-tail table only).
    """
    keys = list(keys)
    present = [c for c in OHLC if c in bars.columns]
    tf = [] if "timeframe" in keys else ["timeframe"]
    d = bars.select(*keys, *tf, "timestamp", *[F.col(c).isNull().alias(f"__null_{c}") for c in present])
    d = previous_value(d, keys, "timestamp", "timestamp", "gap_start", block_seconds_column("timeframe"))
    stats = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_count"),
        *[(F.lit(100.0) * F.sum(F.col(f"__null_{c}").cast("int")) / F.count(F.lit(1))).alias(f"__n_{c}")
          for c in present],
        F.sum(F.when(_is_gap(), 1).otherwise(0)).cast("long").alias("gaps"))
    parts = [F.col(f"__n_{c}") if c in present else F.lit(100.0) for c in OHLC]
    mean = ((parts[0] + parts[1]) + parts[2]) + parts[3]
    out = stats.withColumn("ohlc_null_pct", mean / 4.0).drop(*[f"__n_{c}" for c in present])
    out = out.select(*keys, "rows_count", "ohlc_null_pct", "gaps")
    score = (F.lit(100.0) - F.least(F.lit(NULL_CAP), F.col("ohlc_null_pct") * NULL_WEIGHT)
             - F.least(F.lit(GAP_CAP), F.col("gaps") * GAP_WEIGHT))
    return out.withColumn("quality_score", F.greatest(F.lit(0.0), score))


def simple_score(nulls_pct) -> Column:
    """A4: max(0, 100 − 2 × null-close %)."""
    n = F.col(nulls_pct) if isinstance(nulls_pct, str) else nulls_pct
    return F.greatest(F.lit(0.0), F.lit(100.0) - n * 2.0)


def catalog_stats(bars: DataFrame, keys: Sequence[str] = ("symbol", "timeframe", "asset_class"),
                  also: Sequence[Column] = ()) -> DataFrame:
    """A1 + A4: per series first/last timestamp, rows, null closes, null %, simple score, and
    the aggregates ``also``.

    One aggregation over the whole lake; partial aggregates combine map-side.
    """
    keys = list(keys)
    return (bars.groupBy(*keys)
            .agg(F.min("timestamp").alias("start_date"), F.max("timestamp").alias("end_date"),
                 F.count(F.lit(1)).alias("rows_count"),
                 F.sum(F.when(F.col("close").isNull(), 1).otherwise(0)).alias("null_closes"), *also)
            .withColumn("nulls_pct", F.lit(100.0) * F.col("null_closes") / F.col("rows_count"))
            .withColumn("quality_score", simple_score("nulls_pct")))


def ohlc_violations(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Extra consistency check (not part of any score): per series, bars whose high is
    below open/close/low or whose low is above open/close/high."""
    keys = list(keys)
    bad = ((F.col("high") < F.greatest("open", "close", "low")) |
           (F.col("low") > F.least("open", "close", "high")))
    return bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_count"),
                                   F.sum(F.when(bad, 1).otherwise(0)).alias("violations"))
