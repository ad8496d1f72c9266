"""Bar retrieval and per-series bar operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import chart_time
from .blocked import block_of, block_seconds_column, block_seconds_for, lag_n  # noqa: F401  (lag_n re-exported)

SERIES_KEYS = ["symbol", "timeframe", "timestamp"]
STANDARD = ["timestamp", "symbol", "asset_class", "timeframe", "open", "high", "low", "close",
            "volume", "adj_close", "adj_factor", "source"]


def _ts_literal(value) -> Column:
    """A bound given as text or date/datetime; a bare date means midnight (Q4)."""
    if isinstance(value, dt.datetime):
        return F.lit(value).cast("timestamp_ntz")
    if isinstance(value, dt.date):
        return F.lit(dt.datetime(value.year, value.month, value.day)).cast("timestamp_ntz")
    return F.lit(str(value)).cast("timestamp_ntz")


def _year(value) -> int:
    if isinstance(value, (dt.date, dt.datetime)):
        return value.year
    return int(str(value)[:4])


def filter_bars(df: DataFrame, symbols=None, timeframe: str | None = "D1", start=None, end=None,
                asset_class: str | None = None) -> DataFrame:
    """timeframe = t AND symbol IN (…) AND start ≤ timestamp ≤ end (both inclusive).

    ``symbols=None`` keeps every symbol. Symbols are upper-cased (Q16). Bounds also
    prune ``year`` partitions when the frame has that column.
    """
    cond = F.lit(True)
    if timeframe is not None:
        cond = cond & (F.col("timeframe") == timeframe)
    if asset_class is not None:
        cond = cond & (F.col("asset_class") == asset_class)
    if symbols is not None:
        syms = [symbols] if isinstance(symbols, str) else list(symbols)
        cond = cond & F.col("symbol").isin([s.upper() for s in syms])
    has_year = "year" in df.columns
    if start is not None:
        cond = cond & (F.col("timestamp") >= _ts_literal(start))
        if has_year:
            cond = cond & (F.col("year") >= _year(start))
    if end is not None:
        cond = cond & (F.col("timestamp") <= _ts_literal(end))
        if has_year:
            cond = cond & (F.col("year") <= _year(end))
    return df.filter(cond)


def standard_projection(df: DataFrame, extras: bool = False) -> DataFrame:
    """S3: the standard columns, and after them all others if ``extras``. An absent column and a stored null count alike, since a lake
    read with an explicit schema shows files without the column as null:
    adj_factor ← adj_factor, else 1.0; adj_close ← adj_close, else close × adj_factor."""
    kinds = {"timestamp": None, "symbol": None, "asset_class": "string", "timeframe": "string", "source": "string"}

    def own(name: str) -> Column:
        kind = kinds.get(name, "double")
        c = F.col(name) if name in df.columns else F.lit(None)
        return c if kind is None else c.cast(kind)

    factor = F.coalesce(own("adj_factor"), F.lit(1.0))
    made = {"adj_factor": factor, "adj_close": F.coalesce(own("adj_close"), own("close") * factor)}
    rest = [c for c in df.columns if c not in (*STANDARD, "year")] if extras else []
    return df.select(*[made.get(c, own(c)).alias(c) for c in STANDARD], *[F.col(f"`{c}`") for c in rest])


def source_rank(priority: Sequence[str] | None) -> Column:
    """Rank of the ``source`` column in a priority list (unlisted sources last)."""
    if not priority:
        return F.lit(0)
    expr = F.lit(len(priority))
    for i, s in reversed(list(enumerate(priority))):
        expr = F.when(F.lower(F.col("source")) == s.lower(), F.lit(i)).otherwise(expr)
    return expr


def dedup_bars(df: DataFrame, keys: Sequence[str] = SERIES_KEYS, source_priority: Sequence[str] | None = None,
               order: Sequence[str] | None = None) -> DataFrame:
    """Keep one row per key — best source first, then the smallest remaining columns.

    The order is total, so the winner does not depend on file or partition order (Q3).
    The window partitions on the whole key, so no series ends up in a single task.
    """
    keys = list(keys)
    rest = list(order) if order is not None else [c for c in df.columns if c not in keys and c != "source"]
    by_source = ([source_rank(source_priority)] if source_priority else []) + [F.col("source").asc_nulls_first()] \
        if "source" in df.columns else []
    w = Window.partitionBy(*keys).orderBy(*by_source, *[F.col(c).asc_nulls_first() for c in rest])
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the last row per key in the given ingestion order (later wins)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def adjust(df: DataFrame, adjusted=True) -> DataFrame:
    """True → OHLC × adj_factor, drop adj_factor; False → drop adj_close, adj_factor;
    'factor' → raw prices with adj_factor kept."""
    if adjusted is True:
        out = df
        for c in ("open", "high", "low", "close"):
            out = out.withColumn(c, F.col(c) * F.col("adj_factor"))
        return out.drop("adj_factor")
    if adjusted is False:
        return df.drop("adj_close", "adj_factor")
    if adjusted == "factor":
        return df
    raise ValueError(f"adjusted must be True, False or 'factor', got {adjusted!r}")


def get_ohlcv(lake: DataFrame, symbols=None, timeframe: str | None = "D1", start=None, end=None,
              adjusted=True, source_priority: Sequence[str] | None = None, keep_block: bool = False,
              ordered: bool = False, extras: bool = False) -> DataFrame:
    """Bars of some (or all) symbols, de-duplicated and (un)adjusted; by symbol and
    timestamp if ``ordered`` (L1, a range-partitioned sort); with the lake's extra columns if ``extras`` (S3).

    ``keep_block`` partitions the de-dup on (symbol, time block) and returns the block as
    ``__blk``: per-series sequential work after it (returns, momentum) then reuses that
    exchange and that sort. (The timeframe is left out of the hash: it is often a
    constant, which Catalyst folds into the exchange but not into the window keys.)
    """
    bars = standard_projection(filter_bars(lake, symbols, timeframe, start, end), extras)
    if keep_block:
        bars = (bars.withColumn("__blk", block_of("timestamp", block_seconds_column("timeframe")))
                .repartition("symbol", "__blk"))
        bars = dedup_bars(bars, keys=["symbol", "timeframe", "__blk", "timestamp"], source_priority=source_priority)
    else:
        bars = dedup_bars(bars, source_priority=source_priority)
    bars = adjust(bars, adjusted)
    return bars.orderBy("symbol", "timestamp") if ordered else bars


def chart_records(bars: DataFrame, start=None, end=None) -> DataFrame:
    """Chart points — time text, OHLC, volume (null → 0); rows lacking open or
    close dropped; one point per (symbol, timeframe, time), the last ingested."""
    d = bars
    if start is not None:
        d = d.filter(F.col("timestamp") >= _ts_literal(start))
    if end is not None:
        d = d.filter(F.col("timestamp") <= _ts_literal(end))
    d = d.filter(F.col("open").isNotNull() & F.col("close").isNotNull())
    return d.select(
        "symbol", "timeframe", "timestamp",
        chart_time("timestamp", F.col("timeframe")).alias("time"),
        "open", "high", "low", "close",
        F.coalesce(F.col("volume"), F.lit(0.0)).alias("value"),
    )


def with_returns(bars: DataFrame, n: int = 1, price: str = "close", out: str | None = None,
                 keys: Sequence[str] = ("symbol", "timeframe"), block_seconds: int | None = None) -> DataFrame:
    """Simple return over ``n`` bars, (p − lag(p, n)) / lag(p, n), per series."""
    out = out or ("return_1" if n == 1 else f"return_{n}")
    bs = block_seconds or (block_seconds_column("timeframe") if "timeframe" in bars.columns
                           else block_seconds_for(None))
    # bars from get_ohlcv(keep_block=True) are already partitioned by (series, block)
    blk = "__blk" if "__blk" in bars.columns and block_seconds is None else None
    d = lag_n(bars, list(keys), "timestamp", price, n, "__prev", bs, block_col=blk)
    return d.withColumn(out, (F.col(price) - F.col("__prev")) / F.col("__prev")).drop("__prev")


def momentum(bars: DataFrame, n: int = 20, price: str = "close",
             keys: Sequence[str] = ("symbol", "timeframe"), block_seconds: int | None = None) -> DataFrame:
    """``momentum_{n}d`` = (close − lag(close, n)) / lag(close, n)."""
    return with_returns(bars, n, price, f"momentum_{n}d", keys, block_seconds)


def latest_bar(bars: DataFrame, keys: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """The last bar of every series (an aggregate: partial per task, no sort)."""
    cols = [c for c in bars.columns if c not in keys]
    return (bars.groupBy(*keys)
            .agg(F.max_by(F.struct(*cols), F.col("timestamp")).alias("__b"))
            .select(*keys, *[F.col("__b")[c].alias(c) for c in cols]))


def last_n_bars(bars: DataFrame, n: int = 100) -> DataFrame:
    """L2: the ``n`` most recent bars (TakeOrdered, a top-k, not a global sort)."""
    ties = [F.col(c) for c in ("symbol", "timeframe", "asset_class") if c in bars.columns]
    return bars.orderBy(F.col("timestamp").desc(), *ties).limit(n)


def top_symbols(bars: DataFrame, k: int = 10, timeframe: str = "D1", asset_class: str = "stocks") -> DataFrame:
    """Series with the most bars: symbol, timeframe, bars, first and last date."""
    return (bars.filter((F.col("asset_class") == asset_class) & (F.col("timeframe") == timeframe))
            .groupBy("symbol", "timeframe")
            .agg(F.count(F.lit(1)).alias("bars"), F.min("timestamp").alias("start_date"),
                 F.max("timestamp").alias("end_date"))
            .orderBy(F.col("bars").desc(), F.col("symbol"))
            .limit(k))


def symbols_of_class(catalog: DataFrame, asset_class: str) -> DataFrame:
    """Distinct symbols of an asset class."""
    return catalog.filter(F.col("asset_class") == asset_class).select("symbol").distinct()
