"""Point-in-time consolidated feature table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import Right, asof_fill, since
from .bars import _ts_literal, adjust, dedup_bars, filter_bars, lag_n, standard_projection
from .blocked import block_seconds_for

# fixed values: output order of the joined columns (only those present are returned)
JOINED_COLUMNS = ["realized_vol_30d", "implied_vol", "pe_ratio", "price_to_book", "beta_raw", "sales",
                  "beta_adj", "revenue", "net_income", "eps", "cash", "free_cash_flow"]
FUNDAMENTAL_COLUMNS = ["implied_vol", "pe_ratio", "price_to_book", "beta_raw", "sales", "beta_adj"]
FINANCIAL_COLUMNS = ["revenue", "net_income", "eps", "cash", "free_cash_flow"]


def _present(df: DataFrame | None, wanted: Sequence[str]) -> list[str]:
    return [] if df is None else [c for c in wanted if c in df.columns]


def _day_after(value) -> dt.datetime:
    d = value if isinstance(value, (dt.date, dt.datetime)) else dt.date.fromisoformat(str(value)[:10])
    d = dt.date(d.year, d.month, d.day)
    return dt.datetime.combine(d + dt.timedelta(days=1), dt.time())


def prepare_financials(fin: DataFrame, lag_days: int = 0) -> DataFrame:
    """Financials as an as-of right side: timestamp = report_date (+ ``lag_days``, the
    publication delay; 0 reproduces the reference, which looks ahead: Q7), FCF derived
    when absent (N15)."""
    d = fin
    if "free_cash_flow" not in d.columns and "operating_cf" in d.columns:
        capex = F.coalesce(F.abs(F.col("capex")), F.lit(0.0)) if "capex" in d.columns else F.lit(0.0)
        d = d.withColumn("free_cash_flow", F.col("operating_cf") - capex)
    ts = F.col("report_date")
    if lag_days:
        ts = F.timestampadd("DAY", F.lit(lag_days), ts)
    return d.withColumn("timestamp", ts)


def consolidated(lake: DataFrame, volatility: DataFrame | None = None, fundamentals: DataFrame | None = None,
                 financials: DataFrame | None = None, metadata: DataFrame | None = None, symbols=None,
                 timeframe: str = "D1", adjusted=True, start=None, end=None, keep_keys: bool = False,
                 financials_lag_days: int = 0) -> DataFrame:
    """Bars + company constants + as-of realised vol, vendor fundamentals and
    quarterly financials, for all (or some) symbols in one job.

    Columns: date, symbol, company_name, sector, industry, market_cap, open, high, low,
    close, volume, then the joined columns that exist. The date window is applied to the
    bars *before* the fill (equivalent, since the right sides keep their last values before ``start``, one
    row per symbol, and are cut at ``end``). ``keep_keys`` adds timestamp,
    timeframe and asset_class (the SQL view E5 needs them).
    """
    # bars of the window, not yet de-duplicated: the fill runs first and the de-dup
    # shares its (symbol, block) partitioning, so the bars are shuffled once
    bars = standard_projection(filter_bars(lake, symbols, timeframe))
    rights = []
    if volatility is not None:
        rights.append(Right(volatility, _present(volatility, ["realized_vol_30d"])))
    if fundamentals is not None:
        rights.append(Right(fundamentals, _present(fundamentals, FUNDAMENTAL_COLUMNS)))      # J8
    if financials is not None:
        fin = prepare_financials(financials, financials_lag_days)
        rights.append(Right(fin, _present(fin, FINANCIAL_COLUMNS)))
    rights = [r for r in rights if r.columns]
    if symbols is not None:
        syms = [s.upper() for s in ([symbols] if isinstance(symbols, str) else symbols)]
        rights = [Right(r.df.filter(F.col("symbol").isin(syms)), r.columns) for r in rights]
    if start is not None:
        lo = _ts_literal(str(start)[:10])
        bars = bars.filter(F.col("timestamp") >= lo)
        rights = [since(r, "symbol", lo) for r in rights]
    if end is not None:
        stop = F.lit(_day_after(end)).cast("timestamp_ntz")
        bars = bars.filter(F.col("timestamp") < stop)
        rights = [Right(r.df.filter(F.col(r.ts) < stop), r.columns) for r in rights]

    bar_cols = ["asset_class", "timeframe", "open", "high", "low", "close", "volume", "adj_close", "adj_factor",
                "source"]
    rest = ["asset_class", "open", "high", "low", "close", "volume", "adj_close", "adj_factor"]
    meta = None if metadata is None else metadata.select("symbol", "longname", "sector", "industry", "marketcap")
    packed = None
    if rights and meta is not None and not keep_keys:
        # a symbol's metadata (all rows of it) ride along in the fill: a join would deal the filled rows by symbol once more
        packed = meta.groupBy("symbol").agg(F.collect_list(F.struct("longname", "sector", "industry", "marketcap")).alias("__meta"))
    if rights:
        # the fill sorts each (symbol, block) by timestamp, then by W3's order, so the
        # de-dup window (keys in the same order) reuses that sort instead of its own
        filled = asof_fill(bars, rights, by="symbol", ts="timestamp", block_seconds=block_seconds_for(timeframe),
                           keep=bar_cols, keep_block=True, left_order=["timeframe", "source", *rest], constants=packed)
        filled = dedup_bars(filled, keys=["symbol", "__blk", "timestamp", "timeframe"], order=rest)
    else:
        filled = dedup_bars(bars, order=rest).withColumn("__blk", F.lit(None).cast("long"))
    filled = adjust(filled, adjusted)

    if packed is not None:
        filled = filled.select("*", F.inline_outer("__meta"))
    elif meta is not None:
        filled = filled.join(meta, "symbol", "left")       # keeps the order in a block when it is broadcast
    else:
        filled = (filled.withColumn("longname", F.lit(None).cast("string"))
                  .withColumn("sector", F.lit(None).cast("string"))
                  .withColumn("industry", F.lit(None).cast("string"))
                  .withColumn("marketcap", F.lit(None).cast("double")))
    joined = [c for c in JOINED_COLUMNS if c in filled.columns]
    keys = ["timestamp", "timeframe", "asset_class", "__blk"] if keep_keys else []
    return filled.select(
        F.date_format("timestamp", "yyyy-MM-dd").alias("date"), "symbol",
        F.coalesce(F.col("longname"), F.lit("")).alias("company_name"),
        F.coalesce(F.col("sector"), F.lit("")).alias("sector"),
        F.coalesce(F.col("industry"), F.lit("")).alias("industry"),
        F.col("marketcap").alias("market_cap"),
        "open", "high", "low", "close", "volume", *joined, *keys)


def feature_table(consolidated_view: DataFrame, n: int = 20, timeframe: str = "D1", bars: DataFrame | None = None) -> DataFrame:
    """Momentum feature over the consolidated view (needs ``keep_keys=True``; its
    (symbol, block) partitioning is reused, so the lag adds no shuffle of the rows).

    ``bars`` (``get_ohlcv(…, keep_block=True)`` of the same lake) give the closes at the blocks' ends without
    the as-of pipeline; without them they come from the view, column by column what they need.
    """
    d = lag_n(consolidated_view, ["symbol"], "timestamp", "close", n, "__prev", block_seconds_for(timeframe),
              block_col="__blk", edges=bars)
    return d.withColumn(f"momentum_{n}d", (F.col("close") - F.col("__prev")) / F.col("__prev")).drop("__prev")


def wide_prices(bars: DataFrame, symbols: Sequence[str], value: str = "adj_close") -> DataFrame:
    """One row per timestamp, one column for each of ``symbols``. The caller names them:
    they are the schema of the result, and finding them would collect every symbol."""
    return bars.groupBy("timestamp").pivot("symbol", list(symbols)).agg(F.max(value))


def register_consolidated_view(lake: DataFrame, name: str = "ohlcv_consolidated", **kw) -> DataFrame:
    """E5: the consolidated table of every symbol as a SQL view (with ``timestamp``,
    ``timeframe`` and ``asset_class``, which the documented queries filter on).

    ``kw`` are ``consolidated`` arguments (right tables, metadata, timeframe …).
    """
    view = consolidated(lake, keep_keys=True, **kw).drop("__blk")
    view.createOrReplaceTempView(name)
    return view
