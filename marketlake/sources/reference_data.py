"""Reference tables: macro series, yield curve, corporate actions, option data,
vendor fundamentals / volatility (S12, S14-S17, S20, S21, U1, N16, N18, N25)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_ticker

# ---- fixed values that must equal the reference's --------------------------------
YIELD_TENORS = {"3_month": "t_bill_3m", "2_year": "t_note_2y", "10_year": "t_note_10y", "30_year": "t_bond_30y"}
VENDOR_FUNDAMENTALS = {"Implied_Vol": "implied_vol", "PE_Ratio": "pe_ratio", "Price_to_Book": "price_to_book",
                       "Beta_Raw": "beta_raw", "Sales": "sales", "Beta_Adj": "beta_adj"}
VENDOR_VOLATILITY = {"Realized_Vol_30D": "realized_vol_30d"}
YIELD_CURVE_SYMBOL = "US_YIELD_CURVE"
# ----------------------------------------------------------------------------------


def macro_series(raw: DataFrame, source: str = "fred") -> DataFrame:
    """(symbol, timestamp, value) for any number of series: value coerced to
    double, null values dropped, lake constants added."""
    return (raw.select("symbol", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
                       F.col("value").try_cast("double").alias("value"))
            .filter(F.col("value").isNotNull())
            .withColumn("asset_class", F.lit("macro")).withColumn("timeframe", F.lit("D1"))
            .withColumn("source", F.lit(source)))


def macro(macro_table: DataFrame, symbol: str, start=None, end=None, yield_curve: DataFrame | None = None) -> DataFrame:
    """One series by name (case-insensitive); ``US_YIELD_CURVE`` reads the 10-year
    tenor of the yield curve. Returns time (epoch seconds) and value (null → 0.0)."""
    if symbol.upper() == YIELD_CURVE_SYMBOL and yield_curve is not None:
        d = yield_curve.select("timestamp", F.col("t_note_10y").alias("value"))
    else:
        d = macro_table.filter(F.upper("symbol") == symbol.upper()).select("timestamp", "value")
    if start is not None:
        d = d.filter(F.col("timestamp") >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        d = d.filter(F.col("timestamp") <= F.lit(str(end)).cast("timestamp_ntz"))
    return d.select(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                                     F.col("timestamp")).alias("time"),
                    F.coalesce(F.col("value"), F.lit(0.0)).alias("value"))


def yield_curve(rates: DataFrame, columns: dict[str, str] | None = None, date_col: str = "date") -> DataFrame:
    """S15 + N16: tenors renamed, date parsed, 2-10 spread = 10y − 2y."""
    mapping = columns or YIELD_TENORS
    d = rates.select(F.col(date_col).cast("timestamp_ntz").alias("timestamp"),
                     *[F.col(f"`{src}`").cast("double").alias(dst) for src, dst in mapping.items()
                       if src in rates.columns])
    return d.withColumn("yield_spread_2_10", F.col("t_note_10y") - F.col("t_note_2y"))


def corporate_actions(splits: DataFrame, dividends: DataFrame) -> DataFrame:
    """U1 + N18: splits (factor = to/for, dividend 0.0) ∪ dividends (factor 1.0)."""
    s = splits.select(F.col("act_symbol").alias("symbol"), F.col("ex_date").cast("timestamp_ntz").alias("date"),
                      F.lit("split").alias("action_type"),
                      F.try_divide(F.col("to_factor"), F.col("for_factor")).cast("double").alias("split_factor"),
                      F.lit(0.0).alias("dividend_amount"))
    d = dividends.select(F.col("act_symbol").alias("symbol"), F.col("ex_date").cast("timestamp_ntz").alias("date"),
                         F.lit("dividend").alias("action_type"), F.lit(1.0).alias("split_factor"),
                         F.col("amount").cast("double").alias("dividend_amount"))
    return s.unionByName(d)


def option_volatility(raw: DataFrame) -> DataFrame:
    """Option volatility table, date → timestamp, act_symbol → symbol."""
    return raw.withColumnsRenamed({"date": "timestamp", "act_symbol": "symbol"}) \
        .withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def option_chain(raw: DataFrame) -> DataFrame:
    """Option chain, same renames (sorted by timestamp, expiration, strike when written)."""
    return option_volatility(raw)


def vendor_fundamentals(raw: DataFrame) -> DataFrame:
    """S17 + N25: vendor monthly fundamentals with a clean symbol, parsed date and
    snake_case metric names."""
    d = raw.withColumn("symbol", clean_ticker("Ticker")).withColumn(
        "timestamp", F.to_timestamp_ntz(F.col("DATE").cast("string")))
    return d.select("symbol", "timestamp", *[F.col(k).try_cast("double").alias(v)
                                              for k, v in VENDOR_FUNDAMENTALS.items() if k in raw.columns])


def vendor_volatility(raw: DataFrame) -> DataFrame:
    """S17 + N25: vendor daily realised volatility."""
    d = raw.withColumn("symbol", clean_ticker("Ticker")).withColumn(
        "timestamp", F.to_timestamp_ntz(F.col("DATE").cast("string")))
    return d.select("symbol", "timestamp", *[F.col(k).try_cast("double").alias(v)
                                              for k, v in VENDOR_VOLATILITY.items() if k in raw.columns])


def financials_of(financials: DataFrame, symbol: str, start=None, end=None) -> DataFrame:
    """Quarterly statements of one symbol (a partition filter on the symbol column)."""
    d = financials.filter(F.col("symbol") == symbol.upper())
    if start is not None:
        d = d.filter(F.col("report_date") >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        d = d.filter(F.col("report_date") <= F.lit(str(end)).cast("timestamp_ntz"))
    return d
