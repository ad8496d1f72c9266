"""Table schemas of the lake (one place, explicit, never inferred)."""

from pyspark.sql import types as T

# Canonical bar columns, in the standard order (extras follow them).
BAR_COLUMNS = [
    "timestamp", "symbol", "asset_class", "timeframe",
    "open", "high", "low", "close", "volume",
    "adj_close", "adj_factor", "source", "year",
]
PRICE_COLUMNS = ["open", "high", "low", "close"]
#: Folders of the bar lake: many symbols share one, so that their number does not grow with the symbols and years.
SYMBOL_BUCKET, SYMBOL_BUCKETS = "symbol_bucket", 64
PARTITION_COLUMNS = ["asset_class", "timeframe", SYMBOL_BUCKET]

OHLCV = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
    T.StructField("adj_close", T.DoubleType()),
    T.StructField("adj_factor", T.DoubleType()),
    T.StructField("source", T.StringType()),
    # folder names in some lakes, columns in others: typed explicitly so '0001' stays a string
    T.StructField("asset_class", T.StringType()),
    T.StructField("timeframe", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("year", T.IntegerType()),
])

CATALOG = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("timeframe", T.StringType()),
    T.StructField("asset_class", T.StringType()),
    T.StructField("start_date", T.TimestampNTZType()),
    T.StructField("end_date", T.TimestampNTZType()),
    T.StructField("rows_count", T.LongType()),
    T.StructField("nulls_pct", T.DoubleType()),
    T.StructField("quality_score", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("last_updated", T.TimestampNTZType()),
])

METADATA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("exchange", T.StringType()),
    T.StructField("shortname", T.StringType()),
    T.StructField("longname", T.StringType()),
    T.StructField("sector", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("marketcap", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("summary", T.StringType()),
    T.StructField("last_updated", T.TimestampNTZType()),
])

FINANCIALS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("report_date", T.TimestampNTZType()),
    T.StructField("fiscal_period", T.StringType()),
    T.StructField("revenue", T.DoubleType()),
    T.StructField("net_income", T.DoubleType()),
    T.StructField("eps", T.DoubleType()),
    T.StructField("total_assets", T.DoubleType()),
    T.StructField("total_liabilities", T.DoubleType()),
    T.StructField("equity", T.DoubleType()),
    T.StructField("cash", T.DoubleType()),
    T.StructField("total_debt", T.DoubleType()),
    T.StructField("operating_cf", T.DoubleType()),
    T.StructField("capex", T.DoubleType()),
    T.StructField("free_cash_flow", T.DoubleType()),
    T.StructField("eps_estimate", T.DoubleType()),
    T.StructField("actual_eps", T.DoubleType()),
    T.StructField("eps_surprise", T.DoubleType()),
])

CORPORATE_ACTIONS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("action_type", T.StringType()),
    T.StructField("split_factor", T.DoubleType()),
    T.StructField("dividend_amount", T.DoubleType()),
])
