"""Column-level helpers (all JVM-side built-ins, no Python UDFs)."""

from .columns import (adj_factor, vendor_adj_factor, clean_ticker, crypto_pair, crypto_storage_symbol,
                      forex_base_symbol, symbol_asset_class, vendor_symbol, quality_tier, display_label,
                      candle_up, numeric, timeframe_to_vendor, TIMEFRAMES, VENDOR_TIMEFRAMES)
from .time import (to_utc_naive, epoch_seconds, format_timestamp, chart_time, timeframe_step_seconds)

__all__ = [
    "adj_factor", "vendor_adj_factor", "clean_ticker", "crypto_pair", "crypto_storage_symbol",
    "forex_base_symbol", "symbol_asset_class", "vendor_symbol", "quality_tier", "display_label",
    "candle_up", "numeric", "timeframe_to_vendor", "TIMEFRAMES", "VENDOR_TIMEFRAMES",
    "to_utc_naive", "epoch_seconds", "format_timestamp", "chart_time", "timeframe_step_seconds",
]
