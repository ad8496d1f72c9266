"""Scalar column expressions used across the lake."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's --------------------------------
# Canonical timeframe names.
TIMEFRAMES = ["1m", "2m", "5m", "15m", "30m", "1h", "4h", "D1", "1W", "1M"]
# Vendor interval names per canonical timeframe (unsupported = absent).
VENDOR_TIMEFRAMES = {
    "yfinance": {"1m": "1m", "2m": "2m", "5m": "5m", "15m": "15m", "30m": "30m", "1h": "1h",
                 "4h": "1h", "D1": "1d", "1W": "1wk", "1M": "1mo"},
    "alpaca": {"1m": "1Min", "5m": "5Min", "15m": "15Min", "1h": "1Hour", "D1": "1Day"},
    "binance": {"1m": "1m", "5m": "5m", "15m": "15m", "30m": "30m", "1h": "1h", "4h": "4h",
                "D1": "1d", "1W": "1w", "1M": "1M"},
}
# Quote currencies tried, in this order, when splitting a crypto pair.
CRYPTO_QUOTES = ["USDT", "USDC", "BUSD", "BTC", "ETH"]
# Vendor ticker suffix removed from equity tickers.
TICKER_SUFFIX = " US Equity"
# ----------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric(c) -> Column:
    """Coerce anything to DOUBLE; unparsable values become null (never raise)."""
    return _c(c).try_cast("double")


def adj_factor(close="close", adj_close="adj_close") -> Column:
    """adj_close / close, 1.0 where close is 0 or null."""
    close, adj_close = _c(close), _c(adj_close)
    return F.when((close == 0) | close.isNull(), F.lit(1.0)).otherwise(adj_close / close)


def vendor_adj_factor(close="close", adj_close="adj_close") -> Column:
    """The vendor-price variant, only defined for close > 0 (else 1.0)."""
    close, adj_close = _c(close), _c(adj_close)
    return F.when(close > 0, adj_close / close).otherwise(F.lit(1.0))


def forex_base_symbol(symbol="symbol") -> Column:
    """``EURUSD-X`` → ``EURUSD``; ``=X`` vendor suffix also dropped."""
    return F.regexp_replace(_c(symbol), r"(-X|=X)$", "")


def symbol_asset_class(symbol="symbol", default: str = "stocks") -> Column:
    """``-X``/``=X`` suffix ⇒ forex, leading ``^`` ⇒ indices, else ``default``."""
    s = _c(symbol)
    return (F.when(s.endswith("-X") | s.endswith("=X"), F.lit("forex"))
            .when(s.startswith("^"), F.lit("indices"))
            .otherwise(F.lit(default)))


def vendor_symbol(symbol="symbol", asset_class="asset_class") -> Column:
    """Symbol as the equity vendor wants it (``=X`` appended for forex)."""
    s = _c(symbol)
    return F.when((_c(asset_class) == "forex") & ~s.endswith("=X"), F.concat(s, F.lit("=X"))).otherwise(s)


def crypto_pair(symbol="symbol") -> Column:
    """``BTCUSDT``/``BTC-USDT`` → ``BTC/USDT`` (first listed quote that is a suffix wins)."""
    s = F.regexp_replace(_c(symbol), "-", "/")
    out = s
    for q in reversed(CRYPTO_QUOTES):
        base = F.left(s, F.length(s) - F.lit(len(q)))
        out = F.when(s.endswith(q), F.concat(base, F.lit("/" + q))).otherwise(out)
    return F.when(s.contains("/"), s).otherwise(out)


def crypto_storage_symbol(symbol="symbol") -> Column:
    """Storage form, separators stripped and upper-cased (``BTC/USDT`` → ``BTCUSDT``)."""
    return F.upper(F.translate(_c(symbol), "/-", ""))


def clean_ticker(ticker="Ticker") -> Column:
    """Drop the vendor's `` US Equity`` suffix and trim."""
    return F.trim(F.replace(_c(ticker), F.lit(TICKER_SUFFIX), F.lit("")))


def quality_tier(score="quality_score") -> Column:
    """High (≥90) / medium (≥70) / low."""
    s = _c(score)
    return F.when(s >= 90, "high").when(s >= 70, "medium").otherwise("low")


def display_label(symbol="symbol", longname="longname", shortname="shortname") -> Column:
    """``SYM - name`` with the long name, else short name, else ``SYM``."""
    name = F.coalesce(F.nullif(_c(longname), F.lit("")), F.nullif(_c(shortname), F.lit("")))
    return F.when(name.isNull(), _c(symbol)).otherwise(F.concat_ws(" - ", _c(symbol), name))


def candle_up(open_="open", close="close") -> Column:
    """Candle direction, close ≥ open."""
    return _c(close) >= _c(open_)


def timeframe_to_vendor(vendor: str, timeframe="timeframe") -> Column:
    """Vendor interval for a canonical timeframe; one that the vendor lacks is an error."""
    m = VENDOR_TIMEFRAMES[vendor]
    interval = F.create_map(*[F.lit(x) for x in chain.from_iterable(m.items())])[_c(timeframe)]
    return F.when(interval.isNotNull() | _c(timeframe).isNull(), interval).otherwise(
        F.raise_error(F.concat(F.lit(f"{vendor} has no interval for timeframe "), _c(timeframe))))


def vendor_to_timeframe(vendor: str, interval="interval") -> Column:
    """N14, reversed: the shortest canonical timeframe that the vendor calls so, else null."""
    back = {}
    for ours in sorted(VENDOR_TIMEFRAMES[vendor], key=TIMEFRAMES.index):
        back.setdefault(VENDOR_TIMEFRAMES[vendor][ours], ours)
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(back.items())])[_c(interval)]
