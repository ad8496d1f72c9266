"""Time helpers. All lake timestamps are TIMESTAMP_NTZ holding UTC wall time."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: canonical timeframe → bar length in seconds (0 = calendar) ----
TIMEFRAME_SECONDS = {"1m": 60, "2m": 120, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600,
                     "4h": 14400, "D1": 86400, "1W": 604800, "1M": 0}
DAILY_TIMEFRAMES = ["D1", "1W", "1M"]
# -----------------------------------------------------------------------------------

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_utc_naive(ts, source_tz: str) -> Column:
    """A naive local wall time in ``source_tz`` → naive UTC (TIMESTAMP_NTZ).

    Strings carrying an offset are parsed as instants first. Spark resolves DST gaps and
    overlaps without raising (see README)."""
    col = _c(ts)
    as_ntz = col.try_cast("timestamp_ntz")
    return F.convert_timezone(F.lit(source_tz), F.lit("UTC"), as_ntz)


def epoch_seconds(ts) -> Column:
    """Seconds since the epoch of a naive-UTC timestamp, independent of session zone."""
    return F.timestamp_diff("SECOND", F.expr(_EPOCH), _c(ts))


def format_timestamp(ts, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Text form of a timestamp."""
    return F.date_format(_c(ts), fmt)


def chart_time(ts, timeframe) -> Column:
    """Daily timeframes as ``yyyy-MM-dd``, intraday as epoch seconds (text)."""
    tf = _c(timeframe)
    return F.when(tf.isin(DAILY_TIMEFRAMES), F.date_format(_c(ts), "yyyy-MM-dd")) \
        .otherwise(epoch_seconds(ts).cast("string"))


def timeframe_step_seconds(timeframe) -> Column:
    """Bar length in seconds of a canonical timeframe (0 for the calendar month)."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(TIMEFRAME_SECONDS.items())])
    return m[_c(timeframe)]
