"""Update planning over the catalog (P1-P7, A13, E11): each plan is one DataFrame job.

The plan says *what* to fetch; fetching itself (network) is outside this package:
callers land vendor payloads as files, which ``sources`` reads.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import CATALOG_KEY, active, catalog_of_state, filter_catalog, missing_symbols, upsert_datasets
from ..session import ensure_checkpoint_dir
from ..sources.versioned import VersionedLake

# ---- fixed values that must equal the reference's --------------------------------
INTRADAY_MINUTE_FRAMES = ["1m", "2m", "5m", "15m", "30m"]
HOUR_FRAMES = ["1h", "4h"]
DEFAULT_D1_START = "2022-01-01"          # D1 plan start when a series has no end date
BULK_DEFAULT_DAYS = 730                  # bulk intraday plan: start this many days back
MISSING_RANGE = ("1996-01-02", "2026-08-16")  # fixed range of the missing-symbol plan
CLAMP_DAYS = {"yfinance_1m": 29, "yfinance_intraday": 59, "alpaca": 730}
YF_INTRADAY = ["2m", "5m", "15m", "30m", "1h", "4h"]
# ----------------------------------------------------------------------------------


def _now(now) -> Column:
    if now is None:
        return F.localtimestamp().cast("timestamp_ntz")
    return F.lit(now if isinstance(now, dt.datetime) else str(now)).cast("timestamp_ntz")


def _fmt(ts: Column, timeframe: Column) -> Column:
    return F.when(timeframe == "D1", F.date_format(ts, "yyyy-MM-dd")) \
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def next_start(end: Column, timeframe: Column) -> Column:
    """First timestamp after a series' end that the next update must fetch."""
    return (F.when(timeframe == "D1", end + F.expr("INTERVAL 1 DAY"))
            .when(timeframe.isin(HOUR_FRAMES), end + F.expr("INTERVAL 1 HOUR"))
            .when(timeframe.isin(INTRADAY_MINUTE_FRAMES), end + F.expr("INTERVAL 1 MINUTE"))
            .otherwise(end + F.expr("INTERVAL 1 SECOND")))


def plan_updates(catalog: DataFrame, now=None) -> DataFrame:
    """P1 + P2: one row per catalog series with status 'update' / 'up_to_date' / 'skipped' /
    'bad_end_date' (blank or unreadable: that series alone is left out), the text range to fetch, the connector and the vendor time zone."""
    n = _now(now)
    tf, ac = F.col("timeframe"), F.col("asset_class")
    skipped = (ac == "macro") | (F.col("source") == "dolt_rates")
    start = next_start(F.col("end_date").try_cast("timestamp_ntz"), tf)
    status = (F.when(skipped, F.lit("skipped")).when(start.isNull(), F.lit("bad_end_date")).when(start >= n, F.lit("up_to_date")).otherwise(F.lit("update")))
    go = status == "update"
    return catalog.select(
        "symbol", "timeframe", "asset_class",
        F.when(go, _fmt(start, tf)).alias("start"), F.when(go, _fmt(n, tf)).alias("end"),
        F.when(go, F.when(ac == "crypto", F.lit("binance")).otherwise(F.lit("yfinance"))).alias("connector"),
        F.when(go & (ac != "crypto"), F.when(ac == "forex", F.lit("UTC")).otherwise(F.lit("America/New_York")))
        .alias("source_tz"),
        status.alias("status"))


def update_summary(plan: DataFrame) -> DataFrame:
    """Counts per status of a plan or run log."""
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("series"))


def plan_daily_stocks(catalog: DataFrame, now=None) -> DataFrame:
    """Active D1 stock series: next day after the end date (default start when the
    end date is blank), skipped when that day is not before ``now``. A date that is neither
    blank nor readable gives ``bad_end_date`` and no start, for its series alone."""
    n = _now(now)
    d = active(catalog, "stocks", "D1")
    end = F.col("end_date").cast("string")
    blank = end.isNull() | (F.trim(end) == "") | (end == "N/A")
    start = F.when(blank, F.lit(DEFAULT_D1_START).cast("timestamp_ntz")) \
        .otherwise(F.substring(end, 1, 10).try_cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    return d.select("symbol", F.date_format(start, "yyyy-MM-dd").alias("start"),
                    F.date_format(n, "yyyy-MM-dd").alias("end"),
                    F.when(start.isNull(), F.lit("bad_end_date")).when(start >= n, F.lit("up_to_date"))
                    .otherwise(F.lit("update")).alias("status"))


def plan_bulk(metadata: DataFrame, catalog: DataFrame, timeframe: str = "1m", now=None) -> DataFrame:
    """Every metadata symbol; the day after its catalogued end, else ``now`` − 730 days (also
    where no catalogued end is readable; unreadable ones count as absent)."""
    n = _now(now)
    ends = catalog.filter(F.col("timeframe") == timeframe).groupBy("symbol").agg(
        F.max(F.col("end_date").try_cast("date")).alias("__end"))
    d = metadata.select("symbol").join(ends, "symbol", "left")
    start = F.coalesce(F.col("__end") + F.expr("INTERVAL 1 DAY"),
                       F.to_date(n - F.expr(f"INTERVAL {BULK_DEFAULT_DAYS} DAY")))
    return d.select("symbol", F.date_format(start, "yyyy-MM-dd").alias("start"),
                    F.date_format(n, "yyyy-MM-dd").alias("end"))


def plan_missing(universe: DataFrame, catalog: DataFrame, start: str = MISSING_RANGE[0],
                 end: str = MISSING_RANGE[1]) -> DataFrame:
    """P5: universe symbols with no active stock series, with a fixed range."""
    return missing_symbols(universe, catalog).select("symbol", F.lit(start).alias("start"), F.lit(end).alias("end"))


def resample_work_list(catalog: DataFrame) -> DataFrame:
    """Stock symbols with 1m rows (then a semi-join, never a loop)."""
    return active(catalog, "stocks", "1m").select("symbol").distinct()


def history_clamp(plan: DataFrame, vendor: str, now=None) -> DataFrame:
    """Clamp plan starts to the vendor's history limit; drop rows with start ≥ end.

    ``plan`` has ``timeframe``, ``start`` and ``end`` timestamps. yfinance: 1m 29 days,
    other intraday 59 days; the JSON-bars vendor: 730 days for every timeframe.
    """
    n = _now(now)
    tf = F.col("timeframe")
    if vendor == "yfinance":
        limit = (F.when(tf == "1m", n - F.expr(f"INTERVAL {CLAMP_DAYS['yfinance_1m']} DAY"))
                 .when(tf.isin(YF_INTRADAY), n - F.expr(f"INTERVAL {CLAMP_DAYS['yfinance_intraday']} DAY")))
    elif vendor == "alpaca":
        limit = n - F.expr(f"INTERVAL {CLAMP_DAYS['alpaca']} DAY")
    else:
        raise ValueError(f"unknown vendor {vendor!r}")
    start = F.when(limit.isNotNull() & (F.col("start") < limit), limit).otherwise(F.col("start"))
    return plan.withColumn("start", start).filter(F.col("start") < F.col("end"))


def apply_updates(catalog: DataFrame, landed: DataFrame, lake_root: str, now=None,
                  plan: DataFrame | None = None, symbols=None, asset_classes=None) -> tuple[DataFrame, DataFrame]:
    """One incremental update of the lake from landed vendor bars.

    The plan (P1 + P2) gives each catalogued series its fetch window; landed rows inside their series' window are
    appended to the lake (K1) in one commit, which also merges their state into the lake's series state. The catalog rows of
    the series that received rows come from that state (C5) and are upserted (C1): the lake's own bars are not read.
    Returns the new catalog and the run log (status per series: ``success``, ``no_new_rows``, ``up_to_date`` or
    ``skipped``; see ``update_summary``).

    Exactly once: rows up to the last committed time of their series are left out, so a run that is started again (after a
    failure past its commit, or with a catalog that was not saved) adds nothing twice, whatever ``now`` is. ``landed`` is
    any reader's output in the canonical schema. The window table (one row per series) is written to the shared checkpoint
    folder first; landed rows are evaluated for the write alone. ``symbols`` / ``asset_classes`` restrict the run to those
    catalog series (F9).
    """
    spark = landed.sparkSession
    if plan is None:
        scope = catalog if symbols is None and asset_classes is None else filter_catalog(catalog, symbols, asset_classes)
        plan = plan_updates(scope, now)
    ensure_checkpoint_dir(spark)
    lake = VersionedLake(spark, lake_root)
    started = lake.manifest().version
    done = lake.state(started).select(*CATALOG_KEY, F.col("end").alias("__done"))
    windows = (plan.filter(F.col("status") == "update")
               .select(*CATALOG_KEY, F.col("start").cast("timestamp_ntz").alias("__lo"),
                       F.col("end").cast("timestamp_ntz").alias("__hi"))
               .join(done, CATALOG_KEY, "left").checkpoint(eager=True))
    ts = F.col("timestamp")
    new = (landed.join(windows, CATALOG_KEY)
           .filter((ts >= F.col("__lo")) & (ts <= F.col("__hi")) & (F.col("__done").isNull() | (ts > F.col("__done"))))
           .drop("__lo", "__hi", "__done"))
    added = lake.append(new, after=started)
    touched = added.select(*CATALOG_KEY, F.col("rows_count").alias("rows_added"))
    state = lake.state().join(touched.select(*CATALOG_KEY), CATALOG_KEY, "left_semi")
    new_catalog = upsert_datasets(catalog, catalog_of_state(state, now).select(*catalog.columns))
    st = F.col("status")
    log = plan.join(touched, CATALOG_KEY, "left").select(
        *CATALOG_KEY, "start", "end",
        F.when((st == "update") & (F.col("rows_added") > 0), F.lit("success"))
        .when(st == "update", F.lit("no_new_rows")).otherwise(st).alias("status"),
        F.coalesce(F.col("rows_added"), F.lit(0)).alias("rows_added"))
    return new_catalog, log
