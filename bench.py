"""Benchmark of the headline queries.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``;
every query is executed once to warm up, then timed ``$BENCH_REPS`` times (median)
with a ``noop`` sink so that collecting results is not what is measured. Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketlake.registered import QUERIES  # noqa: E402
from marketlake.session import build_session  # noqa: E402

HEADLINE = [
    "resample_all",          # A3: 15m + 1h + 4h for every symbol in one job (events)
    "get_ohlcv_adjusted",    # E1: filter + de-dup + adjust (lineitem bars)
    "consolidated",          # E4: one-pass as-of with three right tables
    "momentum_20d",          # E10: as-of view + skew-safe lag-20
    "quality_score",         # A5: null scan + gap detection
    "cross_validate",        # A7: two-source join and stats
    "range_override_merge",  # U2
    "facts_extract",         # X1
    "catalog_stats",         # A1
    "statements_join",       # J4/J5
]


def point_read_ms(spark, sf_dir: str, reps: int) -> float:
    """BASELINE's single-symbol partition scan: a minute-bar lake (from the events table)
    is written once to the shared scratch folder, then one symbol's bars of one day are
    read with partition pruning, de-duplicated and collected; median milliseconds."""
    from pyspark.sql import functions as F

    from marketlake.operators.bars import get_ohlcv
    from marketlake.registered import _scratch, minute_lake
    from marketlake.sources.lake import scan_bars, write_bars

    minute = minute_lake(spark, sf_dir).drop("event_id").withColumn("year", F.year("timestamp"))
    root = _scratch(spark, "bench-lake")
    write_bars(minute, root, mode="overwrite")
    first = minute.groupBy("symbol").agg(F.min("timestamp").alias("t")).orderBy("symbol").first()
    day = first.t.strftime("%Y-%m-%d")
    lake = scan_bars(spark, root)

    def once():
        return get_ohlcv(lake, [first.symbol], "1m", start=day, end=f"{day} 23:59:59").collect()

    once()
    samples = []
    for _ in range(max(reps, 5)):
        t0 = time.perf_counter()
        once()
        samples.append((time.perf_counter() - t0) * 1000.0)
    return round(statistics.median(samples), 1)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = build_session()
    times: dict[str, float] = {}
    for name in HEADLINE:
        fn = QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()      # warm-up
        samples = []
        for _ in range(reps):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    total = round(sum(times.values()), 3)
    point_ms = point_read_ms(spark, sf_dir, reps)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total_median", "value": total, "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir,
                      "reps": reps, "cpus": int(os.environ.get("BENCH_CPUS", "8")),
                      "single_symbol_point_read_ms": point_ms}))
    spark.stop()


if __name__ == "__main__":
    main()
