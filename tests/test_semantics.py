"""Edge semantics on tiny literal frames."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlake.operators import asof, bars, blocked, crossval, fundamentals, merge, normalize, quality, resample
from marketlake.functions import columns as C

T0 = dt.datetime(2024, 1, 1)


def ts(days=0, minutes=0, seconds=0):
    return T0 + dt.timedelta(days=days, minutes=minutes, seconds=seconds)


def test_daily_gap_boundary(spark):
    rows = [("A", "D1", ts(0)), ("A", "D1", ts(4)), ("A", "D1", ts(8, seconds=1)), ("A", "D1", ts(9))]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, timestamp timestamp_ntz")
    gaps = quality.detect_gaps(df).collect()
    assert len(gaps) == 1                      # exactly 4 days is not a gap
    assert gaps[0].gap_start == ts(4) and gaps[0].gap_size == 4.0 and gaps[0].gap_unit == "days"


def test_minute_gap_boundary(spark):
    rows = [("A", "1m", ts(0, 600)), ("A", "1m", ts(0, 615)), ("A", "1m", ts(0, 631)),
            ("A", "1m", ts(0, 1430)), ("A", "1m", ts(1, 5))]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, timestamp timestamp_ntz")
    gaps = sorted(quality.detect_gaps(df).collect(), key=lambda r: r.gap_start)
    # 15 min exact: no gap; 16 min: gap; 799 min same day: gap; across midnight: none
    assert [g.gap_size for g in gaps] == [16.0, 799.0]


def test_quality_score_full(spark):
    rows = [("A", "D1", ts(d), None if d == 0 else 1.0, 1.0, 1.0, 1.0) for d in (0, 10, 20, 21)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, timestamp timestamp_ntz, "
                                     "open double, high double, low double, close double")
    r = quality.quality_scores(df).collect()[0]
    # open 25 % null → mean 6.25 % → −9.375 ; 2 gaps → −10
    assert r.gaps == 2 and r.quality_score == pytest.approx(100 - 9.375 - 10)


def test_adj_factor_zero_and_null_close(spark):
    df = spark.createDataFrame([(0.0, 5.0), (None, 5.0), (2.0, 1.0)], "close double, adj_close double")
    got = [r.f for r in df.select(C.adj_factor().alias("f")).collect()]
    assert got == [1.0, 1.0, 0.5]


def test_standardize_defaults_and_empty_rows(spark):
    df = spark.createDataFrame([("2024-01-02", "1", None, None, None), ("2024-01-03", None, None, None, None),
                                ("2024-01-04", "x", "2", "1", "1.5")],
                               "Date string, Open string, High string, Low string, Close string")
    out = normalize.standardize(df, symbol="0001", source="t").orderBy("timestamp").collect()
    assert len(out) == 2                                       # all-null OHLC row dropped
    assert out[0].volume == 0.0 and out[0].adj_factor == 1.0   # absent volume → 0, null close → factor 1
    assert out[1].open is None and out[1].close == 1.5         # unparsable → null
    assert out[0].symbol == "0001" and out[0].year == 2024


def test_standardize_requires_timestamp(spark):
    df = spark.createDataFrame([(1.0,)], "open double")
    with pytest.raises(ValueError):
        normalize.standardize(df)


def test_utc_normalisation_dst(spark):
    df = spark.createDataFrame([("2024-03-10 02:30:00",), ("2024-07-01 09:30:00",), ("2024-07-01T09:30:00Z",)],
                               "timestamp string")
    out = [r.timestamp for r in normalize.to_utc(df, "America/New_York").collect()]
    assert out[1] == dt.datetime(2024, 7, 1, 13, 30)
    assert out[2] == dt.datetime(2024, 7, 1, 9, 30)           # aware text is an instant
    assert out[0] == dt.datetime(2024, 3, 10, 7, 30)          # spring gap resolved forward (Q12)


def test_resample_null_rules(spark):
    rows = [("A", ts(0, 0), None, 2.0, 0.5, 1.0, None), ("A", ts(0, 1), 1.5, 3.0, 1.0, None, None),
            ("A", ts(0, 2), 1.7, 2.5, 1.2, None, None)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, open double, high double, "
                                     "low double, close double, volume double")
    r = resample.resample(df, ["15m"]).collect()[0]
    assert (r.open, r.high, r.low, r.close, r.volume) == (1.5, 3.0, 0.5, 1.0, 0.0)
    assert r.adj_close == 1.0 and r.adj_factor == 1.0


def test_resample_drops_bars_without_close(spark):
    df = spark.createDataFrame([("A", ts(0, 0), 1.0, 1.0, 1.0, None, 1.0)],
                               "symbol string, timestamp timestamp_ntz, open double, high double, low double, "
                               "close double, volume double")
    assert resample.resample(df, ["1h"]).count() == 0


def test_resample_rollup_equals_direct(spark):
    rows = [("A", ts(0, m), float(m), float(m) + 1, float(m) - 1, None if m % 7 == 0 else float(m), float(m))
            for m in range(0, 600, 3)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, open double, high double, "
                                     "low double, close double, volume double")
    both = resample.resample(df, ["15m", "4h"]).filter(F.col("timeframe") == "4h")
    direct = resample.resample(df, ["4h"])
    assert sorted(both.collect()) == sorted(direct.collect())


def test_single_overlap_has_zero_std(spark):
    df = spark.createDataFrame([("A", "D1", ts(0), "a", 10.0), ("A", "D1", ts(0), "b", 10.5),
                                ("A", "D1", ts(1), "a", 11.0)],
                               "symbol string, timeframe string, timestamp timestamp_ntz, source string, close double")
    r = crossval.cross_validate(df, "a", "b").collect()[0]
    assert (r.source1_rows, r.source2_rows, r.rows_compared) == (2, 1, 1)
    assert r.std_difference_pct == 0.0 and r.mean_difference_pct == pytest.approx(5.0)
    assert r.reliability_score == pytest.approx(50.0)


def test_cross_validate_without_overlap(spark):
    df = spark.createDataFrame([("A", "D1", ts(0), "a", 10.0)],
                               "symbol string, timeframe string, timestamp timestamp_ntz, source string, close double")
    r = crossval.cross_validate(df, "a", "b").collect()[0]
    assert r.rows_compared == 0 and r.reliability_score == 0.0


def _plain_lag(df, keys, n):
    w = Window.partitionBy(*keys).orderBy("timestamp")
    return df.withColumn("want", F.lag("v", n).over(w))


@pytest.mark.parametrize("n", [1, 3])
def test_blocked_lag_equals_plain_window(spark, n):
    rows = [("A" if i % 3 else "B", ts(i * 2 + (i % 5)), float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, v double")
    got = blocked.lag_n(df, ["symbol"], "timestamp", "v", n, "got", block_seconds=7 * 86400)
    got = _plain_lag(got, ["symbol"], n)
    assert got.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0
    prev = blocked.previous_value(df, ["symbol"], "timestamp", "v", "got", block_seconds=5 * 86400)
    prev = _plain_lag(prev, ["symbol"], 1)
    assert prev.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_asof_equals_brute_force(spark):
    left = spark.createDataFrame([("A", ts(d)) for d in range(0, 200, 3)] + [("B", ts(d)) for d in range(5, 100, 7)],
                                 "symbol string, timestamp timestamp_ntz")
    right = spark.createDataFrame([("A", ts(d), None if d % 4 == 0 else float(d)) for d in range(1, 150, 5)],
                                  "symbol string, timestamp timestamp_ntz, x double")
    got = asof.asof_fill(left, [asof.Right(right, ["x"])], block_seconds=10 * 86400)
    brute = (left.alias("l").join(right.alias("r"), (F.col("l.symbol") == F.col("r.symbol"))
                                  & (F.col("r.timestamp") <= F.col("l.timestamp")) & F.col("r.x").isNotNull(), "left")
             .groupBy("l.symbol", "l.timestamp").agg(F.max_by("r.x", "r.timestamp").alias("x")))
    diff = got.join(brute, ["symbol", "timestamp"], "full").filter(~got.x.eqNullSafe(brute.x))
    assert got.count() == left.count() and diff.count() == 0


def test_asof_never_looks_ahead(spark):
    left = spark.createDataFrame([("A", ts(10))], "symbol string, timestamp timestamp_ntz")
    right = spark.createDataFrame([("A", ts(10), 1.0), ("A", ts(11), 2.0)], "symbol string, timestamp timestamp_ntz, x double")
    assert asof.asof_fill(left, [asof.Right(right, ["x"])]).collect()[0].x == 1.0   # exact match allowed


def test_range_override_has_no_old_rows_inside(spark):
    old = spark.createDataFrame([("A", ts(d), "b", float(d)) for d in range(10)],
                                "symbol string, timestamp timestamp_ntz, source string, close double")
    new = spark.createDataFrame([("A", ts(d), "a", -float(d)) for d in (3, 6)],
                                "symbol string, timestamp timestamp_ntz, source string, close double")
    out = merge.range_override_merge(old, new, ["symbol"]).orderBy("timestamp").collect()
    assert [r.timestamp.day for r in out] == [1, 2, 3, 4, 7, 8, 9, 10]
    assert all(r.source == "a" for r in out if ts(3) <= r.timestamp <= ts(6))


def test_dedup_prefers_source_priority(spark):
    df = spark.createDataFrame([("A", "D1", ts(0), "x", 1.0), ("A", "D1", ts(0), "y", 2.0)],
                               "symbol string, timeframe string, timestamp timestamp_ntz, source string, close double")
    assert bars.dedup_bars(df, source_priority=["y"]).collect()[0].close == 2.0
    assert bars.dedup_bars(df).collect()[0].close == 1.0


def test_fact_extraction_preference(spark):
    rows = [("S", "SalesRevenueNet", "10-Q", ts(0), 1, 5.0), ("S", "Revenues", "8-K", ts(0), 2, 9.0),
            ("S", "SalesRevenueNet", "10-K", ts(0), 3, 6.0), ("T", "Revenues", "10-Q", ts(0), 1, 7.0)]
    df = spark.createDataFrame(rows, "symbol string, concept string, form string, end_date timestamp_ntz, "
                                     "pos long, val double")
    got = {r.symbol: r.val for r in fundamentals.extract_facts(df).filter(F.col("metric") == "revenue").collect()}
    assert got == {"S": 6.0, "T": 7.0}     # 8-K ignored, fallback concept, last report wins


def test_symbol_rules(spark):
    df = spark.createDataFrame([("BTCUSDT",), ("ETH-BTC",), ("EURUSD-X",), ("^GSPC",), ("AAPL US Equity",)], "s string")
    r = df.select(C.crypto_pair("s").alias("p"), C.symbol_asset_class("s").alias("c"),
                  C.forex_base_symbol("s").alias("f"), C.clean_ticker("s").alias("t")).collect()
    assert [x.p for x in r[:2]] == ["BTC/USDT", "ETH/BTC"]
    assert [x.c for x in r] == ["stocks", "stocks", "forex", "indices", "stocks"]
    assert r[2].f == "EURUSD" and r[4].t == "AAPL"


def test_filename_rules(spark):
    from marketlake.sources.csv_sources import filename_symbol_timeframe
    df = spark.createDataFrame([("EURUSD_H1.csv",), ("GBPUSD60.csv",), ("USDJPY7.csv",), ("odd.csv",)], "n string")
    sym, tf = filename_symbol_timeframe(F.col("n"))
    got = [(r.s, r.t) for r in df.select(sym.alias("s"), tf.alias("t")).collect()]
    assert got == [("EURUSD", "1h"), ("GBPUSD", "1h"), ("USDJPY", "7m"), ("odd", "1m")]


def test_an_interval_that_a_vendor_lacks_is_an_error(spark):
    import pytest

    from marketlake.functions.columns import timeframe_to_vendor
    df = spark.createDataFrame([("1m",), ("4h",)], "timeframe string")
    assert df.where("timeframe = '1m'").select(timeframe_to_vendor("alpaca")).first()[0] == "1Min"
    with pytest.raises(Exception, match="alpaca has no interval for timeframe 4h"):
        df.select(timeframe_to_vendor("alpaca")).collect()


def test_a_right_table_since_a_time_keeps_its_last_values(spark):
    from marketlake.operators.asof import Right, asof_fill, since

    right = spark.createDataFrame([("A", 1, 1.0, None), ("A", 2, None, 5.0), ("A", 2, None, 7.0), ("A", 9, 3.0, None), ("B", 3, 4.0, None), (None, 2, 6.0, 8.0)],
                                  "symbol string, d int, x double, y double").selectExpr("symbol", "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, d) as timestamp", "x", "y")
    left = spark.createDataFrame([("A", 5), ("A", 9), ("B", 5), ("C", 5), (None, 5)], "symbol string, d int").selectExpr(
        "symbol", "d", "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, d) as timestamp")
    start = F.lit("2020-01-06").cast("timestamp_ntz")
    cut = since(Right(right, ["x", "y"]), "symbol", start)
    assert cut.df.count() == 4  # one row each of A, B and null before the start, one of A after it
    want = {("A", 5, 1.0, 7.0), ("A", 9, 3.0, 7.0), ("B", 5, 4.0, None), ("C", 5, None, None), (None, 5, 6.0, 8.0)}
    for r in (Right(right, ["x", "y"]), cut):
        out = asof_fill(left, [r], block_seconds=2 * 86_400)
        assert {(x.symbol, x.d, x.x, x.y) for x in out.collect()} == want
        assert "__t0_" not in out._jdf.queryExecution().analyzed().toString()  # values are not carried a second time as tie order
