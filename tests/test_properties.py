"""Property tests on random small series: every skew-safe operator
equals its plain single-window / brute-force definition for any block length."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlake.operators import asof, blocked, resample

T0 = dt.datetime(2024, 1, 1)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

offsets = st.lists(st.integers(min_value=0, max_value=60 * 24 * 40), min_size=1, max_size=60, unique=True)


def _series(spark, mins_a, mins_b):
    rows = [("A", T0 + dt.timedelta(minutes=m), float(i)) for i, m in enumerate(sorted(mins_a))]
    rows += [("B", T0 + dt.timedelta(minutes=m), float(-i)) for i, m in enumerate(sorted(mins_b))]
    return spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, v double")


@SETTINGS
@given(a=offsets, b=offsets, n=st.integers(min_value=1, max_value=6),
       block_days=st.integers(min_value=1, max_value=20))
def test_blocked_lag_is_the_plain_lag(spark, a, b, n, block_days):
    df = _series(spark, a, b)
    got = blocked.lag_n(df, ["symbol"], "timestamp", "v", n, "got", block_seconds=block_days * 86_400)
    want = got.withColumn("want", F.lag("v", n).over(Window.partitionBy("symbol").orderBy("timestamp")))
    assert want.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0
    prev = blocked.previous_value(df, ["symbol"], "timestamp", "v", "got", block_seconds=block_days * 86_400)
    want = prev.withColumn("want", F.lag("v", 1).over(Window.partitionBy("symbol").orderBy("timestamp")))
    assert want.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


@SETTINGS
@given(left=offsets, right=offsets, nulls=st.integers(min_value=2, max_value=5),
       block_days=st.integers(min_value=1, max_value=20))
def test_asof_is_the_brute_force_as_of(spark, left, right, nulls, block_days):
    lf = spark.createDataFrame([("A", T0 + dt.timedelta(minutes=m)) for m in left],
                               "symbol string, timestamp timestamp_ntz")
    rows = [("A", T0 + dt.timedelta(minutes=m), None if i % nulls == 0 else float(i), float(i))
            for i, m in enumerate(sorted(right))]
    r1 = spark.createDataFrame([(s, t, x) for s, t, x, _ in rows], "symbol string, timestamp timestamp_ntz, x double")
    r2 = spark.createDataFrame([(s, t, y) for s, t, _, y in rows[::2]],
                               "symbol string, timestamp timestamp_ntz, y double")
    got = asof.asof_fill(lf, [asof.Right(r1, ["x"]), asof.Right(r2, ["y"])], block_seconds=block_days * 86_400)

    def brute(r, c):
        return (lf.alias("l").join(r.alias("r"), (F.col("l.symbol") == F.col("r.symbol"))
                                   & (F.col("r.timestamp") <= F.col("l.timestamp")) & F.col(f"r.{c}").isNotNull(),
                                   "left")
                .groupBy("l.symbol", "l.timestamp").agg(F.max_by(f"r.{c}", "r.timestamp").alias(c)))
    want = brute(r1, "x").join(brute(r2, "y"), ["symbol", "timestamp"])
    diff = got.join(want, ["symbol", "timestamp"], "full").filter(
        ~got.x.eqNullSafe(want.x) | ~got.y.eqNullSafe(want.y))
    assert got.count() == lf.count() and diff.count() == 0


@SETTINGS
@given(mins=offsets)
def test_resample_conserves_volume_and_price_order(spark, mins):
    rows = [("S", T0 + dt.timedelta(minutes=m), 10.0 + i % 7, 12.0 + i % 7, 9.0 + i % 7, 11.0 + i % 7, float(i % 4))
            for i, m in enumerate(mins)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, open double, high double, low double, "
                                     "close double, volume double")
    for tf, minutes in resample.RESAMPLE_MINUTES.items():
        bars = resample.resample(df, [tf])
        assert bars.agg(F.sum("volume")).first()[0] == df.agg(F.sum("volume")).first()[0]
        assert bars.filter((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
                           ).count() == 0
        starts = df.select(F.window("timestamp", f"{minutes} minutes").start.cast("timestamp_ntz").alias("t"))
        assert bars.count() == starts.distinct().count()
