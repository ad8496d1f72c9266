"""Streaming extension: each stream equals its batch operator on the rows it finalises."""

import os
import uuid

from pyspark.sql import functions as F

from helpers import assert_frames_match
from marketlake.operators import resample as RS
from marketlake.operators.normalize import standardize
from marketlake.registered import minute_lake
from marketlake.sources import lake
from marketlake.streaming import bars_stream as S

SF = "/root/testdata/sf0.001"


def _land_parquet(df, path, files=4):
    df.repartition(files).write.mode("overwrite").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def test_resample_stream_equals_closed_batch_bars(spark, tmpdir_path):
    minute = minute_lake(spark, SF)
    stream = _land_parquet(minute, os.path.join(tmpdir_path, "in"))
    out_path = os.path.join(tmpdir_path, "out")
    q = S.write_stream(S.resample_stream(stream, "15m", delay="10 minutes", tie=["event_id"]), out_path,
                       name=f"rs-{uuid.uuid4().hex}")
    q.awaitTermination(300)
    assert q.exception() is None
    got = spark.read.parquet(out_path).select(*[c for c in RS.resample(minute, ["15m"]).columns])

    max_ts = minute.agg(F.max("timestamp")).first()[0]
    closed = F.col("timestamp") + F.expr("interval 15 minutes") <= F.lit(max_ts) - F.expr("interval 10 minutes")
    want = RS.resample(minute, ["15m"], tie=["event_id"]).filter(closed)
    assert got.count() > 0
    assert_frames_match(got.toPandas(), want.toPandas())


def test_dedup_stream_keeps_one_row_per_key(spark, tmpdir_path):
    bars = minute_lake(spark, SF).drop("event_id")
    twice = bars.unionByName(bars.withColumn("source", F.lit("replay")))
    stream = _land_parquet(twice, os.path.join(tmpdir_path, "in"), files=3)
    out_path = os.path.join(tmpdir_path, "out")
    q = S.write_stream(S.dedup_stream(stream, delay="1 day"), out_path, name=f"dd-{uuid.uuid4().hex}")
    q.awaitTermination(300)
    assert q.exception() is None
    got = spark.read.parquet(out_path)
    keys = ["symbol", "timeframe", "timestamp"]
    assert got.count() == bars.select(*keys).distinct().count()
    assert got.groupBy(*keys).count().filter("count > 1").count() == 0


def test_land_stream_parses_each_file_once(spark, tmpdir_path):
    landed = os.path.join(tmpdir_path, "landed")
    os.makedirs(landed)
    root = os.path.join(tmpdir_path, "lake")
    header = "Date,Open,High,Low,Close,Volume,Symbol\n"

    def land(name, days):
        with open(os.path.join(landed, name), "w") as f:
            f.write(header + "".join(f"2024-01-{d:02d},1,2,0.5,1.5,10,{name[:3].upper()}\n" for d in days))

    def parse(raw):
        return standardize(raw, asset_class="stocks", timeframe="D1", source="landed", source_tz="UTC")

    schema = "Date string, Open string, High string, Low string, Close string, Volume string, Symbol string"
    name = f"land-{uuid.uuid4().hex}"
    land("aaa.csv", range(1, 11))
    q = S.land_stream(spark, landed, root, parse, schema, name=name, options={"header": "true"})
    q.awaitTermination(300)
    assert q.exception() is None
    assert lake.scan_bars(spark, root).count() == 10

    land("bbb.csv", range(1, 6))                  # a second run sees only the new file
    q = S.land_stream(spark, landed, root, parse, schema, name=name, options={"header": "true"})
    q.awaitTermination(300)
    got = lake.scan_bars(spark, root).groupBy("symbol").count().orderBy("symbol").collect()
    assert [(r.symbol, r["count"]) for r in got] == [("AAA", 10), ("BBB", 5)]
