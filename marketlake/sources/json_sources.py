"""Landed JSON vendor payloads (S9, S10, S13). Network download is out of scope: a
caller lands the payloads as files and these readers parse all of them in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.normalize import standardize

BAR_FIELDS = T.StructType([T.StructField(n, t) for n, t in [
    ("t", T.StringType()), ("o", T.DoubleType()), ("h", T.DoubleType()), ("l", T.DoubleType()),
    ("c", T.DoubleType()), ("v", T.DoubleType()), ("n", T.DoubleType()), ("vw", T.DoubleType())]])
BARS_PAGE = T.StructType([
    T.StructField("bars", T.MapType(T.StringType(), T.ArrayType(BAR_FIELDS))),
    T.StructField("next_page_token", T.StringType()),
])
# fixed values: JSON-bars keys → canonical names (other keys are kept as extras)
BAR_KEYS = {"t": "timestamp", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}
KLINES_PAGE = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("end_ms", T.LongType()),
    T.StructField("klines", T.ArrayType(T.ArrayType(T.DoubleType()))),
])
FACTS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("facts", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([
        T.StructField("units", T.MapType(T.StringType(), T.ArrayType(T.StructType([
            T.StructField("end", T.StringType()), T.StructField("val", T.DoubleType()),
            T.StructField("form", T.StringType()), T.StructField("filed", T.StringType())]))))])))),
])


def read_json_bars(spark: SparkSession, path: str, timeframe: str = "1m", asset_class: str = "stocks",
                   source: str = "alpaca") -> DataFrame:
    """Pages ``{bars: {SYM: [{t,o,h,l,c,v,…}]}, next_page_token}`` → canonical bars."""
    pages = spark.read.schema(BARS_PAGE).json(path)
    rows = (pages.select(F.explode("bars").alias("symbol", "bars"))
            .select("symbol", F.explode("bars").alias("b"))
            .select("symbol", *[F.col(f"b.{k}").alias(BAR_KEYS.get(k, k)) for k in BAR_FIELDS.fieldNames()]))
    return standardize(rows, asset_class=asset_class, timeframe=timeframe, source=source, source_tz="UTC")


def read_klines(spark: SparkSession, path: str, timeframe: str = "1m", source: str = "binance") -> DataFrame:
    """Kline arrays ``[ms, o, h, l, c, v]`` per landed page; rows past the page's
    requested end are dropped; epoch milliseconds → naive UTC."""
    pages = spark.read.schema(KLINES_PAGE).json(path)
    k = pages.select("symbol", "end_ms", F.explode("klines").alias("k"))
    ts = F.timestamp_millis(F.col("k")[0].cast("long"))
    rows = (k.filter(F.col("k")[0].cast("long") <= F.col("end_ms"))
            .select(F.col("symbol"), ts.alias("timestamp"), F.col("k")[1].alias("open"), F.col("k")[2].alias("high"),
                    F.col("k")[3].alias("low"), F.col("k")[4].alias("close"), F.col("k")[5].alias("volume")))
    return standardize(rows, asset_class="crypto", timeframe=timeframe, source=source, source_tz="UTC")


def read_company_facts(spark: SparkSession, path: str) -> DataFrame:
    """Company-facts JSON → long facts (symbol, taxonomy, concept, unit, unit_pos,
    form, end_date, pos, val), ready for ``fundamentals.extract_facts``.

    Unit order inside a concept is the map's key order; report order is the array index.
    """
    raw = spark.read.schema(FACTS).json(path)
    t = raw.select("symbol", F.explode("facts").alias("taxonomy", "concepts"))
    c = t.select("symbol", "taxonomy", F.explode("concepts").alias("concept", "body"))
    u = c.select("symbol", "taxonomy", "concept",
                 F.posexplode(F.map_entries("body.units")).alias("unit_pos", "unit_entry"))
    r = u.select("symbol", "taxonomy", "concept", "unit_pos", F.col("unit_entry.key").alias("unit"),
                 F.posexplode("unit_entry.value").alias("pos", "r"))
    return r.select("symbol", "taxonomy", "concept", "unit", "unit_pos", F.col("r.form").alias("form"),
                    F.to_timestamp_ntz(F.col("r.end")).alias("end_date"), F.col("pos").cast("long").alias("pos"),
                    F.col("r.val").alias("val"))
