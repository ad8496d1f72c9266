"""Landed CSV layouts (S4-S8, S11, S18, S19): each reader parses a whole directory in
one splittable scan — no per-file loop on the driver."""

from __future__ import annotations

import csv
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clean_ticker, vendor_adj_factor
from ..operators.normalize import standardize
from ..schemas import METADATA

# ---- fixed values that must equal the reference's --------------------------------
FOREX_SUFFIX = "-X"
STOCK_TZ, FOREX_TZ = "America/New_York", "UTC"
PLATFORM_TZ = "Europe/Athens"
DELIMITERS = [",", "\t", ";"]            # counted on a line; ties go to the earlier one
PLATFORM_SUFFIX_TF = {"M1": "1m", "M5": "5m", "M15": "15m", "M30": "30m", "H1": "1h", "H4": "4h",
                      "D1": "D1", "W1": "1W", "MN1": "1M"}
PLATFORM_MINUTES_TF = {1: "1m", 5: "5m", 15: "15m", 30: "30m", 60: "1h", 240: "4h", 1440: "D1",
                       10080: "1W", 43200: "1M"}
COMBINED_NAMES = ["TIMESTAMP", "OPEN", "HIGH", "LOW", "CLOSE", "TICKVOL", "VOL", "SPREAD"]
SPLIT_NAMES = ["DATE", "TIME", "OPEN", "HIGH", "LOW", "CLOSE", "TICKVOL", "VOL", "SPREAD"]
TIMESTAMP_PATTERNS = ["yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy.MM.dd", "yyyy-MM-dd HH:mm:ss",
                      "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd"]
# ----------------------------------------------------------------------------------
#: A first field that holds date and time: a blank, or a date's separator beside a colon.
DATE_WITH_TIME = r"\s|^(?=.*[-/.]).*:"


def _lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def file_stem(col: Column) -> Column:
    return F.regexp_replace(col, r"\.[^.]*$", "")


def filename_symbol_timeframe(name: Column) -> tuple[Column, Column]:
    """``EURUSD_H1.csv`` / ``EURUSD60.csv`` → (symbol, timeframe); unknown minute
    counts become ``{n}m``; anything else is the whole stem with ``1m``."""
    stem = file_stem(name)
    ticker = "[A-Za-z0-9-]+"
    u_re = f"^({ticker})_((?i:{'|'.join(PLATFORM_SUFFIX_TF)}))$"
    d_re = f"^({ticker}?)([0-9]+)$"
    u_sym, u_tf = F.regexp_extract(stem, u_re, 1), F.upper(F.regexp_extract(stem, u_re, 2))
    d_sym, d_min = F.regexp_extract(stem, d_re, 1), F.regexp_extract(stem, d_re, 2)
    minutes = d_min.try_cast("int")
    d_tf = F.coalesce(_lit_map(PLATFORM_MINUTES_TF)[minutes], F.concat(minutes.cast("string"), F.lit("m")))
    symbol = F.when(u_sym != "", u_sym).when(d_sym != "", d_sym).otherwise(stem)
    tf = F.when(u_sym != "", F.coalesce(_lit_map(PLATFORM_SUFFIX_TF)[u_tf], F.lit("1m"))) \
        .when(d_sym != "", d_tf).otherwise(F.lit("1m"))
    return symbol, tf


def detect_delimiter(line: Column) -> Column:
    """The most frequent of ``, \\t ;`` in the line; tab when none occurs."""
    counts = [F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) for d in DELIMITERS]
    best = F.greatest(*counts)
    pick = F.lit("\t")
    for d, c in reversed(list(zip(DELIMITERS, counts))):
        pick = F.when(c == best, F.lit(d)).otherwise(pick)
    return F.when(best > 0, pick).otherwise(F.lit("\t"))


def _split(line: Column, delim: Column) -> Column:
    # split on the literal delimiter (escape it as a regex), trim every part
    pattern = F.concat(F.lit("\\Q"), delim, F.lit("\\E"))
    return F.transform(F.split(F.trim(line), pattern), lambda x: F.trim(x))


def read_platform_export(spark: SparkSession, path: str, asset_class: str = "forex",
                         source_tz: str = PLATFORM_TZ, name_column: str | None = None) -> DataFrame:
    """Trading-platform CSV exports of many files and dialects in one scan.

    A file whose first line holds ``<DATE>`` or ``<OPEN>`` has a header (its names, with
    brackets stripped, apply to the whole file); header-less files get positional names
    (combined date-time first, or date then time), cut to the column count. The
    delimiter is the most frequent of ``, \\t ;`` in the file's first line (tab by
    default). The first line of every file comes from one group-by over all lines (the
    smallest split start and row id), so no file is read whole by one task. TICKVOL is the
    volume, VOL only when there is no TICKVOL (else it is kept as ``volume_real``).
    Symbol and timeframe come from the file name (``name_column`` overrides it, e.g. a
    partition column of a landed layout).
    """
    lines = spark.read.text(path)
    name = F.col(name_column) if name_column else F.col("_metadata.file_name")
    lines = lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                         name.alias("fname"), F.col("_metadata.file_block_start").alias("__split"),
                         F.monotonically_increasing_id().alias("__row")).filter(F.trim("line") != "")

    def is_header(c: Column) -> Column:
        return F.upper(c).contains("<DATE>") | F.upper(c).contains("<OPEN>")

    # one row per file: its first non-blank line, the file's delimiter and header names
    first = lines.groupBy("file").agg(F.min_by("line", F.struct("__split", "__row")).alias("__first"))
    fdelim = detect_delimiter(F.col("__first"))
    dialect = first.select(
        "file", fdelim.alias("fdelim"),
        F.when(is_header(F.col("__first")),
               F.transform(_split(F.col("__first"), fdelim),
                           lambda x: F.trim(F.regexp_replace(F.upper(x), "[<>]", "")))).alias("hnames"))
    data = lines.filter(~is_header(F.col("line"))).drop("__split", "__row")
    data = data.join(dialect, "file", "left")
    delim = F.col("fdelim")
    d = data.withColumn("parts", _split(F.col("line"), delim))
    first = F.col("parts")[0]
    combined = first.rlike(DATE_WITH_TIME)
    n = F.size("parts")
    positional = F.when(combined, F.slice(F.array(*[F.lit(x) for x in COMBINED_NAMES]), 1, n)) \
        .otherwise(F.slice(F.array(*[F.lit(x) for x in SPLIT_NAMES]), 1, n))
    d = d.withColumn("names", F.coalesce(F.col("hnames"), positional))

    def field(nm: str) -> Column:
        pos = F.array_position(F.col("names"), F.lit(nm))
        return F.when(pos > 0, F.element_at(F.col("parts"), pos.cast("int")))

    has = (lambda nm: F.array_contains(F.col("names"), F.lit(nm)))
    ts_text = (F.when(has("DATE") & has("TIME"), F.concat_ws(" ", field("DATE"), field("TIME")))
               .when(has("DATE"), field("DATE")).when(has("TIME"), field("TIME")).otherwise(field("TIMESTAMP")))
    ts = F.coalesce(*[F.try_to_timestamp(ts_text, F.lit(p)) for p in TIMESTAMP_PATTERNS])
    symbol, tf = filename_symbol_timeframe(F.col("fname"))
    rows = d.select(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("timestamp"), symbol.alias("symbol"), tf.alias("__tf"),
        field("OPEN").alias("open"), field("HIGH").alias("high"), field("LOW").alias("low"),
        field("CLOSE").alias("close"),
        F.when(has("TICKVOL"), field("TICKVOL")).otherwise(field("VOL")).alias("volume"),
        F.when(has("TICKVOL"), field("VOL")).try_cast("double").alias("volume_real"),
        field("SPREAD").try_cast("double").alias("spread"))
    return standardize(rows, asset_class=asset_class, timeframe=F.col("__tf"), source="metatrader5",
                       source_tz=source_tz).drop("__tf")


def _file_headers(lines: DataFrame) -> DataFrame:
    """The first line of every file (path, header), of lines with their ``path`` and ``place``. Spark sorts what it aggregates when
    a buffer holds text, which would be all lines of all files. A list among the aggregates (of nulls, so it is empty) makes it
    keep one line per file in a hash table instead."""
    nothing = F.get(F.collect_list(F.lit(None).cast("string")), F.lit(0))
    return lines.groupBy("path").agg(F.coalesce(nothing, F.min_by("line", "place")).alias("header"))


def read_headed_csv(spark: SparkSession, path: str, name_column: str | None = None) -> DataFrame:
    """CSV files of one folder, each with its own header: columns are matched by name, so
    files may order, add or leave out columns. Names are compared in lower case; a column is
    called as in the first layout (by text) that has it. All are text, and
    ``__file`` and ``__size`` tell the file (``name_column``: a partition column of a landed layout that holds the
    file's name). A record is one line; lines equal to their
    file's header are left out.

    Lines are scanned in parallel; the header of each file comes from one group-by, and the
    distinct layouts (a handful, however many files) fix the schema. With a single layout no line is shuffled or sorted."""
    named = spark.read.schema(f"value string, {name_column} string") if name_column else spark.read
    lines = named.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"),
        F.col(name_column or "_metadata.file_name").alias("__file"),
        F.col("_metadata.file_size").alias("__size"),
        F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row")).alias("place")
    ).where(F.trim("line") != "")
    heads = _file_headers(lines)
    layouts = sorted(r["header"] for r in heads.select("header").distinct().collect())
    names: dict[str, str] = {}
    fields: dict[str, list[str]] = {}
    for header in layouts:
        fields[header] = [c.strip() for c in next(csv.reader([header.lstrip("\ufeff")]))]
        for c in fields[header]:
            names.setdefault(c.lower(), c)
    width = max(map(len, fields.values()), default=1)
    record = F.from_csv("line", F.lit(", ".join(f"c{i} string" for i in range(width))))
    # one layout: every file's header is known, and the lines stay where they are read
    headed = lines.withColumn("header", F.lit(layouts[0])) if len(layouts) == 1 else lines.join(heads, "path")
    rows = headed.where(F.col("line") != F.col("header")).withColumn("r", record)

    def value(name: str) -> Column:
        out = F.lit(None).cast("string")
        for header in layouts:
            low = [c.lower() for c in fields[header]]
            if name in low:
                out = F.when(F.col("header") == header, F.col(f"r.c{low.index(name)}")).otherwise(out)
        return out

    return rows.select(*[value(n).alias(shown) for n, shown in names.items()], "__file", "__size")


def read_symbol_dir(spark: SparkSession, path: str, timeframe: str = "D1", source: str = "archive",
                    min_bytes: int = 0, name_column: str | None = None) -> DataFrame:
    """A directory with one CSV per symbol (``SYM.csv`` or ``PAIR-X.csv``), each with
    its own header.

    The symbol is the file stem, a ``-X`` suffix marks forex (stripped; UTC source times),
    everything else is a stock in New York time. ``min_bytes`` leaves out smaller files
    (none by default; the archive this layout comes from is read with 75,000). ``name_column``: a partition column that
    holds the stem, of an archive landed with a folder per symbol.
    """
    raw = read_headed_csv(spark, path, name_column).where(F.col("__size") >= min_bytes)
    stem = F.col("__file") if name_column else file_stem(F.col("__file"))
    forex = stem.endswith(FOREX_SUFFIX)
    raw = (raw.withColumn("symbol", F.when(forex, F.regexp_replace(stem, f"{FOREX_SUFFIX}$", "")).otherwise(stem))
           .withColumn("__class", F.when(forex, F.lit("forex")).otherwise(F.lit("stocks")))
           .withColumn("__tz", F.when(forex, F.lit(FOREX_TZ)).otherwise(F.lit(STOCK_TZ)))
           .drop("__file", "__size"))
    return standardize(raw, asset_class=F.col("__class"), timeframe=timeframe, source=source,
                       source_tz=F.col("__tz")).drop("__class", "__tz")


def read_bulk_csv(spark: SparkSession, path: str, timeframe: str = "D1", asset_class: str = "stocks",
                  source: str = "bulk_csv", source_tz: str = STOCK_TZ) -> DataFrame:
    """Wide CSV files holding every symbol (splittable; no chunk loop), New York time."""
    return standardize(read_headed_csv(spark, path).drop("__file", "__size"), asset_class=asset_class,
                       timeframe=timeframe, source=source, source_tz=source_tz)


def read_vendor_frame(spark: SparkSession, path: str, symbol: str, timeframe: str = "D1",
                      asset_class: str = "stocks", source: str = "yfinance", source_tz: str = STOCK_TZ,
                      fmt: str = "csv") -> DataFrame:
    """A flat vendor OHLCV frame (with ``Adj Close``) for one requested symbol."""
    raw = read_headed_csv(spark, path).drop("__file", "__size") if fmt == "csv" else spark.read.format(fmt).load(path)
    return standardize(raw, symbol=symbol, asset_class=asset_class, timeframe=timeframe, source=source,
                       source_tz=source_tz)


def vendor_prices(raw: DataFrame) -> DataFrame:
    """Vendor daily prices (Date, Ticker, OHLC, Adj_Close, Volume) → bars with the
    vendor adj_factor (close > 0 only, N6b); adj_close = close × adj_factor (Q11)."""
    d = raw.select(F.to_timestamp_ntz(F.col("Date").cast("string")).alias("timestamp"),
                   clean_ticker("Ticker").alias("symbol"),
                   *[F.col(c).try_cast("double").alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume")],
                   F.col("Adj_Close").try_cast("double").alias("__adj"))
    d = d.withColumn("adj_factor", vendor_adj_factor("close", "__adj")).drop("__adj")
    return d.select("timestamp", "symbol", F.lit("stocks").alias("asset_class"), F.lit("D1").alias("timeframe"),
                    "open", "high", "low", "close", "volume", (F.col("close") * F.col("adj_factor")).alias("adj_close"),
                    "adj_factor", F.lit("vendor_merged").alias("source"), F.year("timestamp").alias("year"))


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """Company CSV → symbols_metadata rows."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        F.upper(F.col("Symbol")).alias("symbol"), F.col("Exchange").alias("exchange"),
        F.col("Shortname").alias("shortname"), F.col("Longname").alias("longname"),
        F.col("Sector").alias("sector"), F.col("Industry").alias("industry"),
        F.col("Marketcap").try_cast("double").alias("marketcap"), F.col("Weight").try_cast("double").alias("weight"),
        F.col("Longbusinesssummary").alias("summary"),
        F.localtimestamp().cast("timestamp_ntz").alias("last_updated")).select(*METADATA.fieldNames())
