"""Dataset catalog work as DataFrame jobs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import display_label
from .merge import coalesce_upsert, latest_wins
from .quality import catalog_stats, quality_scores, simple_score

CATALOG_KEY = ["symbol", "timeframe", "asset_class"]   # asset_class added to the key (Q15)


def active(catalog: DataFrame, asset_class: str | None = "stocks", timeframe: str | None = None) -> DataFrame:
    """series with rows (optionally of one class / timeframe)."""
    cond = F.col("rows_count") > 0
    if asset_class is not None:
        cond = cond & (F.col("asset_class") == asset_class)
    if timeframe is not None:
        cond = cond & (F.col("timeframe") == timeframe)
    return catalog.filter(cond)


def filter_catalog(catalog: DataFrame, symbols: Sequence[str] | None = None,
                   asset_classes: Sequence[str] | None = None) -> DataFrame:
    """by symbol list (upper-cased) and/or asset-class list (lower-cased)."""
    d = catalog
    if symbols:
        d = d.filter(F.upper("symbol").isin([s.upper() for s in symbols]))
    if asset_classes:
        d = d.filter(F.lower("asset_class").isin([a.lower() for a in asset_classes]))
    return d


def in_universe(catalog: DataFrame, universe: DataFrame, stock_class: str = "stocks", on: Sequence[str] = ("symbol",)) -> DataFrame:
    """Keep non-stock series, and stock series whose symbol is in the universe
    (also C6: the catalog rows a universe rewrite keeps). ``on``: the symbol, and what follows from it on both sides."""
    others = catalog.filter(F.col("asset_class") != stock_class)
    rest = catalog.filter(F.col("asset_class").isNull() | (F.col("asset_class") == stock_class))
    return others.unionByName(rest.join(universe.select(*on), list(on), "left_semi"))


def symbol_directory(catalog: DataFrame, metadata: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Catalog rows with company metadata, restricted by the universe rule."""
    d = in_universe(catalog, universe) if universe is not None else catalog
    meta = metadata.select("symbol", *[c for c in metadata.columns if c != "symbol" and c not in d.columns])
    return d.join(meta, "symbol", "left")


def missing_symbols(universe: DataFrame, catalog: DataFrame) -> DataFrame:
    """Universe symbols without an active stock series (anti join, null-safe)."""
    return universe.select("symbol").join(active(catalog).select("symbol"), "symbol", "left_anti")


def coverage(universe: DataFrame, catalog: DataFrame) -> DataFrame:
    """Total universe size, imported (distinct active stock symbols in it), missing."""
    imported = active(catalog).select("symbol").distinct().withColumn("__in", F.lit(1))
    return (universe.select("symbol").join(imported, "symbol", "left")
            .agg(F.count(F.lit(1)).alias("total"),
                 F.count_distinct(F.when(F.col("__in") == 1, F.col("symbol"))).alias("imported"))
            .withColumn("missing", F.col("total") - F.col("imported")))


def dataset_status(catalog: DataFrame, datasets: dict[str, DataFrame]) -> DataFrame:
    """A10: per catalogued symbol, its timeframes and whether each dataset has rows for it.

    ``datasets`` maps an output flag name to a frame with a ``symbol`` column.
    All datasets are read in one union, pre-aggregated per symbol in every task, and joined once.
    """
    out = (catalog.groupBy("symbol")
           .agg(F.concat_ws(",", F.sort_array(F.collect_set("timeframe"))).alias("timeframes")))
    if not datasets:
        return out
    rows = reduce(DataFrame.unionByName, [df.select("symbol", F.lit(name).alias("__set")) for name, df in datasets.items()])
    flags = rows.groupBy("symbol").agg(*[F.max(F.col("__set") == name).alias(name) for name in datasets])
    return out.join(flags, "symbol", "left").fillna(False, list(datasets))


def macro_symbols(catalog: DataFrame) -> DataFrame:
    """Distinct macro series names."""
    return catalog.filter(F.col("asset_class") == "macro").select("symbol").distinct()


def top_by_market_cap(metadata: DataFrame, k: int, sector: str | None = None) -> DataFrame:
    """L3: the ``k`` companies of the largest market cap (in a sector), ties by symbol."""
    d = metadata.filter(F.col("marketcap").isNotNull())
    if sector is not None:
        d = d.filter(F.lower("sector") == sector.lower())
    return d.orderBy(F.col("marketcap").desc(), "symbol").limit(k)


def timeframes(catalog: DataFrame) -> DataFrame:
    """Distinct timeframes."""
    return catalog.select("timeframe").distinct()


def symbol_search(directory: DataFrame, text: str | None) -> DataFrame:
    """distinct symbols whose symbol or label contains ``text`` (case-insensitive);
    blank text returns all."""
    cols = directory.columns
    label = display_label("symbol", "longname" if "longname" in cols else F.lit(None).cast("string"),
                          "shortname" if "shortname" in cols else F.lit(None).cast("string"))
    d = directory.select("symbol", label.alias("label")).distinct()
    if text is None or not text.strip():
        return d
    t = text.strip().lower()
    return d.filter(F.lower("symbol").contains(t) | F.lower("label").contains(t))


def _date_text(ts: str) -> Column:
    """``yyyy-MM-dd`` for D1, with the time otherwise."""
    return F.when(F.col("timeframe") == "D1", F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def refresh_catalog(lake: DataFrame, now: dt.datetime | None = None, score_kind: str = "simple") -> DataFrame:
    """Recompute every catalog row from the lake in one job and, for the simple score, one
    scan.

    Dates are text: ``yyyy-MM-dd`` for D1, with the time otherwise. ``score_kind`` is
    'simple' (A4, what the catalog stores in the reference) or 'full' (A5).
    """
    d = catalog_stats(lake, also=[F.concat_ws("+", F.sort_array(F.collect_set("source"))).alias("source")])
    if score_kind == "full":
        full = quality_scores(lake, ["symbol", "timeframe", "asset_class"]).select(
            *CATALOG_KEY, F.col("quality_score").alias("__full"))
        d = d.join(full, CATALOG_KEY).withColumn("quality_score", F.col("__full")).drop("__full")
    stamp = F.lit(now).cast("timestamp_ntz") if now is not None else F.localtimestamp()
    return d.select(
        "symbol", "timeframe", "asset_class",
        _date_text("start_date").alias("start_date"), _date_text("end_date").alias("end_date"),
        "rows_count", "nulls_pct", "quality_score", "source", stamp.alias("last_updated"))


def series_state(bars: DataFrame) -> DataFrame:
    """C5, mergeable: per series the first and last time, the numbers of rows and of null closes, and the sources.
    ``merge_states`` of the states of two sets of rows is the state of both together."""
    return bars.groupBy(*CATALOG_KEY).agg(
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count(F.lit(1)).alias("rows_count"),
        F.sum(F.when(F.col("close").isNull(), 1).otherwise(0)).alias("null_closes"), F.sort_array(F.collect_set("source")).alias("sources"))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of disjoint sets of rows together: one row per series and state goes in, whatever the rows are."""
    return reduce(DataFrame.unionByName, states).groupBy(*CATALOG_KEY).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("rows_count").alias("rows_count"),
        F.sum("null_closes").alias("null_closes"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def catalog_of_state(state: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """The catalog rows of a state, equal to ``refresh_catalog`` of its rows (simple score)."""
    stamp = F.lit(now).cast("timestamp_ntz") if now is not None else F.localtimestamp()
    pct = F.lit(100.0) * F.col("null_closes") / F.col("rows_count")
    return state.select(*CATALOG_KEY, _date_text("start").alias("start_date"), _date_text("end").alias("end_date"), "rows_count",
                        pct.alias("nulls_pct"), simple_score(pct).alias("quality_score"),
                        F.concat_ws("+", "sources").alias("source"), stamp.alias("last_updated"))


def upsert_datasets(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Replace catalog rows by key (symbol, timeframe, asset_class)."""
    return latest_wins(existing, new, CATALOG_KEY)


def upsert_metadata(existing: DataFrame, new: DataFrame, replace: bool = True) -> DataFrame:
    """C2 (``replace=True``, full row replace) / C3 (``replace=False``, partial update)."""
    return coalesce_upsert(existing, new, ["symbol"], replace=replace)


def get_metadata(metadata: DataFrame, symbol: str) -> DataFrame:
    """C4: one symbol's metadata row."""
    return metadata.filter(F.col("symbol") == symbol.upper())


def macro_catalog(macro_table: DataFrame, now: dt.datetime | None = None, source: str = "fred") -> DataFrame:
    """Catalog rows of macro series: dates as ``yyyy-MM-dd``, rows, null % of the
    value and score = 100 − null % (one aggregate over every series)."""
    stamp = F.lit(now).cast("timestamp_ntz") if now is not None else F.localtimestamp()
    null_pct = 100.0 * F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)) / F.count(F.lit(1))
    d = macro_table.groupBy("symbol").agg(
        F.min("timestamp").alias("__lo"), F.max("timestamp").alias("__hi"),
        F.count(F.lit(1)).alias("rows_count"), null_pct.alias("nulls_pct"))
    return d.select(
        "symbol", F.lit("D1").alias("timeframe"), F.lit("macro").alias("asset_class"),
        F.date_format("__lo", "yyyy-MM-dd").alias("start_date"), F.date_format("__hi", "yyyy-MM-dd").alias("end_date"),
        "rows_count", "nulls_pct", (F.lit(100.0) - F.col("nulls_pct")).alias("quality_score"),
        F.lit(source).alias("source"), stamp.alias("last_updated"))


def curated_catalog(table: DataFrame, symbol: str, source: str, timeframe: str = "D1", asset_class: str = "macro",
                    now: dt.datetime | None = None) -> DataFrame:
    """A curated vendor table registered with the constant score 100 and 0 % nulls."""
    stamp = F.lit(now).cast("timestamp_ntz") if now is not None else F.localtimestamp()
    return table.agg(F.min("timestamp").alias("__lo"), F.max("timestamp").alias("__hi"),
                     F.count(F.lit(1)).alias("rows_count")).select(
        F.lit(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), F.lit(asset_class).alias("asset_class"),
        F.date_format("__lo", "yyyy-MM-dd").alias("start_date"), F.date_format("__hi", "yyyy-MM-dd").alias("end_date"),
        "rows_count", F.lit(0.0).alias("nulls_pct"), F.lit(100.0).alias("quality_score"),
        F.lit(source).alias("source"), stamp.alias("last_updated"))


def symbol_classes(catalog: DataFrame) -> DataFrame:
    """One asset class per (upper-case) symbol; the smallest class name when a
    ticker is catalogued under several (the reference takes an arbitrary one)."""
    return catalog.groupBy(F.upper("symbol").alias("symbol")).agg(F.min("asset_class").alias("asset_class"))


def with_asset_class(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attach the catalogued asset class to rows keyed by symbol. AQE broadcasts the
    class table if its measured size allows, and splits skewed symbols otherwise."""
    keyed = df.withColumn("__sym", F.upper("symbol"))
    classes = symbol_classes(catalog).withColumnRenamed("symbol", "__sym")
    return keyed.join(classes, "__sym", "left").drop("__sym")
