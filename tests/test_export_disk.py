"""What an export and its reader put on disk: compressed text, no shuffle files after the write, no shuffle or sort of the lines read."""
import datetime as dt
import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from marketlake import registered as R
from marketlake import registered_more as RM
from marketlake.operators.consolidated import consolidated
from marketlake.session import FREE_SHUFFLES
from marketlake.sources import csv_sources as CS
from marketlake.sources import export as EX


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def put(folder, name, *lines):
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_shuffle_files_go_with_the_write(spark, tmpdir_path, compression):
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    table = rows.groupBy("k").agg(F.max("id").alias("top")).join(rows.repartition(3, "k"), "k")
    before, settings = shuffle_files(spark), {k: spark.conf.get(k) for k in FREE_SHUFFLES}
    (path,) = EX.export_datasets({"t": table}, tmpdir_path, compression)
    for _ in range(50):  # they are removed beside other work
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert {k: spark.conf.get(k) for k in FREE_SHUFFLES} == settings
    assert CS.read_headed_csv(spark, path).count() == 1000


def test_settings_return_after_a_write_that_fails(spark, tmpdir_path):
    settings = {k: spark.conf.get(k) for k in FREE_SHUFFLES}
    with pytest.raises(Exception, match="no number"):
        EX.write_csv(spark.range(3).select(F.raise_error(F.lit("no number")).cast("string").alias("x")), f"{tmpdir_path}/t")
    assert {k: spark.conf.get(k) for k in FREE_SHUFFLES} == settings


def test_compressed_export_is_bounded_and_whole(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(EX, "MAX_ROWS_PER_COMPRESSED_FILE", 40)
    rows = [(i, f'some, text {i}' if i % 3 else None, i / 7 if i % 5 else None) for i in range(100)]
    table = spark.createDataFrame(rows, "id long, text string, x double").coalesce(1)
    plain, packed = (EX.export_datasets({"t": table}, f"{tmpdir_path}/{c}", c)[0] for c in (None, "gzip"))
    assert len(glob.glob(f"{plain}/part-*.csv")) == 1 and len(glob.glob(f"{packed}/part-*.csv.gz")) == 3
    assert not glob.glob(f"{packed}/part-*.csv")
    back = {p: {tuple(r) for r in CS.read_headed_csv(spark, p).select("id", "text", "x").collect()} for p in (plain, packed)}
    assert back[plain] == back[packed] and len(back[packed]) == 100
    assert ("1", "some, text 1", str(1 / 7)) in back[packed]


def test_lines_of_one_layout_are_neither_shuffled_nor_sorted(spark, tmpdir_path):
    put(tmpdir_path, "a.csv", "", "x,y", "1,2", "x,y", "3,")
    put(tmpdir_path, "b.csv", "x,y", "1,2")
    put(tmpdir_path, "c.csv", "x,y")
    found = CS.read_headed_csv(spark, tmpdir_path)
    assert sorted((r["__file"], r.x, r.y) for r in found.collect()) == [("a.csv", "1", "2"), ("a.csv", "3", None), ("b.csv", "1", "2")]
    assert not any(step in plan(found) for step in ("Exchange", "Sort", "Aggregate", "Join"))


def test_layouts_of_several_files_are_kept_apart(spark, tmpdir_path):
    put(tmpdir_path, "a.csv", "x,y", "1,2", "y,x")
    put(tmpdir_path, "b.csv", "y,x", "1,2", "y,x")
    put(tmpdir_path, "c.csv", "Z", "9")
    found = {(r["__file"], r.x, r.y, r.Z) for r in CS.read_headed_csv(spark, tmpdir_path).collect()}
    assert found == {("a.csv", "1", "2", None), ("a.csv", "y", "x", None), ("b.csv", "2", "1", None), ("c.csv", None, None, "9")}


def test_headers_are_found_without_a_sort(spark):
    lines = spark.createDataFrame([("f", "b", (0, 2)), ("f", "c", (0, 1)), ("f", "a", (1, 0)), ("g", "z", (0, 9))],
                                  "path string, line string, place struct<at: long, row: long>")
    heads = CS._file_headers(lines)
    assert {tuple(r) for r in heads.collect()} == {("f", "c"), ("g", "z")}
    assert "ObjectHashAggregate" in plan(heads) and "Sort" not in plan(heads)


def test_consolidated_export_is_whole_compressed_and_leaves_no_shuffles(spark, tmpdir_path, monkeypatch):
    day = dt.datetime(1995, 1, 1)
    tables = {
        "region": ([(0, "EUROPE")], "r_regionkey int, r_name string"), "nation": ([(1, "X, Y", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(s, f'S, {s}' if s % 2 else None, 1, 1.5 * s) for s in range(1, 6)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "orders": ([(o, 1000.0 + o, day + dt.timedelta(days=11 * o)) for o in range(1, 40)], "o_orderkey long, o_totalprice double, o_orderdate timestamp_ntz"),
        "lineitem": ([(o, n, o % 4, (o * n) % 6, 1.0 + n, 10.0 * o, 0.1, 0.05, "R" if n else "N", "O" if o % 2 else "F",
                       day + dt.timedelta(days=12 * o + n)) for o in range(1, 40) for n in range(3)],
                     "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmpdir_path}/{name}.parquet")
    monkeypatch.setattr(R, "_scratch", lambda spark, what: f"{tmpdir_path}/scratch/{what}")
    wide = RM.q_consolidated_wide(spark, tmpdir_path)
    expected = sorted(map(repr, wide.replace("", None).collect()))
    before = shuffle_files(spark)
    exported = RM.q_consolidated_export(spark, tmpdir_path)
    for _ in range(50):
        if len(left := shuffle_files(spark) - before) <= 2:
            break
        time.sleep(0.1)
    assert len(left) <= 2  # of the search for the files' headers: a line per file
    assert exported.schema.names == wide.schema.names and sorted(map(repr, exported.collect())) == expected and len(expected) > 50
    assert glob.glob(f"{tmpdir_path}/scratch/export/consolidated/*.csv.gz") and not glob.glob(f"{tmpdir_path}/scratch/export/consolidated/*.csv")


def bars_vol_and_metadata(spark):
    day = dt.datetime(2024, 1, 1)
    bar = lambda s, t, c: (s, t, "stocks", "D1", c, c, c, c, 1.0, "v")
    bars = spark.createDataFrame([bar("A", day, 1.0), bar("A", day, 2.0), bar("A", day + dt.timedelta(days=9000), 3.0), bar("A", None, 4.0),
                                  bar("B", day, 5.0), bar(None, day, 6.0), bar("C", day, 7.0)],
                                 "symbol string, timestamp timestamp_ntz, asset_class string, timeframe string, open double, high double, "
                                 "low double, close double, volume double, source string")
    vol = spark.createDataFrame([("A", day, 0.5), ("B", day + dt.timedelta(days=1), 0.7)], "symbol string, timestamp timestamp_ntz, realized_vol_30d double")
    meta = spark.createDataFrame([("A", "a1", "s", "i", 1.0), ("A", "a2", None, "i", None), ("A", "a2", None, "i", None), ("B", None, None, None, None),
                                  (None, "none", "s", "i", 2.0), ("D", "d", "s", "i", 3.0)],
                                 "symbol string, longname string, sector string, industry string, marketcap double")
    return bars, vol, meta


def test_metadata_of_the_consolidated_table_match_as_in_a_join(spark):
    """All rows of a symbol's metadata, none for a null symbol, and those of bars without a time."""
    bars, vol, meta = bars_vol_and_metadata(spark)
    found = consolidated(bars, volatility=vol, metadata=meta)
    joined = consolidated(bars, volatility=vol, metadata=meta, keep_keys=True).select(found.columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, joined.collect()))
    assert found.count() == 3 + 3 + 3 + 1 + 1 + 1
    assert {(r.company_name, r.market_cap) for r in found.where("date is null").collect()} == {("a1", 1.0), ("a2", None)}
    assert {(r.symbol, r.company_name) for r in found.where("symbol is null or symbol <> 'A'").collect()} == {("B", ""), (None, ""), ("C", "")}


def test_metadata_too_large_to_broadcast_do_not_shuffle_the_filled_rows(spark):
    bars, vol, meta = bars_vol_and_metadata(spark)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "-1")
        found = plan(consolidated(bars, volatility=vol, metadata=meta))
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    above = found[:found.index("REPARTITION_BY_COL")]  # what comes after the exchange of the fill
    assert above.count("Exchange") == 1 and "Join" not in above
