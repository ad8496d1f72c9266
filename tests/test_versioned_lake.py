"""The lake with versions: atomic commits, replays, failures between steps, pruning, hot leaves."""

import glob
import os
import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from helpers import assert_frames_match
from marketlake.operators.catalog import catalog_of_state, refresh_catalog
from marketlake.operators.normalize import standardize
from marketlake.plans import updates as PL
from marketlake.sources import lake as LK
from marketlake.sources.versioned import CommitConflict, Manifest, VersionedLake
from marketlake.streaming import bars_stream as S

COLUMNS = ["timestamp", "symbol", "asset_class", "timeframe", "open", "high", "low", "close", "volume", "adj_close", "adj_factor",
           "source", "year"]


def bars(spark, rows):
    """(symbol, day text, close[, source]) rows as daily stock bars."""
    return spark.createDataFrame([(*r[:3], r[3] if len(r) > 3 else "a") for r in rows], "symbol string, d string, close double, source string").select(
        F.col("d").cast("timestamp_ntz").alias("timestamp"), "symbol", F.lit("stocks").alias("asset_class"), F.lit("D1").alias("timeframe"),
        *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"), F.col("close").alias("adj_close"),
        F.lit(1.0).alias("adj_factor"), "source", F.year(F.col("d").cast("date")).alias("year"))


def content(spark, root):
    return sorted((r.symbol, str(r.timestamp)[:10], r.close) for r in LK.scan_bars(spark, root).collect())


A = [("AAA", "2020-01-01", 1.0), ("AAA", "2021-01-01", 2.0), ("BBB", "2020-01-01", 3.0)]


def test_a_replayed_number_adds_nothing(spark, tmpdir_path):
    lake = VersionedLake(spark, tmpdir_path + "/lake")
    assert lake.append(bars(spark, A), "w", 3).count() == 2
    assert lake.append(bars(spark, A), "w", 3) is None and lake.append(bars(spark, A), "w", 2) is None
    assert lake.append(bars(spark, [("CCC", "2020-01-01", 9.0)]), "w", 4) is not None
    assert lake.append(bars(spark, A).limit(0), "w", 5).count() == 0 and lake.manifest().writers == {"w": 5}
    assert content(spark, lake.root) == [*A, ("CCC", "2020-01-01", 9.0)]
    assert sorted((r.symbol, str(r.timestamp)[:10], r.close) for r in lake.scan(1).collect()) == A  # an older version stays readable


@pytest.mark.parametrize("plain", [True, False])
def test_a_failed_replacement_leaves_the_old_series(spark, tmpdir_path, monkeypatch, plain):
    root = tmpdir_path + "/lake"
    LK.write_bars(bars(spark, A), root) if plain else VersionedLake(spark, root).append(bars(spark, A))
    with monkeypatch.context() as m:
        m.setattr(VersionedLake, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            LK.replace_series(bars(spark, [("aaa", "2022-01-01", 7.0)]), root)
    assert content(spark, root) == A
    LK.replace_series(bars(spark, [("aaa", "2022-01-01", 7.0)]), root)
    assert content(spark, root) == [("AAA", "2022-01-01", 7.0), ("BBB", "2020-01-01", 3.0)]
    LK.replace_series(bars(spark, A).limit(0), root)
    assert len(content(spark, root)) == 2


def test_replacement_may_derive_from_the_series_it_replaces(spark, tmpdir_path):
    root = tmpdir_path + "/lake"
    LK.write_bars(bars(spark, A), root)
    for _ in range(2):
        LK.replace_series(LK.scan_bars(spark, root).where("symbol = 'AAA'").withColumn("close", F.col("close") * 10).select(*COLUMNS), root)
    assert content(spark, root) == [("AAA", "2020-01-01", 100.0), ("AAA", "2021-01-01", 200.0), ("BBB", "2020-01-01", 3.0)]


def test_symbols_that_folder_names_escape(spark, tmpdir_path):
    root = tmpdir_path + "/lake"
    LK.write_bars(bars(spark, [("^GSPC", "2020-01-01", 1.0), ("BTC/USD", "2020-01-01", 2.0), ("A%B[1]", "2020-01-01", 3.0)]), root)
    for _ in range(2):
        LK.replace_series(bars(spark, [("^GSPC", "2021-01-01", 5.0), ("A%B[1]", "2021-01-01", 6.0)]), root)
    assert content(spark, root) == [("A%B[1]", "2021-01-01", 6.0), ("BTC/USD", "2020-01-01", 2.0), ("^GSPC", "2021-01-01", 5.0)]


def test_replacement_reads_folder_names_only():
    import inspect

    from marketlake.sources import versioned
    assert "toLocalIterator" not in inspect.getsource(LK) + inspect.getsource(versioned)


def test_two_writers_of_one_version(spark, tmpdir_path, monkeypatch):
    lake = VersionedLake(spark, tmpdir_path + "/lake")
    lake.append(bars(spark, A))
    first = lake.manifest()
    publish, raced = lake.files.publish, []

    def race(name, text):
        if not raced:  # another writer commits this version first
            raced.append(VersionedLake(spark, lake.root).append(bars(spark, [("DDD", "2020-01-01", 5.0)])))
        return publish(name, text)

    monkeypatch.setattr(lake.files, "publish", race)
    lake.append(bars(spark, [("EEE", "2020-01-01", 6.0)]))
    assert [r[0] for r in content(spark, lake.root)] == ["AAA", "AAA", "BBB", "DDD", "EEE"]
    assert lake.manifest().version == first.version + 2
    assert {r.symbol: r.rows_count for r in lake.state().collect()} == {"AAA": 2, "BBB": 1, "DDD": 1, "EEE": 1}
    with pytest.raises(CommitConflict):
        lake.rewrite(bars(spark, A), after=first.version)
    with pytest.raises(CommitConflict):
        lake.append(bars(spark, A), after=first.version)
    assert len(content(spark, lake.root)) == 5


def test_state_follows_every_commit(spark, tmpdir_path):
    root = tmpdir_path + "/lake"
    LK.write_bars(bars(spark, A), root)  # a plain lake, taken over by the first commit
    lake = VersionedLake(spark, root)
    assert lake.manifest() == Manifest(folders=("asset_class=stocks",))

    def same():
        want = refresh_catalog(lake.scan()).drop("last_updated").toPandas()
        assert_frames_match(catalog_of_state(lake.state()).drop("last_updated").toPandas(), want)

    lake.append(bars(spark, [("BBB", "2019-05-01", None, "b"), ("CCC", "2021-01-01", 1.0)]))
    same()
    lake.replace_series(bars(spark, [("AAA", "2023-01-01", None, "z")]))
    same()
    lake.keep_universe(spark.createDataFrame([("bbb",), (" ",)], "symbol string"))
    same()
    assert [r[0] for r in content(spark, root)] == ["BBB", "BBB"]
    lake.rewrite(bars(spark, A).limit(0))
    assert content(spark, root) == [] and lake.state().count() == 0


def test_a_merge_reads_the_batch_and_not_the_lake(spark, tmpdir_path):
    lake = VersionedLake(spark, tmpdir_path + "/lake")
    lake.append(bars(spark, A))
    read, plain = [], VersionedLake._read
    VersionedLake._read = lambda self, folders, *a: (read.append(folders), plain(self, folders, *a))[1]
    try:
        lake.append(bars(spark, [("CCC", "2021-01-01", 1.0)]))
    finally:
        VersionedLake._read = plain
    (only,) = read
    assert len(only) == 1 and only[0] == lake.manifest().folders[-1]
    files = catalog_of_state(lake.state()).inputFiles()
    assert files and all("/_state/" in f for f in files)


def test_an_update_run_started_again_adds_nothing(spark, tmpdir_path):
    root = tmpdir_path + "/lake"
    lake = VersionedLake(spark, root)
    lake.append(bars(spark, A))
    catalog = catalog_of_state(lake.state())
    landed = bars(spark, [("AAA", "2021-01-02", 4.0), ("BBB", "2020-01-01", 3.5), ("BBB", "2020-01-02", 5.0)])
    logs = []
    for now in ("2021-06-01", "2021-06-01", "2022-06-01"):
        new, log = PL.apply_updates(catalog, landed, root, now=now)
        logs.append({r.symbol: (r.status, r.rows_added) for r in log.collect()})
    assert logs[0] == {"AAA": ("success", 1), "BBB": ("success", 1)}
    assert logs[1] == logs[2] == {"AAA": ("no_new_rows", 0), "BBB": ("no_new_rows", 0)}
    assert len(content(spark, root)) == 5


def test_a_stream_batch_replayed_after_a_failure(spark, tmpdir_path):
    landed, root, name = tmpdir_path + "/landed", tmpdir_path + "/lake", f"land-{uuid.uuid4().hex}"
    os.makedirs(landed)
    with open(landed + "/a.csv", "w") as f:
        f.write("Date,Open,High,Low,Close,Volume,Symbol\n" + "".join(f"2024-01-{d:02d},1,2,0.5,1.5,10,AAA\n" for d in range(1, 11)))
    schema = "Date string, Open string, High string, Low string, Close string, Volume string, Symbol string"
    parse = lambda raw: standardize(raw, asset_class="stocks", timeframe="D1", source="landed", source_tz="UTC")

    def run():
        q = S.land_stream(spark, landed, root, parse, schema, name=name, options={"header": "true"})
        q.awaitTermination(300)
        assert q.exception() is None

    run()
    commits = S.checkpoint_location(spark, name).removeprefix("file:") + "/commits"
    moved = [shutil.move(f, tmpdir_path) for f in glob.glob(commits + "/0") + glob.glob(commits + "/.0.crc")]
    assert moved  # the batch wrote, but the stream had not noted that
    run()
    assert LK.scan_bars(spark, root).count() == 10 and VersionedLake(spark, root).manifest().writers == {f"stream-{name}": 0}


def test_the_universe_prunes_symbol_folders(spark, tmpdir_path):
    lake = VersionedLake(spark, tmpdir_path + "/lake")
    lake.append(bars(spark, [(f"S{i:02d}", "2020-01-01", 1.0) for i in range(30)]))
    spark.createDataFrame([("S03",), ("s07",)], "symbol string").write.parquet(tmpdir_path + "/u")
    kept = lake.in_universe(spark.read.parquet(tmpdir_path + "/u"))
    assert sorted(r.symbol for r in kept.collect()) == ["S03", "S07"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_a_hot_leaf_is_written_by_many_tasks(spark, tmpdir_path):
    hot = spark.range(30_000).select(F.lit("HOT").alias("symbol"), (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).cast(
        "timestamp_ntz").alias("timestamp"))
    rest = spark.range(60_000).select(F.concat(F.lit("S"), F.col("id") % 50).alias("symbol"), (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(
        secs=F.col("id"))).cast("timestamp_ntz").alias("timestamp"))
    rows = hot.unionByName(rest).select("timestamp", "symbol", F.lit("stocks").alias("asset_class"), F.lit("1m").alias("timeframe"),
                                        *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume", "adj_close", "adj_factor")],
                                        F.lit("a").alias("source"), F.lit(2020).alias("year"))
    root = tmpdir_path + "/lake"
    LK.write_bars(rows, root)
    files = LK.scan_bars(spark, root).where("symbol = 'HOT'").groupBy(F.col("_metadata.file_path")).agg(
        F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.count("*").alias("n")).orderBy("lo").collect()
    assert len(files) >= 3 and all(a.hi < b.lo for a, b in zip(files, files[1:]))  # time ranges of their own
    assert max(f.n for f in files) <= 1.5 * 90_000 / 8
    assert LK.scan_bars(spark, root).count() == 90_000
    LK.write_per_symbol(rows.select("symbol", "timestamp", "close"), tmpdir_path + "/per", ["timestamp"])
    assert len(os.listdir(tmpdir_path + "/per/symbol=HOT")) > 4


def test_extra_columns_are_found_and_widened(spark, tmpdir_path):
    root = tmpdir_path + "/lake"
    one = bars(spark, [("AAA", "2020-01-01", 1.0)]).withColumn("trades", F.lit(3))
    two = bars(spark, [("BBB", "2020-01-01", 2.0)]).withColumn("timeframe", F.lit("1h")).withColumn("trades", F.lit(2.5)).withColumn("venue", F.lit("x"))
    none = bars(spark, [("CCC", "2020-01-01", 3.0)])
    want = [("AAA", 3.0, None), ("BBB", 2.5, "x"), ("CCC", None, None)]

    def rows(df):
        return sorted((r.symbol, r.trades, r.venue) for r in df.collect())

    for df in (one, two, none):
        LK.write_bars(df, root)  # a plain lake whose files clash
    assert rows(LK.scan_bars(spark, root, discover=True)) == want and "trades" not in LK.scan_bars(spark, root).columns
    LK.replace_series(none.withColumn("venue", F.lit("y")), root)
    assert rows(LK.scan_bars(spark, root)) == [*want[:2], ("CCC", None, "y")]
    lake = VersionedLake(spark, root)
    lake.rewrite(lake.scan().select(*COLUMNS, "trades", "venue"))
    assert rows(LK.scan_bars(spark, root)) == [*want[:2], ("CCC", None, "y")] and len(lake.manifest().layouts) == 1
    assert rows(LK.scan_bars(spark, root).where("timeframe = '1h'")) == [want[1]]


def _leaves(root):
    return {os.path.dirname(f) for f in glob.glob(root + "/**/*.parquet", recursive=True)}


def _by_symbol_and_year(spark, rows, root):
    """A lake as it was laid out before: one folder per symbol and year."""
    bars(spark, rows).write.mode("append").partitionBy("asset_class", "timeframe", "symbol", "year").parquet(root)


def test_the_number_of_folders_does_not_grow_with_symbols_and_years(spark, tmpdir_path):
    rows = [(f"S{i:03d}", f"{year}-01-01", 1.0) for i in range(300) for year in (2019, 2020, 2021)]
    LK.write_bars(bars(spark, rows), tmpdir_path + "/plain")
    lake = VersionedLake(spark, tmpdir_path + "/lake")
    lake.append(bars(spark, rows))
    LK.replace_series(bars(spark, [("S007", "2022-01-01", 7.0)]), lake.root)
    assert 1 < len(_leaves(tmpdir_path + "/plain")) <= 64 and len(_leaves(lake.root + "/_data")) <= 64 + 2
    assert content(spark, tmpdir_path + "/plain") == rows
    assert content(spark, lake.root) == sorted([r for r in rows if r[0] != "S007"] + [("S007", "2022-01-01", 7.0)])
    assert len(lake.manifest().folders) <= 64 + 2


def test_lakes_with_a_folder_per_symbol_are_read_and_added_to(spark, tmpdir_path):
    root = tmpdir_path + "/lake"
    _by_symbol_and_year(spark, A, root)
    assert content(spark, root) == A
    LK.write_bars(bars(spark, [("AAA", "2022-01-01", 4.0), ("CCC", "2020-01-01", 5.0)]), root)
    both = sorted([*A, ("AAA", "2022-01-01", 4.0), ("CCC", "2020-01-01", 5.0)])
    assert content(spark, root) == both == sorted((r.symbol, str(r.timestamp)[:10], r.close) for r in LK.scan_bars(spark, root, discover=True).collect())
    kept = VersionedLake(spark, root).in_universe(spark.createDataFrame([("aaa",)], "symbol string"))
    assert {r.symbol for r in kept.collect()} == {"AAA"} and kept.columns == LK.scan_bars(spark, root).columns
    for _ in range(2):
        LK.replace_series(bars(spark, [("AAA", "2023-01-01", 9.0)]), root)
        assert content(spark, root) == sorted([r for r in both if r[0] != "AAA"] + [("AAA", "2023-01-01", 9.0)])


def test_rows_without_a_symbol_or_class_are_replaced_too(spark, tmpdir_path):
    root, none = tmpdir_path + "/lake", F.lit(None).cast("string")
    blank = bars(spark, [("X", "2020-01-01", 1.0)]).withColumn("symbol", none)
    lake = VersionedLake(spark, root)
    lake.append(bars(spark, A).unionByName(blank).unionByName(bars(spark, A[:1]).withColumn("asset_class", none)))
    LK.replace_series(blank.withColumn("close", F.lit(5.0)), root)
    got = {(r.symbol, r.asset_class, str(r.timestamp)[:10], r.close) for r in LK.scan_bars(spark, root).collect()}
    assert got == {(s, "stocks", d, c) for s, d, c in A} | {("AAA", None, "2020-01-01", 1.0), (None, "stocks", "2020-01-01", 5.0)}
    assert lake.state().count() == 4
