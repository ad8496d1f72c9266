"""File formats, lake round trips, the SQL guard and plan shape."""

import datetime as dt
import json
import os

import contextlib
import io

from pyspark.sql import functions as F

from marketlake.operators import bars, consolidated
from marketlake.operators.asof import Right
from marketlake.plans import query
from marketlake.sources import csv_sources, json_sources, lake


def explain(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def _bars(spark, symbols=("0001", "^X", "AAPL")):
    rows = [(dt.datetime(2023 + (i % 2), 1, 1 + i), s, "stocks", "D1", 1.0, 2.0, 0.5, 1.5, 10.0, 1.5, 1.0, "v",
             2023 + (i % 2)) for s in symbols for i in range(4)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, symbol string, asset_class string, "
                                       "timeframe string, open double, high double, low double, close double, "
                                       "volume double, adj_close double, adj_factor double, source string, year int")


def test_lake_roundtrip_keeps_symbol_text(spark, tmpdir_path):
    lake.write_bars(_bars(spark), tmpdir_path, mode="overwrite")
    got = {r.symbol for r in lake.scan_bars(spark, tmpdir_path).select("symbol").distinct().collect()}
    assert got == {"0001", "^X", "AAPL"}


def test_replace_series_is_idempotent(spark, tmpdir_path):
    b = _bars(spark)
    lake.write_bars(b, tmpdir_path, mode="overwrite")
    lake.replace_series(b.filter(F.col("symbol") == "AAPL"), tmpdir_path)
    lake.replace_series(b.filter(F.col("symbol") == "AAPL"), tmpdir_path)
    assert lake.scan_bars(spark, tmpdir_path).count() == b.count()


def test_empty_lake_scan(spark, tmpdir_path):
    assert lake.scan_bars(spark, os.path.join(tmpdir_path, "none")).count() == 0


def test_partition_filters_reach_the_scan(spark, tmpdir_path):
    lake.write_bars(_bars(spark), tmpdir_path, mode="overwrite")
    df = bars.get_ohlcv(lake.scan_bars(spark, tmpdir_path), ["aapl"], "D1", start="2024-01-01")
    plan = explain(df)
    assert "PartitionFilters" in plan and "symbol" in plan and "AAPL" in plan
    assert df.count() == 2


def test_consolidated_shuffles_bars_once(spark):
    b = _bars(spark, ("A", "B"))
    vol = spark.createDataFrame([("A", dt.datetime(2023, 1, 1), 0.2)], "symbol string, timestamp timestamp_ntz, "
                                                                         "realized_vol_30d double")
    out = consolidated.consolidated(b, volatility=vol)
    plan = explain(out, "simple")
    assert plan.count("REPARTITION_BY_COL") == 1          # one exchange of the bars for fill + de-dup
    assert out.count() == b.count()


def test_read_only_guard(spark):
    spark.range(3).createOrReplaceTempView("guard_t")
    assert query.is_read_only(spark, "select id as update from guard_t")
    assert query.is_read_only(spark, "with x as (select 1 as a) select * from x")
    assert not query.is_read_only(spark, "drop view guard_t")
    assert not query.is_read_only(spark, "create or replace temp view v2 as select 1")
    assert not query.is_read_only(spark, "insert into guard_t select 1")
    assert not query.is_read_only(spark, "with x as (select 1 as a) insert into guard_t select * from x")
    assert not query.is_read_only(spark, "with x as (select 1 as a) insert overwrite directory '/tmp/w' using csv select * from x")
    assert not query.is_read_only(spark, "from guard_t insert into a select * insert into b select *")
    assert spark.catalog.tableExists("guard_t")
    for call in ("reflect('java.lang.System', 'getProperty', 'user.home')", "`Java_Method`('java.lang.System', 'exit', 1)",
                 "system.builtin.try_reflect('java.lang.System', 'gc')", "upper(reflect('java.lang.System', 'lineSeparator'))"):
        for text in (f"select {call}", f"with x as (select {call} as c) select * from x", f"select 1 where exists (select {call})",
                     f"select id from guard_t where id in (select {call})", f"select id from guard_t order by {call}",
                     f"select sum(id) over (partition by {call}) from guard_t", f"select id from guard_t group by id having max({call}) > '1'",
                     f"select * from guard_t a join guard_t b on a.id = length({call})", f"select 1 union all select length({call})"):
            assert not query.is_read_only(spark, text), text
    spark.udf.register("own_function", lambda x: x)
    assert not query.is_read_only(spark, "select own_function(id) from guard_t")
    assert query.is_read_only(spark, "select upper(trim(cast(id as string))), extract(year from current_date), id + 1, "
                                     "row_number() over (order by id), count(*) from guard_t group by id")
    assert query.is_read_only(spark, "select * from range(3) lateral view explode(array(id)) t as y")


def test_run_query_caps_rows(spark):
    res = query.run_query(spark, "select id, double('NaN') as nan_col from range(1000)", max_rows=500)
    assert res["truncated"] and res["total_rows"] == 1000 and len(res["rows"]) == 500
    assert res["rows"][0]["nan_col"] is None                    # NaN is shown as null
    res = query.run_query(spark, "select id % 7 as a, id as b from range(0, 1000, 1, 9) order by a desc, b", max_rows=3)
    assert [(r["a"], r["b"]) for r in res["rows"]] == [(6, 6), (6, 13), (6, 20)] and res["total_rows"] == 1000
    res = query.run_query(spark, "select id from range(5) where id > 9")
    assert res == {"columns": ["id"], "rows": [], "total_rows": 0, "truncated": False}


def test_a_capped_query_is_one_job(spark):
    context = spark.sparkContext
    context.setJobGroup("capped", "")
    query.run_query(spark, "select id from range(0, 1000, 1, 9)", max_rows=3)
    jobs = context.statusTracker().getJobIdsForGroup("capped")
    context._jsc.clearJobGroup()
    assert len(jobs) == 1


def test_platform_export_dialects(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "EURUSD_H1.csv"), "w") as f:
        f.write("<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>\n")
        f.write("2024.01.02\t10:00\t1.1\t1.2\t1.0\t1.15\t100\t7\t2\n")
    with open(os.path.join(tmpdir_path, "GBPUSD60.csv"), "w") as f:
        f.write("2024.01.02 10:00:00,1.3,1.4,1.2,1.35,50\n")
    df = csv_sources.read_platform_export(spark, tmpdir_path, source_tz="UTC").orderBy("symbol").collect()
    assert [(r.symbol, r.timeframe, r.close, r.volume) for r in df] == [("EURUSD", "1h", 1.15, 100.0),
                                                                       ("GBPUSD", "1h", 1.35, 50.0)]
    assert df[0].volume_real == 7.0 and df[0].timestamp == dt.datetime(2024, 1, 2, 10)


def test_symbol_dir_reader(spark, tmpdir_path):
    big = "Date,Open,High,Low,Close,Adj Close,Volume\n" + "".join(
        f"2020-01-{d:02d},1,2,0.5,1.5,0.75,100\n" for d in range(1, 29)) * 90
    with open(os.path.join(tmpdir_path, "AAA.csv"), "w") as f:
        f.write(big)
    with open(os.path.join(tmpdir_path, "EURUSD-X.csv"), "w") as f:
        f.write(big)
    with open(os.path.join(tmpdir_path, "TINY.csv"), "w") as f:
        f.write("Date,Open,High,Low,Close,Adj Close,Volume\n2020-01-01,1,1,1,1,1,1\n")
    assert csv_sources.read_symbol_dir(spark, tmpdir_path).where("symbol = 'TINY'").count() == 1
    df = csv_sources.read_symbol_dir(spark, tmpdir_path, min_bytes=75_000)
    got = {(r.symbol, r.asset_class) for r in df.select("symbol", "asset_class").distinct().collect()}
    assert got == {("AAA", "stocks"), ("EURUSD", "forex")}
    r = df.filter(F.col("symbol") == "AAA").orderBy("timestamp").first()
    assert r.timestamp == dt.datetime(2020, 1, 1, 5) and r.adj_factor == 0.5


def test_headers_are_read_file_by_file(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "AAA.csv"), "w") as f:
        f.write("Date,Open,High,Low,Close,Adj Close,Volume\n2020-01-02,1,4,0.5,2,1,10\n")
    with open(os.path.join(tmpdir_path, "BBB.csv"), "w") as f:
        f.write("Date,Close,High,Low,Open,Volume,Adj Close,Note\n2020-01-02,20,40,5,10,100,10,\"a, b\"\n")
    got = {r.symbol: r for r in csv_sources.read_symbol_dir(spark, tmpdir_path).collect()}
    show = (lambda r: (r.open, r.high, r.low, r.close, r.volume, r.adj_close, r.adj_factor, r.Note))
    assert show(got["AAA"]) == (1.0, 4.0, 0.5, 2.0, 10.0, 1.0, 0.5, None)
    assert show(got["BBB"]) == (10.0, 40.0, 5.0, 20.0, 100.0, 10.0, 0.5, "a, b")


def test_company_facts_reader(spark, tmpdir_path):
    doc = {"symbol": "S", "facts": {"us-gaap": {
        "Revenues": {"units": {"USD": [{"end": "2023-03-31", "val": 5, "form": "10-Q"},
                                       {"end": "2023-03-31", "val": 6, "form": "10-Q"}]}},
        "Assets": {"units": {"USD": [{"end": "2023-03-31", "val": 50, "form": "10-K"}]}}}}}
    with open(os.path.join(tmpdir_path, "s.json"), "w") as f:
        f.write(json.dumps(doc) + "\n")
    from marketlake.operators import fundamentals
    facts = json_sources.read_company_facts(spark, tmpdir_path)
    fin = fundamentals.facts_to_financials(fundamentals.extract_facts(facts)).collect()
    assert len(fin) == 1 and fin[0].revenue == 6.0 and fin[0].total_assets == 50.0 and fin[0].fiscal_period == "FY"


def test_asof_right_class_exported():
    assert Right.__name__ == "Right"


def test_apply_updates_appends_inside_windows_and_logs(spark, tmpdir_path):
    from marketlake.operators import catalog as CT
    from marketlake.plans import updates
    now = dt.datetime(2024, 6, 1)
    old = _bars(spark, ("AAA", "BBB")).filter(F.col("timestamp") < F.lit("2024-01-02").cast("timestamp_ntz"))
    lake.write_bars(old, tmpdir_path, mode="overwrite")
    cat = CT.refresh_catalog(lake.scan_bars(spark, tmpdir_path), now=now)
    cat_path = os.path.join(tmpdir_path, "_catalog")
    lake.write_table(cat, cat_path)
    catalog = spark.read.parquet(cat_path)
    # landing: every bar again (old ones must not be re-appended) plus one bar after "now"
    landed = _bars(spark, ("AAA", "BBB", "CCC")).unionByName(
        _bars(spark, ("AAA",)).limit(1).withColumn("timestamp", F.lit("2024-07-01").cast("timestamp_ntz")))
    new_cat, log = updates.apply_updates(catalog, landed, tmpdir_path, now=now)
    counts = {r.symbol: r["count"] for r in lake.scan_bars(spark, tmpdir_path).groupBy("symbol").count().collect()}
    assert counts == {"AAA": 4, "BBB": 4}                       # CCC is not catalogued; July is after now
    assert {(r.symbol, r.status, r.rows_added) for r in log.collect()} == {("AAA", "success", 2),
                                                                          ("BBB", "success", 2)}
    assert {(r.symbol, r.rows_count, r.end_date) for r in new_cat.collect()} == {("AAA", 4, "2024-01-04"),
                                                                                 ("BBB", 4, "2024-01-04")}


def test_lower_case_symbols_are_stored_and_found_upper_case(spark, tmpdir_path):
    lake.write_bars(_bars(spark, ("msft",)), tmpdir_path, mode="overwrite")
    assert {r.symbol for r in lake.scan_bars(spark, tmpdir_path).select("symbol").distinct().collect()} == {"MSFT"}
    assert bars.get_ohlcv(lake.scan_bars(spark, tmpdir_path), ["msft"], "D1").count() == 4


def test_apply_updates_scoped_to_symbols(spark, tmpdir_path):
    from marketlake.operators import catalog as CT
    from marketlake.plans import updates
    now = dt.datetime(2024, 6, 1)
    old = _bars(spark, ("AAA", "BBB")).filter(F.col("timestamp") < F.lit("2024-01-02").cast("timestamp_ntz"))
    lake.write_bars(old, tmpdir_path, mode="overwrite")
    cat_path = os.path.join(tmpdir_path, "_catalog")
    lake.write_table(CT.refresh_catalog(lake.scan_bars(spark, tmpdir_path), now=now), cat_path)
    catalog = spark.read.parquet(cat_path)
    _, log = updates.apply_updates(catalog, _bars(spark, ("AAA", "BBB")), tmpdir_path, now=now, symbols=["aaa"])
    assert {(r.symbol, r.status) for r in log.collect()} == {("AAA", "success")}
    counts = {r.symbol: r["count"] for r in lake.scan_bars(spark, tmpdir_path).groupBy("symbol").count().collect()}
    assert counts == {"AAA": 4, "BBB": 2}


def test_platform_export_delimiter_comes_from_the_first_line(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "USDJPY_H1.csv"), "w") as f:
        f.write("2024.01.02 10:00:00;1.3;1.4;1.2;1.35;50\n")
        f.write("2024.01.02 11:00:00;1,3;1,4;1,2;1,35;5,0\n")   # as many commas as semicolons
    rows = csv_sources.read_platform_export(spark, tmpdir_path, source_tz="UTC").orderBy("timestamp").collect()
    assert [r.timestamp for r in rows] == [dt.datetime(2024, 1, 2, 10), dt.datetime(2024, 1, 2, 11)]
    assert rows[0].close == 1.35 and rows[1].close is None     # split on ';', decimal comma is not a number


def _sorts_down_to_exchange(plan: str, marker: str) -> int:
    """Sorts on the single-child path below the first line holding ``marker``, up to
    the first exchange (pre-order text: the first child path comes right after)."""
    lines = plan.split("\n")
    start = next(i for i, line in enumerate(lines) if marker in line)
    n = 0
    for line in lines[start + 1:]:
        if "Exchange" in line:
            break
        n += "Sort [" in line
    return n


def test_consolidated_dedup_reuses_the_fill_sort(spark):
    b = _bars(spark, ("A", "B"))
    vol = spark.createDataFrame([("A", dt.datetime(2023, 1, 1), 0.2)], "symbol string, timestamp timestamp_ntz, "
                                                                         "realized_vol_30d double")
    plan = explain(consolidated.consolidated(b, volatility=vol), "simple")
    assert _sorts_down_to_exchange(plan, "Window [row_number()") == 1      # the fill's sort only


def test_returns_share_the_dedup_exchange_and_sort(spark):
    d = bars.with_returns(bars.get_ohlcv(_bars(spark, ("A", "B")), None, "D1", keep_block=True), 1)
    plan = explain(d, "simple")
    assert _sorts_down_to_exchange(plan, "Window [row_number()") == 1      # de-dup, lag: one sort
    assert plan.count("REPARTITION_BY_COL") >= 1


def test_cross_validation_is_aggregates_only(spark):
    from marketlake.operators import crossval
    b = _bars(spark, ("A",)).unionByName(_bars(spark, ("A",)).withColumn("source", F.lit("w")))
    plan = explain(crossval.cross_validate(b, "v", "w"), "simple")
    assert "Join" not in plan and "Window" not in plan


def test_all_resample_targets_come_from_one_scan(spark):
    from marketlake.registered import QUERIES as Q

    plan = Q["resample_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1
    executed = Q["resample_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 2


def test_returns_read_the_bars_once(spark):
    from marketlake.registered import QUERIES as Q

    df = Q["returns"](spark, "/root/testdata/sf0.001")
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1


def test_symbol_files_in_folders_named_by_them(spark, tmpdir_path):
    for stem in ("AAA", "EURUSD-X", "0012", "BRK.B"):
        os.makedirs(os.path.join(tmpdir_path, f"symbol={stem}"))
        with open(os.path.join(tmpdir_path, f"symbol={stem}", "part-0.csv"), "w") as f:
            f.write("Date,Open,High,Low,Close,Adj Close,Volume\n2020-01-02,1,2,0.5,1.5,0.75,100\n")
    got = {(r.symbol, r.asset_class, r.timestamp.hour) for r in csv_sources.read_symbol_dir(spark, tmpdir_path, name_column="symbol").collect()}
    assert got == {("AAA", "stocks", 5), ("EURUSD", "forex", 0), ("0012", "stocks", 5), ("BRK.B", "stocks", 5)}
