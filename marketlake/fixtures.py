"""Fixture views derived from the driver's TPC-H-style tables.

Each fixture is one SQL text that runs unchanged in Spark SQL and DuckDB, apart from
``{ts}`` (``timestamp_ntz`` in Spark, ``timestamp`` in DuckDB). Table references are
``{name}`` placeholders: in Spark they bind DataFrames through ``spark.sql(text,
name=df)`` (no global temp views), in DuckDB they become CTE / view names.
Everything a registered query reads is one of these, so its work grows with the
driver's tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events")

_BAR_BODY = """
  l_extendedprice/l_quantity as open, l_extendedprice/l_quantity*(1+l_tax) as high, l_extendedprice/l_quantity*(1-l_discount) as low,
  case when l_orderkey % 50 = 0 then null else l_extendedprice/l_quantity*(1+(l_tax-l_discount)/2) end as close,
  l_quantity as volume, case when l_returnflag='R' then 0.5e0 else 1.0e0 end as adj_factor,
  case when l_linestatus='O' then 'vendor_a' else 'vendor_b' end as source, l_orderkey, l_linenumber, l_partkey, l_extendedprice, cast(year(l_shipdate) as int) as year from {lineitem}"""

_DEDUP = ("select * from (select *, row_number() over (partition by symbol, timestamp order by source, "
          "l_orderkey, l_linenumber, l_partkey, l_extendedprice, adj_factor, volume, high, low) as rn from {%s}) t "
          "where rn = 1")

# Fixed fixture texts (test inputs; see FIXTURES.md for row counts).
FIXTURE_SQL: dict[str, str] = {
    "fx_raw_bars": "select concat('SUP', lpad(cast(l_suppkey as string), 6, '0')) as symbol, l_shipdate as timestamp, "
                   "'stocks' as asset_class, 'D1' as timeframe," + _BAR_BODY,
    "fx_bars": _DEDUP % "fx_raw_bars",
    "fx_minute": "select event_type as symbol, cast(date_trunc('minute', ts) as {ts}) as timestamp, value as open, "
                 "value+(event_id%7)*0.25e0 as high, value-(event_id%5)*0.25e0 as low, "
                 "case when event_id % 40 = 0 then null else value+((event_id%3)-1)*0.125e0 end as close, "
                 "cast(user_id as double) as volume, event_id from {events}",
    "fx_meta": "select concat('SUP', lpad(cast(s_suppkey as string), 6, '0')) as symbol, s_name as longname, "
               "n_name as exchange, r_name as sector, n_name as industry, s_acctbal as marketcap from {supplier} "
               "join {nation} on s_nationkey=n_nationkey join {region} on n_regionkey=r_regionkey where s_suppkey % 7 <> 0",
    "fx_universe": "select concat('SUP', lpad(cast(s_suppkey as string), 6, '0')) as symbol from {supplier} "
                   "where s_suppkey % 3 <> 0 union all select concat('MISSING', cast(r_regionkey as string)) from {region}",
    # right sides are keyed by supplier like the bars, so that they grow with the bars
    "fx_vol": "select concat('SUP', lpad(cast(l_suppkey as string), 6, '0')) as symbol, o_orderdate as timestamp, "
              "max(case when o_orderkey % 4 = 0 then null else o_totalprice/1000 end) as realized_vol_30d "
              "from {orders} join {lineitem} on o_orderkey = l_orderkey group by 1,2",
    "fx_facts": "select concat('SUP', lpad(cast(o_custkey as string), 6, '0')) as symbol, case o_orderstatus "
                "when 'F' then 'Revenues' when 'O' then 'SalesRevenueNet' else 'Assets' end as concept, "
                "case when o_orderkey % 5 = 0 then '8-K' when o_orderkey % 4 = 0 then '10-K' else '10-Q' end as form, "
                "cast(date_trunc('quarter', o_orderdate) as {ts}) as end_date, o_orderkey as pos, o_totalprice as val from {orders}",
    "fx_dense_bars": "select concat('SUP', lpad(cast(l_suppkey as string), 6, '0')) as symbol, l_shipdate as timestamp, "
                     "'stocks' as asset_class, 'D1' as timeframe," + _BAR_BODY,
    "fx_dense": _DEDUP % "fx_dense_bars",
    "fx_fund": "select concat('SUP', lpad(cast(l_suppkey as string), 6, '0')) as symbol, "
               "cast(date_trunc('month', o_orderdate) as {ts}) as timestamp, "
               "max(case when o_orderkey % 3 = 0 then null else o_totalprice/5000 end) as pe_ratio, "
               "max(case when o_orderkey % 5 = 0 then null else o_totalprice/90000 end) as price_to_book, "
               "count(*)*1e0 as sales from {orders} join {lineitem} on o_orderkey = l_orderkey group by 1,2",
    "fx_fin": "select concat('SUP', lpad(cast(l_suppkey as string), 6, '0')) as symbol, "
              "cast(date_trunc('quarter', o_orderdate) as {ts}) as report_date, max(o_totalprice) as revenue, "
              "max(case when o_orderkey % 4 = 0 then null else o_totalprice*0.1e0 end) as net_income, "
              "max(o_totalprice)*0.2e0 as operating_cf, "
              "max(case when o_orderkey % 3 = 0 then null else -o_totalprice*0.05e0 end) as capex "
              "from {orders} join {lineitem} on o_orderkey = l_orderkey group by 1,2",
    # all joined columns of the consolidated table
    "fx_fund_wide": "select *, price_to_book*0.1e0 as implied_vol, case when sales > 2 then null else sales*0.3e0 end as beta_raw, "
                    "pe_ratio*0.01e0 + 0.5e0 as beta_adj from {fx_fund}",
    "fx_fin_wide": "select *, net_income/1e6 as eps, case when capex is null then null else revenue*0.05e0 end as cash, "
                   "revenue*3e0 as total_assets, revenue*2e0 as total_liabilities, revenue as equity, revenue*0.7e0 as total_debt "
                   "from {fx_fin}",
    # a catalog with series of every class, for the branches of the update plan
    "fx_classes": "select symbol, case when symbol like '%4' then '1h' when symbol like '%5' then '1m' else timeframe end as timeframe, "
                  "case when symbol like '%1' then 'crypto' when symbol like '%2' then 'forex' when symbol like '%3' then 'macro' "
                  "else asset_class end as asset_class, start_date, end_date, rows_count, nulls_pct, "
                  "case when symbol like '%6' then 'dolt_rates' else source end as source from {fx_catalog}",
    "fx_income": "select concat('SUP', lpad(cast(o_custkey as string), 6, '0')) as act_symbol, o_orderdate as date, "
                 "o_orderpriority as period, max(o_totalprice) as sales, max(o_totalprice)*0.1e0 as net_income "
                 "from {orders} group by 1, 2, 3",
    "fx_assets": "select act_symbol, date, period, sales*3e0 as total_assets from {fx_income} where sales > 100000",
    "fx_cashflow": "select act_symbol, date, period, sales*0.2e0 as operating_cf, case when sales > 200000 then null "
                   "else -sales*0.05e0 end as property_and_equipment from {fx_income} where sales > 50000",
    "fx_eps": "select act_symbol as symbol, date as period_end_date, max(sales)/1e5 as reported, "
              "max(sales)/1.1e5 as estimate from {fx_income} group by 1,2",
    "fx_split": "select concat('SUP', lpad(cast(l_suppkey as string), 6, '0')) as act_symbol, l_shipdate as ex_date, "
                "l_quantity as to_factor, cast(l_linenumber as double) as for_factor from {lineitem} where l_linestatus = 'O'",
    "fx_div": "select concat('SUP', lpad(cast(l_suppkey as string), 6, '0')) as act_symbol, l_shipdate as ex_date, "
              "l_discount*10e0 as amount from {lineitem} where l_linestatus <> 'O'",
    "fx_rates": "select o_orderdate as date, avg_2y as t2, avg_10y as t10 from (select o_orderdate, "
                "min(o_totalprice)/1e5 as avg_2y, max(o_totalprice)/1e5 as avg_10y from {orders} group by 1) t",
    "fx_macro": "select event_type as symbol, cast(date_trunc('day', ts) as {ts}) as timestamp, "
                "max(case when event_id % 11 = 0 then null else value end) as value from {events} group by 1,2",
    "fx_catalog": "select symbol, timeframe, asset_class, min(timestamp) as start_date, max(timestamp) as end_date, "
                  "count(*) as rows_count, 100e0*sum(case when close is null then 1 else 0 end)/count(*) as nulls_pct, "
                  "'fixture' as source from {fx_raw_bars} group by symbol, timeframe, asset_class",
    "fx_two_source": "select symbol, timestamp, 'vendor_a' as source, close, volume from {fx_bars} union all "
                     "select symbol, timestamp, 'vendor_b' as source, close*(1e0+((l_orderkey % 7)-3)*0.004e0) as close, "
                     "volume from {fx_bars} where l_orderkey % 4 <> 0",
}

_REF = re.compile(r"\{([a-z_0-9]+)\}")


def _deps(name: str) -> list[str]:
    return [r for r in _REF.findall(FIXTURE_SQL[name]) if r != "ts"]


_TABLES: dict[str, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver base table. The driver's tables are read-only, so the DataFrame (whose
    schema Spark infers with a job) is built once per session and path."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = _TABLES.get(path)
    if df is None or df.sparkSession is not spark:
        df = _TABLES[path] = spark.read.parquet(path)
    return df


#: Keys by which two whole tables are joined.
JOIN_KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark DataFrame of fixture ``name`` over the base tables in ``sf_dir``.

    Tables that are joined as a whole come dealt by their key over all shuffle partitions. Left to itself, AQE joins them
    in about as many tasks as there are cores, since their few columns are small once compressed; a task then sorts and
    aggregates the more rows the larger the tables are."""
    if name in BASE_TABLES:
        return table(spark, sf_dir, name)
    text = FIXTURE_SQL[name].replace("{ts}", "timestamp_ntz")
    binds = {d: fixture(spark, sf_dir, d) for d in _deps(name)}
    if JOIN_KEYS.keys() <= binds.keys():
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        binds |= {d: binds[d].repartition(tasks, key) for d, key in JOIN_KEYS.items()}
    return spark.sql(text, **binds)


def duckdb_ctes(*names: str) -> str:
    """``with a as (...), b as (...)`` for DuckDB, dependencies first."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in BASE_TABLES or n in order:
            return
        for d in _deps(n):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        text = FIXTURE_SQL[n].replace("{ts}", "timestamp")
        text = _REF.sub(lambda m: m.group(1), text)
        parts.append(f"{n} as ({text})")
    return "with " + ",\n".join(parts) + "\n" if parts else ""


def duckdb_sql(body: str, *fixtures_used: str) -> str:
    """Oracle text: fixture CTEs + ``body`` (the body names fixtures directly).

    A body that starts with its own ``with`` has it merged into the fixture list.
    """
    head = duckdb_ctes(*fixtures_used)
    stripped = body.lstrip()
    if head and stripped.lower().startswith("with "):
        return head.rstrip() + ",\n" + stripped[5:]
    return head + body
