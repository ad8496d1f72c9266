"""The registered queries: one per operator family, each with its DuckDB oracle.

Each query reads the driver's tables through ``fixtures`` (so its work grows with
them) and runs a library operator on them; the oracle is an independent SQL
statement of the same semantics for DuckDB. Double aggregates whose value depends on
summation order are rounded to 6 decimals in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import duckdb_sql, fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# ------------------------------------------------------------------ E1 / W3 / W4 / N9
from .operators import bars as B  # noqa: E402

_E1_PROJ = ("select timestamp, symbol, asset_class, timeframe, open, high, low, close, volume, "
            "close*adj_factor as adj_close, adj_factor, source from fx_raw_bars")
_E1_ORDER = ("source nulls first, asset_class nulls first, open nulls first, high nulls first, low nulls first, "
             "close nulls first, volume nulls first, adj_close nulls first, adj_factor nulls first")


def _e1_body(where: str, select: str) -> str:
    return (f"select {select} from (select *, row_number() over (partition by symbol, timeframe, timestamp "
            f"order by {_E1_ORDER}) as rn from ({_E1_PROJ} where {where}) p) t where rn = 1")


def _e1_sql(where: str, select: str) -> str:
    return duckdb_sql(_e1_body(where, select), "fx_raw_bars")


_ADJ = ("timestamp, symbol, asset_class, timeframe, open*adj_factor as open, high*adj_factor as high, "
        "low*adj_factor as low, close*adj_factor as close, volume, adj_close, source")
_RAW = "timestamp, symbol, asset_class, timeframe, open, high, low, close, volume, source"
_FACTOR = "timestamp, symbol, asset_class, timeframe, open, high, low, close, volume, adj_close, adj_factor, source"


@register("get_ohlcv_adjusted", _e1_sql("timeframe = 'D1'", _ADJ))
def q_get_ohlcv_adjusted(spark, sf):
    return B.get_ohlcv(fixture(spark, sf, "fx_raw_bars"), None, "D1", adjusted=True)


@register("get_ohlcv_raw", _e1_sql("timeframe = 'D1'", _RAW))
def q_get_ohlcv_raw(spark, sf):
    return B.get_ohlcv(fixture(spark, sf, "fx_raw_bars"), None, "D1", adjusted=False)


@register("get_ohlcv_factor", _e1_sql("timeframe = 'D1'", _FACTOR))
def q_get_ohlcv_factor(spark, sf):
    return B.get_ohlcv(fixture(spark, sf, "fx_raw_bars"), None, "D1", adjusted="factor")


@register("get_ohlcv_range", _e1_sql(
    "timeframe = 'D1' and timestamp >= timestamp '1996-01-01' and timestamp <= timestamp '1997-06-30'", _ADJ))
def q_get_ohlcv_range(spark, sf):
    return B.get_ohlcv(fixture(spark, sf, "fx_raw_bars"), None, "D1", start="1996-01-01", end="1997-06-30")


_RAWCOLS = ("symbol, timestamp, asset_class, timeframe, open, high, low, close, volume, adj_factor, source, "
            "l_orderkey, l_linenumber, l_partkey, l_extendedprice, year")


@register("dedup_first", duckdb_sql(
    f"select {_RAWCOLS} from (select *, row_number() over (partition by symbol, timestamp order by "
    "case lower(source) when 'vendor_b' then 0 when 'vendor_a' then 1 else 2 end, source nulls first, "
    "l_orderkey, l_linenumber, l_partkey, l_extendedprice, volume, high, low) as rn from fx_raw_bars) t "
    "where rn = 1", "fx_raw_bars"))
def q_dedup_first(spark, sf):
    raw = fixture(spark, sf, "fx_raw_bars")
    return B.dedup_bars(raw, keys=["symbol", "timestamp"], source_priority=["vendor_b", "vendor_a"],
                        order=["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "volume", "high", "low"])


@register("dedup_last", duckdb_sql(
    f"select {_RAWCOLS} from (select *, row_number() over (partition by symbol, timestamp order by "
    "l_orderkey desc, l_linenumber desc, l_partkey desc, l_extendedprice desc, volume desc, high desc, low desc, "
    "source desc) as rn from fx_raw_bars) t where rn = 1", "fx_raw_bars"))
def q_dedup_last(spark, sf):
    raw = fixture(spark, sf, "fx_raw_bars")
    return B.keep_last(raw, ["symbol", "timestamp"],
                       ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "volume", "high", "low", "source"])


# ------------------------------------------------------------------ A3 resample
from .operators import resample as RS  # noqa: E402

_MINUTE_LAKE = ("select symbol, timestamp, 'stocks' as asset_class, '1m' as timeframe, open, high, low, close, volume, "
                "close*(1e0+(event_id%4)*0.25e0) as adj_close, 1e0+(event_id%4)*0.25e0 as adj_factor, "
                "case when event_id % 2 = 0 then 'vendor_a' else 'vendor_b' end as source, event_id from {fx_minute}")


def minute_lake(spark, sf):
    """1m bars in lake layout derived from the events table."""
    return spark.sql(_MINUTE_LAKE, fx_minute=fixture(spark, sf, "fx_minute"))


def _resample_body(tf: str, minutes: int) -> str:
    b = f"time_bucket(interval '{minutes} minutes', timestamp)"
    o = "order by timestamp, event_id"

    def first(c):
        return f"first({c} {o}) filter (where {c} is not null)"

    def last(c):
        return f"last({c} {o}) filter (where {c} is not null)"
    return (f"select * from (select {b} as timestamp, symbol, {first('asset_class')} as asset_class, "
            f"'{tf}' as timeframe, {first('open')} as open, max(high) as high, min(low) as low, {last('close')} as close, "
            f"coalesce(sum(volume), 0e0) as volume, {last('adj_close')} as adj_close, {first('adj_factor')} as adj_factor, "
            f"{first('source')} as source, cast(year({b}) as int) as year from ml group by {b}, symbol) t "
            "where open is not null and close is not null")


_ML = _MINUTE_LAKE.replace("{fx_minute}", "fx_minute")


def _resample_sql(tf: str, minutes: int) -> str:
    return duckdb_sql(f"with ml as ({_ML}) {_resample_body(tf, minutes)}", "fx_minute")


_TWO_CLASSES = "(select * replace (case when event_id % 3 = 0 then 'forex' else 'stocks' end as asset_class) from ml)"


@register("resample_two_classes", duckdb_sql(
    f"with ml as ({_ML}) " + _resample_body("1h", 60).replace("from ml group by", f"from {_TWO_CLASSES} m2 group by")
    .replace(", symbol) t", ", symbol, asset_class) t"), "fx_minute"))
def q_resample_two_classes(spark, sf):
    """A3: one symbol in two asset classes gives two series."""
    two = minute_lake(spark, sf).withColumn("asset_class", F.expr("case when event_id % 3 = 0 then 'forex' else 'stocks' end"))
    return RS.resample(two, ["1h"], tie=["event_id"])


for _tf, _m in RS.RESAMPLE_MINUTES.items():
    def _q(spark, sf, _tf=_tf):
        return RS.resample(minute_lake(spark, sf), [_tf], tie=["event_id"])
    register(f"resample_{_tf}", _resample_sql(_tf, _m))(_q)


# ------------------------------------------------------------------ W1 / A2 / A4 / A5 / A1
from .operators import quality as QA  # noqa: E402

_GAPS_D1 = ("select symbol, timeframe, gap_start, gap_end, cast(floor(secs/86400) as double) as gap_size, "
            "'days' as gap_unit from (select *, epoch(gap_end)-epoch(gap_start) as secs from "
            "(select symbol, timeframe, timestamp as gap_end, lag(timestamp) over (partition by symbol, timeframe "
            "order by timestamp) as gap_start from {src} where timeframe in ('D1','1m')) t) u "
            "where gap_start is not null and timeframe = 'D1' and secs > 345600")
_GAPS_1M = ("select symbol, timeframe, gap_start, gap_end, secs/60e0 as gap_size, 'minutes' as gap_unit "
            "from (select *, epoch(gap_end)-epoch(gap_start) as secs from (select symbol, timeframe, timestamp as gap_end, "
            "lag(timestamp) over (partition by symbol, timeframe order by timestamp) as gap_start from {src} "
            "where timeframe in ('D1','1m')) t) u where gap_start is not null and timeframe = '1m' and secs > 900 "
            "and cast(gap_start as date) = cast(gap_end as date)")


@register("gaps_daily", duckdb_sql(_GAPS_D1.format(src="fx_dense"), "fx_dense"))
def q_gaps_daily(spark, sf):
    return QA.detect_gaps(fixture(spark, sf, "fx_dense"))


@register("gaps_minute", duckdb_sql(
    _GAPS_1M.format(src="(select *, '1m' as timeframe from fx_minute)"), "fx_minute"))
def q_gaps_minute(spark, sf):
    return QA.detect_gaps(fixture(spark, sf, "fx_minute").withColumn("timeframe", F.lit("1m")))


def _np(c):
    return f"100e0*sum(case when {c} is null then 1 else 0 end)/count(*)"


@register("null_scan", duckdb_sql(
    "select symbol, timeframe, " + ", ".join(f"{_np(c)} as null_pct_{c}" for c in
                                            ("open", "high", "low", "close", "volume")) +
    " from fx_dense group by symbol, timeframe", "fx_dense"))
def q_null_scan(spark, sf):
    return QA.null_scan(fixture(spark, sf, "fx_dense"), ["open", "high", "low", "close", "volume"])


@register("quality_score", duckdb_sql(
    "with s as (select symbol, timeframe, count(*) as rows_count, "
    f"((({_np('open')} + {_np('high')}) + {_np('low')}) + {_np('close')})/4e0 as ohlc_null_pct "
    "from fx_dense group by symbol, timeframe), "
    f"g as (select symbol, timeframe, count(*) as gaps from ({_GAPS_D1.format(src='fx_dense')}) x group by 1, 2) "
    "select s.symbol, s.timeframe, rows_count, ohlc_null_pct, coalesce(g.gaps, 0) as gaps, "
    "greatest(0e0, 100e0 - least(50e0, ohlc_null_pct*1.5e0) - least(50e0, coalesce(g.gaps, 0)*5e0)) as quality_score "
    "from s left join g on s.symbol = g.symbol and s.timeframe = g.timeframe", "fx_dense"))
def q_quality_score(spark, sf):
    return QA.quality_scores(fixture(spark, sf, "fx_dense"))


_CAT = ("select symbol, timeframe, asset_class, min(timestamp) as start_date, max(timestamp) as end_date, "
        "count(*) as rows_count, cast(sum(case when close is null then 1 else 0 end) as bigint) as null_closes, "
        "100e0*sum(case when close is null then 1 else 0 end)/count(*) as nulls_pct from fx_raw_bars "
        "group by symbol, timeframe, asset_class")


@register("catalog_stats", duckdb_sql(
    f"select *, greatest(0e0, 100e0 - nulls_pct*2e0) as quality_score from ({_CAT}) c", "fx_raw_bars"))
def q_catalog_stats(spark, sf):
    return QA.catalog_stats(fixture(spark, sf, "fx_raw_bars"))


@register("simple_score", duckdb_sql(
    f"select symbol, timeframe, nulls_pct, greatest(0e0, 100e0 - nulls_pct*2e0) as quality_score from ({_CAT}) c",
    "fx_raw_bars"))
def q_simple_score(spark, sf):
    return QA.catalog_stats(fixture(spark, sf, "fx_raw_bars")).select("symbol", "timeframe", "nulls_pct",
                                                                     "quality_score")


@register("ohlc_violations", duckdb_sql(
    "select symbol, timeframe, count(*) as rows_count, cast(sum(case when high < greatest(open, close, low) or "
    "low > least(open, close, high) then 1 else 0 end) as bigint) as violations from fx_raw_bars "
    "group by symbol, timeframe", "fx_raw_bars"))
def q_ohlc_violations(spark, sf):
    return QA.ohlc_violations(fixture(spark, sf, "fx_raw_bars"))


# ------------------------------------------------------------------ J6 / A7 / A8
from .operators import crossval as CV  # noqa: E402

_XV_BASE = (
    "with ts2 as (select symbol, 'D1' as timeframe, timestamp, source, close, volume from fx_two_source), "
    "a as (select symbol, timeframe, timestamp, close from (select *, row_number() over (partition by symbol, "
    "timeframe, timestamp order by close nulls first) as rn from ts2 where lower(source) = 'vendor_a') x where rn = 1), "
    "b as (select symbol, timeframe, timestamp, close from (select *, row_number() over (partition by symbol, "
    "timeframe, timestamp order by close nulls first) as rn from ts2 where lower(source) = 'vendor_b') x where rn = 1), "
    "p as (select a.symbol, a.timeframe, a.timestamp, a.close as close_vendor_a, b.close as close_vendor_b, "
    "abs(a.close - b.close)/greatest(a.close, 1e-8)*100e0 as diff_pct from a join b on a.symbol = b.symbol "
    "and a.timeframe = b.timeframe and a.timestamp = b.timestamp) ")


def _two_source(spark, sf):
    return fixture(spark, sf, "fx_two_source").withColumn("timeframe", F.lit("D1"))


@register("cross_validate", duckdb_sql(
    _XV_BASE +
    ", st as (select symbol, timeframe, count(*) as n, avg(diff_pct) as mean_d, max(diff_pct) as max_d, "
    "stddev_samp(diff_pct) as sd, sum(case when diff_pct > 1 then 1 else 0 end) as disc from p group by 1, 2), "
    "ct as (select symbol, timeframe, cast(sum(case when s = 'vendor_a' then 1 else 0 end) as bigint) as source1_rows, "
    "cast(sum(case when s = 'vendor_b' then 1 else 0 end) as bigint) as source2_rows from (select distinct symbol, "
    "timeframe, timestamp, lower(source) as s from ts2 where lower(source) in ('vendor_a', 'vendor_b')) d group by 1, 2) "
    "select ct.symbol, ct.timeframe, source1_rows, source2_rows, coalesce(n, 0) as rows_compared, "
    "round(mean_d, 6) as mean_difference_pct, max_d as max_difference_pct, "
    "round(case when coalesce(n, 0) > 1 then sd when coalesce(n, 0) = 1 then 0e0 end, 6) as std_difference_pct, "
    "round(case when coalesce(n, 0) > 0 then coalesce(greatest(0e0, 100e0 - mean_d*10e0), 0e0) else 0e0 end, 6) "
    "as reliability_score, cast(coalesce(disc, 0) as bigint) as discrepancies "
    "from ct left join st on ct.symbol = st.symbol and ct.timeframe = st.timeframe", "fx_two_source"))
def q_cross_validate(spark, sf):
    out = CV.cross_validate(_two_source(spark, sf), "vendor_a", "vendor_b")
    return out.select(*[F.round(c, 6).alias(c) if c in ("mean_difference_pct", "std_difference_pct",
                                                          "reliability_score") else F.col(c) for c in out.columns])


@register("discrepancies_range", duckdb_sql(
    _XV_BASE + "select * from p where symbol in ('SUP000001', 'SUP000002') and timestamp >= timestamp '1994-01-01' and "
    "timestamp <= timestamp '1996-12-31'", "fx_two_source"))
def q_discrepancies_range(spark, sf):
    """E6 with its arguments: two symbols, a timeframe and a range of dates."""
    return CV.compare_sources(_two_source(spark, sf), "vendor_a", "vendor_b", symbols=["sup000001", "SUP000002"],
                              timeframe="D1", start="1994-01-01", end="1996-12-31")


@register("discrepancies", duckdb_sql(_XV_BASE + "select * from p where diff_pct > 1", "fx_two_source"))
def q_discrepancies(spark, sf):
    return CV.discrepancies(_two_source(spark, sf), "vendor_a", "vendor_b")


# ------------------------------------------------------------------ U2
from .operators import merge as MG  # noqa: E402

_U2_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "volume", "high", "low"]


@register("range_override_merge", duckdb_sql(
    "with inc as (select * from fx_raw_bars where source = 'vendor_a'), ex as (select * from fx_raw_bars "
    "where source = 'vendor_b'), rng as (select symbol, min(timestamp) as lo, max(timestamp) as hi from inc "
    "group by symbol), outside as (select ex.* from ex left join rng on ex.symbol = rng.symbol where rng.lo is null "
    "or ex.timestamp < rng.lo or ex.timestamp > rng.hi), m as (select *, 0 as origin from outside union all "
    f"select *, 1 as origin from inc) select {_RAWCOLS} from (select *, row_number() over (partition by symbol, "
    "timestamp order by origin desc nulls last, " + ", ".join(f"{c} desc nulls last" for c in _U2_ORDER) +
    ") as rn from m) t where rn = 1", "fx_raw_bars"))
def q_range_override_merge(spark, sf):
    raw = fixture(spark, sf, "fx_raw_bars")
    return MG.range_override_merge(raw.filter(F.col("source") == "vendor_b"), raw.filter(F.col("source") == "vendor_a"),
                                   keys=["symbol"], order=_U2_ORDER)


# ------------------------------------------------------------------ J7-J10 / E4 / E5 / E9 / E10 / W5
_E1_D1 = _e1_body("timeframe = 'D1'", _ADJ)
from .operators import asof as AS  # noqa: E402
from .operators import consolidated as CO  # noqa: E402


def _ffill(cols, src, ts="timestamp", extra=""):
    fills = ", ".join(f"last_value({c} ignore nulls) over (partition by symbol order by {ts} rows between "
                      f"unbounded preceding and current row) as {c}" for c in cols)
    return f"select symbol, {ts} as timestamp, {fills} from {src}{extra}"


_VF = _ffill(["realized_vol_30d"], "fx_vol")
_FF = _ffill(["pe_ratio", "price_to_book", "sales"], "fx_fund")
_FINF = _ffill(["revenue", "net_income", "free_cash_flow"],
               "(select *, operating_cf - coalesce(abs(capex), 0e0) as free_cash_flow from fx_fin) f", "report_date")
_E4_J = (
    f"with e1 as ({_E1_D1}), vf as ({_VF}), ff as ({_FF}), finf as ({_FINF}), "
    "j1 as (select e1.*, vf.realized_vol_30d from e1 asof left join vf on e1.symbol = vf.symbol "
    "and e1.timestamp >= vf.timestamp), "
    "j2 as (select j1.*, ff.pe_ratio, ff.price_to_book, ff.sales from j1 asof left join ff on j1.symbol = ff.symbol "
    "and j1.timestamp >= ff.timestamp), "
    "j as (select j2.*, finf.revenue, finf.net_income, finf.free_cash_flow from j2 asof left join finf "
    "on j2.symbol = finf.symbol and j2.timestamp >= finf.timestamp) ")
_E4_SELECT = (
    "select strftime(j.timestamp, '%Y-%m-%d') as date, j.symbol, coalesce(m.longname, '') as company_name, "
    "coalesce(m.sector, '') as sector, coalesce(m.industry, '') as industry, m.marketcap as market_cap, "
    "open, high, low, close, volume, realized_vol_30d, pe_ratio, price_to_book, sales, revenue, net_income, "
    "free_cash_flow from j left join fx_meta m on j.symbol = m.symbol")
_E4_FX = ("fx_raw_bars", "fx_vol", "fx_fund", "fx_fin", "fx_meta")


def _consolidated(spark, sf, **kw):
    return CO.consolidated(fixture(spark, sf, "fx_raw_bars"), volatility=fixture(spark, sf, "fx_vol"),
                           fundamentals=fixture(spark, sf, "fx_fund"), financials=fixture(spark, sf, "fx_fin"),
                           metadata=fixture(spark, sf, "fx_meta"), timeframe="D1", adjusted=True, **kw)


@register("asof_volatility", duckdb_sql(
    f"with vf as ({_VF}) select b.symbol, b.timestamp, b.close, vf.realized_vol_30d from fx_bars b "
    "asof left join vf on b.symbol = vf.symbol and b.timestamp >= vf.timestamp", "fx_bars", "fx_vol"))
def q_asof_volatility(spark, sf):
    bars = fixture(spark, sf, "fx_bars").select("symbol", "timestamp", "close")
    return AS.asof_fill(bars, [AS.Right(fixture(spark, sf, "fx_vol"), ["realized_vol_30d"])])


@register("consolidated", duckdb_sql(_E4_J + _E4_SELECT, *_E4_FX))
def q_consolidated(spark, sf):
    return _consolidated(spark, sf)


@register("consolidated_range", duckdb_sql(
    _E4_J + "select * from (" + _E4_SELECT + ") r where date >= '1996-01-01' and date <= '1997-12-31'", *_E4_FX))
def q_consolidated_range(spark, sf):
    return _consolidated(spark, sf, start="1996-01-01", end="1997-12-31")


@register("momentum_20d", duckdb_sql(
    _E4_J + "select symbol, timestamp, close, volume, realized_vol_30d, pe_ratio, "
    "(close - lag(close, 20) over (partition by symbol order by timestamp)) / lag(close, 20) over "
    "(partition by symbol order by timestamp) as momentum_20d from j", *_E4_FX))
def q_momentum_20d(spark, sf):
    view = _consolidated(spark, sf, keep_keys=True)
    bars = B.get_ohlcv(fixture(spark, sf, "fx_raw_bars"), None, "D1", adjusted=True, keep_block=True)
    return CO.feature_table(view, 20, bars=bars).select("symbol", "timestamp", "close", "volume", "realized_vol_30d",
                                             "pe_ratio", "momentum_20d")


@register("returns", duckdb_sql(
    f"with e1 as ({_E1_D1}) select symbol, timeframe, timestamp, close, "
    "(close - lag(close) over (partition by symbol, timeframe order by timestamp)) / lag(close) over "
    "(partition by symbol, timeframe order by timestamp) as return_1 from e1", "fx_raw_bars"))
def q_returns(spark, sf):
    bars = B.get_ohlcv(fixture(spark, sf, "fx_raw_bars"), None, "D1", adjusted=True, keep_block=True)
    return B.with_returns(bars, 1).select("symbol", "timeframe", "timestamp", "close", "return_1")


WIDE_SYMBOLS = ["click", "error", "purchase", "signup", "view"]


@register("wide_prices", duckdb_sql(
    f"with ml as ({_ML}) select timestamp, " + ", ".join(
        f"max(adj_close) filter (where symbol = '{x}') as {x}" for x in WIDE_SYMBOLS) + " from ml group by timestamp", "fx_minute"))
def q_wide_prices(spark, sf):
    return CO.wide_prices(minute_lake(spark, sf), WIDE_SYMBOLS, "adj_close")


# ------------------------------------------------------------------ catalog: C*, A9, A10, J1-J3, F3, F6
import datetime as _dt  # noqa: E402

from .operators import catalog as CT  # noqa: E402
from .plans import updates as PL  # noqa: E402

NOW = _dt.datetime(2001, 9, 1)   # fixed "now" so plans are reproducible
_NOW_SQL = "timestamp '2001-09-01 00:00:00'"

_DIRECTORY = ("select c.*, m.longname, m.exchange, m.sector, m.industry, m.marketcap from fx_catalog c "
              "left join fx_meta m on c.symbol = m.symbol where c.asset_class != 'stocks' or "
              "c.symbol in (select symbol from fx_universe)")


def _directory(spark, sf):
    return CT.symbol_directory(fixture(spark, sf, "fx_catalog"), fixture(spark, sf, "fx_meta"),
                               fixture(spark, sf, "fx_universe"))


@register("symbol_directory", duckdb_sql(_DIRECTORY, "fx_catalog", "fx_meta", "fx_universe"))
def q_symbol_directory(spark, sf):
    return _directory(spark, sf)


@register("coverage", duckdb_sql(
    "select total, imported, total - imported as missing from (select count(*) as total, count(distinct i.symbol) "
    "as imported from fx_universe u left join (select distinct symbol from fx_catalog where asset_class = 'stocks' "
    "and rows_count > 0) i on u.symbol = i.symbol) t", "fx_catalog", "fx_universe"))
def q_coverage(spark, sf):
    return CT.coverage(fixture(spark, sf, "fx_universe"), fixture(spark, sf, "fx_catalog"))


@register("missing_symbols", duckdb_sql(
    "select symbol from fx_universe where symbol not in (select symbol from fx_catalog where asset_class = 'stocks' "
    "and rows_count > 0)", "fx_catalog", "fx_universe"))
def q_missing_symbols(spark, sf):
    return CT.missing_symbols(fixture(spark, sf, "fx_universe"), fixture(spark, sf, "fx_catalog"))


def _flag(name, src, col="symbol"):
    return (f"left join (select distinct {col} as symbol, true as flag from {src}) {name} on c.symbol = {name}.symbol",
            f"coalesce({name}.flag, false) as {name}")


_FLAGS = [_flag("financials", "fx_fin"), _flag("volatility", "fx_vol"), _flag("fundamentals", "fx_fund"),
          _flag("corporate_actions", "(select act_symbol from fx_split union all select act_symbol from fx_div) ca",
                "act_symbol")]


@register("dataset_status", duckdb_sql(
    "select c.symbol, c.timeframes, " + ", ".join(f[1] for f in _FLAGS) + " from (select symbol, "
    "array_to_string(list_sort(list_distinct(list(timeframe))), ',') as timeframes from fx_catalog group by symbol) c "
    + " ".join(f[0] for f in _FLAGS), "fx_catalog", "fx_fin", "fx_vol", "fx_fund", "fx_split", "fx_div"))
def q_dataset_status(spark, sf):
    actions = fixture(spark, sf, "fx_split").select(F.col("act_symbol").alias("symbol")).unionByName(
        fixture(spark, sf, "fx_div").select(F.col("act_symbol").alias("symbol")))
    return CT.dataset_status(fixture(spark, sf, "fx_catalog"), {
        "financials": fixture(spark, sf, "fx_fin"), "volatility": fixture(spark, sf, "fx_vol"),
        "fundamentals": fixture(spark, sf, "fx_fund"), "corporate_actions": actions})


@register("symbol_search", duckdb_sql(
    "select * from (select distinct symbol, case when nullif(longname, '') is null then symbol else "
    f"symbol || ' - ' || longname end as label from ({_DIRECTORY}) d) s where contains(lower(symbol), '0000001') "
    "or contains(lower(label), '0000001')", "fx_catalog", "fx_meta", "fx_universe"))
def q_symbol_search(spark, sf):
    return CT.symbol_search(_directory(spark, sf), "0000001")


_NEW_META = ("select concat('SUP', lpad(cast(s_suppkey as string), 6, '0')) as symbol, case when s_suppkey % 4 = 0 "
             "then null else s_acctbal*2e0 end as marketcap, case when s_suppkey % 3 = 0 then 'Updated' end as sector "
             "from {supplier} where s_suppkey % 2 = 0")


@register("metadata_upsert", duckdb_sql(
    f"with nw as ({_NEW_META.replace('{supplier}', 'supplier')}) select coalesce(o.symbol, n.symbol) as symbol, "
    "o.longname, o.exchange, coalesce(n.sector, o.sector) as sector, o.industry, coalesce(n.marketcap, o.marketcap) "
    "as marketcap from fx_meta o full join nw n on o.symbol = n.symbol", "fx_meta"))
def q_metadata_upsert(spark, sf):
    new = spark.sql(_NEW_META, supplier=fixture(spark, sf, "supplier"))
    return CT.upsert_metadata(fixture(spark, sf, "fx_meta"), new, replace=False)


_FMT = ("case when timeframe = 'D1' then strftime({c}, '%Y-%m-%d') else strftime({c}, '%Y-%m-%d %H:%M:%S') end")


@register("refresh_catalog", duckdb_sql(
    "select symbol, timeframe, asset_class, " + _FMT.format(c="min(timestamp)") + " as start_date, "
    + _FMT.format(c="max(timestamp)") + " as end_date, count(*) as rows_count, "
    "100e0*sum(case when close is null then 1 else 0 end)/count(*) as nulls_pct, "
    "greatest(0e0, 100e0 - (100e0*sum(case when close is null then 1 else 0 end)/count(*))*2e0) as quality_score, "
    "array_to_string(list_sort(list_distinct(list(source))), '+') as source, "
    f"{_NOW_SQL} as last_updated from fx_raw_bars group by symbol, timeframe, asset_class", "fx_raw_bars"))
def q_refresh_catalog(spark, sf):
    return CT.refresh_catalog(fixture(spark, sf, "fx_raw_bars"), now=NOW)


@register("catalog_upsert", duckdb_sql(
    "with nw as (select symbol, timeframe, asset_class, min(timestamp) as start_date, max(timestamp) as end_date, "
    "count(*) as rows_count, 100e0*sum(case when close is null then 1 else 0 end)/count(*) as nulls_pct, "
    "'refresh' as source from (select *, '1m' as timeframe, 'stocks' as asset_class from fx_minute) m "
    "group by symbol, timeframe, asset_class), un as (select *, 0 as o from fx_catalog union all "
    "select *, 1 as o from nw) select symbol, timeframe, asset_class, start_date, end_date, rows_count, nulls_pct, "
    "source from (select *, row_number() over (partition by symbol, timeframe, asset_class order by o desc) as rn "
    "from un) t where rn = 1", "fx_catalog", "fx_minute"))
def q_catalog_upsert(spark, sf):
    minute = fixture(spark, sf, "fx_minute").withColumn("timeframe", F.lit("1m")).withColumn("asset_class",
                                                                                            F.lit("stocks"))
    new = (QA.catalog_stats(minute).select("symbol", "timeframe", "asset_class", "start_date", "end_date",
                                           "rows_count", "nulls_pct").withColumn("source", F.lit("refresh")))
    return CT.upsert_datasets(fixture(spark, sf, "fx_catalog"), new)


# ------------------------------------------------------------------ planning P1-P7, A13
_P1_START = ("case when timeframe = 'D1' then end_date + interval 1 day when timeframe in ('1h','4h') then "
             "end_date + interval 1 hour when timeframe in ('1m','2m','5m','15m','30m') then end_date + interval 1 "
             "minute else end_date + interval 1 second end")
_P1 = (
    f"select symbol, timeframe, asset_class, case when st = 'update' then {_FMT.format(c='s')} end as start, "
    f"case when st = 'update' then {_FMT.format(c=_NOW_SQL)} end as \"end\", case when st = 'update' then (case "
    "when asset_class = 'crypto' then 'binance' else 'yfinance' end) end as connector, case when st = 'update' and "
    "asset_class != 'crypto' then (case when asset_class = 'forex' then 'UTC' else 'America/New_York' end) end "
    "as source_tz, st as status from (select *, case when asset_class = 'macro' or source = 'dolt_rates' then "
    f"'skipped' when s >= {_NOW_SQL} then 'up_to_date' else 'update' end as st from (select *, {_P1_START} as s "
    "from fx_catalog) a) b")


@register("plan_updates", duckdb_sql(_P1, "fx_catalog"))
def q_plan_updates(spark, sf):
    return PL.plan_updates(fixture(spark, sf, "fx_catalog"), now=NOW)


_BAD_DATES = ("(select * replace (case when symbol like '%7' then 'N/A' when symbol like '%8' then '' else "
              "strftime(end_date, '%Y-%m-%d') end as end_date) from fx_catalog)")


_MALFORMED_SQL = _BAD_DATES.replace("'N/A'", "'unknown'")


@register("plan_updates_bad_dates", duckdb_sql(
    f"select symbol, case when end_date in ('N/A', '') then 'bad_end_date' when strptime(end_date, '%Y-%m-%d') + interval 1 day "
    f">= {_NOW_SQL} then 'up_to_date' else 'update' end as status from {_BAD_DATES} c", "fx_catalog"))
def q_plan_updates_bad_dates(spark, sf):
    """Unreadable end dates stop their own series only."""
    text = (F.when(F.col("symbol").like("%7"), "N/A").when(F.col("symbol").like("%8"), "")
            .otherwise(F.date_format("end_date", "yyyy-MM-dd")))
    return PL.plan_updates(fixture(spark, sf, "fx_catalog").withColumn("end_date", text), now=NOW).select("symbol", "status")


@register("plan_malformed_dates", duckdb_sql(
    "select symbol, 'daily' as plan, case when end_date = 'unknown' then null when end_date = '' then '2022-01-01' else "
    "strftime(strptime(end_date, '%Y-%m-%d') + interval 1 day, '%Y-%m-%d') end as start, case when end_date = 'unknown' then "
    f"'bad_end_date' when end_date = '' or strptime(end_date, '%Y-%m-%d') + interval 1 day >= {_NOW_SQL} then 'up_to_date' else "
    f"'update' end as status from {_MALFORMED_SQL} c union all select m.symbol, 'bulk', strftime(coalesce(try_strptime(end_date, "
    f"'%Y-%m-%d') + interval 1 day, {_NOW_SQL} - interval 730 day), '%Y-%m-%d'), null from fx_meta m left join {_MALFORMED_SQL} c "
    "on c.symbol = m.symbol", "fx_catalog", "fx_meta"))
def q_plan_malformed_dates(spark, sf):
    """An end date that is neither blank nor readable costs its own series only."""
    text = (F.when(F.col("symbol").like("%7"), "unknown").when(F.col("symbol").like("%8"), "")
            .otherwise(F.date_format("end_date", "yyyy-MM-dd")))
    catalog = fixture(spark, sf, "fx_catalog").withColumn("end_date", text)
    daily = PL.plan_daily_stocks(catalog, now=NOW).select("symbol", F.lit("daily").alias("plan"), "start", "status")
    bulk = PL.plan_bulk(fixture(spark, sf, "fx_meta"), catalog, "D1", now=NOW)
    return daily.unionByName(bulk.select("symbol", F.lit("bulk").alias("plan"), "start", F.lit(None).cast("string").alias("status")))


@register("update_summary", duckdb_sql(
    f"select status, count(*) as series from ({_P1}) p group by status", "fx_catalog"))
def q_update_summary(spark, sf):
    return PL.update_summary(PL.plan_updates(fixture(spark, sf, "fx_catalog"), now=NOW))


@register("plan_bulk", duckdb_sql(
    "select m.symbol, strftime(coalesce(cast(e.e as date) + 1, cast(" + _NOW_SQL + " - interval 730 day as date)), "
    f"'%Y-%m-%d') as start, strftime({_NOW_SQL}, '%Y-%m-%d') as \"end\" from fx_meta m left join (select symbol, "
    "max(end_date) as e from fx_catalog where timeframe = 'D1' group by symbol) e on m.symbol = e.symbol",
    "fx_meta", "fx_catalog"))
def q_plan_bulk(spark, sf):
    return PL.plan_bulk(fixture(spark, sf, "fx_meta"), fixture(spark, sf, "fx_catalog"), "D1", now=NOW)


@register("plan_missing", duckdb_sql(
    "select symbol, '1996-01-02' as start, '2026-08-16' as \"end\" from fx_universe where symbol not in (select "
    "symbol from fx_catalog where asset_class = 'stocks' and rows_count > 0)", "fx_catalog", "fx_universe"))
def q_plan_missing(spark, sf):
    return PL.plan_missing(fixture(spark, sf, "fx_universe"), fixture(spark, sf, "fx_catalog"))


_CLAMP_PLAN = ("select symbol, case cast(right(symbol, 1) as int) % 4 when 0 then '1m' when 1 then '15m' when 2 "
               "then '1h' else 'D1' end as timeframe, start_date as start, {now} as `end` from {fx_catalog}")


@register("history_clamp", duckdb_sql(
    "select symbol, timeframe, s as start, e as \"end\" from (select symbol, timeframe, case when lim is not null and "
    "start < lim then lim else start end as s, e from (select *, \"end\" as e, case when timeframe = '1m' then "
    f"{_NOW_SQL} - interval 29 day when timeframe in ('2m','5m','15m','30m','1h','4h') then {_NOW_SQL} - interval 59 "
    "day end as lim from (" + _CLAMP_PLAN.replace("{fx_catalog}", "fx_catalog").replace("`end`", '"end"')
    .replace("{now}", _NOW_SQL) + ") p) q) r where s < e", "fx_catalog"))
def q_history_clamp(spark, sf):
    plan = spark.sql(_CLAMP_PLAN.replace("{now}", "timestamp_ntz'2001-09-01 00:00:00'"),
                     fx_catalog=fixture(spark, sf, "fx_catalog"))
    return PL.history_clamp(plan, "yfinance", now=NOW)


# ------------------------------------------------------------------ fundamentals: J4, J5, N15, N17, U3, X1-X4
from .operators import fundamentals as FD  # noqa: E402
from .sources import reference_data as RD  # noqa: E402

_J = "on i.act_symbol = {a}.act_symbol and i.date = {a}.date and i.period = {a}.period"


@register("statements_join", duckdb_sql(
    "select i.act_symbol as symbol, i.date as report_date, i.period as fiscal_period, i.sales as revenue, "
    "i.net_income, a.total_assets, c.operating_cf, c.property_and_equipment as capex, "
    "c.operating_cf - coalesce(abs(c.property_and_equipment), 0e0) as free_cash_flow, e.estimate as eps_estimate, "
    "e.reported as actual_eps, e.reported - e.estimate as eps_surprise from fx_income i "
    f"left join fx_assets a {_J.format(a='a')} left join fx_cashflow c {_J.format(a='c')} "
    "left join fx_eps e on i.act_symbol = e.symbol and i.date = e.period_end_date",
    "fx_income", "fx_assets", "fx_cashflow", "fx_eps"))
def q_statements_join(spark, sf):
    return FD.statements_join(fixture(spark, sf, "fx_income"),
                              [fixture(spark, sf, "fx_assets"), fixture(spark, sf, "fx_cashflow")],
                              estimates=fixture(spark, sf, "fx_eps"))


@register("eps_surprise", duckdb_sql(
    "select symbol, period_end_date as report_date, estimate as eps_estimate, reported as actual_eps, "
    "reported - estimate as eps_surprise from fx_eps", "fx_eps"))
def q_eps_surprise(spark, sf):
    return FD.eps_surprise(fixture(spark, sf, "fx_eps"))


_FIN_FCF = ("select symbol, report_date, revenue, net_income, operating_cf, capex, "
            "operating_cf - coalesce(abs(capex), 0e0) as free_cash_flow from fx_fin")


@register("free_cash_flow", duckdb_sql(_FIN_FCF, "fx_fin"))
def q_free_cash_flow(spark, sf):
    return fixture(spark, sf, "fx_fin").withColumn("free_cash_flow", FD.free_cash_flow())


_METRIC_VALUES = ", ".join(f"('{m}', '{c}', {i})" for m, cs in FD.METRIC_CONCEPTS.items() for i, c in enumerate(cs))
_FACTS = (
    f"md as (select * from (values {_METRIC_VALUES}) v(metric, concept, pref)), "
    "c as (select f.symbol, f.end_date, f.pos, f.val, f.form, md.metric, md.pref from fx_facts f join md "
    "on f.concept = md.concept where f.form in ('10-Q', '10-K')), "
    "best as (select symbol, metric, min(pref) as pref from c group by symbol, metric), "
    "x as (select c.symbol, c.metric, c.end_date, arg_max(c.val, c.pos) as val, arg_max(c.form, c.pos) as form "
    "from c join best on c.symbol = best.symbol and c.metric = best.metric and c.pref = best.pref "
    "group by c.symbol, c.metric, c.end_date) ")
_PIVOT = (
    "select symbol, end_date as report_date, case when max(case when form = '10-K' then 1 else 0 end) = 1 then 'FY' "
    "else 'Q' end as fiscal_period, " + ", ".join(f"max(case when metric = '{m}' then val end) as {m}"
                                                  for m in FD.METRIC_CONCEPTS) +
    " from x group by symbol, end_date")
_FACTS_FIN = (
    f"select *, operating_cf - coalesce(abs(capex), 0e0) as free_cash_flow, cast(null as double) as eps_estimate, "
    f"cast(null as double) as actual_eps, cast(null as double) as eps_surprise from ({_PIVOT}) p "
    "where revenue is not null or net_income is not null or total_assets is not null")


@register("facts_extract", duckdb_sql("with " + _FACTS + "select * from x", "fx_facts"))
def q_facts_extract(spark, sf):
    return FD.extract_facts(fixture(spark, sf, "fx_facts"))


@register("facts_pivot", duckdb_sql("with " + _FACTS + _FACTS_FIN, "fx_facts"))
def q_facts_pivot(spark, sf):
    return FD.facts_to_financials(FD.extract_facts(fixture(spark, sf, "fx_facts")))


@register("financials_merge", duckdb_sql(
    "with " + _FACTS + f", nw as (select symbol, report_date, fiscal_period, revenue, total_assets from ({_FACTS_FIN}) "
    f"q), ex as ({_FIN_FCF}), un as (select symbol, report_date, revenue, net_income, operating_cf, capex, "
    "free_cash_flow, cast(null as varchar) as fiscal_period, cast(null as double) as total_assets, 0 as o from ex "
    "union all select symbol, report_date, revenue, null, null, null, null, fiscal_period, total_assets, 1 from nw) "
    "select symbol, report_date, revenue, net_income, operating_cf, capex, free_cash_flow, fiscal_period, "
    "total_assets from (select *, row_number() over (partition by symbol, report_date order by o desc) as rn "
    "from un) t where rn = 1", "fx_facts", "fx_fin"))
def q_financials_merge(spark, sf):
    existing = fixture(spark, sf, "fx_fin").withColumn("free_cash_flow", FD.free_cash_flow())
    new = FD.facts_to_financials(FD.extract_facts(fixture(spark, sf, "fx_facts"))).select(
        "symbol", "report_date", "fiscal_period", "revenue", "total_assets")
    return FD.merge_financials(existing, new)


@register("corporate_actions", duckdb_sql(
    "select act_symbol as symbol, ex_date as date, 'split' as action_type, case when for_factor = 0 then null "
    "else to_factor/for_factor end as split_factor, 0e0 as dividend_amount from fx_split union all "
    "select act_symbol, ex_date, 'dividend', 1e0, amount from fx_div", "fx_split", "fx_div"))
def q_corporate_actions(spark, sf):
    return RD.corporate_actions(fixture(spark, sf, "fx_split"), fixture(spark, sf, "fx_div"))


@register("yield_spread", duckdb_sql(
    "select date as timestamp, t2 as t_note_2y, t10 as t_note_10y, t10 - t2 as yield_spread_2_10 from fx_rates",
    "fx_rates"))
def q_yield_spread(spark, sf):
    return RD.yield_curve(fixture(spark, sf, "fx_rates"), {"t2": "t_note_2y", "t10": "t_note_10y"})


@register("macro_series", duckdb_sql(
    "select symbol, timestamp, value, 'macro' as asset_class, 'D1' as timeframe, 'fred' as source from fx_macro "
    "where value is not null", "fx_macro"))
def q_macro_series(spark, sf):
    return RD.macro_series(fixture(spark, sf, "fx_macro"))


# ------------------------------------------------------------------ normalisation N1-N8
from .operators import normalize as NM  # noqa: E402


def _vendor_frame(spark, sf, empty_rows=False, text=False):
    """A vendor-layout daily file (mixed-case names, 'Adj Close') from the raw bars."""
    r = fixture(spark, sf, "fx_raw_bars")
    gone = (F.col("l_orderkey") % 7 == 0) if empty_rows else F.lit(False)

    def price(c):
        v = F.when(gone, F.lit(None).cast("double")).otherwise(F.col(c))
        if text:
            v = F.when(F.col("l_orderkey") % 13 == 0, F.lit("n/a")).otherwise(v.cast("string"))
        return v
    return r.select(F.col("symbol").alias("Symbol"), F.col("timestamp").alias("Date"),
                    price("open").alias("Open"), price("high").alias("High"), price("low").alias("Low"),
                    price("close").alias("Close"), (F.col("close") * F.col("adj_factor")).alias("Adj Close"),
                    F.col("volume").alias("Volume"), "l_orderkey")


def _std_sql(ts="timestamp", where="", p=lambda c: c, year=None):
    year = year or f"cast(year({ts}) as int)"
    return ("select " + f"{ts} as timestamp, symbol, 'stocks' as asset_class, 'D1' as timeframe, "
            f"{p('open')} as open, {p('high')} as high, {p('low')} as low, {p('close')} as close, volume, "
            "close*adj_factor as adj_close, case when close = 0 or close is null then 1e0 else "
            f"(close*adj_factor)/close end as adj_factor, 'vendor' as source, {year} as year, l_orderkey "
            f"from fx_raw_bars {where}")


@register("canonical_columns", duckdb_sql(_std_sql(), "fx_raw_bars"))
def q_canonical_columns(spark, sf):
    return NM.standardize(_vendor_frame(spark, sf), asset_class="stocks", timeframe="D1", source="vendor")


@register("adj_factor", duckdb_sql(
    "select symbol, timestamp, close, close*adj_factor as adj_close, case when close = 0 or close is null then 1e0 "
    "else (close*adj_factor)/close end as adj_factor from fx_raw_bars", "fx_raw_bars"))
def q_adj_factor(spark, sf):
    from .functions.columns import adj_factor
    r = fixture(spark, sf, "fx_raw_bars").select("symbol", "timestamp", "close",
                                                 (F.col("close") * F.col("adj_factor")).alias("adj_close"))
    return r.withColumn("adj_factor", adj_factor("close", "adj_close"))


@register("drop_empty_ohlc", duckdb_sql(_std_sql(where="where l_orderkey % 7 <> 0"), "fx_raw_bars"))
def q_drop_empty_ohlc(spark, sf):
    return NM.standardize(_vendor_frame(spark, sf, empty_rows=True), source="vendor")


@register("numeric_coerce", duckdb_sql(
    "select timestamp, symbol, 'stocks' as asset_class, 'D1' as timeframe, o as open, h as high, l as low, c as close, "
    "volume, close*adj_factor as adj_close, case when c = 0 or c is null then 1e0 else (close*adj_factor)/c end "
    "as adj_factor, 'vendor' as source, cast(year(timestamp) as int) as year, l_orderkey from (select *, "
    + ", ".join(f"case when l_orderkey % 13 = 0 then null else {c} end as {c[0]}" for c in ("open", "high", "low",
                                                                                           "close")) +
    " from fx_raw_bars) t", "fx_raw_bars"))
def q_numeric_coerce(spark, sf):
    return NM.standardize(_vendor_frame(spark, sf, text=True), source="vendor")


@register("utc_normalize", duckdb_sql(_std_sql(
    ts="((timestamp AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC')"), "fx_raw_bars"))
def q_utc_normalize(spark, sf):
    return NM.standardize(_vendor_frame(spark, sf), source="vendor", source_tz="America/New_York")


# ------------------------------------------------------------------ files: K1, K2, S1, S7, S9, S10
import uuid as _uuid  # noqa: E402

from .schemas import PARTITION_COLUMNS, SYMBOL_BUCKET  # noqa: E402
from .session import shared_dir  # noqa: E402
from .sources import csv_sources as CS  # noqa: E402
from .sources import json_sources as JS  # noqa: E402
from .sources import lake as LK  # noqa: E402
from .sources import versioned as VL  # noqa: E402


def _scratch(spark, what: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return shared_dir(spark, f"marketlake-scratch/{what}-{_uuid.uuid4().hex[:12]}")


def _lake_rows(raw):
    return raw.withColumn("adj_close", F.col("close") * F.col("adj_factor")).select(
        "timestamp", "symbol", "asset_class", "timeframe", "open", "high", "low", "close", "volume", "adj_close",
        "adj_factor", "source", "year")


_LAKE_SQL = ("select timestamp, open, high, low, close, volume, close*adj_factor as adj_close, adj_factor, source, "
             "asset_class, timeframe, symbol, year from fx_raw_bars")


@register("lake_roundtrip", duckdb_sql(_LAKE_SQL, "fx_raw_bars"))
def q_lake_roundtrip(spark, sf):
    root = _scratch(spark, "lake")
    LK.write_bars(_lake_rows(fixture(spark, sf, "fx_raw_bars")), root, mode="overwrite")
    return LK.scan_bars(spark, root)


_DRIFTED = "timestamp, symbol, asset_class, timeframe, open, high, low, close, volume, source, year"


@register("ohlcv_drifted_lake", duckdb_sql(
    "select timestamp, symbol, asset_class, timeframe, open, high, low, close, volume, close as adj_close, source "
    "from fx_bars", "fx_bars"))
def q_ohlcv_drifted_lake(spark, sf):
    """S3: a lake whose files lack both adjustment columns, read adjusted."""
    root = _scratch(spark, "lake")
    rows = fixture(spark, sf, "fx_bars").select(*_DRIFTED.split(", ")).withColumn(SYMBOL_BUCKET, VL.bucket_of("symbol"))
    LK.ranged_writer(rows, [*PARTITION_COLUMNS, "symbol", "timestamp"]).partitionBy(*PARTITION_COLUMNS).parquet(root)
    return B.get_ohlcv(LK.scan_bars(spark, root), None, "D1", adjusted=True).select(
        "timestamp", "symbol", "asset_class", "timeframe", "open", "high", "low", "close", "volume", "adj_close", "source")


@register("drifted_extras", duckdb_sql(
    "select timestamp, symbol, asset_class, timeframe, open, high, low, close, volume, close*adj_factor as adj_close, adj_factor, source, "
    "case when symbol like '%1' then cast(l_linenumber as double) when symbol like '%2' then null else l_extendedprice end as trades, "
    "case when symbol like '%2' then concat('p', cast(l_partkey as varchar)) end as venue from fx_bars", "fx_bars"))
def q_drifted_extras(spark, sf):
    """S3: three layouts (trades as a whole number, as a fraction, and a text column instead); nobody names the extras."""
    rows = fixture(spark, sf, "fx_bars")
    base = _lake_rows(rows.withColumn("asset_class", F.lit("stocks"))).columns
    rows = rows.withColumn("adj_close", F.col("close") * F.col("adj_factor"))
    lake = VL.VersionedLake(spark, _scratch(spark, "extras-lake"))
    one, two = F.col("symbol").like("%1"), F.col("symbol").like("%2")
    lake.append(rows.where(one).select(*base, F.col("l_linenumber").cast("int").alias("trades")))
    lake.append(rows.where(two).select(*base, F.concat(F.lit("p"), "l_partkey").alias("venue")))
    lake.append(rows.where(~one & ~two).select(*base, F.col("l_extendedprice").alias("trades")))
    return B.get_ohlcv(LK.scan_bars(spark, lake.root), None, "D1", adjusted="factor", extras=True)


_CLASSES = ("case when symbol like '%1' then null when symbol like '%2' then 'forex' else 'stocks' end")


@register("rewrite_lake", duckdb_sql(
    f"select * from (select timestamp, symbol, {_CLASSES} as asset_class, close from fx_bars) b where asset_class = 'forex' "
    "or symbol in (select symbol from fx_universe)", "fx_bars", "fx_universe"))
def q_rewrite_lake(spark, sf):
    """K3 with series that have no asset class."""
    rows = _lake_rows(fixture(spark, sf, "fx_bars").withColumn("asset_class", F.expr(_CLASSES)))
    return LK.rewrite_lake(rows, fixture(spark, sf, "fx_universe"), _scratch(spark, "lake")).select(
        "timestamp", "symbol", "asset_class", "close")


@register("replace_series", duckdb_sql(
    f"select * from ({_LAKE_SQL}) a where source = 'vendor_a' union all select * from ({_LAKE_SQL}) b where "
    "source = 'vendor_b' and not exists (select 1 from fx_raw_bars r where r.source = 'vendor_a' and r.year < 1996 and "
    "r.symbol = b.symbol)", "fx_raw_bars").replace("a where source = 'vendor_a'", "a where source = 'vendor_a' and year < 1996"))
def q_replace_series(spark, sf):
    root = _scratch(spark, "lake")
    rows = _lake_rows(fixture(spark, sf, "fx_raw_bars"))
    LK.write_bars(rows.filter(F.col("source") == "vendor_b"), root, mode="overwrite")
    LK.replace_series(rows.filter((F.col("source") == "vendor_a") & (F.col("year") < 1996)), root)  # their other years go
    return LK.scan_bars(spark, root)


@register("rewrite_universe", duckdb_sql(
    f"select * from ({_LAKE_SQL}) b where symbol in (select symbol from fx_universe)", "fx_raw_bars", "fx_universe"))
def q_rewrite_universe(spark, sf):
    """K3 in place, as one commit: the universe prunes the symbol folders of the lake that is rewritten."""
    lake = VL.VersionedLake(spark, _scratch(spark, "lake"))
    lake.append(_lake_rows(fixture(spark, sf, "fx_raw_bars")))
    lake.keep_universe(fixture(spark, sf, "fx_universe"))
    return LK.scan_bars(spark, lake.root)


_PAGE = 5_000


def _mt5_landing(spark, sf) -> str:
    """Platform exports of the minute bars: click/error/signup as tab files with a
    <DATE> <TIME> header named SYM_M1, the others header-less comma files named SYM1. A file
    holds at most _PAGE consecutive events, so more events are more files and more tasks."""
    m = fixture(spark, sf, "fx_minute")
    hdr = m.filter(F.col("symbol").isin("click", "error", "signup"))
    txt = (lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")))
    a = hdr.select(F.concat(F.col("symbol"), F.lit("_M1")).alias("fname"),
                   F.floor(F.col("event_id") / _PAGE).cast("string").alias("part"), F.lit(1).alias("k"), "timestamp", "event_id",
                   F.concat_ws("\t", F.date_format("timestamp", "yyyy.MM.dd"), F.date_format("timestamp", "HH:mm"),
                               txt("open"), txt("high"), txt("low"), txt("close"), txt("volume"), txt("event_id"),
                               F.lit("0")).alias("value"))
    header = (a.select("fname", "part").distinct()
              .select("fname", "part", F.lit(0).alias("k"), F.lit(None).cast("timestamp_ntz").alias("timestamp"),
                      F.lit(None).cast("long").alias("event_id"),
                      F.lit("<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>").alias("value")))
    b = (m.filter(~F.col("symbol").isin("click", "error", "signup"))
         .select(F.concat(F.col("symbol"), F.lit("1")).alias("fname"), F.floor(F.col("event_id") / _PAGE).cast("string").alias("part"),
                 F.lit(1).alias("k"), "timestamp", "event_id",
                 F.concat_ws(",", F.date_format("timestamp", "yyyy.MM.dd HH:mm:ss"), txt("open"), txt("high"),
                             txt("low"), txt("close"), txt("volume"), txt("event_id"),
                             (F.col("event_id") % 3).cast("string")).alias("value")))
    root = _scratch(spark, "mt5")
    (a.unionByName(header).unionByName(b).repartition("fname", "part")
     .sortWithinPartitions("fname", "part", "k", "timestamp", "event_id")
     .select("fname", "part", "value").write.partitionBy("fname", "part").text(root))
    return root


@register("platform_export", duckdb_sql(
    "select ((timestamp AT TIME ZONE 'Europe/Athens') AT TIME ZONE 'UTC') as timestamp, symbol, 'forex' as asset_class, "
    "'1m' as timeframe, open, high, low, close, volume, close as adj_close, case when close = 0 or close is null "
    "then 1e0 else close/close end as adj_factor, 'metatrader5' as source, "
    "cast(year((timestamp AT TIME ZONE 'Europe/Athens') AT TIME ZONE 'UTC') as int) as year, "
    "cast(event_id as double) as volume_real, case when symbol in ('click','error','signup') then 0e0 else "
    "cast(event_id % 3 as double) end as spread from fx_minute", "fx_minute"))
def q_platform_export(spark, sf):
    root = _mt5_landing(spark, sf)
    return CS.read_platform_export(spark, root, name_column="fname")


def _day(ts):
    return F.date_trunc("day", ts).cast("timestamp_ntz")


@register("json_bars", duckdb_sql(
    "select timestamp, symbol, 'stocks' as asset_class, '1m' as timeframe, open, high, low, close, volume, "
    "close as adj_close, case when close = 0 or close is null then 1e0 else close/close end as adj_factor, "
    "'alpaca' as source, cast(year(timestamp) as int) as year, cast(event_id as double) as n, open as vw "
    "from fx_minute", "fx_minute"))
def q_json_bars(spark, sf):
    m = fixture(spark, sf, "fx_minute")
    bar = F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.col("open").alias("o"),
                   F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
                   F.col("volume").alias("v"), F.col("event_id").cast("double").alias("n"), F.col("open").alias("vw"))
    # a page holds at most _PAGE consecutive events of a symbol-day, as a vendor's pages are bounded
    pages = (m.groupBy("symbol", _day(F.col("timestamp")).alias("day"), F.floor(F.col("event_id") / _PAGE).alias("page"))
             .agg(F.collect_list(bar).alias("bars"))
             .select(F.to_json(F.struct(F.create_map("symbol", "bars").alias("bars"),
                                        F.lit(None).cast("string").alias("next_page_token"))).alias("value")))
    root = _scratch(spark, "jsonbars")
    pages.write.text(root)
    return JS.read_json_bars(spark, root)


@register("klines", duckdb_sql(
    "select timestamp, symbol, 'crypto' as asset_class, '1m' as timeframe, open, high, low, close, volume, "
    "close as adj_close, case when close = 0 or close is null then 1e0 else close/close end as adj_factor, "
    "'binance' as source, cast(year(timestamp) as int) as year from fx_minute where timestamp <= "
    "date_trunc('day', timestamp) + interval 20 hour", "fx_minute"))
def q_klines(spark, sf):
    m = fixture(spark, sf, "fx_minute")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ms = F.timestamp_diff("MILLISECOND", epoch, F.col("timestamp"))
    k = F.array(ms.cast("double"), "open", "high", "low", "close", "volume")
    pages = (m.groupBy("symbol", _day(F.col("timestamp")).alias("day"), F.floor(F.col("event_id") / _PAGE).alias("page"))
             .agg(F.collect_list(k).alias("klines"))
             .select(F.to_json(F.struct("symbol", (F.timestamp_diff("MILLISECOND", epoch, F.col("day"))
                                                  + F.lit(20 * 3600 * 1000)).alias("end_ms"), "klines")).alias("value")))
    root = _scratch(spark, "klines")
    pages.write.text(root)
    return JS.read_klines(spark, root)


# ------------------------------------------------------------------ E2, E7, W6, L2, L3
from .plans import query as QY  # noqa: E402

_ML_E1 = ("select * from (select *, row_number() over (partition by symbol, timeframe, timestamp order by "
          + _E1_ORDER + ") as rn from (select timestamp, symbol, asset_class, timeframe, open, high, low, close, "
          "volume, adj_close, adj_factor, source from ml where timeframe = '1m') p) t where rn = 1")


@register("chart_records", duckdb_sql(
    f"with ml as ({_MINUTE_LAKE.replace('{fx_minute}', 'fx_minute')}), e as ({_ML_E1}) select symbol, timeframe, "
    "timestamp, cast(cast(epoch(timestamp) as bigint) as varchar) as time, open*adj_factor as open, "
    "high*adj_factor as high, low*adj_factor as low, close*adj_factor as close, coalesce(volume, 0e0) as value "
    "from e where open*adj_factor is not null and close*adj_factor is not null", "fx_minute"))
def q_chart_records(spark, sf):
    bars = B.get_ohlcv(minute_lake(spark, sf), None, "1m", adjusted=True)
    return B.chart_records(bars)


@register("latest_bar", duckdb_sql(
    f"with e1 as ({_E1_D1}) select symbol, timeframe, timestamp, asset_class, open, high, low, close, volume, "
    "adj_close, source from (select *, row_number() over (partition by symbol, timeframe order by timestamp desc) "
    "as rn from e1) t where rn = 1", "fx_raw_bars"))
def q_latest_bar(spark, sf):
    return B.latest_bar(B.get_ohlcv(fixture(spark, sf, "fx_raw_bars"), None, "D1"))


@register("top_symbols", duckdb_sql(
    "select symbol, timeframe, count(*) as bars, min(timestamp) as start_date, max(timestamp) as end_date "
    "from fx_raw_bars where asset_class = 'stocks' and timeframe = 'D1' group by symbol, timeframe "
    "order by bars desc, symbol limit 10", "fx_raw_bars"))
def q_top_symbols(spark, sf):
    return B.top_symbols(fixture(spark, sf, "fx_raw_bars"), 10)


@register("last_n_bars", duckdb_sql(
    f"with e1 as ({_E1_D1}) select * from e1 order by timestamp desc, symbol limit 100", "fx_raw_bars"))
def q_last_n_bars(spark, sf):
    return B.last_n_bars(B.get_ohlcv(fixture(spark, sf, "fx_raw_bars"), None, "D1"), 100)


@register("sql_adhoc", duckdb_sql(
    "select symbol, year, max(high) as top, min(low) as bottom, cast(sum(case when close is null then 1 else 0 end) as bigint) as no_close "
    "from fx_raw_bars group by symbol, year", "fx_raw_bars"))
def q_sql_adhoc(spark, sf):
    return QY.sql(spark, "SELECT symbol, year, max(high) AS top, min(low) AS bottom, count_if(close IS NULL) AS no_close "
                         "FROM ohlcv GROUP BY symbol, year", {"ohlcv": fixture(spark, sf, "fx_raw_bars")})


@register("resample_all", duckdb_sql(
    f"with ml as ({_ML}) " + " union all ".join(_resample_body(tf, m) for tf, m in RS.RESAMPLE_MINUTES.items()),
    "fx_minute"))
def q_resample_all(spark, sf):
    """A3 for all three targets in one job (15m partials rolled up to 1h and 4h)."""
    return RS.resample(minute_lake(spark, sf), ["15m", "1h", "4h"], tie=["event_id"])


# ------------------------------------------------------------------ E11 / A6 / J12
_UPDATE_CUT = "1996-01-01"


@register("update_lake", duckdb_sql(
    "select symbol, timeframe, asset_class, " + _FMT.format(c="min(timestamp)") + " as start_date, "
    + _FMT.format(c="max(timestamp)") + " as end_date, count(*) as rows_count, "
    "100e0*sum(case when close is null then 1 else 0 end)/count(*) as nulls_pct, "
    "greatest(0e0, 100e0 - (100e0*sum(case when close is null then 1 else 0 end)/count(*))*2e0) as quality_score, "
    "array_to_string(list_sort(list_distinct(list(source))), '+') as source, "
    f"{_NOW_SQL} as last_updated from fx_raw_bars where timestamp <= {_NOW_SQL} and symbol in (select symbol "
    f"from fx_raw_bars where timestamp < timestamp '{_UPDATE_CUT} 00:00:00') group by symbol, timeframe, asset_class",
    "fx_raw_bars"))
def q_update_lake(spark, sf):
    """A lake holding the bars before the cut, its stored catalog, and a landing of
    every bar; one update run appends each series' rows after its end up to "now" and
    refreshes the catalog of the series that received rows."""
    rows = _lake_rows(fixture(spark, sf, "fx_raw_bars"))
    root = _scratch(spark, "update-lake")
    VL.VersionedLake(spark, root).append(rows.filter(F.col("timestamp") < F.lit(_UPDATE_CUT).cast("timestamp_ntz")))
    cat_path = _scratch(spark, "update-catalog")
    LK.write_table(CT.refresh_catalog(LK.scan_bars(spark, root), now=NOW), cat_path)
    catalog = spark.read.parquet(cat_path)
    new_catalog, _log = PL.apply_updates(catalog, rows, root, now=NOW)
    return new_catalog


@register("catalog_state_merge", ORACLES["refresh_catalog"])
def q_catalog_state_merge(spark, sf):
    """C5 without a rescan: three batches (by vendor and date) are committed, and the catalog comes from the merged state."""
    rows = _lake_rows(fixture(spark, sf, "fx_raw_bars"))
    early = F.col("timestamp") < F.lit(_UPDATE_CUT).cast("timestamp_ntz")
    lake = VL.VersionedLake(spark, _scratch(spark, "state-lake"))
    for batch in (rows.where(early), rows.where(~early & (F.col("source") == "vendor_a")), rows.where(~early & (F.col("source") != "vendor_a"))):
        lake.append(batch)
    return CT.catalog_of_state(lake.state(), now=NOW)


@register("land_replayed", duckdb_sql(
    f"select * from ({_LAKE_SQL}) b where timestamp <= {_NOW_SQL}", "fx_raw_bars"))
def q_land_replayed(spark, sf):
    """X-S1 and E11 exactly once: a stream's batch is committed twice under one number, and the update run that lands all
    bars after it is run twice with the same catalog; the lake holds every bar once."""
    rows = _lake_rows(fixture(spark, sf, "fx_raw_bars")).where(F.col("timestamp") <= F.lit(NOW).cast("timestamp_ntz"))
    # the bars before the cut of every symbol, and its first bar where it has none before
    early = rows.join(rows.groupBy("symbol").agg(F.min("timestamp").alias("first")), "symbol").where(
        (F.col("timestamp") < F.lit(_UPDATE_CUT).cast("timestamp_ntz")) | (F.col("timestamp") == F.col("first"))).drop("first")
    lake = VL.VersionedLake(spark, _scratch(spark, "replay-lake"))
    for _ in range(2):
        lake.append(early, "stream-fixture", 0)
    catalog = CT.catalog_of_state(lake.state(lake.manifest().version), now=NOW)
    for _ in range(2):
        PL.apply_updates(catalog, rows, lake.root, now=NOW)
    return LK.scan_bars(spark, lake.root)


@register("macro_catalog", duckdb_sql(
    "select symbol, 'D1' as timeframe, 'macro' as asset_class, strftime(min(timestamp), '%Y-%m-%d') as start_date, "
    "strftime(max(timestamp), '%Y-%m-%d') as end_date, count(*) as rows_count, "
    "100e0*sum(case when value is null then 1 else 0 end)/count(*) as nulls_pct, "
    "100e0 - 100e0*sum(case when value is null then 1 else 0 end)/count(*) as quality_score, 'fred' as source, "
    f"{_NOW_SQL} as last_updated from fx_macro where value is not null group by symbol", "fx_macro"))
def q_macro_catalog(spark, sf):
    return CT.macro_catalog(RD.macro_series(fixture(spark, sf, "fx_macro")), now=NOW)


@register("asset_class_lookup", duckdb_sql(
    "select r.symbol, r.timestamp, r.close, c.asset_class from fx_raw_bars r left join (select upper(symbol) as symbol, "
    "min(asset_class) as asset_class from fx_catalog group by upper(symbol)) c on upper(r.symbol) = c.symbol",
    "fx_raw_bars", "fx_catalog"))
def q_asset_class_lookup(spark, sf):
    bars = fixture(spark, sf, "fx_raw_bars").select("symbol", "timestamp", "close")
    return CT.with_asset_class(bars, fixture(spark, sf, "fx_catalog"))


# ------------------------------------------------------------------ streaming A3 (extension)
from .streaming import bars_stream as ST  # noqa: E402

_STREAM_DELAY_MINUTES = 10


@register("resample_stream_15m", duckdb_sql(
    f"with ml as ({_ML}), b as ({_resample_body('15m', 15)}) select * from b where timestamp + interval 15 minute "
    f"<= (select max(timestamp) from ml) - interval {_STREAM_DELAY_MINUTES} minute", "fx_minute"))
def q_resample_stream_15m(spark, sf):
    """A3 as a Structured Streaming job: the minute bars are landed as Parquet files, the
    stream (watermark 10 minutes, append mode, availableNow) writes the bars it can
    finalise; those are the batch bars whose end the watermark has passed."""
    minute = minute_lake(spark, sf)
    landed = _scratch(spark, "stream-in")
    minute.write.mode("overwrite").parquet(landed)
    stream = spark.readStream.schema(minute.schema).parquet(landed)
    out = _scratch(spark, "stream-out")
    q = ST.write_stream(ST.resample_stream(stream, "15m", delay=f"{_STREAM_DELAY_MINUTES} minutes", tie=["event_id"]),
                        out, name=f"resample-15m-{_uuid.uuid4().hex[:12]}")
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(out).select(*RS.resample(minute, ["15m"]).columns)


# ------------------------------------------------------------------ E5 view + SQL
_E5_SQL = ("SELECT symbol, COUNT(*) AS bars, ROUND(AVG(pe_ratio), 6) AS avg_pe_ratio, MAX(realized_vol_30d) AS max_vol, "
           "MIN(timestamp) AS first_bar, MAX(timestamp) AS last_bar FROM ohlcv_consolidated "
           "WHERE asset_class = 'stocks' AND timeframe = 'D1' GROUP BY symbol")


@register("consolidated_sql", duckdb_sql(
    _E4_J + "select j.symbol, count(*) as bars, round(avg(pe_ratio), 6) as avg_pe_ratio, max(realized_vol_30d) as max_vol, "
    "min(j.timestamp) as first_bar, max(j.timestamp) as last_bar from j group by j.symbol", *_E4_FX))
def q_consolidated_sql(spark, sf):
    """E5 + E2: SQL over the ``ohlcv_consolidated`` view of all symbols."""
    CO.register_consolidated_view(
        fixture(spark, sf, "fx_raw_bars"), volatility=fixture(spark, sf, "fx_vol"),
        fundamentals=fixture(spark, sf, "fx_fund"), financials=fixture(spark, sf, "fx_fin"),
        metadata=fixture(spark, sf, "fx_meta"), timeframe="D1", adjusted=True)
    return QY.sql(spark, _E5_SQL)


# ------------------------------------------------------------------ symbol rules: N10-N14, N20, N21
from pyspark.sql import types as T  # noqa: E402

from .functions import columns as SC  # noqa: E402

_SYMBOLS = ("select c_custkey, case c_custkey % 6 when 0 then concat('EU', cast(c_custkey as {s}), '-X') "
            "when 1 then concat('US', cast(c_custkey as {s}), '=X') when 2 then concat('^I', cast(c_custkey as {s})) "
            "when 3 then concat('c', cast(c_custkey as {s}), 'USDT') when 4 then concat('D', cast(c_custkey as {s}), '-BTC') "
            "else concat(' T', cast(c_custkey as {s}), ' US Equity') end as symbol from {t}")
_PAIR_SQL = "case when contains(p, '/') then p " + " ".join(
    f"when ends_with(p, '{q}') then concat(left(p, length(p) - {len(q)}), '/{q}')" for q in SC.CRYPTO_QUOTES) + " else p end"


@register("symbol_rules", (
    f"with s as ({_SYMBOLS.format(s='varchar', t='customer')}) select c_custkey, "
    "regexp_replace(symbol, '(-X|=X)$', '') as base, case when symbol like '%-X' or symbol like '%=X' then 'forex' when symbol "
    "like '^%' then 'indices' else 'stocks' end as asset_class, case when symbol like '%-X' then concat(symbol, '=X') else symbol "
    f"end as vendor, {_PAIR_SQL} as pair, upper(replace(replace(symbol, '/', ''), '-', '')) as stored, "
    "trim(replace(symbol, ' US Equity', '')) as ticker from (select *, replace(symbol, '-', '/') as p from s) t"))
def q_symbol_rules(spark, sf):
    d = spark.sql(_SYMBOLS.replace("{s}", "string"), t=fixture(spark, sf, "customer"))
    return d.withColumn("asset_class", SC.symbol_asset_class()).select(
        "c_custkey", SC.forex_base_symbol().alias("base"), "asset_class", SC.vendor_symbol().alias("vendor"),
        SC.crypto_pair().alias("pair"), SC.crypto_storage_symbol().alias("stored"), SC.clean_ticker("symbol").alias("ticker"))


@register("vendor_intervals", (
    "with t as (select o_orderkey, case o_orderkey % 4 when 0 then '1m' when 1 then '15m' when 2 then '1h' else 'D1' end as tf "
    "from orders) select o_orderkey, tf, case tf when 'D1' then '1Day' when '1h' then '1Hour' when '1m' then '1Min' else '15Min' end "
    "as interval, tf as back from t"))
def q_vendor_intervals(spark, sf):
    d = fixture(spark, sf, "orders").select("o_orderkey", F.expr(
        "case o_orderkey % 4 when 0 then '1m' when 1 then '15m' when 2 then '1h' else 'D1' end").alias("tf"))
    return d.withColumn("interval", SC.timeframe_to_vendor("alpaca", "tf")).withColumn(
        "back", SC.vendor_to_timeframe("alpaca"))


@register("candles_and_tiers", duckdb_sql(
    "select symbol, cast(sum(case when close >= open then 1 else 0 end) as bigint) as up, case when sc >= 90 then 'high' when sc >= 70 then "
    "'medium' else 'low' end as tier from (select *, greatest(0e0, 100e0 - 2e0*(100e0*sum(case when close is null then 1 else 0 "
    "end) over (partition by symbol)/count(*) over (partition by symbol))) as sc from fx_bars) t group by symbol, sc", "fx_bars"))
def q_candles_and_tiers(spark, sf):
    bars = fixture(spark, sf, "fx_bars")
    up = bars.groupBy("symbol").agg(F.sum(F.when(SC.candle_up(), 1).otherwise(0)).alias("up"))
    tiers = QA.catalog_stats(bars).select("symbol", SC.quality_tier().alias("tier"))
    return up.join(tiers, "symbol")


# ------------------------------------------------------------------ vendor tables: S16-S18, N6b, N25, S19, S4
from .sources import export as EX  # noqa: E402


@register("vendor_prices", duckdb_sql(
    "select timestamp, symbol, 'stocks' as asset_class, 'D1' as timeframe, open, high, low, close, volume, "
    "close*(case when close > 0 then close*adj_factor/close else 1e0 end) as adj_close, "
    "case when close > 0 then close*adj_factor/close else 1e0 end as adj_factor, 'vendor_merged' as source, year "
    "from fx_bars", "fx_bars"))
def q_vendor_prices(spark, sf):
    raw = fixture(spark, sf, "fx_bars").select(
        F.date_format("timestamp", "yyyy-MM-dd").alias("Date"), F.concat("symbol", F.lit(" US Equity")).alias("Ticker"),
        *[F.col(c).alias(c.capitalize()) for c in ("open", "high", "low", "close", "volume")],
        (F.col("close") * F.col("adj_factor")).alias("Adj_Close"))
    return CS.vendor_prices(raw)


@register("vendor_fundamentals", duckdb_sql(
    "select symbol, timestamp, pe_ratio, price_to_book, sales from fx_fund", "fx_fund"))
def q_vendor_fundamentals(spark, sf):
    raw = fixture(spark, sf, "fx_fund").select(
        F.concat("symbol", F.lit(" US Equity")).alias("Ticker"), F.date_format("timestamp", "yyyy-MM-dd").alias("DATE"),
        F.col("pe_ratio").cast("string").alias("PE_Ratio"), F.col("price_to_book").cast("string").alias("Price_to_Book"),
        F.col("sales").cast("string").alias("Sales"))
    return RD.vendor_fundamentals(raw)


@register("vendor_volatility", duckdb_sql("select symbol, timestamp, realized_vol_30d from fx_vol", "fx_vol"))
def q_vendor_volatility(spark, sf):
    raw = fixture(spark, sf, "fx_vol").select(
        F.concat(F.lit(" "), "symbol", F.lit(" US Equity")).alias("Ticker"), F.date_format("timestamp", "yyyy-MM-dd").alias("DATE"),
        F.col("realized_vol_30d").cast("string").alias("Realized_Vol_30D"))
    return RD.vendor_volatility(raw)


@register("option_chain", "select concat('SUP', lpad(cast(l_suppkey as varchar), 6, '0')) as symbol, l_shipdate as timestamp, "
          "l_shipdate + interval 30 day as expiration, l_extendedprice as strike, l_discount as implied_volatility from lineitem")
def q_option_chain(spark, sf):
    raw = fixture(spark, sf, "lineitem").select(
        F.concat(F.lit("SUP"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("act_symbol"), F.col("l_shipdate").alias("date"),
        (F.col("l_shipdate") + F.expr("INTERVAL 30 DAY")).alias("expiration"), F.col("l_extendedprice").alias("strike"), F.col("l_discount").alias("implied_volatility"))
    return RD.option_chain(raw)


@register("companies_csv", duckdb_sql(
    "select upper(symbol) as symbol, exchange, longname, sector, industry, marketcap from fx_meta", "fx_meta"))
def q_companies_csv(spark, sf):
    """Written as CSV with the vendor's headers and read back."""
    path = _scratch(spark, "companies")
    meta = fixture(spark, sf, "fx_meta")
    EX.write_csv(meta.select(
        F.lower("symbol").alias("Symbol"), F.col("exchange").alias("Exchange"), F.col("longname").alias("Shortname"),
        F.col("longname").alias("Longname"), F.col("sector").alias("Sector"), F.col("industry").alias("Industry"),
        F.col("marketcap").alias("Marketcap"), F.lit("0.5").alias("Weight"), F.lit('a "quoted", text').alias("Longbusinesssummary")), path)
    return CS.read_companies(spark, path).select("symbol", "exchange", "longname", "sector", "industry", "marketcap")


@register("bulk_csv", duckdb_sql(
    "select timestamp, symbol, open, high, low, close, volume, close*adj_factor as adj_close from fx_bars where not "
    "(open is null and high is null and low is null and close is null)", "fx_bars"))
def q_bulk_csv(spark, sf):
    """Two layouts of one wide CSV (other column order, an extra column) in one folder."""
    path = _scratch(spark, "bulk")
    rows = fixture(spark, sf, "fx_bars").select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("Date"), "symbol", "open", "high", "low", "close", "volume",
        (F.col("close") * F.col("adj_factor")).alias("Adj Close"))
    old = F.col("Date") < "1996"
    EX.write_csv(rows.filter(old), path)
    (rows.filter(~old).select("symbol", "close", "Adj Close", "open", "low", "high", "volume", "Date", F.lit("n").alias("note"))
     .write.mode("append").option("header", True).csv(path))
    return CS.read_bulk_csv(spark, path, source_tz="UTC").select(
        "timestamp", "symbol", "open", "high", "low", "close", "volume", "adj_close")


# ------------------------------------------------------------------ entries: S20, S21, F2, C2, C4, L3, L5, L6, F9, P3, P7
@register("macro_range", duckdb_sql(
    "select cast(epoch(timestamp) as bigint) as time, coalesce(value, 0e0) as value from fx_macro where symbol = 'click'", "fx_macro"))
def q_macro_range(spark, sf):
    return RD.macro(fixture(spark, sf, "fx_macro"), "CLICK")


@register("financials_range", duckdb_sql(
    "select * from fx_fin where symbol = 'SUP000003' and report_date >= timestamp '1993-01-01' and report_date <= timestamp "
    "'1996-01-01'", "fx_fin"))
def q_financials_range(spark, sf):
    return RD.financials_of(fixture(spark, sf, "fx_fin"), "sup000003", "1993-01-01", "1996-01-01")


@register("metadata_replace", duckdb_sql(
    "select symbol, longname, sector, cast(null as double) as marketcap from fx_meta where right(symbol, 1) in ('0', '2', '4') "
    "union all select symbol, longname, sector, marketcap from fx_meta where right(symbol, 1) not in ('0', '2', '4')", "fx_meta"))
def q_metadata_replace(spark, sf):
    meta = fixture(spark, sf, "fx_meta").select("symbol", "longname", "sector", "marketcap")
    new = meta.filter(F.right("symbol", F.lit(1)).isin("0", "2", "4")).withColumn("marketcap", F.lit(None).cast("double"))
    return CT.upsert_metadata(meta, new, replace=True)


@register("top_market_caps", duckdb_sql(
    "select symbol, sector, marketcap from fx_meta where lower(sector) = 'asia' order by marketcap desc, symbol limit 10", "fx_meta"))
def q_top_market_caps(spark, sf):
    return CT.top_by_market_cap(fixture(spark, sf, "fx_meta"), 10, "Asia").select("symbol", "sector", "marketcap")


@register("catalog_lists", duckdb_sql(
    "select distinct 'symbol' as kind, symbol as name from fx_catalog where asset_class = 'stocks' union all "
    "select distinct 'timeframe', timeframe from fx_catalog", "fx_catalog"))
def q_catalog_lists(spark, sf):
    catalog = fixture(spark, sf, "fx_catalog")
    return B.symbols_of_class(catalog, "stocks").select(F.lit("symbol").alias("kind"), F.col("symbol").alias("name")).unionByName(
        CT.timeframes(catalog).select(F.lit("timeframe").alias("kind"), F.col("timeframe").alias("name")))


@register("plan_daily", duckdb_sql(
    "select symbol, case when symbol like '%7' then '" + PL.DEFAULT_D1_START + "' else strftime(end_date + interval 1 day, '%Y-%m-%d') end "
    f"as start, strftime({_NOW_SQL}, '%Y-%m-%d') as \"end\", case when (case when symbol like '%7' then timestamp '" + PL.DEFAULT_D1_START + f"' "
    f"else end_date + interval 1 day end) >= {_NOW_SQL} "
    "then 'up_to_date' else 'update' end as status from fx_catalog where rows_count > 0", "fx_catalog"))
def q_plan_daily(spark, sf):
    catalog = fixture(spark, sf, "fx_catalog").withColumn("end_date", F.when(F.col("symbol").like("%7"), "N/A").otherwise(
        F.date_format("end_date", "yyyy-MM-dd")))
    return PL.plan_daily_stocks(catalog, now=NOW)


@register("resample_lake", duckdb_sql(
    f"with ml as ({_ML}) select symbol, timeframe, count(*) as rows_count, cast(sum(case when close is null then 1 else 0 end) as bigint) as "
    f"null_closes from (select symbol, timeframe, close from ml union all select symbol, timeframe, close from "
    f"({_resample_body('15m', 15)}) a union all select symbol, timeframe, close from ({_resample_body('1h', 60)}) b union all "
    f"select symbol, timeframe, close from ({_resample_body('4h', 240)}) c) l group by symbol, timeframe", "fx_minute"))
def q_resample_lake(spark, sf):
    """P7 → A3 → K2 → catalog statistics: the lake's minute series in one job, written back."""
    root = _scratch(spark, "lake")
    minute = minute_lake(spark, sf)
    LK.write_bars(minute.withColumn("year", F.year("timestamp")), root, mode="overwrite")
    lake = LK.scan_bars(spark, root, extra_schema=T.StructType([T.StructField("event_id", minute.schema["event_id"].dataType)]))
    work = PL.resample_work_list(QA.catalog_stats(lake).withColumn("source", F.lit("lake")))
    bars = RS.resample(lake.filter(F.col("timeframe") == "1m").join(work, "symbol", "left_semi"), tie=["event_id"])
    LK.replace_series(bars, root)
    return QA.catalog_stats(LK.scan_bars(spark, root)).select(F.lower("symbol").alias("symbol"), "timeframe", "rows_count", "null_closes")


# ------------------------------------------------------------------ J4 with five statements, exports, per-symbol tables, XBRL
_FIVE = {
    "income": "act_symbol, date, period, sales, net_income, sales/1e6 as diluted_net_eps",
    "assets": "act_symbol, date, period, sales*3e0 as total_assets, sales*0.4e0 as cash_and_equivalents",
    "liabilities": "act_symbol, date, period, sales*2e0 as total_liabilities, sales*0.7e0 as long_term_debt",
    "equity": "act_symbol, date, period, sales as total_equity",
    "cash_flow": "act_symbol, date, period, sales*0.2e0 as net_cash_from_operating_activities, -sales*0.05e0 as "
                 "property_and_equipment, sales*0.01e0 as net_change_in_cash_and_equivalents",
}
_FIVE_WHERE = {"income": "true", "assets": "sales > 100000", "liabilities": "sales > 120000", "equity": "sales > 90000",
               "cash_flow": "sales > 50000"}


@register("statements_five", duckdb_sql(
    "select i.act_symbol as symbol, i.date as report_date, i.period as fiscal_period, i.sales as revenue, i.net_income, "
    "i.sales/1e6 as eps, a.sales*3e0 as total_assets, l.sales*2e0 as total_liabilities, e.sales as equity, a.sales*0.4e0 as cash, "
    "l.sales*0.7e0 as total_debt, c.sales*0.01e0 as net_change_cash, c.sales*0.2e0 as operating_cf, -c.sales*0.05e0 as capex, "
    "c.sales*0.2e0 - coalesce(abs(-c.sales*0.05e0), 0e0) as free_cash_flow from fx_income i " + " ".join(
        f"left join (select * from fx_income where {w}) {t[0]} on i.act_symbol = {t[0]}.act_symbol and i.date = {t[0]}.date and "
        f"i.period = {t[0]}.period" for t, w in _FIVE_WHERE.items() if t != "income"), "fx_income"))
def q_statements_five(spark, sf):
    income = fixture(spark, sf, "fx_income")
    tables = [income.filter(_FIVE_WHERE[t]).selectExpr(*[x.strip() for x in c.split(", ")]) for t, c in _FIVE.items()]
    return FD.statements_join(tables[0], tables[1:])


@register("statement_export", duckdb_sql(
    "select strftime(report_date, '%Y-%m-%d') as report_date, symbol, net_income, revenue from fx_fin", "fx_fin"))
def q_statement_export(spark, sf):
    """The income view written as CSV and read back."""
    root = _scratch(spark, "export")
    fin = fixture(spark, sf, "fx_fin")
    paths = EX.export_datasets({k: EX.statement_view(fin, k) for k in ("income", "cashflow")}, root)
    back = CS.read_headed_csv(spark, paths[0])
    return back.select(F.substring("report_date", 1, 10).alias("report_date"), "symbol",
                       F.col("net_income").cast("double").alias("net_income"), F.col("revenue").cast("double").alias("revenue"))


@register("per_symbol_tables", duckdb_sql("select symbol, report_date, revenue, net_income from fx_fin", "fx_fin"))
def q_per_symbol_tables(spark, sf):
    root = _scratch(spark, "financials")
    LK.write_per_symbol(fixture(spark, sf, "fx_fin").select("symbol", "report_date", "revenue", "net_income"), root, ["report_date"])
    return spark.read.schema("report_date timestamp_ntz, revenue double, net_income double, symbol string").parquet(root).select(
        "symbol", "report_date", "revenue", "net_income")


_FACTS2 = ("select concat('SUP', lpad(cast(o_custkey as {s}), 6, '0')) as symbol, case when o_custkey % 3 = 0 then 'dei' when o_orderkey "
           "% 2 = 0 then 'us-gaap' else 'dei' end as taxonomy, case o_orderstatus when 'F' then 'Revenues' when 'O' then 'NetIncomeLoss' "
           "else 'Assets' end as concept, cast(o_orderkey % 2 as int) as unit_pos, case when o_orderkey % 5 = 0 then '8-K' when "
           "o_orderkey % 4 = 0 then '10-K' else '10-Q' end as form, date_trunc('quarter', o_orderdate) as end_date, "
           "o_orderkey as pos, o_totalprice as val from {t}")


@register("facts_units", (
    f"with f as ({_FACTS2.format(s='varchar', t='orders')}), r as (select *, case taxonomy when 'us-gaap' then 0 else 1 end as tx, "
    "case concept when 'Revenues' then 'revenue' when 'NetIncomeLoss' then 'net_income' else 'total_assets' end as metric from f), "
    "t as (select *, min(tx) over (partition by symbol) as best_tx from r), a as (select * from t where tx = best_tx and form in "
    "('10-Q', '10-K')), u as (select *, min(unit_pos) over (partition by symbol, metric) as best_unit from a) "
    "select symbol, metric, cast(end_date as timestamp) as end_date, arg_max(val, pos) as val, arg_max(form, pos) as form from u "
    "where unit_pos = best_unit group by symbol, metric, end_date"))
def q_facts_units(spark, sf):
    """X1, X3 with two units per concept and both taxonomies."""
    facts = spark.sql(_FACTS2.replace("{s}", "string"), t=fixture(spark, sf, "orders"))
    return FD.extract_facts(facts).withColumn("end_date", F.col("end_date").cast("timestamp_ntz"))

from . import registered_more  # noqa: E402, F401  (adds its queries)
