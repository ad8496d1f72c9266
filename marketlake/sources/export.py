"""CSV exports (K6-K8, E8): written by Spark, one folder per dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import freed_shuffles

#: A compressed file is read by one task, so it is bounded.
MAX_ROWS_PER_COMPRESSED_FILE = 1_000_000

# fixed values: columns of the exported statement files, in file order (only those present)
INCOME_COLUMNS = ["report_date", "fiscal_period", "symbol", "revenue", "net_income", "eps", "eps_estimate", "actual_eps",
                  "eps_surprise"]
BALANCE_COLUMNS = ["report_date", "fiscal_period", "symbol", "total_assets", "total_liabilities", "equity", "cash",
                   "total_debt"]
CASHFLOW_COLUMNS = ["report_date", "fiscal_period", "symbol", "net_change_cash", "operating_cf", "capex",
                    "free_cash_flow"]


def statement_view(financials: DataFrame, kind: str) -> DataFrame:
    """The income / balance / cashflow subset of the financials that exists."""
    wanted = {"income": INCOME_COLUMNS, "balance": BALANCE_COLUMNS, "cashflow": CASHFLOW_COLUMNS}[kind]
    return financials.select(*[c for c in wanted if c in financials.columns])


def date_window(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    """inclusive date range on any dated table (applied before any action)."""
    if start is not None:
        df = df.filter(F.col(col) >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col(col) <= F.lit(str(end)).cast("timestamp_ntz"))
    return df


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """K6/K8: header, RFC-4180 quoting (quotes doubled), nulls empty, zeros kept (Q21/Q22).
    Written in parallel, one part file per task; with ``compression`` (``gzip``) each file is compressed, in bounded files."""
    with freed_shuffles(df) as rows:
        w = (rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
             .option("nullValue", "").option("emptyValue", "").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"))
        if compression is not None:
            w = (w.option("compression", compression).option("zlib.compress.level", "BEST_SPEED")
                 .option("maxRecordsPerFile", MAX_ROWS_PER_COMPRESSED_FILE))
        w.csv(path)


def export_datasets(datasets: dict[str, DataFrame], root: str, compression: str | None = None) -> list[str]:
    """K7: one CSV folder per selected dataset; returns the written paths. Text of a wide table is several times its
    Parquet: ``compression="gzip"`` packs it, as the reference does with its sets of files."""
    paths = []
    for name, df in datasets.items():
        p = f"{root.rstrip('/')}/{name}"
        write_csv(df, p, compression)
        paths.append(p)
    return paths
