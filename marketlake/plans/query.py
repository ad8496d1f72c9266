"""Ad-hoc SQL over the lake.

``spark.sql`` runs a query lazily; the read-only guard inspects the *parsed* plan via
``EXPLAIN`` (which never runs the statement) and allows only query plans, so DDL/DML
(``DROP``, ``INSERT``, ``CREATE VIEW`` …) is refused while a column named ``update``
is fine. Function calls are held against a list of allowed ones, since some built-in functions run any code.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.lake import register_views, scan_bars
from ..sources.versioned import Files

# parsed-plan roots that are plain queries
QUERY_ROOTS = {
    "Project", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Filter", "Distinct", "Union", "Join",
    "UnresolvedWith", "WithCTE", "CTE", "SubqueryAlias", "Window", "Offset", "Tail", "Intersect", "Except",
    "Generate", "UnresolvedRelation", "LocalRelation", "Pivot", "Unpivot", "Expand", "Sample",
    "RepartitionByExpression", "Repartition", "UnresolvedHint", "Deduplicate", "UnresolvedInlineTable",
    "UnresolvedTableValuedFunction", "OneRowRelation", "UnresolvedSubqueryColumnAliases",
}
# nodes that change something, anywhere in the plan
WRITES = re.compile("(Insert|Overwrite|Append|Create|Drop|Alter|Rename|Replace|Delete|Update|Merge|Truncate|Load|Cache|"
                    "Uncache|Refresh|Repair|Analyze|Set|Unset|Use|Write|Copy|Call)[A-Z]\\w*|\\w+Command$")
# built-in functions that call static methods of the JVM by name
REFLECTIVE = {"reflect", "java_method", "try_reflect"}
DEFAULT_MAX_ROWS = 500                   # interactive row cap (a fixed value of the console)


def parquet_scan_to_spark(text: str) -> str:
    """``parquet_scan('p')`` / ``read_parquet('p')`` → Spark's ``parquet.`p```."""
    return re.sub(r"(?:parquet_scan|read_parquet)\(\s*'([^']+)'\s*(?:,[^)]*)?\)", r"parquet.`\1`", text)


def called_functions(spark: SparkSession, text: str) -> set[str]:
    """Names of the functions that the parsed statement calls, subqueries and CTEs included."""
    tree = json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toJSON())
    found, todo = set(), [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo.extend(node)
        elif isinstance(node, dict):
            if node.get("class", "").endswith(("UnresolvedFunction", "UnresolvedTableValuedFunction")):
                name = node.get("nameParts", node.get("name"))
                found.add((name if isinstance(name, str) else name[-1]).strip("[]").split(",")[-1].strip().lower())
            todo.extend(node.values())
    return found


def allowed_functions(spark: SparkSession) -> set[str]:
    """The built-in functions, but for those that call any static method of the JVM. Functions that a user has registered
    may do anything and are not on the list."""
    return {r[0].split(".")[-1].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()} - REFLECTIVE


def is_read_only(spark: SparkSession, text: str) -> bool:
    """True when the statement parses to a query (never executes it) that calls allowed functions only."""
    try:
        plan = spark.sql("EXPLAIN EXTENDED " + text).collect()[0][0]
        functions = called_functions(spark, text)
    except Exception:  # noqa: BLE001  (unparsable → not allowed)
        return False
    parsed = plan.split("== Analyzed Logical Plan ==")[0].split("== Parsed Logical Plan ==")[-1]
    nodes = re.findall(r"^[\s:+|-]*'?([A-Za-z]\w*)", parsed, re.M)
    # the whole tree is read: WITH … INSERT and FROM … INSERT have a query as their root
    return (bool(nodes) and nodes[0] in QUERY_ROOTS and not any(WRITES.match(n) for n in nodes)
            and functions <= allowed_functions(spark))


def lake_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every table of a data folder by name: ``ohlcv`` is the bar lake (empty if there is none), each other
    folder or Parquet file beside it a table of its name."""
    files = Files(spark, root)
    names = {n.removesuffix(".parquet"): n for n in files.glob("*") if n != "ohlcv" and not n.startswith(("_", "."))}
    return {"ohlcv": scan_bars(spark, f"{root}/ohlcv")} | {k: spark.read.parquet(f"{root}/{n}") for k, n in names.items()}


def sql(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None, root: str | None = None) -> DataFrame:
    """Run SQL over the tables given, and over all tables of the data folder ``root``."""
    register_views(spark, (lake_tables(spark, root) if root else {}) | (tables or {}))
    return spark.sql(parquet_scan_to_spark(text))


def format_result(df: DataFrame) -> DataFrame:
    """NaN → null and timestamps as ``yyyy-MM-dd HH:mm:ss`` (chosen from the schema)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def run_query(spark: SparkSession, text: str, max_rows: int = DEFAULT_MAX_ROWS,
              tables: dict[str, DataFrame] | None = None) -> dict:
    """Guarded console query: the first ``max_rows`` rows, the total row count and a
    truncated flag, from one run: the rows are counted (``observe``) on their way into a top-k by their
    place, which reads them all and keeps ``max_rows`` a task."""
    if not is_read_only(spark, parquet_scan_to_spark(text)):
        raise PermissionError("only read-only queries are allowed")
    df = format_result(sql(spark, text, tables))
    counted = Observation()
    place = F.monotonically_increasing_id()
    names = [f"c{i}" for i in range(len(df.columns))]  # a result may hold one name twice
    top = (df.toDF(*names).observe(counted, F.count(F.lit(1)).alias("rows")).withColumn("place", place)
           .orderBy("place").limit(max_rows).drop("place"))
    rows = [dict(zip(df.columns, r)) for r in top.collect()]
    total = counted.get["rows"] if rows else 0  # a plan known to be empty is not run, nor counted
    return {"columns": df.columns, "rows": rows, "total_rows": total, "truncated": total > max_rows}
