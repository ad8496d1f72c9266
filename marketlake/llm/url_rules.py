"""Operator 2, URL filters as a sort-merge range join, in DataFrame functions only.

A host's canonical key is its labels in reverse, each closed by a dot (``www.example.com`` ->
``com.example.www.``). All subdomains of a rule's host then lie in one interval of keys, from the
host's key up to the same key with its last dot raised to ``/``, and two intervals are nested or
apart. Rules and URLs are sorted together by key and swept once: the sweep keeps a stack with one
place per number of labels, holding the last rule that began at that depth. A place is active for a
URL whose key is below the end of its interval. Among the active hosts' rules whose path begins the
URL's path the longest wins (host and path together, then the longer host, then block before allow).

Rules and URLs are dealt into as many ranges of the sort order as there are shuffle partitions; a hash of id and URL
ends the order, so a host with very many URLs spreads over several ranges. Each range is swept on its own. What is
open at its border is carried into it: of each depth the last rule that began in an earlier range, if its interval
reaches over the border. So a rule is copied only into ranges that it spans, the carries are found from one row per range
and depth, nothing is broadcast, and no URL meets rules of other hosts. Ranges are written to the shared folder, as
their borders come from a sample. The rules of one host travel as one array.

A URL that is null or has no ``://`` has an empty host and path; only rules with an empty host fit
the empty host. A URL that no rule fits gets ``default`` and a null rule. Rules with a null in any
column are ignored, a rule given twice is one rule, and two verdicts for one rule mean block. Null
ids stay, repeated rows stay, other columns are dropped, an empty table gives no rows. Very long URLs are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.storage import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def _carried(both: DataFrame, deepest: int) -> DataFrame:
    """The rules that are open where each range begins, as rows without a key, which stand before all others."""
    first = both.groupBy("range").agg(F.min("key").alias("first")).select(
        "range", "first", F.explode(F.sequence(F.lit(1), F.lit(deepest))).alias("depth"))
    last = both.where("depth IS NOT NULL").groupBy("range", "depth").agg(F.max_by("opened", "key").alias("opened"))
    before = Window.partitionBy("depth").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.last("opened", ignorenulls=True).over(before)
    return (first.join(last, ["range", "depth"], "left").select("range", "depth", "first", open_.alias("opened"))
            .where("first < opened.end").select("range", "depth", "opened"))


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow", id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """``pages`` (id, url) against ``rules`` (host, path, verdict) -> ``page_id, host, path, rule, verdict``."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.xxhash64(F.col(id_col), F.col(url_col)).alias("deal"), F.col(id_col).alias("page_id"),
                        host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    hosts = (rules.dropna(subset=["host", "path", "verdict"]).select(
        F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").groupBy("host")
        .agg(F.collect_set(F.struct("path", "verdict")).alias("rules")))
    hosts = hosts.select(host_key(F.col("host")).alias("key"), F.size(F.split("host", "[.]")).alias("depth"),
                         F.struct("host", "rules").alias("own"))
    hosts = hosts.select("key", "depth", F.struct(
        F.concat(F.expr("left(key, char_length(key) - 1)"), F.lit("/")).alias("end"), "own").alias("opened"))
    # rules stand before the URLs of their own host
    both = materialise(urls.unionByName(hosts, allowMissingColumns=True)
                       .repartitionByRange(n, F.col("key"), F.col("depth").isNull(), F.col("deal"))
                       .withColumn("range", F.spark_partition_id()).drop("deal"), "url-ranges")
    deepest = both.agg(F.max("depth")).first()[0] or 0  # one number
    sweep = Window.partitionBy("range").orderBy("key", F.col("depth").isNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = both.unionByName(_carried(both, deepest), allowMissingColumns=True) if deepest else both
    stack = F.array(*[F.last(F.when(F.col("depth") == d, F.col("opened")), ignorenulls=True).over(sweep)
                      for d in range(1, deepest + 1)]) if deepest else F.array().cast(
                          "array<struct<end:string,own:struct<host:string,rules:array<struct<path:string,verdict:string>>>>>")
    swept = rows.withColumn("stack", stack).where("depth IS NULL")
    active = F.filter("stack", lambda s: s["end"].isNotNull() & (F.col("key") < s["end"]))
    fits = F.flatten(F.transform(active, lambda s: F.transform(
        F.filter(s["own"]["rules"], lambda r: F.startswith(F.col("swept.path"), r["path"])),
        lambda r: F.struct(F.char_length(F.concat(s["own"]["host"], r["path"])).alias("length"),
                           F.char_length(s["own"]["host"]).alias("of_host"), r["verdict"].alias("verdict"),
                           F.concat(s["own"]["host"], r["path"]).alias("rule")))))
    best = swept.alias("swept").withColumn("best", F.array_max(fits))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
