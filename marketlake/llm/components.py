"""Connected components of a link table, by alternating large and small stars.

Each round joins every node's links to the smallest neighbour; the number of rounds grows with
the logarithm of the longest chain. Links and rounds are written to the shared folder. Nothing but a
count and a checksum per round reaches the driver.

A hub may hold most links. Its smallest neighbour is found by an aggregate, which is combined before
the shuffle; the join back is ``join_hot``: keys with at least one in ``HOT`` of the rows are at most ``HOT``, so they
are broadcast, and the rows of the others are shuffled.

Links that repeat or join a node to itself count once or not at all; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.storage import materialise

HOT = 1024


def join_hot(rows: DataFrame, known: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``known``, which has each key once and ``n``, the number of rows with it; ``n`` is
    left out of the result. ``total`` is at least the sum of ``n``, so at most ``HOT`` keys are broadcast."""
    heavy = F.broadcast(known.where(F.col("n") * HOT >= total).drop("n"))
    light = known.where(F.col("n") * HOT < total).drop("n")
    rest = rows.join(heavy.select(key), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(light, key))


def _large_star(links: DataFrame, n: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
    return join_hot(both, least, "a", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame, n: int) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    near = join_hot(down, least, "a", n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(a, b)`` links of longs, in any order, repeated or not -> ``(node, root)`` for every
    linked node; ``root`` is the smallest node of its component."""
    links = materialise(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "links")
    before, n = None, links.count()
    while n:
        # a large star has a row per link, or fewer
        large = materialise(_large_star(links, n).distinct(), "large-stars")
        links = materialise(_small_star(large, n), "stars")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    tops = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(tops)
