"""Operator 11, line dedup over levelled sorted runs of line hashes, with DataFrame functions only.

A line's key is the line without white space at both ends, A-Z lower-cased; keys of at least
``min_chars`` code points count. A *run* holds, for each key of some batches, its 128-bit hash, the
number of documents with it and the largest of their ids. Runs are tables bucketed and sorted by the
hash, so that runs meet runs and batches meet runs bucket by bucket: only the batch's own hashes are
shuffled, whatever the runs hold.

- A new batch adds a run of its own on level 0. When a level has ``fanout`` runs, they are compacted into
  one run of the next level, so a key is rewritten once a level and the number of runs grows with the
  logarithm of the number of batches. Superseded runs stay on disk until the folder is cleaned.
- A batch's lines are merge-joined with the runs: a line is dropped where its key stands in ``min_docs``
  documents or more and the document is not the one with the largest id. After all batches are added
  (``dedup``), the result does not depend on how the documents were dealt to batches.
- Hot lines: a key in more than one of every ``HEAVY`` pairs of document and key is looked up in a
  broadcast table, which so has at most ``HEAVY`` rows; all other keys are joined by hash. A document
  counts a key once, and tasks pre-aggregate before the shuffle.

Two different keys share a hash with a chance of 2^-128. A line's places are matched to its document by
id and text hash; texts are shuffled once, their lines never.

Null text counts as empty: one empty line, which is kept. Every row is a document of its own, repeated rows
too; rows that share the largest id of a key all keep it. A null id is below every other id, and a key that only
null ids hold stays. Ids may be of any type with an order. A very long text is one row of lines and its dropped
places, never more than the text itself. Other columns are not looked at, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from marketlake.llm.native_text import SPACES, ascii_lower
from marketlake.llm.storage import shared_root

MIN_CHARS = 40
MIN_DOCS = 5
FANOUT = 4
BATCHES = 6
#: Rows of the broadcast table of hot lines, at most.
HEAVY = 1024


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(text: Column) -> Column:
    """Key of every line; the text is lower-cased at once."""
    return F.transform(_lines(ascii_lower(text)), lambda line: F.btrim(line, F.lit(SPACES)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class LineRuns:
    """The runs of one corpus, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, fanout: int = FANOUT):
        self.spark, self.id_col, self.text_col = spark, id_col, text_col
        self.min_chars, self.fanout = min_chars, fanout
        self.folder = folder or f"{shared_root(spark)}/line-runs-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame, level: int) -> None:
        """``run`` is hash-partitioned like the buckets, so each bucket is one sorted file."""
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        (run.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", f"{self.folder}/level-{level}/{name}").saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """One row per key of these runs. The union keeps the runs' buckets, so they meet where they lie: nothing is shuffled."""
        runs = [self.spark.table(name) for name in names]
        return reduce(DataFrame.unionByName, runs).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def add(self, batch: DataFrame) -> None:
        """Add a batch's own run, and compact each level that is full."""
        key = F.array_distinct(F.filter(_keys(F.col(self.text_col)), lambda k: F.char_length(k) >= self.min_chars))
        lines = batch.select(F.col(self.id_col).alias("id"), F.explode(key).alias("key")).select("id", *_hashes(F.col("key")))
        self._write(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            level += 1

    def counts(self) -> DataFrame:
        """``h1, h2, n, top`` of every key added so far, merged over all levels as it is read."""
        return self._merged([name for level in self.levels for name in level])

    def _dropped(self, docs: DataFrame, min_docs: int) -> DataFrame:
        """``id, mark, gone``: sorted places of the lines that go, by document and text hash."""
        self.levels = [[] for _ in self.levels] + [[name] for name in self._compacted()]
        counts = self.counts()
        pairs = counts.agg(F.sum("n")).first()[0] or 0
        known = counts.where(F.col("n") >= min_docs).select("h1", "h2", "top", (F.col("n") * HEAVY >= pairs).alias("hot"))
        heavy = known.where("hot").select("h1", "h2", F.col("top").alias("hot_top"), F.lit(True).alias("hot"))
        light = known.where("NOT hot").select("h1", "h2", "top", F.lit(True).alias("found"))
        lines = docs.select(F.col(self.id_col).alias("id"), F.xxhash64(self.text_col).alias("mark"),
                            F.posexplode(_keys(F.col(self.text_col))).alias("place", "key"))
        lines = lines.where(F.char_length("key") >= self.min_chars).select("id", "mark", "place", *_hashes(F.col("key")))
        lines = lines.join(F.broadcast(heavy), ["h1", "h2"], "left")
        # a hot line is settled; it goes on with a key that matches nothing and is dealt by its document
        lines = (lines.withColumn("h1", F.when(F.col("hot"), F.xxhash64("mark", "place")).otherwise(F.col("h1")))
                 .withColumn("h2", F.when(F.col("hot").isNull(), F.col("h2"))))
        lines = lines.join(light, ["h1", "h2"], "left").withColumn("top", F.coalesce("hot_top", "top"))
        gone = lines.where("(hot OR found) AND NOT (id <=> top)")
        return gone.groupBy("id", "mark").agg(F.sort_array(F.collect_set("place")).alias("gone"))

    def _compacted(self) -> list[str]:
        """The one run that holds all keys."""
        names = [name for level in self.levels for name in level]
        if len(names) > 1:
            self._write(self._merged(names), len(self.levels))
            names = self.levels[-1]
        return names

    def drop(self, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
        """``id, n_lines, n_dropped, kept`` of every document, against all runs added so far."""
        gone = self._dropped(docs, min_docs).select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark"), "gone")
        docs = docs.select(F.col(self.id_col).alias("id"), F.col(self.text_col).alias("text"), F.xxhash64(self.text_col).alias("mark"))
        both = docs.join(gone, (F.col("id").eqNullSafe(F.col("gone_id"))) & (F.col("mark") == F.col("gone_mark")), "left")
        lines = _lines(F.col("text"))
        both = both.select("id", F.col("gone"), lines.alias("lines"))
        starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
        ends = F.concat(F.col("gone"), F.array(F.size("lines")))
        kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
            F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(F.col("lines"), a + 1, b - a))))
        return both.select(F.col("id").alias(self.id_col), F.size("lines").cast("long").alias("n_lines"),
                           F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))


def batches_of(docs: DataFrame, n: int) -> list[DataFrame]:
    """The table dealt into at most ``n`` batches by its files, each of which reads its own files only; a
    table that is no plain scan of several files is one batch."""
    if len(docs.inputFiles()) < 2:
        return [docs]
    try:
        path = docs.metadataColumn("_metadata").getField("file_path")
        return [docs.where(F.pmod(F.xxhash64(path), F.lit(n)) == i) for i in range(n)]
    except AnalysisException:
        return [docs]


def dedup(docs: DataFrame, batches: list[DataFrame] | None = None, *, min_docs: int = MIN_DOCS, **options) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` of every document: its batches are added one by one, then
    its lines are merge-joined with the runs."""
    runs = LineRuns(docs.sparkSession, **options)
    for batch in batches or batches_of(docs, BATCHES):
        runs.add(batch)
    return runs.drop(docs, min_docs)
