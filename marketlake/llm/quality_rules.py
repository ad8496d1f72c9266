"""Operator 7, quality rules in DataFrame functions only: counting rules, and a hashed n-gram
log-likelihood ratio between a trusted target and the raw corpus.

Words, the runs of signs in them and (for n = 2) pairs of neighbouring words are hashed into
``BUCKETS`` buckets. Two multinomials are counted over them: the target's, from labelled documents of
quality 1 that are not toxic, and the raw corpus's, from all documents. A document's score is the mean log
ratio of its n-grams, so its length does not matter, and it passes at ``THRESHOLD`` or more: a fixed
number of nats, the same for every document and size of corpus. Counts are smoothed by ``PRIOR`` on the
target's scale; a bucket that is seldom seen says nothing.

The rules: fewer than ``MIN_WORDS`` words, or over ``MAX_REPEAT`` per cent of the words in windows of
``REPEAT_WINDOW`` words that stand twice or more in the text. Windows are compared by hash first; a text
with equal hashes has its windows sorted as strings, so the count is exact.

Labels are a sample of at most ``MAX_LABELS`` trusted ids (smallest hashes first), the only rows broadcast;
counts and scores cover all documents. The model is one array of ``BUCKETS`` numbers.

Null text has no words, lines or signs and fails. Repeated rows and null ids stay rows of their
own, several labels of a document count as the worst, an empty table gives no rows, without trusted documents
every score is zero (passes). A text is judged whole in one row, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.native_text import SPACES, doubled, let, shifted, split_words

BUCKETS = 1 << 18
N = 2
PRIOR = 20.0
THRESHOLD = -0.08
MAX_LABELS = 200_000
MIN_WORDS, MAX_REPEAT, REPEAT_WINDOW = 20, 30, 8
SIGNS = r"[^\x00-\x20\x7F0-9A-Za-z\x{80}-\x{10FFFF}]+"


def covered(starts: Column, size: int) -> Column:
    """Number of places in the windows of ``size`` that begin at the ascending ``starts``."""
    steps = shifted(starts, starts, 1, lambda a, b: F.least(b - a, F.lit(size)))
    return F.when(F.size(starts) == 0, 0).otherwise(F.aggregate(steps, F.lit(size), lambda a, b: a + b))


def repeat_words(words: Column, halves: Column, size: int) -> Column:
    """Words in windows of ``size`` words that stand twice or more, the first included. ``halves`` are
    hashes of the windows' first half: where none repeats, no window does, and nothing is sorted."""
    def exact(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1),
                            lambda i: F.struct(F.array_join(F.slice(w, i, size), " ").alias("g"), i.alias("i")))
        return let(F.sort_array(grams), lambda s: let(F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(
            (F.get(s, j - 1)["g"] == x["g"]) | (F.get(s, j + 1)["g"] == x["g"]), x["i"])), lambda i: i.isNotNull())),
            lambda starts: covered(starts, size)))

    return F.when((F.size(words) < size) | (F.size(F.array_distinct(halves)) == F.size(halves)), 0).otherwise(let(words, exact))


def token_hashes(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` with ``words``, ``signs`` (the runs of signs inside the words), ``ones`` (the words' hashes) and
    ``grams`` (hashes of words, runs of signs and, for n = 2, pairs of words)."""
    text = F.coalesce("text", F.lit(""))
    split = docs.withColumns({"words": split_words(text, r"[\x20\x09-\x0D]"),
                              "signs": F.regexp_extract_all(text, F.lit(SIGNS), F.lit(0))})
    hashed = split.withColumn("ones", F.transform("words", lambda w: F.xxhash64(w)))
    pairs = [shifted(F.col("ones"), F.col("ones"), 1, lambda a, b: F.xxhash64(a, b))] if n == 2 else []
    return hashed.withColumn("grams", F.concat("ones", F.transform("signs", lambda w: F.xxhash64(w, F.lit("sign"))), *pairs))


def bucket(h: Column, buckets: int) -> Column:
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")  # a power of two


def trusted_sample(labels: DataFrame, bound: int = MAX_LABELS) -> DataFrame:
    """At most ``bound`` ids of trusted documents."""
    worst = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return (worst.where("q = 1 AND NOT coalesce(t = 1, false)").select(F.col("doc_id").alias("trusted_id"))
            .orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(bound))


def model(docs: DataFrame, labels: DataFrame, *, n: int = N, buckets: int = BUCKETS, prior: float = PRIOR,
          max_labels: int = MAX_LABELS) -> DataFrame:
    """One row: ``ratios``, the log ratio of target to raw by bucket."""
    sample = F.broadcast(trusted_sample(labels, max_labels))  # bounded by max_labels
    grams = token_hashes(docs.join(sample, docs["doc_id"] == sample["trusted_id"], "left"), n).select(
        F.col("trusted_id").isNotNull().cast("long").alias("trusted"),
        F.explode_outer("grams").alias("h")).select(  # outer: no filter on the array is inferred, so it is computed once
            "trusted", bucket(F.col("h"), buckets).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")  # no row has the null of a text without n-grams
    whole = every.agg(
        F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("raw"),
                                             F.coalesce("target", F.lit(0)).alias("target")))).alias("c"),
        F.coalesce(F.try_divide(F.sum("target"), F.sum("raw")), F.lit(0.0)).alias("share"))
    return whole.select(F.transform("c", lambda x: F.log((x["target"] + prior) / (x["raw"] * F.col("share") + prior))).alias("ratios"))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD, n: int = N, buckets: int = BUCKETS, **parameters) -> DataFrame:
    """One row per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, llr, kept``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    text, signs = F.coalesce("text", F.lit("")), F.array_join("signs", "")
    # the model and the n-grams are used in one place each, so the optimizer puts the subquery's value there and no
    # row carries the array
    tokens = token_hashes(docs, n).withColumn("ratios", model(docs, labels, n=n, buckets=buckets, **parameters).scalar())
    llr = let(F.col("grams"), lambda g: F.coalesce(F.try_divide(F.aggregate(
        g, F.lit(0.0), lambda a, h: a + F.get(F.col("ratios"), bucket(h, buckets))), F.size(g)), F.lit(0.0)))
    ready = tokens.select(
        "doc_id", "words", "signs", llr.alias("llr"),
        let(F.col("ones"), lambda ones: doubled(ones, REPEAT_WINDOW // 2)).alias("halves"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"))
    counted = ready.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length(signs) - F.char_length(F.regexp_replace(signs, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words"), F.col("halves"), REPEAT_WINDOW).cast("long").alias("n_repeat_words"), "llr")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))
