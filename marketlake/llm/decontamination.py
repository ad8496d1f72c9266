"""Operator 1, benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item (an item of fewer words is one window). Of the
``k``-grams in each window the smallest hash is its fingerprint. A document's windows choose in the same
way, so a shared window has a shared fingerprint on both sides: no shared span of ``window`` words is missed.
Neighbouring windows mostly choose the same gram and are kept as one run, whose words are packed as one
string. Runs meet the benchmark's fingerprints by hash; those that meet are extended to all their windows,
which are compared with the benchmark's word for word.

Items shorter than a window are met by their own length: the document's grams of all lengths that occur are
hashed in one pass, meet the items by length and hash, and are compared as words where they met. The lengths (at
most ``window - 1`` numbers) are all that reaches the driver.

Benchmark windows are made distinct before they meet documents, so equal passages of many items cost one
match; which items they come from is joined last, on what was hit. No join has a broadcast hint: Catalyst
broadcasts a side of known small size, and sorts, shuffles and splits skewed keys otherwise.

Null text has no words; an item without words or without id has no windows that count. Documents are known by id
and text, so rows that repeat both are judged once and each of them gets the result. A text is split and hashed whole
in one row, however long it is. Null document ids stay; extra columns are
dropped; an empty benchmark leaves all documents clean; an empty document table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.native_text import ascii_lower, doubled, gram_hashes, let, shifted, split_words
from marketlake.llm.storage import materialise

WINDOW, GRAM = 10, 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def item_words(text: Column) -> Column:
    return split_words(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)


# Arrays are unpacked with the outer generators: for the inner ones the optimizer infers a filter on the array and
# computes it a second time below. The nulls they add for empty arrays meet nothing in the joins that follow.

def _text(words: Column, start: Column, n) -> Column:
    return F.array_join(F.slice(words, start + 1, n), " ")


def _less(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _sliding_min(h: Column, width: int) -> Column:
    if width == 1:
        return h
    half = width // 2
    return let(_sliding_min(h, half), lambda m: let(
        shifted(m, m, half, _less), lambda even: even if width % 2 == 0 else shifted(even, h, width - 1, _less)))


def fingerprints(words: Column, window: int, k: int) -> Column:
    """The smallest ``k``-gram hash of every window, by the window's start."""
    return let(gram_hashes(words, k), lambda h: _sliding_min(h, window - k + 1))


def runs(words: Column, window: int, k: int) -> Column:
    """Runs of windows with one fingerprint: ``start, n`` windows, ``fp`` and their words, packed."""
    def cut(w: Column, m: Column) -> Column:
        starts = F.filter(F.transform(m, lambda x, i: F.when((i == 0) | (F.get(m, i - 1) != x), i)), lambda i: i.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda a, j: let(
            F.coalesce(F.get(s, j + 1), F.size(m)) - a, lambda n: F.struct(
                a.alias("start"), n.alias("n"), F.get(m, a).alias("fp"), _text(w, a, n + window - 1).alias("packed")))))

    return let(words, lambda w: let(fingerprints(w, window, k), lambda m: cut(w, m)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """``(item_id, n, words, fp)``: the windows of each item; ``fp`` is null for a short item."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", item_words(F.col("text")).alias("w")).where("size(w) > 0")
    long = items.where(F.size("w") >= window).select("item_id", "w", F.posexplode_outer(fingerprints(F.col("w"), window, k)).alias("i", "fp"))
    return long.select("item_id", F.lit(window).alias("n"), _text(F.col("w"), F.col("i"), window).alias("words"), "fp").unionByName(
        items.where(F.size("w") < window).select("item_id", F.size("w").alias("n"), F.array_join("w", " ").alias("words"),
                                                 F.lit(None).cast("long").alias("fp")))


def hits(docs: DataFrame, windows: DataFrame, *, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """``(doc_id, text_hash, start, n, words)``: every place where a benchmark window stands in a
    document; ``docs`` has ``doc_id, text_hash, w``."""
    chosen = windows.where("fp IS NOT NULL").select("fp").distinct()
    met = (docs.select("doc_id", "text_hash", runs(F.col("w"), window, k).alias("runs"))
           .select("doc_id", "text_hash", F.inline_outer("runs")).join(chosen, "fp", "left_semi"))
    parts = F.split("packed", " ")
    stands = met.select("doc_id", "text_hash", "start", let(parts, lambda p: F.transform(
        F.sequence(F.lit(0), F.col("n") - 1), lambda i: _text(p, i, window))).alias("texts"))
    stands = stands.select("doc_id", "text_hash", "start", F.posexplode_outer("texts").alias("i", "words")).select(
        "doc_id", "text_hash", (F.col("start") + F.col("i")).alias("start"), F.lit(window).alias("n"), "words")
    found = stands.join(windows.where(F.col("n") == window).select("words").distinct(), "words", "left_semi")
    lengths = sorted(r["n"] for r in windows.where(F.col("n") < window).select("n").distinct().collect())
    return found.unionByName(_short_hits(docs, windows.where(F.col("n") < window), lengths)) if lengths else found


def _short_hits(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for whole items of few words: grams of all ``lengths`` are hashed in one pass and meet the
    items' hashes; the places that met are compared word for word."""
    def of(n: int, ones: Column) -> Column:
        return F.transform(doubled(ones, n), lambda h, i: F.struct(F.lit(n).alias("n"), i.alias("start"), h.alias("h")))

    def grams(words: Column) -> Column:
        return let(F.transform(words, lambda w: F.xxhash64(w)), lambda ones: F.concat(*(of(n, ones) for n in lengths)))

    items = windows.select("n", "words").distinct()
    one = F.coalesce(*(F.when(F.col("n") == n, F.get(gram_hashes(F.split("words", " "), n), F.lit(0))) for n in lengths))
    met = (docs.select("doc_id", "text_hash", F.inline_outer(grams(F.col("w"))))
           .join(items.select("n", one.alias("h")).distinct(), ["n", "h"], "left_semi")
           .groupBy(F.col("doc_id").alias("met_id"), F.col("text_hash").alias("met_hash"))
           .agg(F.collect_set(F.struct("start", "n")).alias("at")))
    same = F.col("doc_id").eqNullSafe(F.col("met_id")) & (F.col("text_hash") == F.col("met_hash"))
    return docs.join(met, same).select("doc_id", "text_hash", let(F.col("w"), lambda w: F.transform("at", lambda x: F.struct(
        x["start"].alias("start"), x["n"].alias("n"), _text(w, x["start"], x["n"]).alias("words")))).alias("stands")).select(
            "doc_id", "text_hash", F.inline_outer("stands")).join(items, ["n", "words"], "left_semi").select(
                "doc_id", "text_hash", "start", "n", "words")


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                       item_words(F.col(text_col)).alias("w"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, item_ids`` (strings, sorted)."""
    own = _prepared(docs, id_col, text_col)
    windows = benchmark_windows(benchmark, window, k)
    found = materialise(hits(own, windows, window=window, k=k), "decontamination-hits")  # read twice below
    key = ["doc_id", "text_hash"]
    places = found.groupBy(*key).agg(F.collect_set(F.struct("start", "n")).alias("at")).select(*key, F.size(F.array_distinct(
        F.flatten(F.transform("at", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1))))).cast("long").alias("n_hit"))
    # items may share windows: distinct pairs of document and item
    items = (found.select(*key, "words").distinct().join(windows.select("words", "item_id").distinct(), "words")
             .select(*key, F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("item_ids")))
    counts = own.select(*key, F.size("w").cast("long").alias("n_words"))
    every = (counts.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.count("*").cast("int").alias("copies"))
             .unionByName(places, allowMissingColumns=True).unionByName(items, allowMissingColumns=True)
             .groupBy(*key).agg(*(F.max(c).alias(c) for c in ("n_words", "copies", "n_hit", "item_ids"))))
    return every.select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col")


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """``docs``, all columns, without the documents in which a benchmark window stands."""
    found = hits(_prepared(docs, id_col, text_col), benchmark_windows(benchmark, window, k), window=window, k=k)
    dirty = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = docs[id_col].eqNullSafe(dirty["__id"]) & (F.xxhash64(docs[text_col]) == dirty["__hash"])
    return docs.join(dirty, same, "left_anti")
