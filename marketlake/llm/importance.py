"""Operator 3, quality classifier by importance resampling.

Texts are bags of hashed n-grams: each token (a run of letters and digits, or of signs) falls in one
of ``BUCKETS`` buckets, each pair of neighbouring tokens in one of as many others, and one more bucket counts the
pairs that a window of ``WINDOW`` tokens has already had, as repeated lines and words are the mark of much junk
(the share of such pairs does not grow with the text). Generative models are the bucket counts of

* the target: trusted documents (quality 1, not toxic) among the labelled;
* the raw text: all documents;

and the numbers of labelled documents, trusted and toxic, that have a token or pair at all. A witness is one
that more toxic documents have than chance explains: its surprise (the number of documents times the divergence of
their toxic share from all documents') reaches a bound at which ``FALSE_WITNESSES`` of the tokens, and as many of the
pairs, are expected to pass by chance, so the bound fits the number of labels; and its log ratio of trusted to
toxic documents is at most ``WITNESS``.

A document's log weight is the sum of two log ratios, in nats: that of target to raw, of a text longer than
``REACH`` tokens the mean times ``REACH``; and that of the witnesses, each ``MOST_USES`` times at most, in the worst
window, plus the log of the number of windows (the worst of many is bad by chance), zero at most. So neither falls with
the text's length. Counts are smoothed on the scale of the target, so that a bucket that is seldom seen says nothing.

Then k documents are drawn without replacement in proportion to their weights, by Gumbel top-k: log weight plus
standard Gumbel noise (from a hash of id and text), the k largest kept; ties on the last place are all kept. A
document of log weight w has its key above -m with probability 1 - exp(-exp(w + m)). m is taken so that the share
``KEEP_TRUSTED`` of the labelled trusted documents is expected above it, each weighed by models without itself, and k
is the number of all documents that are expected above it, rounded up: corpora with more text like the target keep more.

Counting and scoring cover every document and whole texts. The classifier's labels are a sample of
at most ``MAX_LABELS`` rows (smallest hashes of the id), which is all that is broadcast beside the
counts, whose size is fixed. The k-th largest key is found by narrowing histograms of 1,024 bins.

Null text has no tokens and log weight zero, like any unsuspicious text. Ids are integers (a string that is none is an
error). Null ids are unlabelled. Several labels of a
document count as the worst. Repeated rows are documents of their own with equal results; an empty table gives no rows;
without labelled trusted documents all are kept. Very long texts are scored whole, in slices of the batch.
``select_documents`` keeps every column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from marketlake.llm.storage import free_names, materialise
from marketlake.llm.text_arrays import SPACE, mix, runs, slices, span_hashes, utf8_buffer

BUCKETS = 1 << 20
MAX_LABELS = 200_000
#: Share of the labelled trusted documents that is expected to be drawn; it fixes k.
KEEP_TRUSTED = 0.995
QUALITY_PRIOR, TOXIC_PRIOR = 20.0, 0.5
#: Tokens of a window: the scale on which repeats and insults are judged.
WINDOW = 512
#: Tokens of which the quality sum of a longer text is the average.
REACH = 16
#: Tokens, and pairs, that may be called witnesses by chance, and the largest log ratio of a witness.
FALSE_WITNESSES, WITNESS = 10.0, -1.5
#: Uses of a witness that count in one window.
MOST_USES = 2
BINS = 1024
#: Buckets whose ratios are computed at a time.
BLOCK = 1 << 17
#: The bucket after those of tokens and of pairs.
REPEATED = 2 * BUCKETS
COUNTS = ("raw", "target", "clean_docs", "toxic_docs")

_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[SPACE] = 0


def _tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document, window) of every token, of every pair of neighbouring tokens and of every pair that its
    window has already had. Windows are numbered through all documents, and a pair is of its second token's."""
    start, end = runs(_KIND[data], bounds)
    h = span_hashes(data, start, end)
    doc = np.searchsorted(bounds, start, side="right") - 1
    n = np.bincount(doc, minlength=len(bounds) - 1)
    many = -(-n // WINDOW)
    window = (np.cumsum(many) - many)[doc] + (np.arange(len(h)) - (np.cumsum(n) - n)[doc]) // WINDOW
    inside = doc[1:] == doc[:-1]
    pair = mix(h[:-1] + np.uint64(3) * h[1:])[inside]
    doc2, window2 = doc[1:][inside], window[1:][inside]
    _, first = np.unique(pair ^ mix(window2.astype(np.uint64)), return_index=True)
    again = np.ones(len(pair), dtype=bool)
    again[first] = False
    shift = np.uint64(65 - BUCKETS.bit_length())
    return (np.concatenate([(h >> shift).astype(np.int64), (pair >> shift).astype(np.int64) + BUCKETS,
                            np.full(int(again.sum()), REPEATED)]),
            np.concatenate([doc, doc2, doc2[again]]), np.concatenate([window, window2, window2[again]]))


def label_rows(labels: DataFrame, bound: int = MAX_LABELS) -> DataFrame:
    """(doc_id, kind) of at most ``bound`` labelled documents: 1 trusted, 2 toxic, 0 neither."""
    kind = F.when(F.max("toxic") == 1, 2).when(F.min("quality") == 1, 1).otherwise(0)
    return (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(kind.cast("int").alias("kind")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))


def label_sample(labels: DataFrame, bound: int = MAX_LABELS) -> tuple[np.ndarray, np.ndarray]:
    """``label_rows`` as arrays, sorted by id."""
    rows = label_rows(labels, bound).toArrow()
    ids = rows["doc_id"].to_numpy()
    order = np.argsort(ids)
    return ids[order], rows["kind"].to_numpy()[order]


def _distinct(bucket: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The buckets of the distinct (bucket, group)."""
    return np.unique(group * (REPEATED + 1) + bucket) % (REPEATED + 1)


def models(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> np.ndarray:
    """``COUNTS`` by bucket: tokens of raw and target text, trusted and toxic documents. The last place counts documents."""
    sample = docs.sparkSession.sparkContext.broadcast(label_sample(labels, max_labels))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, kinds = sample.value
        counts = np.zeros((4, REPEATED + 2), dtype=np.int64)
        for batch in batches:
            own = batch.column(0)
            known = np.asarray(own.is_valid())
            own = own.fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
            kind = np.where(known & (ids[at] == own), kinds[at], 0) if len(ids) else np.zeros(len(own), np.int64)
            data, bounds = utf8_buffer(batch.column(1))
            for a, b in slices(bounds):
                bucket, doc, _ = _tokens(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a])
                np.add.at(counts[0], bucket, 1)
                of = kind[a:b][doc]
                np.add.at(counts[1], bucket[of == 1], 1)
                for k in (1, 2):
                    some = (of == k) & (bucket < REPEATED)
                    np.add.at(counts[k + 1], _distinct(bucket[some], doc[some]), 1)
            for k in (0, 1, 2):
                counts[k + 1 if k else 0, -1] += np.sum(kind == k)
        some = np.flatnonzero(counts.any(axis=0))
        for i in range(0, len(some), 100_000):
            part = some[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(c[part]) for c in counts)], names=["bucket", *COUNTS])

    sums = (docs.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(count, "bucket long, " + ", ".join(f"{c} long" for c in COUNTS))
            .groupBy("bucket").agg(*(F.sum(c).alias(c) for c in COUNTS)).toArrow())
    full = np.zeros((4, REPEATED + 2))
    for row, name in zip(full, COUNTS):
        row[sums["bucket"].to_numpy()] = sums[name].to_numpy()
    return full


def bounds_of(counts: np.ndarray) -> tuple[float, float]:
    """The surprise that makes a witness, of tokens and of pairs."""
    toxic = counts[3, :-1]
    return tuple(float(np.log(max(np.count_nonzero(part), 1) / FALSE_WITNESSES)) for part in (toxic[:BUCKETS], toxic[BUCKETS:]))


def share_of(counts: np.ndarray) -> float:
    """The target's part of all tokens and pairs."""
    raw, target = counts[0, :-1].sum(), counts[1, :-1].sum()
    return float(target / raw) if raw else 0.0


def ratios_of(bucket: np.ndarray, counts: np.ndarray, n_clean: float, n_toxic: float, share: float,
              bounds: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios of these buckets with these counts: target to raw, and trusted to toxic documents (witnesses, else 0)."""
    raw, target, clean, toxic = counts
    quality = np.log((target + QUALITY_PRIOR) / (raw * share + QUALITY_PRIOR))
    if not n_clean or not n_toxic:
        return quality, np.zeros_like(quality)
    expected = n_toxic / (n_clean + n_toxic)  # of the documents with a word, the share that is toxic by chance
    both = np.maximum(clean + toxic, 1)
    seen = toxic / both
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = both * (np.where(seen > 0, seen * np.log(seen / expected), 0)
                           + np.where(seen < 1, (1 - seen) * np.log((1 - seen) / (1 - expected)), 0))
    bound = np.where(bucket < BUCKETS, *bounds)
    safety = np.log((clean * n_toxic / n_clean + TOXIC_PRIOR) / (toxic + TOXIC_PRIOR))
    return quality, np.where((surprise >= bound) & (safety <= WITNESS), safety, 0.0)


def all_ratios(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both log ratios of every bucket; taken in blocks, as the driver holds what they are computed from."""
    out = np.empty((2, REPEATED + 1), dtype=np.float32)
    share, bounds = share_of(counts), bounds_of(counts)
    for a in range(0, REPEATED + 1, BLOCK):
        b = min(a + BLOCK, REPEATED + 1)
        out[:, a:b] = ratios_of(np.arange(a, b), counts[:, a:b], *counts[2:, -1], share, bounds)
    return out[0], out[1]


def weigh(data: np.ndarray, bounds: np.ndarray, ratios: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of tokens and both sums of the documents of one slice."""
    bucket, doc, window = _tokens(data, bounds)
    return _sums(bucket, doc, window, len(bounds) - 1, bucket, ratios)


def weigh_apart(data: np.ndarray, counts: np.ndarray, share: float, bounds: tuple[float, float]) -> float:
    """Log weight of one trusted document under models without it."""
    bucket, doc, window = _tokens(data, np.array([0, len(data)]))
    own, place, uses = np.unique(bucket, return_inverse=True, return_counts=True)
    rest = counts[:, own] - np.stack([uses, uses, own < REPEATED, np.zeros_like(uses)])
    ratios = ratios_of(own, rest, counts[2, -1] - 1, counts[3, -1], share, bounds)
    _, quality, safety = _sums(bucket, doc, window, 1, place, ratios)
    return float(quality[0] + safety[0])


def _sums(bucket: np.ndarray, doc: np.ndarray, window: np.ndarray, size: int, place: np.ndarray,
          ratios: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``weigh`` from the tokens, whose ratios are at ``place``."""
    quality, safety = ratios
    n = np.bincount(doc[bucket < BUCKETS], minlength=size)
    total = np.bincount(doc, weights=quality[place], minlength=size) * (REACH / np.maximum(n, REACH))
    many = -(-n // WINDOW)
    hit = np.flatnonzero(safety[place] != 0)
    _, first, uses = np.unique(window[hit] * (REPEATED + 1) + bucket[hit], return_index=True, return_counts=True)
    word = hit[first]
    by_window = np.bincount(window[word], weights=safety[place[word]] * np.minimum(uses, MOST_USES), minlength=int(many.sum()))
    worst = np.zeros(size)
    np.minimum.at(worst, np.repeat(np.arange(size), many), by_window)
    return n, total, np.minimum(worst + np.log(np.maximum(many, 1)), 0.0)


def shared_ratios(docs: DataFrame, counts: np.ndarray) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(all_ratios(counts))


def scored(docs: DataFrame, counts: np.ndarray, shared: Broadcast | None = None) -> DataFrame:
    """``docs`` with three columns more: the number of tokens and both sums. ``shared`` are the ratios, if sent already."""
    shared = shared or shared_ratios(docs, counts)
    at = docs.columns.index("text")
    names = [*docs.columns, *_added(docs)[:3]]
    schema = StructType([*docs.schema.fields, *(StructField(name, kind) for name, kind in zip(
        names[-3:], (LongType(), DoubleType(), DoubleType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8_buffer(batch.column(at))
            for a, b in slices(bounds):
                part = batch.slice(a, b - a)
                sums = weigh(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a], shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, sums)], names=names)

    return docs.mapInArrow(run, schema)


def trusted_weights(docs: DataFrame, labels: DataFrame, counts: np.ndarray, max_labels: int = MAX_LABELS) -> DataFrame:
    """(w, n): log weights of the labelled trusted documents under models without each, in hundredths."""
    trusted = label_rows(labels, max_labels).where("kind = 1").select("doc_id")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(trusted), "doc_id", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast((counts.astype(np.float32), share_of(counts), bounds_of(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8_buffer(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(
                [weigh_apart(data[a:b], *shared.value) for a, b in zip(bounds[:-1], bounds[1:])], pa.float64())], names=["w"])

    return own.select("text").mapInArrow(run, "w double").groupBy(F.round("w", 2).alias("w")).agg(F.count("*").alias("n"))


def _added(docs: DataFrame) -> list[str]:
    return free_names(docs, "n_tokens", "quality", "safety", "log_weight", "gumbel_key")


def _keyed(docs: DataFrame, counts: np.ndarray, seed: int, shared: Broadcast | None = None) -> DataFrame:
    """``docs`` with the columns of ``_added``. The key is the weight plus Gumbel noise from a hash of id and
    text: the same in every run."""
    _, quality, safety, weight, key = _added(docs)
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 12)
    uniform = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
    return scored(docs, counts, shared).withColumn(weight, F.col(quality) + F.col(safety)).withColumn(
        key, F.col(weight) - F.log(-F.log(uniform)))


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest value, from histograms of ``BINS`` counts; never more than some
    thousand values reach the driver."""
    lo, hi = keys.agg(F.min(column), F.max(column)).first()
    rest = k
    while lo < hi:
        inside = keys.where(F.col(column).between(lo, hi))
        step = (hi - lo) / BINS
        if step == 0.0 or lo + step == lo:
            break
        place = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(step)), F.lit(BINS - 1))
        bins = inside.groupBy(place.alias("bin")).agg(
            F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for b in sorted(bins, key=lambda r: -r["bin"]):
            if rest <= b["n"]:
                lo, hi, n = b["lo"], b["hi"], b["n"]
                break
            rest -= b["n"]
        if n <= BINS:
            values = sorted((r[0] for r in inside.where(F.col(column).between(lo, hi)).select(column).collect()), reverse=True)
            return values[rest - 1]
    return lo


def margin(weights: np.ndarray, n: np.ndarray, share: float = KEEP_TRUSTED) -> float:
    """The m at which ``share`` of documents with these log weights, ``n`` of each, has keys above -m on average."""
    lo, hi = -weights.max() - 50.0, -weights.min() + 50.0
    for _ in range(100):
        m = (lo + hi) / 2
        above = np.average(-np.expm1(-np.exp(np.minimum(weights + m, 50.0))), weights=n)
        lo, hi = (m, hi) if above < share else (lo, m)
    return hi


def sample_size(keys: DataFrame, trusted: DataFrame) -> int | None:
    """k, from the log weights of ``keys`` and the histogram ``trusted``; None where nothing tells what to keep."""
    bins = trusted.orderBy("w").toPandas()  # hundredths of the range of weights
    if not len(bins):
        return None
    m = margin(bins["w"].to_numpy(), bins["n"].to_numpy())
    above = -F.expm1(-F.exp(F.least(F.col("log_weight") + F.lit(m), F.lit(50.0))))
    # whole millionths, so that the sum does not depend on the order of rows
    parts = keys.agg(F.sum(F.round(above * 1e6).cast("long"))).first()[0] or 0
    return -(-parts // 1_000_000)


def _last_key(keys: DataFrame, trusted: DataFrame) -> float:
    """The smallest key kept."""
    k = sample_size(keys, trusted)
    return float("-inf") if k is None else kth_largest(keys, "gumbel_key", k) if k else float("inf")


def resample(docs: DataFrame, labels: DataFrame, *, seed: int = 0, max_labels: int = MAX_LABELS) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, log_weight, gumbel_key, kept``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = models(docs, labels, max_labels)
    keys = materialise(_keyed(docs, counts, seed).select("doc_id", "n_tokens", "log_weight", "gumbel_key"), "importance")
    return keys.withColumn("kept", F.col("gumbel_key") >= _last_key(keys, trusted_weights(docs, labels, counts, max_labels)))


def select_documents(docs: DataFrame, labels: DataFrame, *, seed: int = 0, max_labels: int = MAX_LABELS) -> DataFrame:
    """The documents that ``resample`` keeps, with all their columns."""
    counts = models(docs, labels, max_labels)
    shared = shared_ratios(docs, counts)
    keys = materialise(_keyed(docs.select("doc_id", "text"), counts, seed, shared).select("log_weight", "gumbel_key"), "importance")
    last = _last_key(keys, trusted_weights(docs, labels, counts, max_labels))
    return _keyed(docs, counts, seed, shared).where(F.col(_added(docs)[-1]) >= last).select(*docs.columns)
