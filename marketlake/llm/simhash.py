"""Operator 5, SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``max_bits`` bits of each other have a point half-way. The whole ball of
half the radius has 2,081 points for 64 bits and four bits, which is some 40 times the text's
size in rows; so balls are drawn on views of the bits: the 64 bits are three blocks, a view leaves
one block out, and as every differing bit is seen by two of the three views, some view sees at
most ``2 * max_bits // 3`` of them. Each distinct fingerprint emits, for each view, every variant
within half of that radius (131 in all for four bits), variants are shuffled and sorted, and
those that meet are checked over all 64 bits. No link is lost.

Copies share a fingerprint and are one row before any variant is made. Where many fingerprints
meet, a search over what is not yet reached emits a forest of at most n - 1 links in place of all
pairs; the components of the links (``components``) are the result. Roots and fingerprints that very many rows
share are joined by ``join_hot``, apart from the rest.

Null text has no words: fingerprint zero, linked like any other. Ids are integers (a string that is none is an
error), as the smallest of a component is its name. A very long text is read in one row. Repeated rows are documents of
their own, a null id stays null and counts for no component's smallest id, an empty table gives
no rows, other columns are kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from marketlake.llm.components import components, join_hot
from marketlake.llm.storage import free_names, materialise
from marketlake.llm.text_arrays import single_spaced, slices, utf8_buffer, words

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BLOCKS = ((0, 22), (22, 43), (43, 64))
#: Rows of variants made at once.
VARIANT_ROWS = 1 << 20


def _slice_fingerprints(data: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    low = data.copy()
    low[(data >= 0x41) & (data <= 0x5A)] += 0x20
    low, bounds = single_spaced(low, bounds)
    start, end = words(low, bounds)
    first = np.searchsorted(start, bounds)
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
    out = np.zeros(len(n), dtype=np.uint64)
    if not n.any():
        return out
    stop = np.cumsum(n)
    a = np.repeat(first[:-1] - (stop - n), n) + np.arange(stop[-1])
    b = np.minimum(a + size, np.repeat(first[1:], n)) - 1
    raw, digest = low.tobytes(), xxhash.xxh64_intdigest
    h = np.array([digest(raw[x:y], SEED) for x, y in zip(start[a].tolist(), end[b].tolist())], dtype=np.uint64)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = n > 0
    counts = np.add.reduceat(bits, (stop - n)[some], axis=0, dtype=np.int32)
    over = np.packbits(2 * counts > n[some, None], axis=1, bitorder="little")
    out[some] = np.ascontiguousarray(over).view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, *, text_col: str = "text", shingle: int = SHINGLE,
                 name: str = "fingerprint") -> DataFrame:
    """``docs`` with a long column ``name``: the 64-bit SimHash of the text."""
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8_buffer(batch.column(at))
            for a, b in slices(bounds):
                h = _slice_fingerprints(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a], shingle)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(h.view(np.int64))],
                                                 names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def ball_masks(max_bits: int) -> list[tuple[int, int, list[int]]]:
    """For each view: the bits it leaves out, its tag (in those bits), the flips of its ball."""
    half = (2 * max_bits // 3 + 1) // 2
    views = []
    for k, (lo, hi) in enumerate(BLOCKS):
        bits = [i for i in range(64) if not lo <= i < hi]
        flips = [sum(1 << i for i in c) for r in range(half + 1) for c in combinations(bits, r)]
        views.append((((1 << hi) - 1) ^ ((1 << lo) - 1), (k + 1) << lo, flips))
    return views


def _forest(x: np.ndarray, max_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among the fingerprints ``x``."""
    left, right, rest, todo = [], [], x, []
    while todo or len(rest):
        if not todo:
            todo, rest = [rest[0]], rest[1:]
        u = todo.pop()
        near = np.bitwise_count(rest ^ u) <= max_bits
        if near.any():
            found = rest[near]
            rest = rest[~near]
            left.append(np.full(len(found), u))
            right.append(found)
            todo.extend(found)
    return left, right


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``(a, b)`` that join all of ``distinct``'s fingerprints (column ``fp``) that are
    within ``max_bits`` of each other, directly or over others of the same variant."""
    views = [(np.uint64(~mask & (2**64 - 1)), np.uint64(tag), np.array(flips, dtype=np.uint64))
             for mask, tag, flips in ball_masks(max_bits)]
    per = sum(len(f) for _, _, f in views)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(every), VARIANT_ROWS // per):
                fp = every[i:i + VARIANT_ROWS // per]
                keys = np.concatenate([(((fp & keep) | tag)[:, None] ^ flips) for keep, tag, flips in views], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, per).view(np.int64))],
                    names=["variant", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in _then_none(batches):
            if batch is None:
                key, fp, whole = held_key, held_fp, len(held_key)
            else:
                key = np.concatenate([held_key, batch.column(0).to_numpy()])
                fp = np.concatenate([held_fp, batch.column(1).to_numpy().view(np.uint64)])
                whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last group may go on
            held_key, held_fp = key[whole:], fp[whole:]
            key, fp = key[:whole], fp[:whole]
            if len(key) < 2:
                continue
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            size, first = np.diff(edge), edge[:-1]
            two = first[size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
            left, right = [fp[two]], [fp[two + 1]]
            for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                a, b = _forest(fp[i:i + n], max_bits)
                left += a
                right += b
            a, b = np.concatenate(left), np.concatenate(right)
            links = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, k]).view(np.int64)) for k in (0, 1)],
                                             names=["a", "b"])

    return (distinct.select("fp").mapInArrow(emit, "variant long, fp long")
            .repartition("variant").sortWithinPartitions("variant")
            .mapInArrow(meet, "a long, b long"))


def _then_none(batches):
    yield from batches
    yield None


def link_components(marked: DataFrame, *, id_col: str, fp_col: str, max_bits: int = MAX_BITS) -> DataFrame:
    """``(fp, component, n)`` of each distinct fingerprint: the smallest id reachable, and its number of rows."""
    distinct = materialise(marked.groupBy(F.col(fp_col).alias("fp")).agg(
        F.min(id_col).alias("least"), F.count("*").alias("copies")), "fingerprints")
    roots = components(near_links(distinct, max_bits))
    of = materialise(distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", "copies", F.coalesce("root", "fp").alias("root")), "roots")
    least = of.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n"))
    return join_hot(of, least, "root", of.count()).select("fp", "component", F.col("copies").alias("n"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id``."""
    marked = fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                          shingle=shingle, name="fp").select("doc_id", "fp")
    marked = materialise(marked, "simhash")
    of = link_components(marked, id_col="doc_id", fp_col="fp", max_bits=max_bits)
    return join_hot(marked, materialise(of, "components"), "fp", marked.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without all but one row of each component: the row with the smallest id (a row
    without id only if none has one), of several such rows the first as they were read."""
    fp, row = free_names(docs, "simhash", "row")
    marked = materialise(fingerprints(docs, text_col=text_col, shingle=shingle, name=fp)
                         .withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    narrow = marked.select(F.col(fp).alias("simhash"), order.alias("place"))
    of = link_components(narrow, id_col="place", fp_col="simhash", max_bits=max_bits)
    kept = of.select(F.col("component.row").alias(row)).distinct()
    return marked.join(kept, row, "left_semi").drop(fp, row)
