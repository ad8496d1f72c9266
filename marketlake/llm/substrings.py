"""Operator 4, substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the smallest hash among
its runs of ``minimiser`` words. Consecutive windows that share a minimiser travel as one packed
string (a super-k-mer) to the bucket of that minimiser, so a word is sent about three times and not
``window`` times, and equal windows always meet. There their hashes are sorted and equal neighbours
are compared word for word. A window found twice or more covers its words, wherever it stands.

Before anything is sent, each chunk of ``CHUNK_BYTES`` of text sorts its own windows: those that
repeat inside the chunk are settled, and only the first of them travels. So a passage that stands in
a third of all documents sends one string per chunk and not one per document. A super-k-mer whose
minimiser nobody shares is dropped without being read.

A phrase shorter than a window may stand in very many documents between other words. If one of its runs were the
minimiser of all those windows, they would meet in one bucket. So runs that are common are taken as minimisers only
where a window holds no other: ``common_runs`` counts, over ``STEER`` of the documents, in how many of them the runs of each
of 2^20 hash slots stand. The choice of a minimiser is still one function of a window's words for the
whole job, so equal windows meet whatever those counts say; they steer rows and decide nothing.

Windows are judged on the input alone. Ids are integers (a string that is none is an error). A document is known by its id and its text's hash, so rows
that repeat both have one result, which stands on each of them. Null text has no words. A null id
stays null, other columns are dropped, an empty table gives no rows, and a document of fewer than
``window`` words keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.text_arrays import (gram_hashes, mix, single_spaced, sliding_min, slices, span_hashes,
                                        utf8_buffer, words)

WINDOW = 35
MINIMISER = 4
#: zstandard level of what is sent.
LEVEL = 9
CHUNK_BYTES = 8 << 20
#: Parts of a task's bucket, each sorted on its own.
PARTS = 4
#: Share of the documents that common runs are counted in, slots of runs, and what makes a slot common: the share of
#: those documents that hold it, and their least number.
STEER, SLOT_BITS, COMMON_SHARE, COMMON_LEAST = 0.01, 20, 0.005, 8

_SKMER = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()),
                    ("start", pa.int64()), ("packed", pa.large_binary())])
_COVER = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(
            compression=pa.Codec("zstd", LEVEL))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blobs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])


class _Words:
    """The words of some texts: one buffer with single spaces, places and hashes of the words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        raw, start, end, hashed, first, at, n = [], [], [], [], [np.zeros(1, np.int64)], 0, 0
        for a, b in slices(bounds):
            d, own = single_spaced(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a])
            s, e = words(d, own)
            raw.append(d.tobytes())
            start.append(s + at)
            end.append(e + at)
            hashed.append(span_hashes(d, s, e))
            first.append(np.searchsorted(s, own[1:]) + n)
            at, n = at + len(d), n + len(s)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.raw, self.start, self.end = b"".join(raw), join(start, np.int64), join(end, np.int64)
        self.hash, self.first = join(hashed, np.uint64), np.concatenate(first)
        self.doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, size: int) -> np.ndarray:
        """Places of the windows that lie in one text."""
        if len(self.hash) < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[size - 1:] == self.doc[:len(self.doc) - size + 1])

    def groups(self, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(order, group): a stable order of the windows at ``places`` in which equal ones stand
        together, and the group of each in that order, equal for windows of equal words."""
        key = gram_hashes(self.hash, size)[places]
        order = np.argsort(key, kind="stable")
        key, at = key[order], places[order]
        same = np.concatenate([[False], key[1:] == key[:-1]])
        group = np.cumsum(~same) - 1
        a, b, raw = self.start[at].tolist(), self.end[at + size - 1].tolist(), self.raw
        clash = {int(group[i]) for i in np.flatnonzero(same).tolist() if raw[a[i - 1]:b[i - 1]] != raw[a[i]:b[i]]}
        for g in clash:  # different words of one hash
            seen: dict[bytes, int] = {}
            for i in np.flatnonzero(group == g).tolist():
                group[i] = seen.setdefault(raw[a[i]:b[i]], int(group.max()) + 1)
        return order, group

    def covers(self, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, lo, hi): the words of the windows at the ascending ``places``, as ranges."""
        if not len(places):
            return (np.zeros(0, np.int64),) * 3
        doc = self.doc[places]
        cut = np.concatenate([[True], (np.diff(places) > size) | (doc[1:] != doc[:-1])])
        last = np.concatenate([np.flatnonzero(cut)[1:] - 1, [len(places) - 1]])
        doc = doc[cut]
        return doc, places[cut] - self.first[doc], places[last] + size - self.first[doc]


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def common_runs(docs: DataFrame, gram: int, share: float = STEER) -> np.ndarray:
    """True for each hash slot whose runs stand in many documents. At most 2^20 numbers reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << SLOT_BITS, np.int64), 0
        for batch in batches:
            data, bounds = utf8_buffer(batch.column(0))
            n += batch.num_rows
            for a, b in slices(bounds):
                w = _Words(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a])
                at = w.windows(gram)
                keys = np.unique((w.doc[at] << SLOT_BITS) | _slots(gram_hashes(w.hash, gram)[at]))
                total += np.bincount(keys & ((1 << SLOT_BITS) - 1), minlength=1 << SLOT_BITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["slot", "n"])

    counts = docs.select("text").sample(share, 7).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counts.where((F.col("slot") < 0) | (F.col("n") >= COMMON_LEAST)).toArrow()
    slots, n = found.column(0).to_numpy(), found.column(1).to_numpy()
    slots = slots[(slots >= 0) & (n >= COMMON_SHARE * n[slots < 0].sum())]
    out = np.zeros(1 << SLOT_BITS, dtype=bool)
    out[slots] = True
    return out


def _chunk(ids: pa.Array, hashes: pa.Array, data: np.ndarray, bounds: np.ndarray, size: int, gram: int,
           buckets: int, common: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes]]:
    """What one chunk sends: (task, part, packed rows); part -1 has what is settled here."""
    w = _Words(data, bounds)
    places = w.windows(size)
    if not len(places):
        return
    order, group = w.groups(places, size)
    count = np.bincount(group)
    _, leader = np.unique(group, return_index=True)  # the order is stable: the first of its group
    doc, lo, hi = w.covers(np.sort(places[order[count[group] > 1]]), size)
    if len(doc):
        where = (hashes.to_numpy()[doc].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        for k in np.unique(where).tolist():
            i = np.flatnonzero(where == k)
            rows = pa.array(doc[i])
            yield k, -1, _pack(pa.RecordBatch.from_arrays(
                [ids.take(rows), hashes.take(rows), pa.array(lo[i]), pa.array(hi[i])], schema=_COVER))
    sent = np.sort(places[order[leader]])
    grams = gram_hashes(w.hash, gram)
    if common is not None:  # common runs stand behind all others
        grams = (grams >> np.uint64(1)) | (common[_slots(grams)].astype(np.uint64) << np.uint64(63))
    least = sliding_min(grams, size - gram + 1)[sent]
    cut = np.concatenate([[True], (np.diff(sent) != 1) | (least[1:] != least[:-1])])
    first = sent[cut]
    last = sent[np.concatenate([np.flatnonzero(cut)[1:] - 1, [len(sent) - 1]])] + size - 1
    bucket = mix(least[cut])
    place = bucket % np.uint64(buckets * PARTS)
    order = np.argsort(place, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) != 0, [True]]))
    a, b, raw = w.start[first].tolist(), w.end[last].tolist(), w.raw
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
        i = order[x:y]
        rows = pa.array(w.doc[first[i]])
        packed = pa.array([raw[a[j]:b[j]] for j in i.tolist()], pa.large_binary())
        key = int(place[i[0]])
        yield key // PARTS, key % PARTS, _pack(pa.RecordBatch.from_arrays(
            [pa.array(bucket[i].view(np.int64)), ids.take(rows), hashes.take(rows),
             pa.array(first[i] - w.first[w.doc[first[i]]]), packed], schema=_SKMER))


def _count(table: pa.Table, size: int) -> pa.RecordBatch | None:
    """The words covered by windows that stand more than once in one part of a bucket."""
    _, back, shared = np.unique(table["bucket"].to_numpy(), return_inverse=True, return_counts=True)
    table = table.filter(pa.array(shared[back] > 1)).combine_chunks()
    if not len(table):
        return None
    packed = table["packed"].chunk(0)
    w = _Words(*utf8_buffer(packed))
    places = w.windows(size)
    order, group = w.groups(places, size)
    doc, lo, hi = w.covers(np.sort(places[order[np.bincount(group)[group] > 1]]), size)
    if not len(doc):
        return None
    rows, start = pa.array(doc), table["start"].to_numpy()[doc]
    return pa.RecordBatch.from_arrays([table["doc_id"].chunk(0).take(rows), table["text_hash"].chunk(0).take(rows),
                                       pa.array(lo + start), pa.array(hi + start)], schema=_COVER)


def repeated_words(docs: DataFrame, *, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """``(doc_id, text_hash, lo, hi)``: word ranges covered by windows that stand anywhere else;
    ranges of a document may overlap. ``docs`` has ``doc_id, text_hash, text``."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = np.packbits(common_runs(docs, minimiser))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(packed).astype(bool)
        for batch in batches:
            data, bounds = utf8_buffer(batch.column(2))
            for a, b in slices(bounds, CHUNK_BYTES):
                own = bounds[a:b + 1] - bounds[a]
                for task, part, blob in _chunk(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                                               data[bounds[a]:bounds[b]], own, window, minimiser, buckets, common):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([task], pa.int32()), pa.array([part], pa.int32()), pa.array([blob], pa.binary())],
                        names=["task", "part", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blobs = None, []
        for batch in batches:
            for task, part, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if part < 0:
                    yield from _unpack([blob]).to_batches()
                    continue
                if held != (task, part):
                    if blobs and (found := _count(_unpack(blobs), window)):
                        yield found
                    held, blobs = (task, part), []
                blobs.append(blob)
        if blobs and (found := _count(_unpack(blobs), window)):
            yield found

    return (docs.select("doc_id", "text_hash", "text").mapInArrow(emit, "task int, part int, blob binary")
            .repartitionById(buckets, F.col("task")).sortWithinPartitions("task", "part")
            .mapInArrow(count, "doc_id long, text_hash long, lo long, hi long"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   minimiser: int = MINIMISER) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept`` (the other words, one space apart)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("text_hash"))
    covers = repeated_words(docs, window=window, minimiser=minimiser).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    joined = docs.alias("d").join(covers.alias("c"), F.expr("d.doc_id <=> c.doc_id AND d.text_hash = c.text_hash"), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8_buffer(batch.column(1))
            for a, b in slices(bounds):
                total, removed, kept = [], [], []
                for i, ranges in zip(range(a, b), batch.column(2).slice(a, b - a).to_pylist()):
                    w = data[bounds[i]:bounds[i + 1]].tobytes().split()
                    n, stay, at = len(w), [], 0
                    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
                        stay += w[at:lo] if lo > at else []
                        at = max(at, hi)
                    stay = w if at == 0 else stay + w[at:]
                    total.append(n)
                    removed.append(n - len(stay))
                    kept.append(b" ".join(stay).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.select("d.doc_id", "d.text", "c.ranges").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept string")
