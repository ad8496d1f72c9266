"""Operator 9, packing: concatenate and cut.

All documents' token ids, each document closed by an end id, form one long stream that is cut
into sequences of ``length`` ids. Two passes over the data, no sort and no shuffle of ids:

1. every partition tokenises its documents and writes their ids (two bytes each) with the number
   of ids that stand before them in the partition;
2. prefix sums over the partitions' totals (one number per partition) give each document its
   place in the stream, and each document is cut where a sequence ends. A document over a
   boundary gives one record on either side.

The order of the stream is (partition, row) of the written table, so a retried task repeats it.
Only one number per partition passes through the driver.

Tokenising: the vocabulary drops white space and case and splits at letters, digits and signs, so
a text's ids are those of its pieces. Pieces are found and hashed by array operations and looked
up in a table of some ``CACHE_PIECES`` pieces per Python worker by 63-bit hash; a second, independent 64-bit
hash is compared, and a piece that differs in it goes to the tokenizer, as new ones do. A run between white
space that holds anything but printable ASCII without ``'`` and the letters U+00C0-U+00FF goes to the tokenizer
whole. Ids are kept in two bytes, so a larger vocabulary is refused.

Null text counts as empty (one piece: the end id). Ids of documents are integers (a string that is none is an
error). Repeated rows are documents of their own, a null id stays null, other columns are dropped, an empty
table gives no rows. A very long text is tokenised in one task, by slices of whole documents.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.storage import materialise
from marketlake.llm.text_arrays import BASES, SPACE, runs, slices, span_hashes, utf8_buffer

LENGTH = 2048
END_ID = 1
CACHE_PIECES = 2_000_000

_OTHER, _LETTER, _DIGIT, _WHOLE = 1, 2, 3, 5
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[SPACE] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[0x21:0x7F] = True
_PLAIN[[0x27, 0x3C]] = False
_PLAIN[SPACE] = True


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for ``n`` items, at least twice as long if it has to grow."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])


class PieceTokenizer:
    """Ids of many texts at once; see the module's text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path}: ids of more than two bytes cannot be packed")
        self.piece = self.whole.model
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: shown.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.clear()

    def clear(self) -> None:
        # hash table with linear probing: key -> row of the list of ids; key 0 marks a free slot
        self.keys = np.zeros(2 * CACHE_PIECES, dtype=np.uint64)
        self.rows = np.zeros(2 * CACHE_PIECES, dtype=np.int32)
        self.n = 0
        self.checks = np.zeros(1 << 17, dtype=np.uint64)
        self.first = np.zeros(1 << 17, dtype=np.int64)
        self.flat = np.zeros(1 << 18, dtype=np.uint16)

    def _ids(self, piece: bytes, plain: bool) -> list[int]:
        text = piece.decode("utf-8", "replace")
        if plain:
            return [t.id for t in self.piece.tokenize(text if text.isascii() else text.translate(self.shown))]
        return self.whole.encode(text, add_special_tokens=False).ids

    def _append(self, checks: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """Rows of new lists of ids."""
        n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        rows = np.arange(self.n, self.n + len(ids))
        self.first = _room(self.first, self.n + len(ids) + 1)
        self.checks = _room(self.checks, self.n + len(ids))
        self.checks[rows] = checks
        self.first[rows + 1] = self.first[self.n] + np.cumsum(n)
        self.flat = _room(self.flat, int(self.first[self.n + len(ids)]))
        self.flat[self.first[self.n]:self.first[self.n + len(ids)]] = list(chain.from_iterable(ids))
        self.n += len(ids)
        return rows

    def _add(self, keys: np.ndarray, checks: np.ndarray, ids: list[list[int]]) -> None:
        """Enter new, distinct keys with their lists of ids."""
        rows = self._append(checks, ids)
        if 3 * self.n > 2 * len(self.keys):  # only a document of millions of pieces gets here
            old = self.keys > 0
            keys, rows = np.concatenate([self.keys[old], keys]), np.concatenate([self.rows[old], rows])
            self.keys, self.rows = (np.zeros(4 * len(keys), x.dtype) for x in (self.keys, self.rows))
        slot = (keys % np.uint64(len(self.keys))).astype(np.int64)
        while len(keys):  # each round fills free slots, one key a slot, and moves the others on
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.rows[slot[put]] = keys[put], rows[put]
            rest = np.ones(len(keys), dtype=bool)
            rest[put] = False
            keys, rows, slot = keys[rest], rows[rest], (slot[rest] + 1) % len(self.keys)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is new."""
        size = np.uint64(len(self.keys))
        slot = (keys % size).astype(np.int64)
        at = self.keys[slot]
        out = np.where(at == keys, self.rows[slot], -1)
        rest = np.flatnonzero((at != keys) & (at != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) % len(self.keys)
            at = self.keys[slot[rest]]
            hit = at == keys[rest]
            out[rest[hit]] = self.rows[slot[rest[hit]]]
            rest = rest[~hit & (at != 0)]
        return out

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by document) of the documents ``data[bounds[i]:bounds[i + 1]]``."""
        if self.n > CACHE_PIECES:
            self.clear()
        low = data.copy()
        upper = (data >= 0x41) & (data <= 0x5A)
        second = np.zeros(len(data), dtype=bool)  # second bytes of U+00C0-U+00FF
        second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0)
        upper |= second & (data <= 0x9E) & (data != 0x97)
        low[upper] += 0x20
        plain = _PLAIN[data]
        letter = second & (data != 0x97) & (data != 0xB7)
        plain |= letter
        plain[:-1] |= letter[1:]
        kind = _KIND[data]
        digits = np.flatnonzero(kind == _DIGIT)
        kind[digits] = _DIGIT + (digits & 1)  # neighbouring digits are pieces of their own
        other = np.flatnonzero(~plain)
        if len(other):  # runs between white space that hold other bytes stay whole
            start, end = runs((kind > 0).view(np.uint8), bounds)
            odd = np.unique(np.searchsorted(start, other, side="right") - 1)
            for a, b in zip(start[odd].tolist(), end[odd].tolist()):
                kind[a:b] = _WHOLE
                low[a:b] = data[a:b]
        start, end = runs(kind, bounds)
        if not len(start):
            return np.zeros(0, np.uint16), np.zeros(len(bounds), np.int64)
        whole = kind[start] == _WHOLE
        keys = (span_hashes(low, start, end) ^ whole) | np.uint64(2)
        checks = span_hashes(low, start, end, BASES[1]) ^ whole
        raw = low.tobytes()

        def encoded(j: np.ndarray) -> list[list[int]]:
            return [self._ids(raw[a:b], not w) for a, b, w in zip(start[j].tolist(), end[j].tolist(), whole[j].tolist())]

        at = self._find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            _, first = np.unique(keys[new], return_index=True)
            j = new[first]
            self._add(keys[j], checks[j], encoded(j))
            at[new] = self._find(keys[new])
        other = np.flatnonzero(self.checks[at] != checks)
        if len(other):  # another piece has this key: its ids stand beside the table
            at[other] = self._append(checks[other], encoded(other))
        n = self.first[at + 1] - self.first[at]
        stop = np.cumsum(n)
        ids = self.flat[np.repeat(self.first[at] - stop + n, n) + np.arange(stop[-1])]
        total = np.concatenate([[0], stop])
        return ids, total[np.searchsorted(start, bounds, side="left")]


_tokenizers: dict[str, PieceTokenizer] = {}


def tokenise(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text",
             end_id: int = END_ID) -> DataFrame:
    """One row per document: ``doc_id``, ``part``, ``before`` (ids before it in its partition),
    ``n`` (its ids with the end id), ``ids`` (little-endian, two bytes each)."""
    schema = "doc_id long, part int, before long, n long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = _tokenizers.get(vocabulary) or _tokenizers.setdefault(vocabulary, PieceTokenizer(vocabulary))
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, bounds = utf8_buffer(batch.column(1))
            for a, b in slices(bounds):
                own = bounds[a:b + 1] - bounds[a]
                ids, at = tokenizer(data[bounds[a]:bounds[b]], own)
                raw = np.insert(ids.astype("<u2"), at[1:], end_id).tobytes()
                at = at + np.arange(len(at))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)),
                    pa.array(before + at[:-1]), pa.array(np.diff(at)),
                    pa.array([raw[2 * x:2 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()),
                ], names=["doc_id", "part", "before", "n", "ids"])
                before += int(at[-1])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str | None = None, *, length: int = LENGTH, end_id: int = END_ID,
         with_ids: bool = False, **columns: str) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    and, if asked for, ``ids`` (binary, little-endian unsigned 32-bit)."""
    tokens = materialise(tokenise(docs, vocabulary or public_vocabulary(), end_id=end_id, **columns), "packing-ids")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row per partition
    base, at = {}, 0
    for row in totals:
        base[row["part"]], at = at, at + row["n"]
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + ", ids binary" * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            begin = np.array([base[p] for p in batch.column(1).to_pylist()], dtype=np.int64) + batch.column(2).to_numpy()
            n = batch.column(3).to_numpy()
            first, last = begin // length, (begin + n - 1) // length
            row = np.repeat(np.arange(len(n)), last - first + 1)
            sequence = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
            a = np.maximum(sequence * length, begin[row])
            b = np.minimum((sequence + 1) * length, (begin + n)[row])
            start, raw = a - begin[row], batch.column(4)
            pieces, crc = [], np.empty(len(row), dtype=np.int64)
            for i, (r, s, k) in enumerate(zip(row.tolist(), start.tolist(), (b - a).tolist())):
                ids = np.frombuffer(raw[r].as_buffer(), dtype="<u2", count=k, offset=2 * s).astype("<u4").tobytes()
                crc[i] = zlib.crc32(ids)
                if with_ids:
                    pieces.append(ids)
            out = dict(zip(names, (start, b - a, crc, n[row], sequence, a - sequence * length)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), *(pa.array(out[k].astype(np.int64)) for k in names),
                 *([pa.array(pieces, pa.binary())] if with_ids else [])],
                names=["doc_id", *names, *(["ids"] if with_ids else [])])

    return tokens.select("doc_id", "part", "before", "n", "ids").mapInArrow(cut, schema)
