"""Operator 13, cross-tokenizer alignment: the groups of two tokenizers' tokens that cover the same bytes.

Both tokenizers see a space and then the text. A *unit* is a space with what stands before the next space that
follows a non-space character. Neither tokenizer has a token over the start of a unit (A splits there before it
merges; no piece of B's vocabulary holds a space after anything but spaces, which is checked when it is loaded), so a
text's tokens are those of its units and both sides end together at a unit's end.

- Texts of at most ``CHUNK_BYTES`` are put together from a table of units per Python worker (``CACHE_UNITS`` units at
  most; others are made as they come): nothing is shuffled.
- Longer texts are dealt to tasks in pieces that end at a unit. A piece gives one fragment for each byte range of
  ``CHUNK_BYTES`` that its tokens end in: open prefix, closed groups, open suffix (``fragments``). A tree of
  ``FAN`` fragments a step composes them across tasks. Copies of a long text are one row with a count.

Links are counted over the corpus in one table. Linked tokens end at the same byte, so the shorter one's bytes end the
longer one's: the pairs that can be linked follow from the vocabularies (324,302 for the default ones), whatever the
corpus. So tasks count in an array of that length, one row per pair and task is shuffled, and the total is sent to
the tasks, which read the written links again for ``n_best`` and ``count_sum``.

Texts that are null, empty, or that a tokenizer does not give back byte for byte have no tokens: zeros and no digest. Every row is a
document of its own, repeated rows too. A null id stays null; ids may be of any type that can be grouped. A text without
spaces is one unit and is tokenised in one task. Other columns are not looked at, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.fragments import EMPTY, Fragment, compose, finish, fragment, groups_text, link
from marketlake.llm.storage import materialise

CHUNK_BYTES = 1 << 16
FAN = 16
CACHE_UNITS = 400_000
CACHE_CHARS = 1 << 25
#: Documents are taken in slices of this many characters.
SLICE_CHARS = 1 << 20

_ODD = re.compile(r"\A |\s | \Z")
_CUT = re.compile(r"(?<=\S) (?=[\s\S])")
_BYTE = re.compile("<0x([0-9A-F]{2})>")


def public_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def units(text: str) -> list[str]:
    """The units of space + text, without their first space."""
    parts = text.split(" ")
    if not _ODD.search(text):
        return parts
    out = [parts[0]]
    for part in parts[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    if len(out) > 1 and not out[-1]:  # a space at the end, after a word
        out[-2:] = [out[-2] + " "]
    return out


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in A's vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Tokens, groups and links of units, many at once; holds the two tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        self.bytes_a: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b: list[bytes] = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if re.search("[^▁]▁", piece):
                raise ValueError(f"piece {i} holds a space inside: texts can't be cut at spaces")
            hex_byte = _BYTE.fullmatch(piece)
            self.bytes_b.append(bytes([int(hex_byte[1], 16)]) if hex_byte else piece.replace("▁", " ").encode())
        self.length_a, self.length_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.pairs = self._pairs()
        self.clear()

    def _pairs(self) -> np.ndarray:
        """All pairs that can be linked, ascending (by B's id first)."""
        ids_a, ids_b = {}, {}
        for table, tokens in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            for i, token in enumerate(tokens):
                table.setdefault(token, []).append(i)
        found = {link(a, b) for s, of_a in ids_a.items() for k in range(len(s)) for b in ids_b.get(s[k:], ()) for a in of_a}
        found |= {link(a, b) for s, of_b in ids_b.items() for k in range(1, len(s)) for a in ids_a.get(s[k:], ()) for b in of_b}
        return np.array(sorted(found), dtype=np.int64)

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.text: list[str] = []  # groups of a unit
        self.numbers = np.zeros((0, 4), dtype=np.int64)  # ok, tokens of A, of B, groups
        self.first = np.zeros(1, dtype=np.int64)  # of a unit's links in ``links``
        self.links = np.zeros(0, dtype=np.int32)

    def tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """A's ids and B's ids of space + text, and whether both give its bytes back."""
        spaced = [" " + t for t in texts]
        a = [x.ids for x in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        whole = "".join(spaced).encode()
        joined = lambda ids, of: b"".join([of[i] for i in ids])
        ok = np.ones(len(texts), dtype=bool)
        if not joined(chain.from_iterable(a), self.bytes_a) == whole == joined(chain.from_iterable(b), self.bytes_b):
            ok[:] = [joined(x, self.bytes_a) == t.encode() == joined(y, self.bytes_b) for t, x, y in zip(spaced, a, b)]
        return a, b, ok

    def _add(self, new: list[str]) -> None:
        tokens_a, tokens_b, ok = self.tokens(new)
        good = np.flatnonzero(ok).tolist()
        n_a, n_b = (np.array([len(x[i]) if ok[i] else 0 for i in range(len(new))], dtype=np.int64) for x in (tokens_a, tokens_b))
        a, b = (np.fromiter(chain.from_iterable(x[i] for i in good), dtype=np.int64) for x in (tokens_a, tokens_b))
        a_ends, b_ends = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        stop_a, stop_b = (np.searchsorted(x, common, side="right") for x in (a_ends, b_ends))
        unit = np.repeat(np.arange(len(new)), n_a)[stop_a - 1]  # of each group; a unit's end is a common end
        last = np.append(unit[1:] != unit[:-1], True)[:len(unit)]
        shown = groups_text(a, b, stop_a, stop_b, np.where(last, ord("\n"), ord(";"))).decode().split("\n")
        n_groups = np.bincount(unit, minlength=len(new))
        text = [""] * len(new)
        for i, t in zip(good, shown):
            text[i] = t
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.chars += sum(map(len, new))
        self.text.extend(text)
        self.numbers = np.concatenate([self.numbers, np.stack([ok, n_a, n_b, n_groups], axis=1)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n_groups)])
        self.links = np.concatenate([self.links, self.indices(link(a[stop_a - 1], b[stop_b - 1]))])

    def indices(self, links: np.ndarray | tuple[int, ...]) -> np.ndarray:
        """Places in ``pairs``."""
        links = np.asarray(links, dtype=np.int64)
        at = np.searchsorted(self.pairs, links)
        if not np.array_equal(self.pairs[np.minimum(at, len(self.pairs) - 1)], links):
            raise AssertionError("linked tokens that do not end alike")
        return at.astype(np.int32)

    def rows(self, texts: list[str]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, digest, link indices, their counts) of each text."""
        if len(self.known) > CACHE_UNITS or self.chars > CACHE_CHARS:
            self.clear()
        parts = [units(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(parts))
        new = list(set(flat).difference(self.known))
        if new:
            self._add(new)
        at = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        stop = np.cumsum([len(p) for p in parts])
        start = stop - [len(p) for p in parts]
        total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.numbers[at], axis=0)])
        sums = total[stop] - total[start]
        ok = sums[:, 0] == stop - start
        sums[~ok] = 0
        n = np.where(np.repeat(ok, stop - start), self.first[at + 1] - self.first[at], 0)
        ends = np.cumsum(n)
        own = self.links[np.repeat(self.first[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        document = np.repeat(np.repeat(np.arange(len(texts)), stop - start), n)
        keys, counts = np.unique(document * len(self.pairs) + own, return_counts=True)
        bound = np.searchsorted(keys, np.arange(len(texts) + 1) * len(self.pairs))
        keys = (keys % len(self.pairs)).astype(np.int32)
        at, text = at.tolist(), self.text
        for i, (a, b, lo, hi) in enumerate(zip(start.tolist(), stop.tolist(), bound.tolist(), bound[1:].tolist())):
            whole = ";".join([text[u] for u in at[a:b]]) if ok[i] else ""
            yield (*sums[i, 1:].tolist(), hashlib.sha256(whole.encode()).hexdigest() if whole else "", keys[lo:hi], counts[lo:hi])


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    return _aligners.get(paths) or _aligners.setdefault(paths, Aligner(*paths))


_RESULT = ["n_a", "n_b", "n_groups", "groups_sha256", "pair", "occurs"]
_RESULT_TYPES = "n_a long, n_b long, n_groups long, groups_sha256 string, pair array<int>, occurs array<long>"
_PIECE = "mark long, size long, copies long"
_FRAGMENT_TYPES = ("chunk int, piece int, ok boolean, closed boolean, prefix_a array<int>, prefix_b array<int>, groups string, "
                   "n_groups long, n_a long, n_b long, links array<long>, suffix_a array<int>, suffix_b array<int>")
_ARROW = [pa.bool_(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.int64(), pa.int64(), pa.int64(),
          pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]


def _fragment_columns(fragments: list[Fragment]) -> list[pa.Array]:
    return [pa.array([f[i] for f in fragments], kind) for i, kind in enumerate(_ARROW)]


def _result_columns(rows: list[tuple]) -> list[pa.Array]:
    offsets = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])]).astype(np.int32)
    lists = [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0) for i in (4, 5)]
    return [*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string()),
            *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(t))) for x, t in zip(lists, (np.int32, np.int64)))]


def _short(docs: DataFrame, id_type: str, paths: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = aligner(paths)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            first = 0
            while first < len(texts):
                last, chars = first, 0
                while last < len(texts) and chars < SLICE_CHARS:
                    chars, last = chars + len(texts[last]), last + 1
                rows = list(make.rows(texts[first:last]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *_result_columns(rows)], names=["id", *_RESULT])
                first = last

    return docs.mapInArrow(run, f"id {id_type}, {_RESULT_TYPES}").withColumn("copies", F.lit(1).cast("long"))


def _pieces(docs: DataFrame, id_type: str, chunk: int) -> DataFrame:
    """Pieces of some ``chunk`` characters that end at a unit, with their first byte in space + text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                at, base, no = 0, 0, 0
                while at < len(text):
                    cut = _CUT.search(text, at + chunk)
                    end = cut.start() if cut else len(text)
                    piece = text[at:end]
                    yield pa.RecordBatch.from_arrays(
                        [*(c.slice(i, 1) for c in (batch.column(0), batch.column(2), batch.column(3), batch.column(4))),
                         pa.array([no], pa.int32()), pa.array([base], pa.int64()), pa.array([piece], pa.string())],
                        names=["id", "mark", "size", "copies", "piece", "base", "text"])
                    at, base, no = end + 1, base + 1 + len(piece.encode()), no + 1

    return docs.mapInArrow(run, f"id {id_type}, {_PIECE}, piece int, base long, text string")


def _piece_fragments(pieces: DataFrame, id_type: str, paths: tuple[str, str], chunk: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = aligner(paths)
        for batch in batches:
            for i, (piece, base, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (4, 5, 6)))):
                (a,), (b,), (ok,) = make.tokens([text])
                if ok:
                    a, b = np.array(a), np.array(b)
                    ends_a, ends_b = base + np.cumsum(make.length_a[a]), base + np.cumsum(make.length_b[b])
                    ranges = np.arange((base + 1) // chunk, (int(ends_a[-1]) - 1) // chunk + 1)
                    cut_a, cut_b = (np.searchsorted(e, np.append(ranges, ranges[-1] + 1) * chunk, side="right") for e in (ends_a, ends_b))
                    fragments = [fragment(a[w:x], ends_a[w:x], b[y:z], ends_b[y:z])
                                 for w, x, y, z in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]
                else:
                    ranges, fragments = np.array([base // chunk]), [EMPTY._replace(ok=False)]
                n = len(fragments)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(np.full(n, i))) for c in range(4)), pa.array(ranges.astype(np.int32)),
                     pa.array(np.full(n, piece, np.int32)), *_fragment_columns(fragments)],
                    names=["id", "mark", "size", "copies", "chunk", "piece", *Fragment._fields])

    return pieces.mapInArrow(run, f"id {id_type}, {_PIECE}, {_FRAGMENT_TYPES}")


def _tree_step(fragments: DataFrame, fan: int) -> DataFrame:
    """Every ``fan`` neighbouring byte ranges of a document become one."""
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["chunk"], r["piece"]))
        out = EMPTY
        for r in rows:
            out = compose(out, Fragment(*(tuple(r[c]) if isinstance(r[c], list) else r[c] for c in Fragment._fields)))
        one = group.slice(0, 1).select(["id", "mark", "size", "copies"]).columns
        return pa.Table.from_arrays([*one, pa.array([rows[0]["chunk"] // fan], pa.int32()), pa.array([0], pa.int32()),
                                     *_fragment_columns([out])], names=group.column_names)

    part = F.floor(F.col("chunk") / fan).cast("int").alias("part")
    return fragments.groupBy("id", "mark", "size", "copies", part).applyInArrow(run, fragments.schema)


def _finished(fragments: DataFrame, id_type: str, paths: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = aligner(paths)
        for batch in batches:
            rows = []
            for r in batch.select(list(Fragment._fields)).to_pylist():
                f = finish(Fragment(**r))
                pair, occurs = np.unique(make.indices(f.links), return_counts=True)
                rows.append((f.n_a, f.n_b, f.n_groups, hashlib.sha256(f.groups.encode()).hexdigest() if f.groups else "", pair, occurs))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_result_columns(rows), batch.column(3)], names=["id", *_RESULT, "copies"])

    return fragments.mapInArrow(run, f"id {id_type}, {_RESULT_TYPES}, copies long")


def _long(docs: DataFrame, id_type: str, paths: tuple[str, str], chunk: int, fan: int) -> DataFrame:
    texts = docs.groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.select("id", "text", F.xxhash64("text").alias("mark"), F.octet_length("text").cast("long").alias("size"), "copies")
    pieces = _pieces(texts, id_type, chunk).repartition("id", "mark", "piece")
    fragments = materialise(_piece_fragments(pieces, id_type, paths, chunk), "alignment-fragments")
    top = fragments.agg(F.max("chunk")).first()[0] or 0
    while True:
        fragments, top = _tree_step(fragments, fan), top // fan
        if top == 0:
            return _finished(fragments, id_type, paths)


def _totals(found: DataFrame, paths: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """(corpus-wide count, count is the highest of its B id) by pair; one row per pair reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(aligner(paths).pairs), dtype=np.int64)
        for batch in batches:
            pair, occurs = batch.column(0), batch.column(1)
            times = np.repeat(batch.column(2).to_numpy(), pa.compute.list_value_length(pair).to_numpy())
            np.add.at(total, pair.flatten().to_numpy(), occurs.flatten().to_numpy() * times)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["pair", "n"])

    pairs = Aligner(*paths).pairs
    sums = found.select("pair", "occurs", "copies").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(pairs), dtype=np.int64)
    total[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    side_b = pairs >> 32
    first = np.flatnonzero(np.diff(side_b, prepend=-1))
    highest = np.repeat(np.maximum.reduceat(total, first), np.diff(first, append=len(pairs)))
    return total, total == highest


def align(docs: DataFrame, paths: tuple[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text",
          chunk: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document. ``paths`` are the files of
    a byte-level BPE (A) and of a piece model (B)."""
    paths = paths or public_vocabularies()
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    both = _short(docs.where(~is_long), id_type, paths).unionByName(_long(docs.where(is_long), id_type, paths, chunk, fan))
    found = materialise(both, "alignment-links")
    sums = docs.sparkSession.sparkContext.broadcast(_totals(found, paths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, best = sums.value
        for batch in batches:
            pair, occurs = batch.column("pair"), batch.column("occurs").flatten().to_numpy()
            at, n = pair.flatten().to_numpy(), pa.compute.list_value_length(pair).to_numpy()
            stop = np.cumsum(n)
            sums_of = lambda x: (lambda t: t[stop] - t[stop - n])(np.concatenate([[0], np.cumsum(x)]))
            links, n_best, count_sum = sums_of(occurs), sums_of(occurs * best[at]), sums_of(occurs * total[at])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "n_a", "n_b", "n_groups")), *(pa.array(x.astype(np.int64)) for x in (links, n_best, count_sum)),
                 batch.column("groups_sha256"), batch.column("copies")],
                names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "copies"])

    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = f"`{id_col}` {id_type}, {', '.join(f'{c} long' for c in names)}, groups_sha256 string, copies long"
    rows = found.mapInArrow(run, schema)
    return rows.select(*rows.columns[:-1], F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")
