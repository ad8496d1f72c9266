"""Operator 12, fill-in-middle: a document's text is cut at two of its units and its parts are put in another order.

The ends of a text's units are a boundary set (``boundary_set``: array, bitmap and run containers with cumulative
cardinalities); the two cuts are selects on it. Units are words with the white space before them (white space at the
end of the text is one of its own), or code points. Cuts and form come from ``sha256`` of the seed and the document's
id, so a document's row depends on nothing but itself: one pass, no shuffle, and a retried task repeats it.

A text that is empty or holds one of the three marks stays plain, so that ``restore`` can rebuild every text from
output and form.

Null text counts as empty. Repeated rows give repeated rows. A null id is hashed as the empty string and stays null; ids may be
of any type that has a text form. Very long texts are handled one at a time; the set takes two bytes a boundary at most, a bitmap
one bit an offset. Other columns are not looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.boundary_set import BoundarySet
from marketlake.llm.text_arrays import SPACE, slices, utf8_buffer

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 documents, those that are cut; of 100 cut ones, those with the suffix first.
RATE, SPM_RATE = 50, 80


def word_ends(data: np.ndarray) -> np.ndarray:
    """Byte offsets 0 and the end of every unit ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``."""
    word = np.append(~SPACE[data], False)
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    tail = [len(data)] if len(data) and not word[len(data) - 1] else []
    return np.concatenate([[0], ends, tail]).astype(np.int64)


def code_point_ends(data: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)).astype(np.int64)


UNITS = {"word": word_ends, "code point": code_point_ends}


def _code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def rearranged(text: bytes, doc_id: object, *, unit: str = "word", seed: int = SEED, rate: int = RATE,
               spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, bytes]:
    """(number of units, form, code points of prefix and of middle, output) of one document."""
    data = np.frombuffer(text, dtype=np.uint8)
    ends = BoundarySet(UNITS[unit](data))
    n = len(ends) - 1
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))
    if not text or h3 % 100 >= rate or any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (ends.select(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = PREFIX.encode() + text[:a], MIDDLE.encode() + text[a:b], SUFFIX.encode() + text[b:]
    spm = h4 % 100 < spm_rate
    output = suffix + prefix + middle if spm else prefix + suffix + middle
    return n, "spm" if spm else "psm", _code_points(data[:a]), _code_points(data[a:b]), output


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8_buffer(batch.column(1))
            shown = batch.column(2).to_pylist()
            for first, last in slices(bounds):
                rows = [rearranged(data[bounds[i]:bounds[i + 1]].tobytes(), shown[i], **options) for i in range(first, last)]
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                     pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                    names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"),
                       F.col(id_col).cast("string").alias("shown")).mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text of an output. No part holds a mark, so the first of each mark is the one that was put in."""
    after = lambda text, mark: F.substr(text, F.locate(mark, text) + len(mark))
    before = lambda text, mark: F.substring_index(text, mark, 1)
    middle = after(output, MIDDLE)
    spm = F.concat(before(after(output, PREFIX), MIDDLE), middle, before(after(output, SUFFIX), PREFIX))
    psm = F.concat(before(after(output, PREFIX), SUFFIX), middle, before(after(output, SUFFIX), MIDDLE))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
