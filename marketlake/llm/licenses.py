"""Operator 8, license scans by conditional compression.

Candidates are the lines with a license word, joined with such lines at most ``NEAR_LINES`` further on; in them the words
around each license word are a block, in the three sizes of ``REACHES``, widest first. A
block is compressed alone and with each template as a raw zstandard dictionary; templates are ranked by the share
of the block's size that this saves, and those that save anything are confirmed, best first, by their
exact wording: the template's words are aligned with the block's, and the words that one side has and the other
has not are counted and reported. A template is found if they are at most ``MAX_DIFFERENCE`` of its words and none tells
licenses apart (``IDENTITY``, or a version number). Words
found belong to one license; the license words left over are judged on.

Whole texts are read and each document is on its own: one pass, no shuffle. A notice without any of the license
words ``TRIGGERS`` is not looked at; every license word costs up to three rankings of all templates, so a very long text
full of them is slow, yet in one worker of its own. Null and empty texts have no blocks;
repeated rows and null ids stay; other columns are dropped; an empty table gives no rows; of equal savings the
template listed first wins.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEAR_LINES = 2
MAX_DIFFERENCE = 0.2
#: Words that name a license: a template that lacks or has one of them besides is another license's.
IDENTITY = frozenset("lesser library affero gnu apache mozilla bsd agpl lgpl gpl only later by-nc by-sa by-nd by-nc-sa by-nc-nd".split())
#: Words on either side of a license word that are compressed at once: first enough for the longest template,
#: then few enough for a short one to show among other words.
REACHES = (160, 48, 10)
LEVEL = 3

TRIGGERS = ("licen", "copyright", "rights reserved", "warrant", "permission is", "redistribut", "public domain")
_TRIGGER = re.compile("|".join(TRIGGERS), re.I)
_NUMBER = re.compile(r"[0-9]|^v[0-9]")
_WORD = re.compile(r"[0-9A-Za-z]+(?:[.-][0-9A-Za-z]+)*")

_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:")
_BSD_2 = (" Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
          "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
          "following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_3 = (" Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
          "products derived from this software without specific prior written permission.")

# Short notices of public licenses, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation, either version 3 of the "
                         "License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation; either version 2 of the "
                         "License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                          "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
                          "License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                          "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
                          "License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                          "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                          "License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This work is licensed under the GNU General Public License, version 3 or any later version."),
    ("GPL-2.0-or-later", "This work is licensed under the GNU General Public License, version 2 or any later version."),
    ("LGPL-2.1-only", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    # the first sentence is the same in both, so alone it names neither
    ("LicenseRef-BSD", _BSD),
    ("BSD-2-Clause", _BSD + _BSD_2),
    ("BSD-3-Clause", _BSD + _BSD_2 + _BSD_3),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
)

FOUND = "array<struct<license:string,start:long,end:long,saving:double,missing:array<string>,added:array<string>>>"


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.templates = []
        for name, text in templates:
            known = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)
            self.templates.append((name, packer, [w.lower() for w in _WORD.findall(text)]))

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the groups of lines with a license word."""
        out: list[list[int]] = []
        last = -NEAR_LINES - 2
        line = at = 0
        for m in _TRIGGER.finditer(text):
            if m.start() < at:
                continue
            start = text.rfind("\n", 0, m.start()) + 1
            line += text.count("\n", at, start)
            end = text.find("\n", m.start())
            end = len(text) if end < 0 else end
            if line - last <= NEAR_LINES + 1 and out:
                out[-1][1] = end
            else:
                out.append([start, end])
            last, at = line, end
        return [(a, b) for a, b in out]

    def _align(self, template: list[str], words: list[str]) -> tuple[int, int, list[str], list[str]] | None:
        """(first, last + 1, missing, added): the stretch of ``words`` nearest to the template."""
        aligned = SequenceMatcher(None, template, words, autojunk=False)
        best = aligned.find_longest_match(0, len(template), 0, len(words))
        if not best.size:
            return None
        spare = int(MAX_DIFFERENCE * len(template)) + 1
        lo = max(0, best.b - best.a - spare)
        hi = min(len(words), best.b + len(template) - best.a + spare)
        near = SequenceMatcher(None, template, words[lo:hi], autojunk=False)
        same = [m for m in near.get_matching_blocks() if m.size]
        first, last = same[0].b + lo, same[-1].b + same[-1].size + lo
        missing, added = [], []
        for kind, a, b, c, d in SequenceMatcher(None, template, words[first:last], autojunk=False).get_opcodes():
            if kind != "equal":
                missing += template[a:b]
                added += words[first + c:first + d]
        return first, last, missing, added

    @staticmethod
    def _refuted(template: list[str], missing: list[str], added: list[str]) -> bool:
        """Whether the differences make it another license."""
        if any(w in IDENTITY or _NUMBER.search(w) for w in missing) or any(w in IDENTITY for w in added):
            return True
        return any(map(_NUMBER.search, template)) and any(map(_NUMBER.search, added))  # else a list's numbers

    def _nearest(self, text: str, spans: list[tuple[int, int]]) -> tuple[int, int, dict] | None:
        """The best confirmed template among the words ``spans`` (places in ``text``)."""
        block = text[spans[0][0]:spans[-1][1]].encode()
        alone = len(self.alone.compress(block))
        ranked = sorted(((1 - len(p.compress(block)) / alone, -i) for i, (_, p, _) in enumerate(self.templates)), reverse=True)
        words = [text[x:y].lower() for x, y in spans]
        have = set(words)
        for saving, i in ranked:
            if saving <= 0:
                break
            name, _, template = self.templates[-i]
            if sum(w not in have for w in template) > MAX_DIFFERENCE * len(template):
                continue  # too many words are missing, however they are aligned
            found = self._align(template, words)
            if found and len(found[2]) + len(found[3]) <= MAX_DIFFERENCE * len(template) and not self._refuted(template, *found[2:]):
                first, last, missing, added = found
                return first, last, {"license": name, "start": spans[first][0], "end": spans[last - 1][1],
                                     "saving": round(saving, 6), "missing": missing, "added": added}
        return None

    def __call__(self, text: str | None) -> list[dict]:
        out = []
        for a, b in self.blocks(text) if text else ():
            spans = [m.span() for m in _WORD.finditer(text, a, b)]
            starts = [x for x, _ in spans]
            marks = sorted({bisect_right(starts, m.start()) - 1 for m in _TRIGGER.finditer(text, a, b)} - {-1})
            free = [True] * len(spans)
            for reach in REACHES:
                for i in marks:
                    if not free[i]:
                        continue
                    lo, hi = i, i + 1
                    while lo > 0 and i - lo < reach and free[lo - 1]:
                        lo -= 1
                    while hi < len(spans) and hi - i <= reach and free[hi]:
                        hi += 1
                    found = self._nearest(text, spans[lo:hi])
                    if found:
                        first, last, one = found
                        free[lo + first:lo + last] = [False] * (last - first)
                        out.append(one)
        return sorted(out, key=lambda f: f["start"])


_scanners: list[Scanner] = []


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_blocks, licenses`` (with places and wording differences)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanners:
            _scanners.append(Scanner())
        scanner = _scanners[0]
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saving", pa.float64()),
                                   ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(scanner.blocks(t)) if t else 0 for t in texts], pa.int64()),
                 pa.array([scanner(t) for t in texts], kind)], names=["doc_id", "n_blocks", "licenses"])

    of = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {of}, n_blocks long, licenses {FOUND}")
