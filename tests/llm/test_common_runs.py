"""Substring dedup: a short phrase in a third of all documents does not gather them in one part."""

import numpy as np
import pyarrow as pa

from marketlake.llm import substrings
from marketlake.llm.text_arrays import utf8_buffer

PARTS = 800


def corpus(n, words=200):
    rng = np.random.default_rng(4)
    phrase = [f"phrase{i}" for i in range(20)]
    out = []
    for i in range(n):
        text = [f"w{x}" for x in rng.integers(0, 1_000_000, words)]
        if i % 3 == 0:
            at = int(rng.integers(0, words - 20))
            text[at:at + 20] = phrase
        out.append(" ".join(text))
    return out


def part_sizes(texts, common):
    data, bounds = utf8_buffer(pa.array(texts))
    rows = pa.array(np.arange(len(texts)))
    sizes = np.zeros(PARTS, np.int64)
    for task, part, blob in substrings._chunk(rows, rows, data, bounds, substrings.WINDOW, substrings.MINIMISER, PARTS // substrings.PARTS, common):
        if part >= 0:
            sizes[task * substrings.PARTS + part] += sum(map(len, substrings._unpack([blob])["packed"].to_pylist()))
    return sizes


def test_a_phrase_in_a_third_of_the_documents_is_spread(llm):
    texts = corpus(12_000)
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    common = substrings.common_runs(docs, substrings.MINIMISER)
    assert 15 <= common.sum() <= 40
    before, after = part_sizes(texts, None), part_sizes(texts, common)
    assert before.max() > 5 * np.median(before) and after.max() <= 3 * np.median(after)


def test_results_do_not_depend_on_the_steering(llm, monkeypatch):
    texts = corpus(400, 120)
    texts += texts[:3] + [" ".join(texts[5].split()[10:80]), " ".join(["phrase1 phrase2"] * 60), "", None]
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def result():
        return sorted(map(tuple, substrings.remove_repeats(docs).collect()))

    want = result()
    for common in (np.zeros(1 << substrings.SLOT_BITS, bool), np.ones(1 << substrings.SLOT_BITS, bool),
                   np.arange(1 << substrings.SLOT_BITS) % 2 == 0):
        monkeypatch.setattr(substrings, "common_runs", lambda *_, c=common: c)
        assert result() == want
    assert want[5][2] == 70 and want[0][2] == want[400][2] == 120
