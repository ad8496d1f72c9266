"""Benchmark items of every length below a window, and pieces that share a hash."""

import random

import pytest

from marketlake.llm import decontamination


@pytest.mark.parametrize("partitions", [1, 5])
def test_items_of_all_lengths(llm, partitions):
    rng = random.Random(partitions)
    words = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, words(n)) for i, n in enumerate(list(range(1, 10)) * 3 + [12, 15]) if n > 2] + [(90, "zebra"), (91, "No, zebra!"), (92, "")]
    docs = [(i, words(rng.randint(0, 40))) for i in range(60)]
    docs += [(100, "a zebra; no ZEBRA here"), (None, "no zebra"), (None, "no zebra"), (None, None), (101, "no zebra"), (101, "no zebra"), (102, "")]
    want = []
    for i, text in docs:
        w = (text or "").lower().replace(";", " ").split()
        hit, of = set(), set()
        for item, t in items:
            v = t.lower().replace(",", " ").replace("!", " ").split()
            n = min(10, len(v))
            grams = {tuple(v[j:j + n]) for j in range(len(v) - n + 1)} if n else set()
            at = [j for j in range(len(w) - n + 1) if tuple(w[j:j + n]) in grams]
            hit.update(k for j in at for k in range(j, j + n))
            of.update([str(item)] * bool(at))
        want.append((i, len(w), len(hit), sorted(of)))
    frame = llm.createDataFrame(docs, "doc_id long, text string").repartition(partitions)
    benchmark = llm.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in decontamination.contamination(frame, benchmark).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(x[2] > 0 for x in want) > 20
    kept = decontamination.clean_documents(frame, benchmark).collect()
    assert sorted(repr(r.doc_id) for r in kept) == sorted(repr(x[0]) for x in want if not x[2])


def test_short_items_are_met_in_one_pass(llm):
    """The documents are read for the windows, for the grams of all lengths and for the comparison, not once a length."""
    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = llm.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in range(1, 12)], "item_id long, text string")
    own = decontamination._prepared(docs, "doc_id", "text")
    plan = decontamination.hits(own, decontamination.benchmark_windows(items))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3


def test_pieces_that_share_a_hash(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from marketlake.llm import packing
    from marketlake.llm.text_arrays import BASES, span_hashes, utf8_buffer

    few = lambda d, a, b, base=BASES[0]: span_hashes(d, a, b, base) % np.uint64(3 if base == BASES[0] else 1 << 63)
    monkeypatch.setattr(packing, "span_hashes", few)
    tokenizer = packing.PieceTokenizer(packing.public_vocabulary())
    texts = ["some words share a key here", "é other words, 12 of them don't", "some words again"]
    for _ in range(2):
        ids, at = tokenizer(*utf8_buffer(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [
            e.ids for e in tokenizer.whole.encode_batch(texts, add_special_tokens=False)]


def test_a_vocabulary_of_too_many_ids_is_refused(tmp_path):
    from tokenizers import Tokenizer, models

    from marketlake.llm.packing import PieceTokenizer

    path = str(tmp_path / "large.json")
    Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0")).save(path)
    with pytest.raises(ValueError, match="two bytes"):
        PieceTokenizer(path)
