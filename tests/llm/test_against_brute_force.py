"""Every registered query over whole tables against DuckDB or a plain Python version."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from marketlake.llm import decontamination, importance, packing, quality_rules, simhash
from marketlake.llm.queries import ORACLES, QUERIES


SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark pages labels".split()
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(llm, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](llm, SF)
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    rows = [tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fp):
    """{id: smallest id reachable} over fingerprints at most four bits apart."""
    top = {i: i for i in fp}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(fp)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(llm, texts):
    fp = {i: brute_fingerprint(t) for i, t in texts.items()}
    of = brute_components(fp)
    got = QUERIES["op5_simhash"](llm, SF).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{fp[i]:016x}", of[i]) for i in fp)


def test_ball_finds_every_link_within_four_bits(llm):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    near = base.copy()
    for i in range(60):
        for bit in rng.choice(64, size=i % 7, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(bit)
    every = np.concatenate([base, near])
    df = llm.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long").distinct()
    from marketlake.llm.components import components
    root = {r.node: r.root for r in components(simhash.near_links(df)).collect()}
    for i in range(60):
        a, b = int(base[i:i + 1].view(np.int64)[0]), int(near[i:i + 1].view(np.int64)[0])
        linked = a == b or (a in root and root.get(a) == root.get(b))
        assert linked == (i % 7 <= 4)


def test_crowded_variant_gives_a_forest():
    rng = np.random.default_rng(1)
    x = np.unique(np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    left, right = simhash._forest(x, 4)
    assert sum(map(len, left)) == len(x) - 1
    left, right = simhash._forest(np.array([0, 0xFF, 0xFFFF], dtype=np.uint64), 4)
    assert not left


def brute_base_spans(text):
    text = text or ""
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
    kinds = [re.compile(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    keep = [lambda m: len(m[2]) >= 6, lambda m: len(m[0]) >= 20, lambda m: len(m[0]) >= 24]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(kinds) for m in p.finditer(text) if keep[k](m))


def test_secrets(llm, texts):
    names = ("assign", "access", "hex", "random")
    for r in QUERIES["op6_secrets"](llm, SF).collect():
        base = brute_base_spans(texts[r.doc_id])
        shown = [f"{names[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == shown


def test_quality_rules(llm, texts):
    labels = llm.read.parquet(f"{SF}/labels.parquet").collect()
    worst = {}
    for r in labels:
        q, t = worst.get(r.doc_id, (1, 0))
        worst[r.doc_id] = min(q, r.quality), max(t, r.toxic)
    trusted = {i for i, x in worst.items() if x == (1, 0)}
    sign = re.compile("[^\x00-\x20\x7f0-9A-Za-z\x80-\U0010ffff]+")

    def buckets(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text)]
        pairs = [xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)) for a, b in zip(h, h[1:])]
        signs = [xxhash.xxh64_intdigest(b"sign", xxhash.xxh64_intdigest(w.encode(), 42)) for w in sign.findall(text)]
        return np.array([x % quality_rules.BUCKETS for x in h + signs + pairs], dtype=np.int64)

    grams = {i: buckets(t) for i, t in texts.items()}
    raw = np.bincount(np.concatenate(list(grams.values())), minlength=quality_rules.BUCKETS)
    target = np.bincount(np.concatenate([g for i, g in grams.items() if i in trusted]), minlength=quality_rules.BUCKETS)
    ratio = np.log((target + quality_rules.PRIOR) / (raw * (target.sum() / raw.sum()) + quality_rules.PRIOR))
    for r in QUERIES["op7_quality_rules"](llm, SF).collect():
        t = texts[r.doc_id]
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams8 = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        count, mark = Counter(grams8), set()
        for i, g in enumerate(grams8):
            if count[g] > 1:
                mark.update(range(i, i + 8))
        llr = ratio[grams[r.doc_id]].mean() if len(grams[r.doc_id]) else 0.0
        failed = len(w) < 20 or 100 * len(mark) > 30 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(mark), failed)
        assert abs(r.llr - llr) < 1e-9
        assert r.kept == (not failed and llr >= quality_rules.THRESHOLD)


def test_packing_round_trip(llm, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.public_vocabulary())
    want = {i: [*whole.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    got = QUERIES["op9_packing"](llm, SF).collect()
    at, seen = {}, {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0) and r.length > 0 and r.offset + r.length <= packing.LENGTH
        at[r.sequence_id] = r.offset + r.length
        assert r.start == seen.get(r.doc_id, 0) and r.doc_tokens == len(want[r.doc_id])
        seen[r.doc_id] = r.start + r.length
        ids = np.array(want[r.doc_id][r.start:r.start + r.length], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(ids.tobytes())
    assert seen == {i: len(x) for i, x in want.items()}
    assert sorted(at) == list(range(len(at))) and all(at[k] == packing.LENGTH for k in sorted(at)[:-1])


def test_licenses(llm, texts):
    import json

    want = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
            "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
            "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "LicenseRef-all-rights-reserved": "All rights reserved."}
    for r in QUERIES["op8_licenses"](llm, SF).collect():
        t = texts[r.doc_id]
        places = sorted((m.start(), k) for k, v in want.items() for m in re.finditer(re.escape(v), t))
        found = json.loads(r.licenses)
        assert [(x["start"], x["license"]) for x in found] == places
        assert all(not x["missing"] and not x["added"] and 0 < x["saving"] <= 1 for x in found) and r.n_licenses == len(found)


def test_classifier_on_held_out_labels(llm):
    """Fitted on half of the labels of sf0.1, judged on the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = llm.read.parquet(f"{sf}/documents.parquet"), llm.read.parquet(f"{sf}/labels.parquet")
    share = {(r.quality, r.toxic): r.s for r in importance.resample(docs, labels.where("doc_id % 2 = 0")).join(
        labels.where("doc_id % 2 = 1"), "doc_id").selectExpr("quality", "toxic", "double(kept) k").groupBy(
            "quality", "toxic").agg({"k": "avg"}).withColumnRenamed("avg(k)", "s").collect()}
    assert share[(1, 0)] > 0.97 and share[(0, 0)] < 0.05 and share[(1, 1)] < 0.1


def test_kth_largest_is_exact(llm):
    rng = np.random.default_rng(0)
    values = np.round(np.concatenate([rng.normal(0, 1, 5000), rng.normal(1e4, 1e-3, 3000), np.zeros(2000)]), 6).tolist()
    df = llm.createDataFrame([(v,) for v in values], "x double")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 2999, 3001, 6000, len(values)):
        assert importance.kth_largest(df, "x", k) == ranked[k - 1]


def test_pipeline(llm, documents, texts):
    """Each stage's decisions, taken again in plain Python on its own input."""
    import corpus_pipeline as p
    from marketlake.llm.storage import materialise

    names, steps, docs = [n for n, _ in p.STAGES], [], documents
    for _, f in p.STAGES:
        docs = materialise(f(llm, docs, SF), "test-stage")
        steps.append(docs)
    assert names == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    assert all(s.columns == documents.columns for s in steps[:-1])
    after = [{r.doc_id: r.text for r in s.collect()} for s in steps[:-1]]
    kept = {r.doc_id for r in QUERIES["op3_importance"](llm, SF).where("kept").collect()}
    assert after[0] == {i: texts[i] for i in kept}
    of = brute_components({i: brute_fingerprint(t) for i, t in after[0].items()})
    assert after[1] == {i: after[0][i] for i, c in of.items() if i == c}
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: word.findall("".join(c.lower() if c.isascii() else c for c in t))
    bad = set()
    for r in llm.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = low(r.text)
        n = min(10, len(w))
        bad |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(x) for x in bad}
    clean = {i: t for i, t in after[1].items() if not any(
        tuple(w[j:j + n]) in bad for w in [low(t)] for n in sizes for j in range(len(w) - n + 1))}
    assert after[2] == clean

    def redacted(t):
        out, at = [], 0
        for a, _, b in brute_base_spans(t):
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        return "".join(out) + t[at:]

    assert after[3] == {i: redacted(t) for i, t in after[2].items()}
    pieces = steps[-1].groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect()
    assert {r.doc_id for r in pieces} == set(after[3]) and all(r["sum(length)"] == r.doc_tokens for r in pieces)
    cols = steps[-1].columns
    assert sorted(p.run(llm, SF).select(*cols).collect()) == sorted(steps[-1].collect())


def test_winnowing_misses_no_shared_window(llm):
    """Every window of ten words, wherever it starts, in texts with many equal words."""
    rng = np.random.default_rng(3)
    item = [f"w{x}" for x in rng.integers(0, 6, 60)]
    rows = []
    for i in range(50):
        noise = [f"n{x}" for x in rng.integers(0, 9, 20)]
        rows.append((i, " ".join(noise[:10] + item[i:i + 10] + noise[10:])))
    got = decontamination.contamination(llm.createDataFrame(rows, "doc_id long, text string"),
                                        llm.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert all(r.n_hit >= 10 and r.item_ids == ["1"] for r in got.collect())
