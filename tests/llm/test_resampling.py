"""Importance resampling against a plain Python version: model, weights, size of the draw and the documents drawn."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from marketlake.llm import importance as imp

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")


def features(text):
    """[(window, feature)] in order: tokens, pairs, and the mark of a pair that its window has had."""
    tokens = TOKEN.findall((text or "").encode())
    out, seen = [], set()
    for i, t in enumerate(tokens):
        w = i // imp.WINDOW
        out.append((w, t))
        if i:
            pair = (tokens[i - 1], t)
            out.append((w, pair))
            if (w, pair) in seen:
                out.append((w, "again"))
            seen.add((w, pair))
    return len(tokens), out


def brute(docs, kinds):
    """{id: (log weight, log weight under models without the document)}; the second for trusted documents only."""
    parts = {i: features(t) for i, t in docs.items()}
    raw, target, by_kind = Counter(), Counter(), {1: Counter(), 2: Counter()}
    for i, (_, fs) in parts.items():
        raw.update(f for _, f in fs)
        if kinds.get(i) == 1:
            target.update(f for _, f in fs)
        if kinds.get(i) in by_kind:
            by_kind[kinds[i]].update({f for _, f in fs if f != "again"})
    clean, toxic = by_kind[1], by_kind[2]
    n_clean, n_toxic = (sum(kinds.get(i) == k for i in docs) for k in (1, 2))
    share = sum(target.values()) / sum(raw.values())
    bound = {kind: math.log(max(sum(isinstance(f, kind) for f in toxic), 1) / imp.FALSE_WITNESSES) for kind in (bytes, tuple)}

    def weight(n, fs, apart):
        own, had = Counter(f for _, f in fs) if apart else Counter(), int(apart)
        n_c = n_clean - had
        total, windows = 0.0, Counter()
        for _, f in fs:
            total += math.log((target[f] - own[f] + imp.QUALITY_PRIOR) / ((raw[f] - own[f]) * share + imp.QUALITY_PRIOR))
        for (w, f), uses in Counter(fs).items():
            c, t = clean[f] - had, toxic[f]
            if f == "again" or not n_c or not n_toxic:
                continue
            both, e = max(c + t, 1), n_toxic / (n_c + n_toxic)
            s = t / both
            surprise = both * ((s * math.log(s / e) if s else 0) + ((1 - s) * math.log((1 - s) / (1 - e)) if s < 1 else 0))
            ratio = math.log((c * n_toxic / n_c + imp.TOXIC_PRIOR) / (t + imp.TOXIC_PRIOR))
            if surprise >= bound[type(f)] and ratio <= imp.WITNESS:
                windows[w] += ratio * min(uses, imp.MOST_USES)
        many = max(-(-n // imp.WINDOW), 1)
        worst = min([windows[w] for w in range(many)])
        return total * imp.REACH / max(n, imp.REACH) + min(worst + math.log(many), 0)

    return {i: (weight(*p, False), weight(*p, True) if kinds.get(i) == 1 else None) for i, p in parts.items()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    good, bad = [f"word{i}" for i in range(12)], ["moron", "scum"]
    docs, labels = {}, []
    for i in range(120):
        n = rng.choice([3, 20, 60, 90]) if i else 1400
        kind = (1, 1, 2, 0)[i % 4]
        words = [rng.choice(good) for _ in range(n)] if kind else ["buy", "now", "!!"] * (n // 3 + 1)
        docs[i] = " ".join(words + ([rng.choice(bad) for _ in range(4)] if kind == 2 else []))
        if i % 3 or i == 0:
            labels.append((i, int(kind > 0), int(kind == 2)))
    docs[200], docs[201] = "", None
    return docs, labels


def frames(llm, corpus):
    docs, labels = corpus
    return (llm.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3),
            llm.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_weights_size_and_draw(llm, corpus):
    docs, labels = corpus
    want = brute(docs, {i: 2 if t else q for i, q, t in labels})
    rows = {r.doc_id: r for r in imp.resample(*frames(llm, corpus)).collect()}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        assert r.log_weight == pytest.approx(want[i][0], abs=1e-4)
        assert r.n_tokens == len(TOKEN.findall((docs[i] or "").encode()))
    apart = [round(w, 2) for _, w in want.values() if w is not None]
    above = lambda ws, m: [1 - math.exp(-math.exp(min(w + m, 50))) for w in ws]
    lo, hi = -100.0, 100.0
    for _ in range(80):
        m = (lo + hi) / 2
        lo, hi = (m, hi) if np.mean(above(apart, m)) < imp.KEEP_TRUSTED else (lo, m)
    size = sum(above([w for w, _ in want.values()], hi))
    kept = sorted((r.gumbel_key for r in rows.values() if r.kept), reverse=True)
    assert abs(len(kept) - size) < 1.5  # weights apart are rounded, models are single precision
    assert kept == sorted((r.gumbel_key for r in rows.values()), reverse=True)[:len(kept)]
    assert not any(r.kept for i, r in rows.items() if docs[i] and "buy now" in docs[i] and len(docs[i]) > 200)


def test_noise_is_standard_gumbel_and_moves_the_border(llm):
    docs, labels = (llm.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    a, b = (imp.resample(docs, labels, seed=s).toPandas().set_index("doc_id").sort_index() for s in (0, 1))
    assert (a["log_weight"] == b["log_weight"]).all()
    noise = (a["gumbel_key"] - a["log_weight"]).to_numpy()
    assert abs(noise.mean() - 0.5772) < 0.06 and abs(noise.var() - math.pi ** 2 / 6) < 0.15
    assert a.loc[a["kept"], "log_weight"].nunique() > 0.9 * a["kept"].sum()  # not saturated
    changed = (a["kept"] != b["kept"]).to_numpy()
    near = (a["log_weight"] - a.loc[a["kept"], "gumbel_key"].min()).abs().to_numpy() < 3
    assert changed.sum() >= 10 and changed[near].sum() > 0.5 * changed.sum()
    assert a["kept"].sum() == b["kept"].sum()


def test_ties_on_the_last_place_all_stay(llm):
    rows = [(7, "one two three")] * 50
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    labels = llm.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    got = imp.resample(docs, labels).collect()
    assert len(got) == 50 and len({r.gumbel_key for r in got}) == 1 and all(r.kept for r in got)
