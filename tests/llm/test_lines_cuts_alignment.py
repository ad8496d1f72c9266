"""Line dedup, fill-in-middle and alignment: brute force, laws, edge cases, hot keys."""

import hashlib
import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketlake.llm import alignment, fill_in_middle, line_runs
from marketlake.llm.boundary_set import BoundarySet
from marketlake.llm.fragments import EMPTY, compose, finish, fragment
from marketlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
EDGE = ["", None, " ", "  ", " a", "a ", "a  b", "a\n b ", "\n", "one  two", "<|endoftext|> <s> </s>", "a▁b", "▁", "tab\t here",
        "ﬁ ① Ａ 日本語 テスト", "x\x00y", "don't  we'll", "é \U0001f600 \U0001f468‍\U0001f469", "  lead", "trail  ", "a\r\nb \x1c c　 d",
        "word " * 3000, "x" * 5000, "日本" * 900, " " * 700, "a" + "\n " * 300]


# --- line dedup

def brute_lines(rows, min_docs=5, min_chars=40):
    strip, low = re.compile(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: strip.sub("", line).translate(low)
    docs = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            docs[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        top = lambda k: max((d for d in docs[k] if d is not None), default=None)
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(docs[key(x)]) >= min_docs and top(key(x)) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows(seed=3):
    rng = np.random.default_rng(seed)
    pool = [f"shared line number {i:02d} that is long enough to count é" for i in range(12)] + ["short", "", "   ", "\t\x0b"]
    rows = []
    for i in range(120):
        lines = [pool[j] for j in rng.integers(0, len(pool), rng.integers(0, 9))]
        lines = [f" \t{x.upper() if rng.random() < .2 else x}\r" if rng.random() < .3 else x for x in lines]
        if i % 3 == 0:
            lines.insert(0, "Accept all cookies to go on reading this page today")
        rows.append((int(i) if i % 17 else None, "\n".join(lines)))
    rows += [(7, None), (8, ""), (9, rows[9][1]), (9, rows[9][1]), (5, "x" * 39), (500, "tie " * 20), (500, "tie " * 20)]
    return rows + [(i, "tie " * 20) for i in range(4)]


@pytest.mark.parametrize("batches", [1, 7])
def test_line_dedup(llm, batches):
    rows = line_rows()
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    split = [llm.createDataFrame(rows[i::batches], "doc_id long, text string") for i in range(batches)]
    got = line_runs.dedup(docs, split, fanout=3)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lines(rows)


def test_line_runs_meet_without_a_shuffle(llm):
    rows = line_rows()
    runs = line_runs.LineRuns(llm, fanout=3)
    for i in range(8):
        runs.add(llm.createDataFrame(rows[i::8], "doc_id long, text string"))
    assert [len(level) for level in runs.levels] == [2, 2]
    counts = runs.counts()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert counts.count() == counts.select("h1", "h2").distinct().count()
    total = runs.counts().agg({"n": "sum"}).first()[0]
    whole = line_runs.LineRuns(llm)
    whole.add(llm.createDataFrame(rows, "doc_id long, text string"))
    assert total == whole.counts().agg({"n": "sum"}).first()[0]


def test_line_batches_read_their_own_files(llm, tmp_path):
    rows = line_rows()
    llm.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "d"))
    docs = llm.read.parquet(str(tmp_path / "d"))
    parts = line_runs.batches_of(docs, 3)
    files = [set(p.select("_metadata.file_path").distinct().toPandas().file_path) for p in parts]
    assert sum(p.count() for p in parts) == docs.count() and sum(map(len, files)) == len(set().union(*files)) == len(docs.inputFiles())
    assert sorted(map(tuple, line_runs.dedup(docs).collect()), key=repr) == brute_lines([tuple(r) for r in docs.collect()])


def test_line_dedup_edges(llm):
    names = "doc_id string, text string, h1 string, id string, n long, mark int, top int, place int"
    rows = [(f"d{i}", "the very same line that stands in every document here\nown", "x", "y", i, 0, 1, 2) for i in range(6)]
    got = {r.doc_id: tuple(r)[1:] for r in line_runs.dedup(llm.createDataFrame(rows, names)).collect()}
    assert got["d5"] == (2, 0, rows[5][1]) and all(got[f"d{i}"] == (2, 1, "own") for i in range(5))
    assert line_runs.dedup(llm.createDataFrame([], "doc_id long, text string")).collect() == []
    long = "\n".join(f"line {i % 2000} of a very long text, said over and over" for i in range(60_000))
    rows = [(i, long) for i in range(5)]
    assert sorted(map(tuple, line_runs.dedup(llm.createDataFrame(rows, "doc_id long, text string")).collect())) == [
        (i, 60_000, 60_000, "") for i in range(4)] + [(4, 60_000, 0, long)]


# --- fill-in-middle

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400_000), max_size=60, unique=True), st.integers(0, 300_000), st.integers(0, 70_000))
def test_boundary_set_selects(some, first, length):
    every = np.unique(np.concatenate([np.array(some, dtype=np.int64), np.arange(first, first + length)]))
    s = BoundarySet(every)
    assert len(s) == len(every)
    for k in {0, len(every) // 3, len(every) - 1, min(65_536, len(every) - 1)} - {-1}:
        if len(every):
            assert s.select(k) == every[k]
    with pytest.raises(IndexError):
        s.select(len(every))


def test_boundary_set_takes_each_form():
    rng = np.random.default_rng(0)
    x = np.unique(np.concatenate([np.arange(70_000), 200_000 + np.sort(rng.choice(60_000, 20_000, replace=False)), [10_000_000, 10_000_005]]))
    s = BoundarySet(x)
    assert [c.form for c in s.containers] == ["runs", "runs", "bitmap", "array"]
    assert [s.select(k) for k in range(0, len(x), 97)] == x[::97].tolist()
    assert all(c.size() <= 8192 for c in s.containers)


def brute_cut(text, doc_id):
    text = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    spm = h[3] % 100 < 80
    return len(u), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(llm, texts):
    rows = list(texts.items()) + [(100_000 + i, t) for i, t in enumerate(EDGE * 4)]
    rows += [(None, "a b c"), (3, "say <P> twice"), (3, "a <S"), (200_003, "<<P"), (5, "wörter " * 40_000), (5, "wörter " * 40_000)]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    got = fill_in_middle.transform(df)
    back = got.select("doc_id", fill_in_middle.restore(got.output, got.form).alias("text")).collect()
    assert [(r.doc_id, r.text) for r in back] == [(i, t or "") for i, t in rows]
    assert [tuple(r) for r in got.collect()] == [(i, *brute_cut(t, i)) for i, t in rows]
    assert {r.form for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_fill_in_middle_edges(llm):
    df = llm.createDataFrame([("k", "ab cd", 1, "z")] * 2, "doc_id string, text string, n int, shown string")
    assert [tuple(r) for r in fill_in_middle.transform(df).collect()] == [("k", *brute_cut("ab cd", "k"))] * 2
    assert fill_in_middle.transform(df.limit(0)).collect() == []
    n, form, prefix, middle, output = fill_in_middle.rearranged("größe".encode(), 4, unit="code point", rate=100)
    assert n == 5 and form != "plain" and len(output.decode()) == 5 + 9 and prefix + middle <= 5


# --- alignment

def brute_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path_a, path_b = alignment.public_vocabularies()
    a_model, b_model = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    a_model.encode_special_tokens = True
    letters = alignment._byte_letters()
    token_bytes = lambda i: bytes(letters[c] for c in a_model.id_to_token(i))

    def piece_bytes(i):
        p = b_model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    docs = []
    for t in texts:
        raw = (" " + (t or "")).encode()
        a, b = a_model.encode(raw.decode(), add_special_tokens=False).ids, b_model.encode(t or "")
        x, y = [token_bytes(i) for i in a], [piece_bytes(i) for i in b]
        if not t or b"".join(x) != raw or b"".join(y) != raw:
            docs.append(([], [], [], []))
            continue
        ends = lambda z: np.cumsum([len(v) for v in z]).tolist()
        ea, eb = ends(x), ends(y)
        common = sorted(set(ea) & set(eb))
        groups, i, j = [], 0, 0
        for c in common:
            i2, j2 = ea.index(c, i) + 1, eb.index(c, j) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        docs.append((a, b, groups, [(g[0][-1], g[1][-1]) for g in groups]))
    count = Counter(p for d in docs for p in d[3])
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    shown = lambda g: ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
    return [(len(a), len(b), len(g), len(p), sum(count[x] == best[x[1]] for x in p), sum(count[x] for x in p),
             hashlib.sha256(shown(g).encode()).hexdigest() if g else "") for a, b, g, p in docs]


@pytest.mark.parametrize("chunk", [alignment.CHUNK_BYTES, 300])
def test_alignment(llm, texts, chunk):
    rows = list(texts.items())[:120 if chunk == 300 else None] + [(-1 - i, t) for i, t in enumerate(EDGE)] + [(None, "x y " * 200)] * 2
    got = alignment.align(llm.createDataFrame(rows, "doc_id long, text string"), chunk=chunk, fan=3).collect()
    want = [(i, *w) for (i, _), w in zip(rows, brute_alignment([t for _, t in rows]))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_alignment_query_and_edges(llm):
    assert QUERIES["op13_alignment"](llm, SF).count() == llm.read.parquet(f"{SF}/documents.parquet").count()
    df = llm.createDataFrame([("k", "ab cd", 1, "z")] * 2, "doc_id string, text string, copies int, id string")
    assert {tuple(r)[:5] for r in alignment.align(df).collect()} == {("k", 2, 2, 2, 2)}
    assert alignment.align(df.limit(0)).collect() == [] and alignment.align(df.limit(0), chunk=1).collect() == []


tokens = st.lists(st.integers(1, 4), min_size=1, max_size=25)


@settings(max_examples=200, deadline=None)
@given(tokens, tokens, st.lists(st.integers(0, 60), max_size=5), st.randoms())
def test_fragments_are_a_monoid(a_lengths, b_lengths, cuts, random):
    total = min(sum(a_lengths), sum(b_lengths))
    a_ends, b_ends = (np.unique(np.append(np.cumsum(x)[np.cumsum(x) < total], total)) for x in (a_lengths, b_lengths))
    a, b = np.arange(1, len(a_ends) + 1), np.arange(1, len(b_ends) + 1) * 7
    whole = fragment(a, a_ends, b, b_ends)
    bounds = [0, *sorted(min(c, total) for c in cuts), total]
    parts = []
    for lo, hi in zip(bounds, bounds[1:]):
        of = lambda e: (e > lo) & (e <= hi)
        parts.append(fragment(a[of(a_ends)], a_ends[of(a_ends)], b[of(b_ends)], b_ends[of(b_ends)]))
    assert reduce(compose, parts, EMPTY) == whole == compose(whole, EMPTY)
    while len(parts) > 1:  # any bracketing
        i = random.randrange(len(parts) - 1)
        parts[i:i + 2] = [compose(parts[i], parts[i + 1])]
    assert parts[0] == whole
    done = finish(whole)
    assert not done.suffix_a and done.n_groups == len(done.links) == len(done.groups.split(";"))
