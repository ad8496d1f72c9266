"""The battery and the control of false discoveries against plain Python, on planted keys of every encoding."""

import math
import random
import re

import pytest

from pyspark.sql import functions as F

from marketlake.llm import secrets

PLANTED = ["0123456789", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz",
           "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
           "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/",
           "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-_"]
TEXT = ["internationalization-of-everything", "counterrevolutionaries", "xy" * 15, "Q" * 40, "path/to/some/ordinary/place/of/files",
        "SomeVeryLongClassNameInCamelCase", "an_identifier_with_under_scores", "a" * 30, "0" * 22, "abcdefghijklmnopqrstuvwxyz",
        "1234567890123456789012", "zyxwvutsrqponmlkjihgfedcba"]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    keys = [(a, "".join(r.choice(a) for _ in range(n))) for a in PLANTED for n in (22, 40, 64, 120) for _ in range(6)]
    rows = [(i, f"see {k} here") for i, (_, k) in enumerate(keys)]
    rows += [(1000 + i, f"and {t}, then {t} again") for i, t in enumerate(TEXT * 3)]
    return keys, rows


def encoding(token):
    """The smallest of the planted alphabets, in order, that holds the token; base64 in either form else."""
    plain = token.translate(str.maketrans("-_", "+/"))
    return next((a for a in PLANTED[:6] if set(token) <= set(a)), PLANTED[6]), plain


def brute_battery(token):
    alphabet, plain = encoding(token)
    v, size, n = [alphabet.index(c) for c in plain], len(alphabet), len(plain)
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi = sum((v.count(s) - n / size) ** 2 / (n / size) for s in range(size))
    df = size - 1
    z1 = ((max(chi, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))  # Wilson and Hilferty
    changes = sum((a < size / 2) != (b < size / 2) for a, b in zip(v, v[1:]))
    z2 = (changes - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    mean, var = sum(range(size)) / size, sum(x * x for x in range(size)) / size - (sum(range(size)) / size) ** 2
    z3 = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / (var * math.sqrt(n - 1))
    p = min(1.0, 3 * min(tail(z1), 2 * tail(abs(z2)), 2 * tail(abs(z3))))
    share = [x / sum(secrets.LETTERS) for x in secrets.LETTERS]

    def log_text(c):
        if c.isdigit():
            own = secrets.SHARES[2] / 10
        elif c.isalpha():
            own = secrets.SHARES[0 if c.islower() else 1] * share[ord(c.lower()) - ord("a")]
        else:
            own = secrets.SHARES[3] / 4
        return math.log((1 - secrets.EVEN) * own + secrets.EVEN / 66)

    return p, sum(-math.log(size) - log_text(c) for c in token)


def test_battery(llm, corpus):
    keys, _ = corpus
    tokens = sorted({k for _, k in keys} | set(TEXT))
    got = llm.createDataFrame([(t,) for t in tokens], "token string").select("token", secrets.battery(F.col("token")).alias("b")).collect()
    assert len(got) == len(tokens)
    for r in got:
        p, log_e = brute_battery(r.token)
        assert abs(r.b.log_e - log_e) < 1e-9
        assert abs(r.b.p - p) < 2e-3  # the normal tail is approximated
    assert sum(r.b.p >= secrets.RANDOM_P for r in got if r.token not in TEXT) >= 0.98 * (len(tokens) - len(TEXT))
    assert all(r.b.p < secrets.RANDOM_P for r in got if r.token in ("xy" * 15, "Q" * 40, "a" * 30, "0" * 22))


@pytest.mark.parametrize("fdr", [0.01, 0.2])
def test_random_spans(llm, corpus, fdr):
    _, rows = corpus
    docs = llm.createDataFrame(rows + rows[:20] + [(None, None), (5000, "")], "doc_id long, text string")
    got = secrets.report(docs, fdr=fdr).collect()
    battery = {}
    found = {}
    for i, text in rows:
        base = [(m.start(), m.end()) for p in (r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}") for m in re.finditer(p, text)]
        found[i] = [(m[0], m.start(), m.end()) for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", text)
                    if not any(a < m.end() and m.start() < b for a, b in base)]
        battery.update((t, brute_battery(t)) for t, _, _ in found[i])
    passing = set()
    for low, high in zip(secrets.LENGTHS, (*secrets.LENGTHS[1:], math.inf)):
        own = [(t, math.floor(2 * e) / 2 if p >= secrets.RANDOM_P else -math.inf) for t, (p, e) in battery.items() if low <= len(t) < high]
        ranked = sorted((e for _, e in own), reverse=True)
        fits = [e for k, e in enumerate(ranked, 1) if e >= 0 and e >= math.log(len(own) / (fdr * k))]
        passing |= {t for t, e in own if fits and e >= fits[-1]}
    assert passing and not passing & set(TEXT[:5])
    want = {i: [f"random:{a}:{b}" for t, a, b in f if t in passing] for i, f in found.items()}
    assert len(got) == len(rows) + 22
    for r in got:
        assert [s for s in r.spans if s.startswith("random")] == want.get(r.doc_id, [])
