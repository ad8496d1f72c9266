"""Operator 6, secret scans, in DataFrame functions only: three patterns, and a randomness test battery.

Patterns (kinds ``assign``, ``access``, ``hex``) are matched leftmost without overlap, each kind on its own;
places are code points, ends exclusive.

The battery judges every other run of ``MIN_TOKEN`` or more characters that could be an encoded key. The
smallest alphabet that holds the run is taken for its encoding (digits, hexadecimal, base32, lower-case letters
and digits, letters and digits, base64), and three tests ask whether its symbols could be drawn evenly from
that alphabet: chi-squared over the alphabet, the number of runs above and below its middle, and the
correlation of neighbours. The p-value is three times the smallest (Bonferroni), and a run below ``RANDOM_P`` is
no key.

Short runs pass such tests by chance, so a run must also be unlikely as text: its e-value is the likelihood of
even symbols over that of text with known letter frequencies, which grows with its length. Over all distinct runs
of the corpus in the same class of length, the e-BH procedure keeps the share of false discoveries at ``FDR``: with m
runs, the k largest e-values pass if the k-th is at least m / (FDR * k). The ranks come from a histogram of
half-nat bins by length class, read at the bins' lower ends, so only some hundred counts reach the driver.

Null text is empty. A text is searched whole in one row, however long it is. Repeated rows and null ids stay rows of their own, other columns are dropped (``redact``
keeps them), an empty table gives no rows. A run that overlaps a pattern's span is left to the pattern.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.native_text import let
from marketlake.llm.storage import free_names

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
# the shorter matches of these two end with the run they stand in, so asking for the length here drops just them
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

MIN_TOKEN = 20
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"
RANDOM_P = 0.001
FDR = 0.01
#: Lower ends of the classes of length.
LENGTHS = (20, 32, 48, 96)
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_"
ENCODINGS = (
    ("^[0-9]+$", "0123456789"),
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[0-9A-Za-z]+$", SYMBOLS[:62]),
)
BASE64 = SYMBOLS[:64]
# Relative frequencies of a-z in English text, in per cent.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1,
           2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Shares of text's characters: small letters, capitals, digits, the four signs; and of even symbols mixed in.
SHARES = (0.88, 0.05, 0.04, 0.03)
EVEN = 0.1


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``(start, end, token)`` of all matches: what lies between them gives their places."""
    def places(gaps: Column, found: Column, tokens: Column) -> Column:
        steps = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(
            F.char_length(g).alias("gap"), F.char_length(m).alias("n"))), tokens, lambda s, t: F.struct(
                s["gap"].alias("gap"), s["n"].alias("n"), t.alias("t")))
        empty = F.array().cast("array<struct<start:int,end:int,token:string>>")
        return F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda a, s: F.struct(
            (a["at"] + s["gap"] + s["n"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["n"]).alias("end"),
                                                s["t"].alias("token")))).alias("out")), lambda a: a["out"])

    all_of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    return F.when(text.rlike(pattern), let(F.split(text, pattern, -1), lambda gaps: let(
        all_of(0), lambda found: let(all_of(group), lambda tokens: places(gaps, found, tokens))))).otherwise(none)


def _log_text() -> list[float]:
    """Log probability in text of each of SYMBOLS."""
    letter = [x / sum(LETTERS) for x in LETTERS]
    small, capital, digit, sign = SHARES
    p = [digit / 10] * 10 + [small * x for x in letter] + [capital * x for x in letter] + [sign / 4] * 4
    return [math.log((1 - EVEN) * x + EVEN / len(SYMBOLS)) for x in p]


def _upper_tail(z: Column) -> Column:
    """P(Z >= z) of a standard normal variable, by the logistic approximation (error below 2e-4)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.lit(1.5976) * z + F.lit(0.070566) * z * z * z, F.lit(700.0))))


def _alphabet(token: Column) -> Column:
    out = F.lit(BASE64)
    for pattern, alphabet in reversed(ENCODINGS):
        out = F.when(token.rlike(pattern), F.lit(alphabet)).otherwise(out)
    return out


def battery(token: Column) -> Column:
    """``(p, log_e)`` of a token: the combined p-value of evenness, and the log e-value against text."""
    log_text = F.array(*map(F.lit, _log_text()))

    def of(alphabet: Column, symbols: Column) -> Column:
        size = F.char_length(alphabet).cast("double")
        n = F.size(symbols).cast("double")
        values = F.transform(symbols, lambda c: _index(alphabet, F.translate(c, "-_", "+/")))

        def tests(v: Column) -> Column:
            counts = F.transform(F.array_distinct(v), lambda x: F.size(F.filter(v, lambda y: y == x)).cast("double"))
            chi = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) * size / n - n
            df = size - 1
            third = F.lit(2.0) / (F.lit(9.0) * df)
            z1 = (F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - third)) / F.sqrt(third)
            pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            half, mean, var = size / 2, (size - 1) / 2, (size * size - 1) / 12
            n_runs = F.size(F.filter(pairs, lambda p: (p["a"] < half) != (p["b"] < half))).cast("double")
            z2 = (n_runs - (n - 1) / 2) / F.sqrt((n - 1) / 4)
            z3 = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean)) / (var * F.sqrt(n - 1))
            p = F.least(_upper_tail(z1), 2 * _upper_tail(F.abs(z2)), 2 * _upper_tail(F.abs(z3)))
            return F.least(3 * p, F.lit(1.0))

        log_e = F.aggregate(symbols, F.lit(0.0), lambda a, c: a - F.log(size) - F.get(log_text, _index(F.lit(SYMBOLS), c)))
        return F.struct(let(values, tests).alias("p"), log_e.alias("log_e"))

    return let(_alphabet(token), lambda a: let(F.split(token, ""), lambda s: of(a, F.filter(s, lambda c: c != ""))))


def _index(alphabet: Column, symbol: Column) -> Column:
    """Place of a symbol in the alphabet, from 0."""
    return F.call_function("instr", alphabet, symbol) - 1


def _spans(text: Column) -> Column:
    """The patterns' spans as ``(start, rank, end)``, in order."""
    def kind(found: Column, rank: int) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))

    assign = F.filter(_matches(text, ASSIGN, 1), lambda m: F.char_length(m["token"]) >= ASSIGN_VALUE)
    return F.sort_array(F.concat(kind(assign, 0), kind(_matches(text, ACCESS), 1), kind(_matches(text, HEX), 2)))


def _candidates(text: Column, base: Column) -> Column:
    return F.filter(_matches(text, TOKEN), lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, low in enumerate(LENGTHS):
        out = F.when(n >= low, i).otherwise(out)
    return out


def thresholds(found: DataFrame, fdr: float = FDR) -> list[float]:
    """Smallest log e-value that passes, by class of length; ``found`` has ``cands``."""
    distinct = found.select(F.explode_outer("cands").alias("m")).where("m IS NOT NULL").select("m.token").distinct()
    bins = (distinct.select(_length_class(F.char_length("token")).alias("length"), battery(F.col("token")).alias("b"))
            .groupBy("length", F.greatest(F.floor(2 * F.col("b.log_e")), F.lit(-1)).alias("bin"))
            .agg(F.count("*").alias("m"), F.count(F.when(F.col("b.p") >= RANDOM_P, 1)).alias("n")).collect())
    out = [math.inf] * len(LENGTHS)
    for length in range(len(LENGTHS)):
        own = sorted((r for r in bins if r["length"] == length), key=lambda r: -r["bin"])
        m, k = sum(r["m"] for r in own), 0
        for r in own:
            k += r["n"]
            if k and r["bin"] >= 0 and r["bin"] / 2 >= math.log(m / (fdr * k)):
                out[length] = r["bin"] / 2
    return out


def scan(docs: DataFrame, *, text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """``docs`` with two columns more (names as in ``_added``): the patterns' spans and all spans, arrays of
    ``(start, rank, end)``, rank into ``KINDS``."""
    base, spans, cands = _added(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumn(base, _spans(text)).withColumn(cands, _candidates(text, F.col(base)))
    limits = F.array(*(F.lit(x) for x in thresholds(found.select(F.col(cands).alias("cands")), fdr)))
    random = F.filter(cands, lambda m: let(battery(m["token"]), lambda b: (b["p"] >= RANDOM_P) & (
        b["log_e"] >= F.get(limits, _length_class(F.char_length(m["token"]))))))
    own = F.transform(random, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("rank"), m["end"].alias("end")))
    return found.withColumn(spans, F.sort_array(F.concat(base, own))).drop(cands)


def _added(docs: DataFrame) -> list[str]:
    return free_names(docs, "base_spans", "all_spans", "candidates")


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per document: ``doc_id, base, spans`` (arrays of ``kind:start:end``)."""
    kinds = F.array(*map(F.lit, KINDS))
    shown = lambda c: F.transform(c, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"]))
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), fdr=fdr)
    return found.select("doc_id", shown("base_spans").alias("base"), shown("all_spans").alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs``, all columns, with ``mark`` in place of every span (overlapping spans are one); ``n_chars``
    follows if it is there."""
    def cut(a: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= a["at"], F.concat(
            F.substr(F.col(text_col), a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], gap).alias("out"))

    found, spans = scan(docs, text_col=text_col, fdr=fdr), _added(docs)[1]
    text = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut,
                       lambda a: F.concat(a["out"], F.substr(F.col(text_col), a["at"] + 1)))
    some = F.size(spans) > 0
    out = found.withColumn(text_col, F.when(some, text).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.char_length(text_col).cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
