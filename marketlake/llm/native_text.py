"""Column expressions shared by the native operators: words, n-gram hashes, binding a value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas inside use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; ``lower`` does it faster for pure ASCII."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def split_words(text: Column, separators: str) -> Column:
    """The non-empty pieces between runs of ``separators`` (a character class); null has none."""
    pieces = F.split(F.coalesce(text, F.lit("")), f"{separators}+")
    # only the first and the last piece can be empty
    return let(pieces, lambda p: let(
        F.when(F.get(p, F.lit(0)) == "", F.slice(p, 2, F.size(p))).otherwise(p),
        lambda q: F.when((F.size(q) > 0) & (F.element_at(q, F.greatest(F.size(q), F.lit(1))) == ""),
                         F.slice(q, 1, F.size(q) - 1)).otherwise(q)))


def shifted(a: Column, b: Column, by: int, combine: Callable[[Column, Column], Column]) -> Column:
    """``combine(a[i], b[i + by])`` for all places that both arrays have."""
    n = F.greatest(F.least(F.size(a), F.size(b) - by), F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, by + 1, n), combine)


def gram_hashes(words: Column, n: int) -> Column:
    """64-bit hash of every ``n`` consecutive words."""
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda ones: doubled(ones, n))


def doubled(ones: Column, n: int) -> Column:
    """The same from the words' hashes, by doubling: a gram is hashed from the two halves'
    hashes, and an odd one from its first half and the last word."""
    def of(k: int, ones: Column) -> Column:
        if k == 1:
            return ones
        half = k // 2
        return let(of(half, ones), lambda h: let(
            shifted(h, h, half, lambda x, y: F.xxhash64(x, y)),
            lambda even: even if k % 2 == 0 else shifted(even, ones, k - 1, lambda x, y: F.xxhash64(x, y))))

    return of(n, ones)
