"""The fragment monoid of operator 13: two token sequences over the same bytes, cut into groups piece by piece.

A group ends where a token of A and a token of B end at the same byte. A ``Fragment`` stands for any byte range of a
document: the tokens that end in it, as far as the range alone tells their groups.

- Before the first common end, the tokens belong to a group that may have begun in an earlier range: the open prefix.
- Between the first and the last common end, groups are closed. Only their text form and the number of occurrences of
  each linked pair are kept.
- After the last common end, the tokens wait for a later range: the open suffix.

``compose`` joins neighbours: the left one's open suffix and the right one's open prefix are one group (or, without a common
end on the right, one longer open suffix). It is associative and ``EMPTY`` is its identity, so fragments of a long
document may be composed in a tree, in any bracketing, in different tasks. ``finish`` closes a whole document's
fragment: its first group begins with the document.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

Ids = tuple[int, ...]


class Fragment(NamedTuple):
    #: False where the tokens' bytes are not the text's: the whole document has no tokens then.
    ok: bool
    #: The range holds a common end.
    closed: bool
    #: Without a common end, all tokens are here.
    prefix_a: Ids
    prefix_b: Ids
    #: Closed groups as text, ``a1,a2|b1;a3|b2,b3``.
    groups: str
    n_groups: int
    n_a: int
    n_b: int
    #: Linked pairs (see ``link``), one for each common end, the open prefix's included.
    links: tuple[int, ...]
    suffix_a: Ids
    suffix_b: Ids


EMPTY = Fragment(True, False, (), (), "", 0, 0, 0, (), (), ())


def group_text(a: Ids, b: Ids) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def link(a: int, b: int) -> int:
    return (b << 32) | a


def compose(x: Fragment, y: Fragment) -> Fragment:
    ok, n_a, n_b = x.ok and y.ok, x.n_a + y.n_a, x.n_b + y.n_b
    if not x.closed and not y.closed:
        return Fragment(ok, False, x.prefix_a + y.prefix_a, x.prefix_b + y.prefix_b, "", 0, n_a, n_b, (), (), ())
    if not x.closed:
        return y._replace(ok=ok, prefix_a=x.prefix_a + y.prefix_a, prefix_b=x.prefix_b + y.prefix_b, n_a=n_a, n_b=n_b)
    if not y.closed:
        return x._replace(ok=ok, suffix_a=x.suffix_a + y.prefix_a, suffix_b=x.suffix_b + y.prefix_b, n_a=n_a, n_b=n_b)
    joint = group_text(x.suffix_a + y.prefix_a, x.suffix_b + y.prefix_b)
    groups = ";".join(g for g in (x.groups, joint, y.groups) if g)
    return Fragment(ok, True, x.prefix_a, x.prefix_b, groups, x.n_groups + y.n_groups + 1, n_a, n_b, x.links + y.links,
                    y.suffix_a, y.suffix_b)


def groups_text(a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray, after: np.ndarray) -> bytes:
    """The text of many groups at once, each followed by its byte of ``after``; group g holds A's tokens from
    ``stop_a[g - 1]`` to ``stop_a[g]``, and B's likewise."""
    n_a, n_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    at_a = np.arange(len(a)) + np.repeat(stop_b - n_b, n_a)  # A's tokens of a group stand before B's
    at_b = np.arange(len(b)) + np.repeat(stop_a, n_b)
    ids = np.empty(len(a) + len(b), dtype=np.int64)
    ids[at_a], ids[at_b] = a, b
    width = len(str(int(ids.max(initial=0))))
    shown = np.empty((len(ids), width + 1), dtype=np.uint8)
    shown[:, width] = ord(",")
    shown[at_a[stop_a - 1], width] = ord("|")
    shown[at_b[stop_b - 1], width] = after
    keep = np.ones(shown.shape, dtype=bool)
    for i in range(width):
        power = 10 ** (width - 1 - i)
        shown[:, i] = ord("0") + ids // power % 10
        if power > 1:
            keep[:, i] = ids >= power
    return shown[keep].tobytes()


def fragment(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """The fragment of the tokens that end in one byte range; ``a_ends`` and ``b_ends`` are their ends, ascending."""
    common = np.intersect1d(a_ends, b_ends)
    if not len(common):
        return EMPTY._replace(prefix_a=tuple(a.tolist()), prefix_b=tuple(b.tolist()), n_a=len(a), n_b=len(b))
    at, bt = (np.searchsorted(ends, common, side="right") for ends in (a_ends, b_ends))
    links = tuple(link(x, y) for x, y in zip(a[at - 1].tolist(), b[bt - 1].tolist()))
    groups = ""
    if len(common) > 1:
        inner_a, inner_b = a[at[0]:at[-1]], b[bt[0]:bt[-1]]
        after = np.full(len(common) - 1, ord(";"), dtype=np.uint8)
        groups = groups_text(inner_a, inner_b, at[1:] - at[0], bt[1:] - bt[0], after)[:-1].decode()
    return Fragment(True, True, tuple(a[:at[0]].tolist()), tuple(b[:bt[0]].tolist()), groups, len(common) - 1, len(a), len(b),
                    links, tuple(a[at[-1]:].tolist()), tuple(b[bt[-1]:].tolist()))


def finish(x: Fragment) -> Fragment:
    """A whole document: the open prefix is its first group. With the same bytes on both sides the last ends meet, so
    nothing is open at its end."""
    if not x.ok or not x.closed:
        return EMPTY._replace(ok=x.ok)
    first = group_text(x.prefix_a, x.prefix_b)
    return x._replace(prefix_a=(), prefix_b=(), groups=f"{first};{x.groups}" if x.groups else first, n_groups=x.n_groups + 1)
