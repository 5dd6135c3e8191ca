"""Fuzzy and phonetic similarity as Arrow-batched columns.

The pure helpers work on one pair of short strings (a quote and a line); Spark decides which pairs exist.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, functions as F


def jaro_winkler(a: str, b: str) -> float:
    """Winkler's prefix-boosted Jaro similarity; the boost applies above 0.7."""
    if a == b:
        return 1.0 if a else 0.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(max(la, lb) // 2 - 1, 0)
    taken = [False] * lb
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(lb) if taken[j]]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    sim = (m / la + m / lb + (m - swaps) / m) / 3
    if sim > 0.7:
        prefix = 0
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            prefix += 1
        sim += prefix * 0.1 * (1 - sim)
    return sim


_VOWELS = set("aeiou")


def metaphone_word(word: str) -> str:
    """Philips' Metaphone key of one lower-case a-z word."""
    w = word
    for start, keep in (("kn", 1), ("gn", 1), ("pn", 1), ("wr", 1), ("ae", 1)):
        if w.startswith(start):
            w = w[keep:]
            break
    out: list[str] = []
    n = len(w)
    at = lambda k: w[k] if 0 <= k < n else ""
    i = 0
    while i < n:
        c, nxt, after = w[i], at(i + 1), at(i + 2)
        if c == nxt and c != "c":
            i += 1
            continue
        step = 1
        if c in _VOWELS:
            if i == 0:
                out.append(c)
        elif c == "b":
            if not (at(i - 1) == "m" and nxt == ""):
                out.append("b")
        elif c == "c":
            if nxt == "i" and after == "a" or nxt == "h":
                out.append("x")
                step = 2 if nxt == "h" else 1
            elif nxt and nxt in "iey":
                out.append("s")
            else:
                out.append("k")
        elif c == "d":
            if nxt == "g" and after and after in "iey":
                out.append("j")
                step = 3
            else:
                out.append("t")
        elif c in "fjlmnr":
            out.append(c)
        elif c == "g":
            if nxt and nxt in "iey":
                out.append("j")
            elif nxt == "h" and after and after not in _VOWELS:
                step = 2
            elif nxt == "n" and after == "":
                step = 2
            else:
                out.append("k")
        elif c == "h":
            if i == 0 or nxt in _VOWELS or at(i - 1) not in _VOWELS:
                out.append("h")
        elif c == "k":
            if i == 0 or at(i - 1) != "c":
                out.append("k")
        elif c == "p":
            if nxt == "h":
                out.append("f")
                step = 2
            else:
                out.append("p")
        elif c == "q":
            out.append("k")
        elif c == "s":
            if nxt == "h":
                out.append("x")
                step = 2
            elif nxt == "i" and after and after in "oa":
                out.append("x")
                step = 3
            else:
                out.append("s")
        elif c == "t":
            if nxt == "i" and after and after in "oa":
                out.append("x")
            elif nxt == "h":
                out.append("0")
                step = 2
            elif not (nxt == "c" and after == "h"):
                out.append("t")
        elif c == "v":
            out.append("f")
        elif c == "w":
            if i == 0 and nxt == "h":
                step = 2
                if at(2) in _VOWELS:
                    out.append("w")
            elif nxt in _VOWELS and nxt:
                out.append("w")
        elif c == "x":
            out.append("s" if i == 0 else "ks")
        elif c == "y":
            if nxt in _VOWELS and nxt:
                out.append("y")
        elif c == "z":
            out.append("s")
        i += step
    return "".join(out).upper()


def metaphone(phrase: str) -> str:
    """Key of a phrase that ignores word boundaries."""
    letters = "".join(ch if "a" <= ch <= "z" else " " for ch in phrase.lower())
    return "".join(metaphone_word(w) for w in letters.split())


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel row updates."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs_length(a, b) / total


def partial_ratio(a: str, b: str, floor: float = 0.0) -> float:
    """Best indel ratio of the shorter text against windows of the longer one; 0 when below ``floor``."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 100.0
    m, n = len(a), len(b)
    # A window reaching ratio r with length w <= m needs lcs >= r (m + w) / 200 and w >= lcs.
    if floor and lcs_length(a, b) < math.ceil(m * floor / (200.0 - floor) - 1e-9):
        return 0.0
    best = 0.0
    letters = set(a)
    for i in range(1, m):
        if b[i - 1] in letters:
            best = max(best, indel_ratio(a, b[:i]))
    for i in range(n - m + 1):
        if b[i + m - 1] in letters:
            best = max(best, indel_ratio(a, b[i:i + m]))
    for i in range(n - m + 1, n):
        if b[i] in letters:
            best = max(best, indel_ratio(a, b[i:]))
    if m == n:
        letters = set(b)
        for i in range(1, m):
            if a[i - 1] in letters:
                best = max(best, indel_ratio(b, a[:i]))
            if a[i] in letters:
                best = max(best, indel_ratio(b, a[i:]))
    return best if best >= floor else 0.0


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of the word sets of two texts."""
    sa, sb = set(a.split()), set(b.split())
    if not sa or not sb:
        return 0.0
    both, only_a, only_b = sa & sb, " ".join(sorted(sa - sb)), " ".join(sorted(sb - sa))
    if both and (not only_a or not only_b):
        return 100.0
    shared = " ".join(sorted(both))
    best = indel_ratio(only_a, only_b) if not shared else indel_ratio(f"{shared} {only_a}", f"{shared} {only_b}")
    if shared:
        best = max(best, indel_ratio(shared, f"{shared} {only_a}"), indel_ratio(shared, f"{shared} {only_b}"))
    return best


def _pairwise(fn, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def _single(fn):
    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else fn(x))

    return run


def jaro_winkler_col(a: Column, b: Column) -> Column:
    return _pairwise(jaro_winkler, "double")(a, b)


def metaphone_col(a: Column) -> Column:
    return _single(metaphone)(a)


def token_set_col(a: Column, b: Column) -> Column:
    return _pairwise(token_set_ratio, "double")(a, b)


def partial_ratio_col(a: Column, b: Column, floor: float = 0.0) -> Column:
    return _pairwise(lambda x, y: partial_ratio(x, y, floor), "double")(a, b)
