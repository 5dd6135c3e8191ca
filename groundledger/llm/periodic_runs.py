"""Maximal runs of periodic words, found by uniting suffix classes by falling LCP, and texts without the repeats.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are the same), of at least ``least`` words
and ``exponent`` periods, that no word beside it continues. Method, document by document: sort the suffixes of the word sequence
by prefix doubling, and read the LCP of neighbours off the ranks of the rounds. Suffixes are then united as in Kruskal's method,
the pair of largest LCP first, by union-find whose classes are ordered lists of positions; the smaller list goes into the larger
one. When positions ``a < b`` become neighbours in a class, their suffixes agree in exactly ``l`` words, the LCP of this union. If
``b - a <= l`` they seed a run of period ``b - a``, which is the smallest one (a smaller one would have put a position of the
same class between them), and which ends at ``b + l``. It begins at ``a`` if the words before ``a`` and ``b`` differ; other
pairs belong to a run that is seeded from its own begin. So each run comes out once, in O(n log n) insertions.

Unions below the LCP that the shortest admitted run needs are left out, and so are documents in which no gram of that many words
returns soon enough: neither can seed a run.

Words are split at ASCII blanks. A null text has no words and collapses to the empty text, and so does one of blanks. Texts of any
length are worked on whole, each in one task (about 4 bytes a word and round of doubling). Every row has its own result: repeated
rows and ids, null ids and ties need no rule. Other columns stay; a column named like a new one is replaced.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame

from .common import with_columns

#: Words that are sorted together; a longer document is sorted alone.
TOGETHER = 1 << 17


def least_lcp(least: int, exponent: int) -> int:
    """Words in which the two seeds of a run of any period agree at least."""
    return min(max(least - d, (exponent - 1) * d) for d in range(1, least + 1))


def doubling(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks of the beginnings of 1, 2, 4, ... words, until all suffixes differ. ``codes`` hold a different negative number behind
    each document, so no beginning crosses a border."""
    order = np.argsort(codes, kind="stable")
    rank = np.empty(len(codes), np.int64)
    first = np.r_[True, codes[order][1:] != codes[order][:-1]]
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(codes)), 0))
    rounds, length = [rank.astype(np.int32)], 1
    while True:
        sizes = np.bincount(rank, minlength=len(rank))
        open_ = np.flatnonzero(sizes[rank] > 1)
        if not len(open_):
            return rounds
        key = rank[open_] * np.int64(len(codes)) + rank[open_ + length]
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        # a class keeps its place in the order; inside it, a new class begins where the second half changes
        place = np.arange(len(open_))
        old = rank[open_]
        head = np.r_[True, old[1:] != old[:-1]]
        begin = np.maximum.accumulate(np.where(head, place, 0))
        new = np.r_[True, key[1:] != key[:-1]]
        rank[open_] = old + np.maximum.accumulate(np.where(new, place, 0)) - begin
        rounds.append(rank.astype(np.int32))
        length *= 2


def neighbours_by_lcp(rounds: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in suffix order with their LCP, the largest first, those below ``least`` left out."""
    order = np.argsort(rounds[-1], kind="stable")
    a, b = order[:-1], order[1:]
    near = rounds[0][a] == rounds[0][b]
    a, b = a[near], b[near]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        same = rounds[k][a + lcp] == rounds[k][b + lcp]
        lcp[same] += 1 << k
    long_ = np.flatnonzero(lcp >= least)
    long_ = long_[np.argsort(-lcp[long_], kind="stable")]
    return a[long_], b[long_], lcp[long_]


def seeds(codes: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """``start, length, period`` of the runs of ``codes``, whose first number is a border as well."""
    first, second, lcps = neighbours_by_lcp(doubling(codes), least_lcp(least, exponent))
    word = codes.tolist()
    owner: dict[int, list[int]] = {}
    out = []
    for x, y, l in zip(first.tolist(), second.tolist(), lcps.tolist()):
        small, large = owner.get(x) or [x], owner.get(y) or [y]
        if len(small) > len(large):
            small, large = large, small
        reach = min(l // (exponent - 1), l)
        at, end = 0, len(small)
        for i, p in enumerate(small):
            at = bisect_left(large, p, at)
            if at and (i == 0 or large[at - 1] != small[i - 1]):
                q = large[at - 1]
                if p - q <= reach and p - q + l >= least and word[q - 1] != word[p - 1]:
                    out.append((q, p - q + l, p - q))
            if at < len(large) and (i + 1 == end or large[at] < small[i + 1]):
                q = large[at]
                if q - p <= reach and q - p + l >= least and word[q - 1] != word[p - 1]:
                    out.append((p, q - p + l, q - p))
            large.insert(at, p)
            owner[p] = large
        if len(large) == 2:  # the other one was a single position, too, and has no entry yet
            owner[x] = owner[y] = large
    return out


def returning(codes: np.ndarray, doc: np.ndarray, size: np.ndarray, gram: int, exponent: int) -> np.ndarray:
    """Whether a gram of each document returns within the longest period that fits; a hash may say yes too often."""
    hit = np.zeros(len(size), bool)
    n = len(codes) - gram + 1
    if n < 1:
        return hit
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + n].astype(np.uint64) + np.uint64(1)
            h ^= h >> np.uint64(31)
    by = np.argsort(h, kind="stable")
    a, b = by[:-1], by[1:]
    near = (h[a] == h[b]) & (doc[a] == doc[b]) & ((b - a) * exponent <= size[doc[a]])
    hit[doc[a[near]]] = True
    return hit


def runs_of(docs: list[list[bytes]], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each word sequence, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    group: list[int] = []
    held = 0
    for i, words in enumerate(docs):
        if len(words) < least:
            continue
        if group and held + len(words) > TOGETHER:
            _solve(docs, group, out, least, exponent)
            group, held = [], 0
        group.append(i)
        held += len(words)
    if group:
        _solve(docs, group, out, least, exponent)
    return out


def _solve(docs: list[list[bytes]], group: list[int], out: list, least: int, exponent: int) -> None:
    known: dict[bytes, int] = {}
    parts, border = [], -1
    for i in group:
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in docs[i]), np.int64, len(docs[i])))
    size = np.array([len(p) for p in parts])
    doc = np.repeat(np.arange(len(parts)), size)
    kept = np.flatnonzero(returning(np.concatenate(parts), doc, size, least_lcp(least, exponent), exponent))
    if not len(kept):
        return
    codes, starts, at = [np.array([border])], [], 1
    for k in kept:
        border -= 1
        starts.append(at)
        # numbered apart for each document, so classes never mix documents
        codes += [parts[k] + k * len(known), np.array([border])]
        at += len(parts[k]) + 1
    begins = np.array(starts)
    for start, length, period in seeds(np.concatenate(codes), least, exponent):
        k = int(np.searchsorted(begins, start, "right")) - 1
        out[group[kept[k]]].append((start - starts[k], length, period))
    for k in kept:
        out[group[k]].sort(key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, each run cut to its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(change.cumsum()[:-1] == 0)])


def find_runs(docs: DataFrame, least: int = 6, exponent: int = 4, text: str = "text", names: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """Adds all runs of each text, by start and then period, and the text with each run cut to its first period."""
    if least < 2 or exponent < 2:
        raise ValueError("a run has two words and two periods at least")

    def make():
        def solve(texts: list) -> list:
            words = [(t or b"").split() for t in texts]
            runs = runs_of(words, least, exponent)
            return [runs, [collapse(w, r) for w, r in zip(words, runs)]]

        return solve

    return with_columns(docs, [text], make, "`{}` array<struct<start: long, length: long, period: long>>, `{}` string".format(*names))
