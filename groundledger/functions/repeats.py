"""Phrases said several times in a row, in time that hardly grows faster than the text."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

_WORD = re.compile(r"[\w']+")
#: Words that are looked at together.
TOGETHER = 1 << 17


def _ranks(codes: np.ndarray, rounds: int) -> list[np.ndarray]:
    """Numbers of the groups of 1, 2, 4, ... words from each position on; -1 - position where the text ends before."""
    n = len(codes)
    out = [codes]
    for t in range(rounds):
        step = 1 << t
        last = out[-1]
        key = np.full(n, -1, np.int64)
        key[: n - step] = last[: n - step] * np.int64(2 * n + 2) + last[step:] + n + 1
        whole = n - 2 * step + 1
        if whole < 1:
            break
        now = -1 - np.arange(n)
        now[:whole] = np.unique(key[:whole], return_inverse=True)[1]
        out.append(now)
    return out


def _agree(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words in which the text from ``a`` on and from ``b`` on agree (``a < b``)."""
    n = len(ranks[0])
    out = np.zeros(len(a), np.int64)
    for t in range(len(ranks) - 1, -1, -1):
        at = np.flatnonzero(b + out < n)
        same = at[ranks[t][a[at] + out[at]] == ranks[t][b[at] + out[at]]]
        out[same] += 1 << t
    return out


def _repeated(codes: np.ndarray, min_words: int, repeats: int) -> bool:
    """A phrase of n words said so often is a stretch of ``n (repeats - 1)`` positions that equal the word n further on. Such a
    stretch holds a multiple of n, so it is found by looking ahead and back from those only: n ln n places in all."""
    size = len(codes)
    anchors, lengths = [], []
    for n in range(min_words, size // repeats + 1):
        at = np.arange(0, size - n, n)
        at = at[codes[at] == codes[at + n]]
        anchors.append(at)
        lengths.append(np.full(len(at), n))
    a, n = np.concatenate(anchors), np.concatenate(lengths)
    if not len(a):
        return False
    rounds = int(size).bit_length()
    ahead = _agree(_ranks(codes, rounds), a, a + n)
    back = _agree(_ranks(codes[::-1].copy(), rounds), size - (a + n), size - a)  # the text before the anchor, read backwards
    return bool((ahead + back >= n * (repeats - 1)).any())


def say_again(texts: list[str | None], min_words: int = 4, repeats: int = 3) -> list[bool]:
    """Whether some phrase of ``min_words`` or more words is said ``repeats`` or more times in a row, for each text."""
    out = [False] * len(texts)
    group: list[tuple[int, list[str]]] = []
    held = 0
    for i, text in enumerate(texts):
        words = _WORD.findall(text.lower()) if text else []
        if len(words) >= min_words * repeats:
            group.append((i, words))
            held += len(words)
        if held >= TOGETHER or (i == len(texts) - 1 and group):
            for k in _candidates([w for _, w in group], min_words, repeats):
                out[group[k][0]] = _repeated(pd.factorize(np.asarray(group[k][1], dtype=object))[0].astype(np.int64), min_words, repeats)
            group, held = [], 0
    return out


def _candidates(docs: list[list[str]], min_words: int, repeats: int) -> list[int]:
    """Texts in which a group of ``min_words`` words comes ``repeats`` times; equal hashes may let a text through in vain."""
    known: dict[str, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for words in docs for w in words], np.uint64)
    doc = np.repeat(np.arange(len(docs)), [len(w) for w in docs])
    n = len(codes) - min_words + 1
    h = doc[:n].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min_words):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + n]
    order = np.argsort(h, kind="stable")
    often = h[order[: n - repeats + 1]] == h[order[repeats - 1:]]
    return np.unique(doc[order[: n - repeats + 1][often]]).tolist()


def may_repeat(text: Column, min_words: int = 4, repeats: int = 3) -> Column:
    """False only for texts without such a phrase: all but one of its copies say words that were said before. Texts with letters
    or signs whose words Spark might cut in another way are left to the exact test."""
    words = F.split(F.lower(text), r"[^\p{L}0-9_']+")
    return text.rlike(r"[^\x00-\x7F\p{L}]|[İΣ]") | (F.size(words) - F.size(F.array_distinct(words)) >= min_words * (repeats - 1))


def repeated_phrase_col(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series(say_again(list(t)), dtype="boolean")

    return run(F.when(may_repeat(text), text))
