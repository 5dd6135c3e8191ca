"""Token counts of the sections of a document, from one encoding of the whole document.

The whole text is encoded once; each token has a span of bytes, and with it of characters. Tokens meet the sections by an
interval join inside the task (binary search in the sorted borders). A token that touches one section counts there. A
token that touches several, or a section and a gap between sections, counts where most of its bytes are; on a tie, where
it begins first. Tokens outside of all sections form a row of their own with a null section, so the counts of a document
add up to its tokens.

Sections are half-open ranges of characters, given in an array column or, by default, the lines with their line ends.
They are put in order of start; one that reaches into the next is cut there, ranges outside the text are cut to it, and
empty ones keep a row with no tokens. A null or empty text has no tokens: it gives one row with a null section. Null
entries of the array count as absent. Repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .bpe import codec
from .common import Memo, flat_rows, in_small_batches, strips

FIELDS = "doc_id long, section int, name string, start long, end long, n_tokens long, n_crossing long, doc_tokens long"


@lru_cache(2)
def _lengths(path: str, pattern: str) -> Memo:
    """Chunk -> the byte lengths of its tokens, as 16-bit numbers."""
    c = codec(path, pattern)
    size = np.array([len(p) for p in c.pieces], "<u2")
    return Memo(lambda new: [size[ids].tobytes() for ids in c.encode_chunks(new)])


def lines(text: bytes) -> list[tuple[str, int, int]]:
    """The lines of a text as byte ranges; the first with a word is the title, ``|`` marks a table, the rest is body."""
    out, at, titled = [], 0, False
    for raw in text.splitlines(True) if b"\r" not in text else text.replace(b"\r", b" ").splitlines(True):
        if not raw.strip():
            name = "blank"
        elif not titled:
            name, titled = "title", True
        else:
            name = "table" if b"|" in raw else "body"
        out.append((name, at, at + len(raw)))
        at += len(raw)
    return out


def allot(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none) and whether it crosses a border. Tokens follow each other without gaps and end at
    ``ends``; sections are ordered and apart."""
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    if not len(starts):
        return np.full(len(ends), -1), np.zeros(len(ends), bool)
    first = np.searchsorted(stops, begins, "right")
    last = np.searchsorted(starts, ends, "left") - 1
    inside = (first == last) & (starts[np.minimum(first, len(starts) - 1)] <= begins) & (stops[np.maximum(last, 0)] >= ends)
    crossing = (last >= first) & ~inside
    section = np.where(inside, first, -1)
    for i in np.flatnonzero(crossing):
        a, b = int(begins[i]), int(ends[i])
        share, begin, at = {-1: 0}, {-1: b}, a
        for s in [*range(int(first[i]), int(last[i]) + 1), None]:
            lo, hi = (b, b) if s is None else (max(a, int(starts[s])), min(b, int(stops[s])))
            if lo > at:  # bytes of no section
                share[-1] += lo - at
                begin[-1] = min(begin[-1], at)
            if hi > lo:
                share[s], begin[s] = hi - lo, lo
            at = max(at, hi)
        most = max(share.values())
        section[i] = min((s for s, n in share.items() if n == most), key=begin.get)
    return section, crossing


def count_tokens(docs: DataFrame, path: str, pattern: str, sections: str | None = None, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """One row per section of each document; ``sections``: column ``array<struct<name,start,end>>`` in characters."""
    def make():
        c, memo = codec(path, pattern), _lengths(path, pattern)

        def given(raw: bytes, spans: list) -> list[tuple[str, int, int]]:
            heads = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            at = np.append(heads, len(raw))
            n = len(heads)
            spans = sorted((max(0, min(n, s["start"] or 0)), i, max(0, min(n, n if s["end"] is None else s["end"])), s["name"])
                           for i, s in enumerate(spans) if s is not None)
            out = []
            for k, (a, _, b, name) in enumerate(spans):
                b = max(a, min(b, spans[k + 1][0]) if k + 1 < len(spans) else b)
                out.append((name, int(at[a]), int(at[b])))
            return out

        def run(batch):
            for strip in strips(batch, 1):
                keys, part = strip.column(0).to_pylist(), strip.column(1).to_pylist()
                spans = strip.column(2).to_pylist() if sections else [None] * len(keys)
                cut = [c.chunks(t) if t else [] for t in part]
                memo.know(x for xs in cut for x in xs)
                out = {n: [] for n in ("doc_id", "section", "name", "start", "end", "n_tokens", "n_crossing", "doc_tokens")}
                for key, t, xs, own in zip(keys, part, cut, spans):
                    raw = (t or "").encode()
                    ends = np.cumsum(np.frombuffer(b"".join(map(memo.known.__getitem__, xs)), "<u2"), dtype=np.int64)
                    parts = (given(raw, own or []) if sections else lines(raw))
                    a, b = np.array([p[1] for p in parts], np.int64), np.array([p[2] for p in parts], np.int64)
                    full = np.flatnonzero(b > a)
                    where, crossing = allot(ends, a[full], b[full])
                    n, x = (np.bincount(where + 1, w, len(full) + 1).astype(int) for w in (None, crossing))
                    count, cross = np.zeros(len(parts), int), np.zeros(len(parts), int)
                    count[full], cross[full] = n[1:], x[1:]
                    heads = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                    chars = lambda p: int(heads[p - 1]) if p else 0
                    rows = [(i, name, chars(s), chars(e), int(count[i]), int(cross[i])) for i, (name, s, e) in enumerate(parts)]
                    if n[0] or not rows:
                        rows.append((None, None, None, None, int(n[0]), int(x[0])))
                    for r in rows:
                        for k, v in zip(("section", "name", "start", "end", "n_tokens", "n_crossing"), r):
                            out[k].append(v)
                        out["doc_id"].append(key)
                        out["doc_tokens"].append(len(ends))
                yield out

        return run

    cols = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")]
    if sections:
        cols.append(F.col(sections).cast("array<struct<name:string,start:long,end:long>>").alias("sections"))
    return flat_rows(in_small_batches(docs.select(*cols)), make, FIELDS)
