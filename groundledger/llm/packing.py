"""Packing of documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are those of its whole text and one end id. Whole windows are cut off a document first; what is left is
cut into pieces of at most ``grain`` ids. Pieces gather in blocks of about ``block`` windows while a task reads its
partition, so nothing is shuffled and a task holds one block. Per block the multiway differencing method merges partial
partitions, the largest with the smallest parts, into near-equal windows; if one passes the capacity, the block gets one
window more and is solved again. Before that, ids are taken off a block as sequences whose lengths are powers of two, so
that its rest fills whole windows.

Null and empty texts are documents of the end id alone. Every row is packed, repeated rows and ids too. Empty tables give
no pieces. The same input partition always gives the same pieces, so a lost task can be run again.
"""

from __future__ import annotations

import heapq
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import Memo, _arrow, in_small_batches, strips
from .vocab import word_ids

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], windows: int) -> np.ndarray:
    """Window of each size. Partial partitions are vectors of ``windows`` sums, kept in falling order; the two of the
    largest spread are merged so that the largest sums meet the smallest, until one is left."""
    n = len(sizes)
    if windows <= 1 or n == 0:
        return np.zeros(n, np.int64)
    sums: list = [None] * n
    nodes: list = [None] * n  # (left, right, slot of left per slot, slot of right per slot)
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def vector(i: int) -> np.ndarray:
        if i < n:
            v = np.zeros(windows, np.int64)
            v[0] = sizes[i]
            return v
        return sums[i]

    back = np.arange(windows - 1, -1, -1)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = vector(a) + vector(b)[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        nodes.append((a, b, order, back[order]))
        sums.append(total - total[-1])
        if a >= n:
            sums[a] = None
        if b >= n:
            sums[b] = None
        heapq.heappush(heap, (-int(total[0] - total[-1]), len(nodes) - 1))
    out = np.zeros(n, np.int64)
    todo = [(heap[0][1], np.arange(windows))]
    while todo:
        i, window_of = todo.pop()
        if i < n:
            out[i] = window_of[0]
            continue
        a, b, left, right = nodes[i]
        for child, slots in ((a, left), (b, right)):
            w = np.empty(windows, np.int64)
            w[slots] = window_of
            todo.append((child, w))
    return out


class Packer:
    """Takes documents one by one and gives placed pieces ``(document, start, length, sequence, offset)``."""

    def __init__(self, capacity: int, grain: int, block: int, slack: int) -> None:
        self.capacity, self.grain, self.block, self.slack = capacity, grain, block * capacity, slack
        self.waiting: list[tuple[int, int, int]] = []
        self.total = self.sequences = 0

    def _open(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def add(self, doc: int, tokens: int) -> Iterator[tuple[int, int, int, int, int]]:
        at = 0
        while tokens - at >= self.capacity:
            yield doc, at, self.capacity, self._open(), 0
            at += self.capacity
        while at < tokens:
            n = min(self.grain, tokens - at)
            self.waiting.append((doc, at, n))
            self.total += n
            at += n
        if self.total >= self.block:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, int, int, int, int]]:
        yield from self._powers()
        pieces, self.waiting, total, self.total = self.waiting, [], self.total, 0
        if not pieces:
            return
        windows = -(-total // self.capacity)
        sizes = [n for _, _, n in pieces]
        while True:
            window = differencing(sizes, windows)
            filled = np.bincount(window, weights=sizes, minlength=windows)
            if filled.max() <= self.capacity:
                break
            windows += 1
        first = self.sequences
        ids = {int(w): first + i for i, w in enumerate(np.flatnonzero(filled))}
        self.sequences += len(ids)
        at = [0] * windows
        for (doc, start, n), w in zip(pieces, window.tolist()):
            yield doc, start, n, ids[w], at[w]
            at[w] += n

    def _powers(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Takes what whole windows can't hold, and ``slack`` ids per window, off the block as powers of two."""
        windows = self.total // self.capacity
        over = self.total - windows * self.capacity
        over = min(self.total, over + windows * self.slack)
        if windows == 0 and over > self.capacity * 15 // 16:
            return
        size = self.capacity
        while over > 0 and self.waiting:
            while size > over and size > 64:
                size //= 2
            if size > self.total:  # fewer than 64 ids are left
                if windows:
                    return
                while size > self.total:
                    size //= 2
            take, at, sequence = size, 0, self._open()
            while take:
                doc, start, n = self.waiting.pop()
                used = min(n, take)
                yield doc, start, used, sequence, at
                if used < n:
                    self.waiting.append((doc, start + used, n - used))
                at, take = at + used, take - used
            self.total -= size
            over -= size


@lru_cache(2)
def _memo(path: str) -> Memo:
    return Memo(word_ids(path), most=350_000)


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096, grain: int = 4096, block: int = 128,
         slack: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    schema = _arrow(StructType.fromDDL(PIECES))
    end = struct.pack("<I", end_id)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memo, packer = _memo(path), Packer(capacity, grain, block, slack)
        held: dict[int, tuple] = {}  # documents with pieces that wait
        base = TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        seen = 0

        def put(placed) -> None:
            for doc, start, n, sequence, offset in placed:
                key, ids = held[doc]
                out.append((key, start, n, zlib.crc32(ids[4 * start:4 * (start + n)]), len(ids) // 4, base + sequence, offset))

        def sent() -> Iterator[pa.RecordBatch]:
            waits = {d for d, _, _ in packer.waiting}
            for d in [d for d in held if d not in waits]:
                del held[d]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()

        for batch in batches:
            for part in strips(batch, 1):
                words = [(t or b"").split() for t in part.column(1).cast(pa.binary()).to_pylist()]
                memo.know(set().union(*words))
                for key, ws in zip(part.column(0).to_pylist(), words):
                    ids = b"".join(map(memo.known.__getitem__, ws)) + end
                    held[seen] = (key, ids)
                    put(packer.add(seen, len(ids) // 4))
                    seen += 1
                yield from sent()
        put(packer.flush())
        yield from sent()

    return in_small_batches(docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))).mapInArrow(run, StructType.fromDDL(PIECES))
