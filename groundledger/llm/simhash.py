"""Near-duplicates by 64-bit SimHash fingerprints and a covering code.

Anchors are the words of the perfect binary Golay code on the first 23 bits: its balls of radius 3 cover all words once.
A fingerprint's home is the anchor within radius 3; it is replicated to every anchor within 6, radius plus threshold.
Let ``x`` and ``y`` differ in 3 bits at most, and ``a`` be the home of ``x``: ``y`` is within 6 of ``a``, so they meet
there. If ``y`` is ``3 + e`` from ``a``, at least ``e`` of the differing bits are among the first 23, so the other 41
bits differ in ``3 - e`` at most; cut into ``4 - e`` parts, one part is equal. The anchor's list is therefore kept per
(``e``, part, bits of the part), which loses no link and keeps the lists short. The full fingerprints are compared there.

Equal fingerprints are one from the start (a partial aggregate), so groups of copies don't meet at an anchor. Long lists
give a spanning forest instead of all pairs. Documents without words have fingerprint zero and are linked like others; a
null text has no words. Repeated rows are copies. ``component_id`` is the smallest non-null id of the component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import flat_rows, free_names, settle, with_columns
from .components import components

SEED = 42
#: Ids and hashes of texts that are broadcast (about a hundred bytes each).
FEW = 500_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
LENGTH, RADIUS = 23, 3
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: bytes | None, width: int = 3) -> int:
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        h = np.array([hashed(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())
        h = np.array([hashed(joined[a:b], SEED) for a, b in spans], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at:at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``fp``, the fingerprint as a signed long, in place of the text."""
    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]

    return with_columns(docs, [text], make, "fp long", without=(text,))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of division by the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(1)
def cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of weight 6 or less by syndrome: where each syndrome's begin, the words, their weights."""
    words = [0] + [sum(1 << b for b in c) for n in range(1, 2 * RADIUS + 1) for c in combinations(range(LENGTH), n)]
    words = np.array(words, np.int64)
    s = syndrome(words)
    order = np.argsort(s, kind="stable")
    return np.searchsorted(s[order], np.arange(2049)), words[order], np.bitwise_count(words[order].astype(np.uint64)).astype(np.int64)


def parts_of(rest: np.ndarray, e: int) -> list[np.ndarray]:
    """The 41 other bits cut into ``4 - e`` parts."""
    cuts = [41 * i // (4 - e) for i in range(5 - e)]
    return [rest >> np.int64(a) & np.int64((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def replicas(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``key, fingerprint, role`` of all list entries: role 0 at home, 1 replicated, 2 both."""
    first, rest = fp & np.int64((1 << LENGTH) - 1), fp >> np.int64(LENGTH) & np.int64((1 << 41) - 1)
    begins, words, weights = cosets()
    s = syndrome(first)
    n = begins[s + 1] - begins[s]
    who = np.repeat(np.arange(len(fp)), n)
    at = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[s], n)
    anchor, extra = (first[who] ^ words[at]) >> np.int64(11), np.maximum(weights[at] - RADIUS, 0)
    home = np.zeros(len(fp), np.int64)
    near = extra == 0
    home[who[near]] = anchor[near]
    for e in range(RADIUS + 1):
        for i, bits in enumerate(parts_of(rest, e)):
            tag = np.int64(e * 4 + i) << np.int64(53)
            yield tag | home << np.int64(41) | bits, fp, np.full(len(fp), 2 if e == 0 else 0, np.int8)
            if e:
                m = extra == e
                yield tag | anchor[m] << np.int64(41) | bits[who[m]], fp[who[m]], np.ones(int(m.sum()), np.int8)


def forest(nodes: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between ``nodes``."""
    left, out = np.unique(nodes).view(np.uint64), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            parent = np.full(len(left), -1)
            for i, f in enumerate(front):
                parent[(parent < 0) & (np.bitwise_count(left ^ f) <= threshold)] = i
            new = parent >= 0
            out += zip(left[new].view(np.int64).tolist(), front[parent[new]].view(np.int64).tolist())
            front, left = left[new], left[~new]
    return out


def compare(key: np.ndarray, fp: np.ndarray, role: np.ndarray, threshold: int, many: int = 64) -> np.ndarray:
    """Links inside whole lists, sorted by key: all of a short list that has a home, a forest of a long one."""
    cut = np.flatnonzero(np.diff(key)) + 1
    begin = np.concatenate([[0], cut])
    size = np.diff(np.concatenate([begin, [len(key)]]))
    homes = np.add.reduceat((role != 1).astype(np.int64), begin)
    begin, size, homes = (x[(size > 1) & (homes > 0)] for x in (begin, size, homes))
    edges = []
    for b, n in zip(begin[size > many].tolist(), size[size > many].tolist()):
        edges += forest(fp[b:b + n], threshold)
    small = size <= many
    begin, size = begin[small], size[small]
    for step in range(1, int(size.max()) if len(size) else 0):  # entry i beside entry i + step of the same list
        begin, size = begin[size > step], size[size > step]
        n = size - step
        i = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        j = i + step
        hit = (fp[i] != fp[j]) & (np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= threshold)
        edges += zip(fp[i[hit]].tolist(), fp[j[hit]].tolist())
    return np.unique(np.array([(max(a, b), min(a, b)) for a, b in edges], np.int64).reshape(-1, 2), axis=0)


def links(fingerprints: DataFrame, threshold: int = 3) -> DataFrame:
    """Edges ``a, b`` that connect what is linked among distinct fingerprints (column ``fp``)."""
    if not 0 <= threshold <= RADIUS:
        raise ValueError("the parts of the lists are made for thresholds up to 3")

    def make():
        def run(batch: pa.RecordBatch):
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 2048):
                for key, f, role in replicas(fp[at:at + 2048]):
                    yield {"key": pa.array(key), "fp": pa.array(f), "role": pa.array(role)}

        return run

    # A fingerprint makes about a hundred entries, so the few bytes of all of them are dealt to as many tasks as the entries are.
    dealt = fingerprints.select("fp").repartition(int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    lists = flat_rows(dealt, make, "key long, fp long, role byte")
    lists = lists.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []  # entries of the last key so far
        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(batch.column(i).to_numpy() for i in range(3))
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
            if last or (open_ and open_[-1][0][-1] != now[0][0]):
                whole = [np.concatenate([x[i] for x in (*open_, tuple(c[:last] for c in now))]) for i in range(3)]
                open_ = []
                if len(whole[0]):
                    yield _edges(compare(*whole, threshold))
            open_.append(tuple(c[last:] for c in now))
        if open_:
            yield _edges(compare(*(np.concatenate([x[i] for x in open_]) for i in range(3)), threshold))

    return lists.mapInArrow(run, "a long, b long").distinct()


def _edges(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _grouped(docs: DataFrame, threshold: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, copy, fp`` of every row, ``copy`` a hash of its text, and ``fp, root, component_id`` of every fingerprint."""
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("copy"), F.col(text).cast("string").alias("text"))
    prints = settle(with_fingerprints(ids))
    unique = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(unique, threshold))
    rooted = unique.join(roots, unique["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, settle(rooted.join(named, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, threshold: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per row of ``docs``."""
    prints, of = _grouped(docs, threshold, text, doc_id)
    return prints.join(of, "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, threshold: int = 3, text: str = "text", doc_id: str = "doc_id", few: int = FEW) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest id, rows without an id last; among texts of one id the
    one with the smallest hash. Repeated rows of it are one.

    If at most ``few`` ids and hashes go or repeat, they are broadcast and no text is shuffled but those of repeated rows.
    """
    prints, of = _grouped(docs, threshold, text, doc_id)
    first = prints.join(of, "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "copy")).alias("_first"))
    own, copy = free_names(docs, "_id", "_copy")
    first = first.select(F.col("_first.doc_id").alias(own), F.col("_first.copy").alias(copy)).distinct()

    def rows_of(keys: DataFrame, how: str) -> DataFrame:
        return docs.join(keys, docs[doc_id].eqNullSafe(keys[own]) & (F.xxhash64(docs[text].cast("string")) == keys[copy]), how)

    seen = prints.groupBy(F.col("doc_id").alias(own), F.col("copy").alias(copy)).agg(F.count(F.lit(1)).alias("rows"))
    stays = first.withColumnsRenamed({own: "_stays_id", copy: "_stays_copy"}).withColumn("stays", F.lit(True))
    seen = seen.join(stays, seen[own].eqNullSafe(stays["_stays_id"]) & (seen[copy] == stays["_stays_copy"]), "left")
    marked = settle(seen.where(F.col("stays").isNull() | (F.col("rows") > 1)).select(own, copy, "stays"))
    total, repeated = marked.agg(F.count(F.lit(1)), F.count("stays")).first()
    if total > few:
        return rows_of(first, "left_semi").dropDuplicates([doc_id, text])
    single = rows_of(F.broadcast(marked), "left_anti")
    if not repeated:
        return single
    return single.unionByName(rows_of(F.broadcast(marked.where("stays")), "left_semi").dropDuplicates([doc_id, text]))
