"""Reversible line dedup: exact reference counts of lines, and cuckoo filters of the shared ones by shard.

A line's key is the line without ASCII blanks at its ends and with A-Z lower-cased; keys of at least ``least_chars`` code points
count. ``LineStore`` keeps, for the documents put in,

* ``references``: key, document, number of lines. Exact; a key is the 128-bit BLAKE2b digest of the line.
* ``shared``: the keys that at least ``least_docs`` documents hold, with their number and the largest document id.
* ``filters``: per shard of the keys one cuckoo filter, which holds a 16-bit fingerprint of every key in ``shared``.

``insert`` and ``delete`` take documents in and out. Only keys of these documents are counted anew; a key that becomes shared is
put into the filter of its shard, a key that no longer is one is taken out, which a cuckoo filter can do, as the tables tell that
the fingerprint is there. A filter that gets too full, and every filter when the shards get too large, is built again from
``shared``. So a store after deletions answers like a store that never held these documents.

``clean`` asks the filters for each line of each text while the texts are scanned; the few lines that pass go to ``shared``, which
removes false positives and names the document that keeps the line. Filters go to the executors as one broadcast if they take at
most ``broadcast_bytes``; otherwise the keys go to the filters, shard by shard, a hot shard dealt over several tasks.

A document is an id: rows of one id are one document, and rows without an id are one together, smaller than all others. A null or
empty text is one empty line. Repeated rows add up in ``lines`` and are cleaned alike. Texts are split whole, whatever their
length. Columns other than id and text pass through ``clean``; columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from .common import free_names, in_small_batches, settle, strips, with_columns

#: Keys of a full shard, entries of a bucket, moves before a filter is built larger.
SHARD_KEYS, WAYS, MOVES = 50_000, 4, 200


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """Digest of a line that is long enough."""
    key = line.strip().lower()  # of bytes: ASCII only
    if len(key) < least_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < least_chars):
        return None
    return blake2b(key, digest_size=16).digest()


class Cuckoo:
    """Cuckoo filter over 16-byte digests: two buckets of four fingerprints each; ``add`` is false when the filter is full."""

    def __init__(self, cells: list[int]) -> None:
        self.cells = cells
        self.mask = len(cells) // WAYS - 1

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1
        while buckets * WAYS * 0.9 < keys:
            buckets *= 2
        return cls([0] * (buckets * WAYS))

    @classmethod
    def of(cls, keys: Iterable[bytes], least: int = 0) -> Cuckoo:
        """A filter that holds all keys, twice as large as long as they don't fit."""
        keys = list(keys)
        out = cls.sized(max(len(keys), least))
        while not all(map(out.add, keys)):
            out = cls([0] * (2 * len(out.cells)))
        return out

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, "<u2").tolist())

    def dump(self) -> bytes:
        return np.array(self.cells, "<u2").tobytes()

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        one = int.from_bytes(key[10:16], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def __contains__(self, key: bytes) -> bool:
        mark, one, two = self._places(key)
        return mark in self.cells[one * WAYS:one * WAYS + WAYS] or mark in self.cells[two * WAYS:two * WAYS + WAYS]

    def add(self, key: bytes) -> bool:
        mark, one, two = self._places(key)
        cells, way = self.cells, mark
        for bucket in (one, two):
            for at in range(bucket * WAYS, bucket * WAYS + WAYS):
                if not cells[at]:
                    cells[at] = mark
                    return True
        bucket, moved = one, []
        for _ in range(MOVES):  # whoever is moved goes to its other bucket
            way = (way * 0x9E3779B1 + 12345) & 0xFFFFFFFF
            at = bucket * WAYS + (way >> 30)
            moved.append((at, cells[at]))
            cells[at], mark = mark, cells[at]
            bucket = self._other(bucket, mark)
            for at in range(bucket * WAYS, bucket * WAYS + WAYS):
                if not cells[at]:
                    cells[at] = mark
                    return True
        for at, old in reversed(moved):  # as before, since the caller may keep the filter
            cells[at] = old
        return False

    def remove(self, key: bytes) -> None:
        """Takes one fingerprint of ``key`` out; only for keys that were added."""
        mark, one, two = self._places(key)
        for bucket in (one, two):
            for at in range(bucket * WAYS, bucket * WAYS + WAYS):
                if self.cells[at] == mark:
                    self.cells[at] = 0
                    return
        raise KeyError(key)


def shard_of(key: Column | str, shards: int) -> Column:
    """Shard by the first four bytes of a key."""
    c = F.col(key) if isinstance(key, str) else key
    return (F.conv(F.hex(F.substring(c, 1, 4)), 16, 10).cast("long") % shards).cast("int")


def _shard(key: bytes, shards: int) -> int:
    return int.from_bytes(key[:4], "big") % shards


def _keys(docs: DataFrame, text: str, doc_id: str, least_chars: int, passes: Callable[[], Callable[[bytes], bool]]) -> DataFrame:
    """``doc_id, key, lines`` for the keys of each row's text that ``passes`` lets through."""
    id_type = docs.schema[doc_id].dataType
    schema = StructType([StructField("doc_id", id_type), *StructType.fromDDL("key binary, lines long").fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = passes()
        for batch in batches:
            for part in strips(batch, 1):
                rows, keys, lines = [], [], []
                for i, t in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                    seen: dict[bytes, int] = {}
                    for line in (t or b"").split(b"\n"):
                        if (k := line_key(line, least_chars)) is not None:
                            seen[k] = seen.get(k, 0) + 1
                    for k, n in seen.items():
                        if keep(k):
                            rows.append(i)
                            keys.append(k)
                            lines.append(n)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(rows)), pa.array(keys, pa.binary()), pa.array(lines, pa.int64())], ["doc_id", "key", "lines"])

    return in_small_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInArrow(run, schema)


def _counted(references: DataFrame, least_docs: int) -> DataFrame:
    """Keys that enough documents hold; the first sum is within the tasks, so a line of all documents is no hot key."""
    return references.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last")).where(F.col("docs") >= least_docs)


BOUNDS = "least_chars int, least_docs int, shard_keys long, broadcast_bytes long, shards long"
FILTER = "shard int, keys long, cells binary"


def _build(shared: DataFrame, shards: int) -> DataFrame:
    """A filter for each shard that has keys. A shard has about ``SHARD_KEYS`` of them."""
    def build(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        return pa.table({"shard": pa.array(table.column("shard").to_pylist()[:1], pa.int32()), "keys": [len(keys)],
                         "cells": pa.array([Cuckoo.of(keys).dump()], pa.binary())})

    return shared.select(shard_of("key", shards).alias("shard"), "key").groupBy("shard").applyInArrow(build, FILTER)


def _update(filters: DataFrame, changes: DataFrame, shared: DataFrame, shards: int) -> DataFrame:
    """The filters with ``changes (key, added)`` carried out; a shard whose filter can't take a key is built from ``shared``."""
    def update(old: pa.Table, new: pa.Table) -> pa.Table:
        f = Cuckoo.load(old.column("cells")[0].as_py()) if old.num_rows else Cuckoo.sized(0)
        n = old.column("keys")[0].as_py() if old.num_rows else 0
        full = False
        for key, added in sorted(zip(new.column("key").to_pylist(), new.column("added").to_pylist()), key=lambda r: r[1]):
            n += 1 if added else -1
            if not full and not (f.add(key) if added else f.remove(key) is None):
                full = True
        shard = (old if old.num_rows else new).column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int32()), "keys": [n], "cells": pa.array([None if full else f.dump()], pa.binary())})

    changes = changes.select(shard_of("key", shards).alias("shard"), "key", "added")
    done = settle(filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(update, FILTER))
    full = done.where(F.col("cells").isNull()).select("shard")
    again = _build(shared.join(F.broadcast(full), shard_of("key", shards) == F.col("shard"), "left_semi"), shards)  # a row a shard
    return done.where(F.col("cells").isNotNull() & (F.col("keys") > 0)).unionByName(again)


@dataclass(frozen=True)
class LineStore:
    """Reference counts and filters of the documents put in; see the module."""

    least_chars: int = 20
    least_docs: int = 3
    shard_keys: int = SHARD_KEYS
    broadcast_bytes: int = 32 << 20
    shards: int = 1
    references: DataFrame | None = None
    shared: DataFrame | None = None
    filters: DataFrame | None = None

    def insert(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> LineStore:
        """The store with the lines of ``docs`` added."""
        new = _keys(docs, text, doc_id, self.least_chars, lambda: lambda key: True)
        if self.references is None:
            total = settle(new.groupBy("key", "doc_id").agg(F.sum("lines").alias("lines")))
            return self._all_anew(total)
        new = settle(new)
        total = settle(self.references.unionByName(new).groupBy("key", "doc_id").agg(F.sum("lines").alias("lines")))
        return self._changed(total, new.select("key").distinct())

    def delete(self, docs: DataFrame, doc_id: str = "doc_id") -> LineStore:
        """The store without the documents whose ids ``docs`` holds; ids that it doesn't know change nothing."""
        if self.references is None:
            return self
        gone = docs.select(F.col(doc_id).alias("doc_id")).distinct()
        same = F.col("r.doc_id").eqNullSafe(F.col("g.doc_id"))
        mark = settle(self.references.alias("r").join(gone.withColumn("gone", F.lit(True)).alias("g"), same, "left").select("r.*", "gone"))
        return self._changed(mark.where(F.col("gone").isNull()).drop("gone"), mark.where("gone").select("key").distinct())

    def _all_anew(self, references: DataFrame) -> LineStore:
        shared = settle(_counted(references, self.least_docs))
        shards = max(1, -(-shared.count() // self.shard_keys))
        return replace(self, shards=shards, references=references, shared=shared, filters=settle(_build(shared, shards)))

    def _changed(self, references: DataFrame, keys: DataFrame) -> LineStore:
        keys = settle(keys)
        now = settle(_counted(references.join(keys, "key", "left_semi"), self.least_docs))
        before = self.shared.join(keys, "key", "left_semi")
        changes = now.join(before, "key", "left_anti").select("key", F.lit(True).alias("added")).unionByName(
            before.join(now, "key", "left_anti").select("key", F.lit(False).alias("added")))
        shared = settle(self.shared.join(keys, "key", "left_anti").unionByName(now))
        if shared.count() > 2 * self.shards * self.shard_keys:
            return self._all_anew(references)
        return replace(self, references=references, shared=shared, filters=settle(_update(self.filters, changes, shared, self.shards)))

    def hits(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """``doc_id, key, lines`` for the keys of ``docs`` that a filter knows; few of them are false."""
        size = self.filters.agg(F.sum(F.length("cells"))).first()[0] or 0
        shards = self.shards
        if size <= self.broadcast_bytes:
            held = {r["shard"]: r["cells"] for r in self.filters.collect()}  # at most broadcast_bytes
            shared = docs.sparkSession.sparkContext.broadcast(held)

            def passes() -> Callable[[bytes], bool]:
                filters = {s: Cuckoo.load(c) for s, c in shared.value.items()}
                nothing = Cuckoo.sized(0)
                return lambda key: key in filters.get(_shard(key, shards), nothing)

            return _keys(docs, text, doc_id, self.least_chars, passes)
        return self._routed(_keys(docs, text, doc_id, self.least_chars, lambda: lambda key: True))

    def _routed(self, keys: DataFrame, deal: int = 64) -> DataFrame:
        """``keys`` that a filter knows, each asked where its shard is: ``deal`` tasks a shard, so a hot line is no hot task."""
        deals = F.explode(F.sequence(F.lit(0), F.lit(deal - 1))).alias("deal")
        filters = self.filters.select("shard", "cells", deals)
        placed = keys.select("*", shard_of("key", self.shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(deal)).cast("int").alias("deal"))

        def ask(own: pa.Table, asked: pa.Table) -> pa.Table:
            asked = asked.select(["doc_id", "key", "lines"])
            if not own.num_rows:
                return asked.slice(0, 0)
            f = Cuckoo.load(own.column("cells")[0].as_py())
            return asked.filter(pa.array([k in f for k in asked.column("key").to_pylist()], pa.bool_()))

        return filters.groupBy("shard", "deal").cogroup(placed.groupBy("shard", "deal")).applyInArrow(ask, keys.schema)

    def clean(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept")) -> DataFrame:
        """Adds the number of lines, of dropped lines, and the text without them: lines of a shared key go in all documents
        but the one of the largest id among those put in."""
        base = docs.drop(*names)
        drops, own, key = free_names(base, "_drops", "_own", "_key")
        doomed = self.hits(docs, text, doc_id).alias("h").join(self.shared.alias("s"), "key").where(~F.col("h.doc_id").eqNullSafe(F.col("s.last")))
        doomed = doomed.groupBy(F.col("h.doc_id").alias(own)).agg(F.collect_set("key").alias(drops))  # at most the lines of a document
        joined = base.join(doomed, F.col(doc_id).eqNullSafe(F.col(own)), "left").drop(own)
        least = self.least_chars

        def make():
            def solve(texts: list, gone: list) -> list:
                total, lost, kept = [], [], []
                for t, ks in zip(texts, gone):
                    lines = (t or b"").split(b"\n")
                    left = lines
                    if ks:
                        ks = set(ks)
                        left = [x for x in lines if line_key(x, least) not in ks]
                    total.append(len(lines))
                    lost.append(len(lines) - len(left))
                    kept.append(b"\n".join(left))
                return [total, lost, kept]

            return solve

        return with_columns(joined, [text, drops], make, "`{}` long, `{}` long, `{}` string".format(*names)).drop(drops)

    def save(self, path: str) -> None:
        """Writes the store to a new folder."""
        for name in ("references", "shared", "filters"):
            getattr(self, name).write.parquet(f"{path}/{name}")
        bounds = (self.least_chars, self.least_docs, self.shard_keys, self.broadcast_bytes, self.shards)
        self.shared.sparkSession.createDataFrame([bounds], BOUNDS).write.parquet(f"{path}/bounds")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineStore:
        kept = {name: spark.read.parquet(f"{path}/{name}") for name in ("references", "shared", "filters")}
        return cls(**spark.read.parquet(f"{path}/bounds").first().asDict(), **kept)
