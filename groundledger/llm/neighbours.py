"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to length one for hashing only and turned by fast pseudo-rotations: three rounds of random signs and a
Walsh-Hadamard transform. A table's hash is the signed axis nearest to the turned vector. Every candidate stands in one
bucket of each table; a query looks into the ``probes`` nearest signed axes of each table. Bucket by bucket the queries
meet the candidates in blocks, by exact Euclidean distance in double precision on the vectors as given, and the nearest
of all buckets are merged.

Hot buckets: equal vectors are one candidate that carries its smallest ids (as many as can ever be answers), and a bucket
is cut into blocks of bounded numbers of candidates and queries. Queries that find fewer than ``k`` ids in their buckets
are searched against all candidates, in blocks, so small tables give whole results.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id.
Vectors of different length are never compared. Ties go to the smaller id. Repeated rows count once; an id with several
vectors is as near as its nearest one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import flat_rows, settle


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two; keeps lengths."""
    rows, n = x.shape
    step = 1
    while step < n:
        pairs = x.reshape(rows, n // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(rows, n)
        step *= 2
    return x / np.sqrt(n)


def axis_values(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Inner products of unit vectors with the signed axes of a table, after its pseudo-rotation."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, :x.shape[1]] = x
    signs = np.random.Generator(np.random.PCG64([seed, table, width]))
    for _ in range(3):
        y = hadamard(y * signs.choice([-1.0, 1.0], width))
    return np.hstack([y, -y])


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda v: v != 0)


def _hashed(df: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """``ids, vec`` (bytes of doubles), ``dim`` and per table the ``probes`` nearest axes, nearest first."""
    def make():
        def run(batch: pa.RecordBatch):
            ids, vecs = batch.column(0), batch.column(1).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vecs):
                by_dim.setdefault(len(v), []).append(i)
            for dim, where in by_dim.items():
                x = np.array([vecs[i] for i in where])
                unit = x / np.abs(x).max(1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                axes = []
                for t in range(tables):
                    v = axis_values(unit, t, seed)
                    axes.append(np.argsort(-v, 1, kind="stable")[:, :probes] if probes > 1 else v.argmax(1)[:, None])
                axes = np.stack(axes, 1)
                yield {"ids": ids.take(pa.array(where)), "vec": [r.tobytes() for r in x], "dim": [dim] * len(where),
                       "axes": axes.tolist()}

        return run

    return flat_rows(df, make, "ids array<long>, vec binary, dim int, axes array<array<int>>")


def _nearest(k: int):
    """Answers of one block: for each query the first ``k`` ids by (distance, id)."""
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            x = np.frombuffer(b"".join(rows["vec"])).reshape(len(rows), -1)
            ids = list(rows["ids"])
            norm = np.einsum("ij,ij->i", x, x)
            for at in range(0, len(queries), 512):
                part = queries.iloc[at:at + 512]
                q = np.frombuffer(b"".join(part["vec"])).reshape(len(part), -1)
                own = np.einsum("ij,ij->i", q, q)
                rough = own[:, None] + norm[None] - 2 * (q @ x.T)
                take = min(k + 1, len(x))  # the query's own vector may be among them
                edge = np.partition(rough, take - 1, 1)[:, take - 1]
                margin = 1e-9 * (own + norm.max())
                for i, query in enumerate(part["query_id"]):
                    near = np.flatnonzero(rough[i] <= edge[i] + margin[i])
                    exact = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                    found = sorted((d, ids[r][0], r) for d, r in zip(exact.tolist(), near.tolist()))[:take]
                    best = sorted((d, int(v)) for d, _, r in found for v in ids[r] if v != query)[:k]
                    out += [(query, v, d) for d, v in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _blocks(queries: DataFrame, rows: DataFrame, keys: list[str], k: int, row_block: int, query_block: int) -> DataFrame:
    """Joins queries and rows of equal keys, cut into blocks of about ``row_block`` rows and ``query_block`` queries."""
    n_rows = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / row_block).cast("int").alias("row_parts"))
    n_queries = queries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("query_parts"))
    parts = F.broadcast(n_rows.join(n_queries, keys))  # one row per bucket: tables x signed axes

    def spread(df: DataFrame, own: str, other: str, salt: Column) -> DataFrame:
        cut = df.join(parts, keys)
        return cut.withColumn(own[:-1], F.pmod(salt, F.col(own))).withColumn(
            other[:-1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop(own, other)

    block = [*keys, "row_part", "query_part"]
    left = spread(queries, "query_parts", "row_parts", F.xxhash64("query_id").cast("long")).withColumn("query_part", F.col("query_part").cast("int"))
    right = spread(rows, "row_parts", "query_parts", F.xxhash64("ids").cast("long")).withColumn("row_part", F.col("row_part").cast("int"))
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 10, tables: int = 12, probes: int = 8, seed: int = 42,
           vec_id: str = "vec_id", embedding: str = "embedding", row_block: int = 8192, query_block: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of every row for which ``is_query`` (over the id
    column ``vec_id``) holds."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).dropDuplicates(["vec_id", "v"])
    # at most k + 1 ids of equal vectors can be answers: the query itself may be one of them
    w = Window.partitionBy("v").orderBy("vec_id")
    unique = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    unique = unique.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "v")
    candidates = settle(_hashed(unique, tables, 1, seed))
    asked = settle(_hashed(rows.where(is_query).select(F.array("vec_id").alias("ids"), "v"), tables, probes, seed).withColumn(
        "query_id", F.col("ids")[0]).drop("ids"))
    placed = candidates.select("ids", "vec", "dim", F.posexplode("axes").alias("tbl", "axis")).withColumn("axis", F.col("axis")[0])
    probing = asked.select("query_id", "vec", "dim", F.posexplode("axes").alias("tbl", "axis")).withColumn("axis", F.explode("axis"))
    found = _merge(_blocks(probing, placed, ["dim", "tbl", "axis"], k, row_block, query_block), k)
    found = settle(found)
    enough = found.where(F.col("rank") == k).select("query_id")
    short = settle(asked.join(enough, "query_id", "left_anti"))
    if short.isEmpty():
        return found
    more = _blocks(short.select("query_id", "vec", "dim"), candidates.select("ids", "vec", "dim"), ["dim"], k, row_block, query_block)
    return found.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(_merge(more, k))


def _merge(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
