"""Blocks of lines sent to a model: refine windows with context and chunks under a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions import text as T
from .folds import cut_pieces
from .ordered import chunk_of, dense_order, settle

KEYS = ["meeting_id"]


def refine_windows(segments: DataFrame, size: int = C.REFINE_WINDOW, context: int = C.REFINE_CONTEXT) -> DataFrame:
    """Each line in the window it belongs to and, read-only, in windows less than ``context`` lines away."""
    own = chunk_of(F.col("ord") - 1, size)
    first = chunk_of(F.greatest(F.col("ord") - 1 - context, F.lit(0)), size)
    last = chunk_of(F.col("ord") - 1 + context, size)
    placed = segments.withColumn("_own", own).withColumn("win", F.explode(F.sequence(first, last)))
    # A later window exists only if the meeting reaches it.
    ends = segments.groupBy(*KEYS).agg(chunk_of(F.max("ord") - 1, size).alias("_last"))
    part = F.when(F.col("win") == F.col("_own"), "target").when(F.col("win") > F.col("_own"), "before").otherwise("after")
    return placed.join(ends, KEYS).where(F.col("win") <= F.col("_last")).withColumn("part", part).drop("_own", "_last")


def _budget_step(limit: int):
    def make(rows: dict):
        cost = rows["_cost"].tolist()
        n = len(cost)

        def step(i: int) -> int:
            used = cost[i]
            for j in range(i + 1, n):
                if used + cost[j] > limit:
                    return j
                used += cost[j]
            return n

        return step

    return make


def token_chunks(segments: DataFrame, max_tokens: int, overlap: bool = True) -> DataFrame:
    """Chunks of whole lines under a token budget; each starts with the last tenth of the one before."""
    limit = int(max_tokens * 0.9) if overlap else max_tokens
    line = T.prompt_line(F.col("seg_id"), F.col("text"), F.col("speaker") if overlap else None)
    costed = segments.withColumn("line", line).withColumn("_cost", T.estimate_tokens(F.col("line")) + 1).withColumn(
        "_i", F.col("ord") - 1
    )
    # A line costs at least two tokens, which bounds the lines of a chunk.
    cut = cut_pieces(costed, KEYS, "_i", _budget_step(limit), max(1, limit // 2) + 1)
    cut = settle(cut)
    sizes = cut.groupBy(*KEYS, "head").agg(F.count(F.lit(1)).alias("_n"))
    numbered = dense_order(sizes, KEYS, ["head"], chunk_of("head"), "chunk_no")
    numbered = settle(numbered)
    own = cut.join(numbered, [*KEYS, "head"]).withColumn("overlap", F.lit(False))
    if not overlap:
        return own.drop("_cost", "_i", "head", "_n")
    last = F.col("head") + F.col("_n") - F.greatest(F.lit(1), F.floor(F.col("_n") / 10))
    tail = own.where(F.col("_i") >= last).withColumn("chunk_no", F.col("chunk_no") + 1).withColumn("overlap", F.lit(True))
    exists = numbered.select(*KEYS, "chunk_no")
    return own.unionByName(tail.join(exists, [*KEYS, "chunk_no"], "left_semi").select(*own.columns)).drop("_cost", "_i", "head", "_n")
