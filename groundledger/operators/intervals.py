"""Interval joins, merges, islands and as-of look-ups on integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import TIME_CHUNK_MS, carry_in, chunk_of, running_max, running_sum, settle

BUCKET_MS = 10_000
MARK, ROW, BEHIND, AHEAD = 0, 1, 2, 3


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(chunk_of(start, width), chunk_of(F.greatest(start, end), width)))


def overlap_pairs(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str],
    width: int = BUCKET_MS, how: str = "inner",
) -> DataFrame:
    """All pairs whose closed intervals meet, each once.

    Both sides are spread over time buckets and joined by equality; a pair that shares several buckets is
    kept only in the bucket where the later of its two starts falls.
    """
    ls, le = (F.col(c) for c in left_span)
    rs, re = (F.col(c) for c in right_span)
    lb = left.withColumn("_b", _buckets(ls, le, width))
    rb = right.withColumn("_b", _buckets(rs, re, width))
    meet = (rs <= le) & (ls <= re) & (F.col("_b") == chunk_of(F.greatest(ls, rs), width))
    return lb.join(rb, [*keys, "_b"], how).where(meet).drop("_b")


def point_in_interval(
    points: DataFrame, spans: DataFrame, keys: list[str], at: Column, span: tuple[str, str],
    width: int = BUCKET_MS, closed: bool = True,
) -> DataFrame:
    """Points joined to the intervals that hold them (end included when ``closed``)."""
    p = points.withColumn("_at", at).withColumn("_b", chunk_of(F.col("_at"), width))
    s = spans.withColumn("_b", _buckets(F.col(span[0]), F.col(span[1]), width))
    upper = F.col("_at") <= F.col(span[1]) if closed else F.col("_at") < F.col(span[1])
    return p.join(s, [*keys, "_b"]).where((F.col("_at") >= F.col(span[0])) & upper).drop("_b", "_at")


def merge_overlaps(spans: DataFrame, keys: list[str], start: str, end: str, best: str) -> DataFrame:
    """Touching or overlapping intervals become one; the highest ``best`` survives."""
    same_start = spans.groupBy(*keys, start).agg(F.max(end).alias(end), F.max(best).alias(best))
    marked = island_starts(same_start, keys, start, end)
    return (
        marked.groupBy(*keys, "island")
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.max(best).alias(best))
        .drop("island")
    )


def island_starts(spans: DataFrame, keys: list[str], start: str, end: str, width: int = TIME_CHUNK_MS) -> DataFrame:
    """Adds ``island``: the start of the first interval of the run of intervals that touch each other."""
    bucket = chunk_of(start, width)
    seen = running_max(spans, keys, [start], bucket, F.col(end), "_seen", inclusive=False)
    seen = settle(seen)
    opens = F.when(F.col("_seen").isNull() | (F.col(start) > F.col("_seen")), F.col(start))
    return running_max(seen, keys, [start], bucket, opens, "island").drop("_seen")


def budget_prefix(spans: DataFrame, keys: list[str], length: Column, budget: Column, order: list[Column],
                  bucket: Column) -> DataFrame:
    """Rows in ``order`` as long as the running total of ``length`` stays within ``budget``."""
    used = running_sum(spans, keys, order, bucket, length, "_used")
    return used.where(F.col("_used") <= budget).drop("_used")


def follow_marks(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, mark_at: str, value: Column) -> DataFrame:
    """``rows`` and ``marks`` in one table (``_kind`` ``ROW`` or ``MARK``), laid beside each other by one shuffle and no join.

    A row's ``_mark`` is the ``value`` (a struct that tells marks apart) of the first mark whose ``mark_at`` is strictly after
    ``at``, the smallest of several at one time, or of the last mark when none is. A mark is ``_taken`` if it is such a first
    mark of a row. Rows without a time are left out; a mark without one is never taken.
    """
    rows = rows.withColumn("_t", F.col(at)).where(F.col("_t").isNotNull()).withColumn("_chunk", chunk_of("_t", TIME_CHUNK_MS))
    marks = marks.withColumn("_t", F.col(mark_at)).withColumn("_chunk", chunk_of("_t", TIME_CHUNK_MS)).withColumn("_mark", value)
    group, timed = [*keys, "_chunk"], F.struct("_t", "_mark")
    # Rows are summed up by numbers alone, as aggregates of structs would sort them.
    summary = rows.groupBy(*group).agg(F.max("_t").alias("_row")).unionByName(
        marks.groupBy(*group).agg(F.min(timed).alias("_first"), F.max(timed).alias("_last")), allowMissingColumns=True)
    summary = summary.groupBy(*group).agg(F.max("_row").alias("_row"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    every = Window.partitionBy(*keys)
    before = every.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    after = every.orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    row, mark = F.max("_row").over(before), F.max("_last").over(before)["_t"]
    edges = summary.select(
        *group, F.coalesce(F.min("_first").over(after), F.max("_last").over(every))["_mark"].alias("_mark"),
        F.when(mark.isNull() | (row >= mark), row).alias("_t"))
    # What lies outside a chunk travels as rows: the mark after it, and the row before it unless a mark lies between.
    edges = edges.select(*group, "_t", "_mark", F.explode(F.when(F.col("_t").isNull(), F.array(F.lit(AHEAD))).otherwise(
        F.array(F.lit(AHEAD), F.lit(BEHIND)))).alias("_kind"))
    edges = edges.withColumn("_mark", F.when(F.col("_kind") == AHEAD, F.col("_mark"))).withColumn(
        "_t", F.when(F.col("_kind") == BEHIND, F.col("_t")))
    both = rows.withColumn("_kind", F.lit(ROW)).unionByName(marks.withColumn("_kind", F.lit(MARK)), allowMissingColumns=True)
    # The order runs backward. At equal times the mark comes after the row, so a row never sees it ahead.
    w = Window.partitionBy(*group).orderBy(F.col("_t").desc_nulls_first(), F.col("_kind").desc(), F.col("_mark").desc())
    seen = both.unionByName(edges, allowMissingColumns=True).withColumn("_taken", F.coalesce(F.lead("_kind").over(w) != MARK, F.lit(False)))
    seen = seen.withColumn("_mark", F.last("_mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return seen.where(F.col("_kind").isin(ROW, MARK)).drop("_t", "_chunk")


def forward_asof(
    rows: DataFrame, marks: DataFrame, keys: list[str], at: str, mark_at: str, mark: str, name: str
) -> DataFrame:
    """Attach the first mark whose ``mark_at`` is strictly after the row's ``at``; last mark when none is."""
    slim = marks.select(*keys, F.col(mark_at).alias("_at"), F.col(mark).cast("long").alias("_no"))
    seen = follow_marks(rows, slim, keys, at, "_at", F.struct("_no"))
    return seen.where(F.col("_kind") == ROW).withColumn(name, F.col("_mark._no")).select(
        *[c for c in rows.columns if c != name], name)


__all__ = [
    "overlap_pairs", "point_in_interval", "merge_overlaps", "island_starts", "budget_prefix", "follow_marks", "forward_asof",
    "carry_in",
]
