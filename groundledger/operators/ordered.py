"""Ordered operators that never put one whole meeting into one task.

A meeting may hold a large share of all rows, so ``partitionBy(meeting)`` windows are avoided over rows.
Rows are cut into chunks by a value they carry (line number or time), windows run per (meeting, chunk),
and only one small summary row per chunk is combined per meeting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

CHUNK = 4096
TIME_CHUNK_MS = 1_800_000


def chunk_of(position: str | Column, size: int = CHUNK) -> Column:
    c = F.col(position) if isinstance(position, str) else position
    return F.floor(c / F.lit(size)).cast("long")


def carry_in(
    df: DataFrame,
    keys: list[str],
    chunk: str,
    before: dict[str, Column] | None = None,
    fold: Callable[[str, WindowSpec], Column] | None = None,
    after: dict[str, Column] | None = None,
    fold_after: Callable[[str, WindowSpec], Column] | None = None,
) -> DataFrame:
    """Attach to each row what the chunks before (``before``) and after (``after``) its own add up to.

    Both are aggregates per chunk; ``fold(name, window)`` combines them over the chunks on that side.
    ``df`` is read twice, so callers settle it first when it is expensive.
    """
    before, after = before or {}, after or {}
    per_chunk = df.groupBy(*keys, chunk).agg(*[e.alias(n) for n, e in {**before, **after}.items()])
    w = Window.partitionBy(*keys).orderBy(F.col(chunk)).rowsBetween(Window.unboundedPreceding, -1)
    v = Window.partitionBy(*keys).orderBy(F.col(chunk).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(
        *keys, chunk, *[fold(n, w).alias(n) for n in before], *[(fold_after or fold)(n, v).alias(n) for n in after]
    )
    return df.join(carried, [*keys, chunk])


def settle(df: DataFrame) -> DataFrame:
    """Materialise an intermediate result in the cluster's checkpoint folder and cut its lineage.

    Used between the stages of a job whose next stage reads its input more than once.
    """
    from ..session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def dense_order(
    df: DataFrame, keys: list[str], order: list[Column | str], bucket: Column, name: str = "ord"
) -> DataFrame:
    """``row_number()`` per key; ``bucket`` must be non-decreasing along ``order``."""
    b = df.withColumn("_bucket", bucket)
    b = carry_in(b, keys, "_bucket", {"_before": F.count(F.lit(1))}, lambda n, w: F.sum(n).over(w))
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return b.withColumn(name, F.coalesce("_before", F.lit(0)) + F.row_number().over(w)).drop("_bucket", "_before")


def running_sum(
    df: DataFrame, keys: list[str], order: list[Column | str], bucket: Column, value: Column, name: str
) -> DataFrame:
    """Inclusive running sum of ``value`` per key."""
    b = df.withColumn("_bucket", bucket).withColumn("_value", value)
    b = carry_in(b, keys, "_bucket", {"_before": F.sum("_value")}, lambda n, w: F.sum(n).over(w))
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.coalesce("_before", F.lit(0)) + F.coalesce(F.sum("_value").over(w), F.lit(0))
    return b.withColumn(name, total).drop("_bucket", "_before", "_value")


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    position: str,
    back: int,
    ahead: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    size: int = CHUNK,
    order: list[Column | str] | None = None,
) -> DataFrame:
    """Window columns that look at most ``back``/``ahead`` positions away.

    Rows near a chunk border are copied into the neighbouring chunk, so one shuffle on (key, chunk) is
    enough and no window partition exceeds ``size`` positions plus the border.
    """
    p = F.col(position)
    targets = F.array_distinct(
        F.array(chunk_of(p, size), *([chunk_of(p - ahead, size)] if ahead else []),
                *([chunk_of(p + back, size)] if back else []))
    )
    copies = df.withColumn("_chunk", F.explode(targets))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*(order or [position]))
    out = copies.select("*", *[c.alias(n) for n, c in columns(w).items()])
    return out.where(F.col("_chunk") == chunk_of(p, size)).drop("_chunk")


def running_max(
    df: DataFrame, keys: list[str], order: list[Column | str], bucket: Column, value: Column, name: str,
    inclusive: bool = True,
) -> DataFrame:
    """Running maximum per key; exclusive of the current row when ``inclusive`` is false."""
    b = df.withColumn("_bucket", bucket).withColumn("_value", value)
    b = carry_in(b, keys, "_bucket", {"_before": F.max("_value")}, lambda n, w: F.max(n).over(w))
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    return b.withColumn(name, F.greatest("_before", F.max("_value").over(w))).drop("_bucket", "_before", "_value")


def last_known(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str,
    following: bool = False, inclusive: bool = True,
) -> DataFrame:
    """Last non-null ``value`` before each row (first one after it, when ``following``)."""
    b = df.withColumn("_bucket", bucket).withColumn("_value", value)
    rank = F.struct(*order)
    pick = F.min_by if following else F.max_by
    part = {"_before": pick("_value", F.when(F.col("_value").isNotNull(), rank))}
    last = lambda n, w: F.last(n, ignorenulls=True).over(w)
    b = carry_in(b, keys, "_bucket", *((None, None, part, last) if following else (part, last)))
    w = Window.partitionBy(*keys, "_bucket").orderBy(*[F.col(o).desc() if following else F.col(o) for o in order])
    w = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = F.last("_value", ignorenulls=True).over(w)
    return b.withColumn(name, F.coalesce(local, "_before")).drop("_bucket", "_before", "_value")
