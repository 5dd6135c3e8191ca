"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from ..operators.ordered import settle  # noqa: F401  (used by the operators)

#: Whole texts that a task holds as Python objects at one time: so many, and so many bytes unless one text has more.
STRIP, STRIP_BYTES = 512, 4 << 20
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Word characters are everything but these.
BLANKS = " \t\n\x0b\x0c\r"

Make = Callable[[], Callable[[list], list]]


def with_columns(df: DataFrame, inputs: list[str], make: Make, fields: str, without: tuple[str, ...] = ()) -> DataFrame:
    """Add the columns ``fields`` (DDL), computed batch by batch in Python; columns ``without`` are read, but not sent back.

    ``make()`` runs once per task and returns a function from the lists of input values to the lists (or Arrow arrays)
    of new values. String inputs arrive as UTF-8 bytes. A column of ``df`` named like a new one is replaced.
    """
    new = StructType.fromDDL(fields)
    kept = [f for f in df.schema.fields if f.name not in new.names and f.name not in without]
    names = [f.name for f in kept]
    extra = [c for c in inputs if c not in names]  # replaced by a new column, but read
    place = {c: i for i, c in enumerate([*names, *extra])}
    outer = StructType([*(StructField(f.name, f.dataType, True) for f in kept), *new.fields])
    arrow = _arrow(new)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in strips(batch, *[place[c] for c in inputs]):
                out = fn(*[_plain(part.column(place[c])) for c in inputs])
                cols = [part.column(i) for i in range(len(names))]
                cols += [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(out, arrow)]
                yield pa.RecordBatch.from_arrays(cols, [*names, *new.names])
        pa.default_memory_pool().release_unused()

    fed = df.select(*[F.col(_quoted(n)) for n in names], *[F.col(_quoted(c)).alias(f"_in{i}") for i, c in enumerate(extra)])
    return in_small_batches(fed).mapInArrow(run, outer)


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df`` under a clone of its session that sends ``STRIP`` rows at a time to Python; the caller's session keeps its settings.

    Rows are whole texts here, and a batch of the default ten thousand of them (Spark bounds it by 64 MB) lies in memory two or
    three times in each task: a task holds some 150 MB more with it, as measured.
    """
    spark = df.sparkSession
    if int(spark.conf.get(BATCH)) <= STRIP:
        return df
    clone = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    clone.conf.set(BATCH, str(STRIP))
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(clone._jsparkSession, df._jdf.logicalPlan())
    return DataFrame(rows, clone)


def strips(batch: pa.RecordBatch, *texts: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``STRIP`` rows whose columns ``texts`` hold ``STRIP_BYTES`` together, or of one row.

    Spark bounds the bytes of a batch itself (``spark.sql.execution.arrow.maxBytesPerBatch``); this bounds its Python objects.
    """
    size = np.zeros(batch.num_rows, np.int64)
    for i in texts:
        kind = batch.schema.types[i]
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind):
            size += pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    total, at = size.cumsum(), 0
    while at < batch.num_rows:
        done = int(total[at - 1]) if at else 0
        end = min(at + STRIP, max(at + 1, int(np.searchsorted(total, done + STRIP_BYTES, "right"))), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where ``df`` has such a column."""
    out = []
    for n in names:
        while n in df.columns:
            n = "_" + n
        out.append(n)
    return out


def flat_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]], fields: str) -> DataFrame:
    """Rows made from batches: ``make()`` returns a function from a batch to dicts of columns."""
    new = StructType.fromDDL(fields)
    arrow = _arrow(new)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for out in fn(batch):
                yield pa.RecordBatch.from_arrays(
                    [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, new)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _plain(column: pa.Array) -> list:
    return (column.cast(pa.binary()) if pa.types.is_string(column.type) else column).to_pylist()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Memo:
    """Answers for keys seen before; ``solve`` answers a list of new ones. Emptied when it would pass ``most`` keys.

    A Python worker serves many tasks, so it keeps the answers of one memo only: the one used last. ``known`` is a plain
    dict of plain values, which the garbage collector needn't walk through.
    """

    latest: Memo | None = None

    def __init__(self, solve: Callable[[list], list], most: int = 300_000) -> None:
        self.solve, self.most = solve, most
        self.known: dict = {}

    def know(self, keys: Iterable) -> None:
        if Memo.latest is not self:
            if Memo.latest is not None:
                Memo.latest.forget()
            Memo.latest = self
        keys = keys if isinstance(keys, set) else set(keys)
        new = keys.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = keys
        new = list(new)
        if new:
            self.known.update(zip(new, self.solve(new)))

    def forget(self) -> None:
        """Drops all answers and what ``solve`` keeps itself."""
        self.known.clear()
        getattr(self.solve, "forget", dict)()
