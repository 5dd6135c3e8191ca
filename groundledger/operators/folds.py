"""Cutting an ordered sequence into pieces when each cut depends on where the current piece began.

Such a rule is sequential, but a piece never exceeds ``reach`` rows, so a chunk of rows is entered at one of
its first ``reach`` rows.  Each chunk is summarised as a map "entry row -> entry row of the next chunk"; maps
compose, so the true entries of all chunks follow from the small maps, and every chunk is then cut on its own.
A piece of more than ``reach`` rows that passes the end of a chunk is an error, never cut short.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .ordered import chunk_of, settle

SUPER = 256
#: Long keys that are sent to every task; more are joined.
FEW_KEYS = 1_000_000
ARRAY = ArrayType(IntegerType())
Columns = dict[str, np.ndarray]


def _exits(step: Callable[[int], int], own: int, reach: int) -> tuple[list[int], list[int]]:
    """Per entry row: first piece start past the chunk and the last piece start inside it."""
    memo: dict[int, tuple[int, int]] = {}
    exits, lasts = [], []
    for entry in range(min(reach, own)):
        path, i = [], entry
        while i < own and i not in memo:
            path.append(i)
            i = step(i)
        done = memo[i] if i in memo else (i, path[-1] if path else -1)
        for p in path:
            memo[p] = done
        exits.append(done[0] - own)
        lasts.append(done[1])
    return exits, lasts


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of a partition sorted by ``keys``, cut so that no group is split, with the group starts."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        codes = [pdf[k].to_numpy() for k in keys]
        change = np.zeros(len(pdf), dtype=bool)
        for c in codes:
            change[1:] |= c[1:] != c[:-1]
        starts = np.concatenate(([0], np.flatnonzero(change)))
        last = starts[-1]
        if last:
            yield pdf.iloc[:last], starts[:-1]
        rest = pdf.iloc[last:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, np.array([0])


def entry_rows(
    df: DataFrame, rows: DataFrame, keys: list[str], position: str, make_step: Callable[[Columns], Callable[[int], int]],
    reach: int, size: int,
) -> DataFrame | None:
    """Where each later chunk of a long key is entered: ``(keys, _chunk, _entry, _open)``; None without a long key.

    Only keys of more than one chunk take part, which are fewer than one in ``size`` rows.
    """
    longer = settle(df.groupBy(*keys).agg(F.max(position).alias("_max")).where(F.col("_max") >= size).select(*keys))
    n = longer.count()
    if not n:
        return None
    longer = F.broadcast(longer) if n <= FEW_KEYS else longer
    key_fields = [df.schema[k] for k in keys]
    longs = lambda *names: [StructField(n, LongType()) for n in names]
    map_schema = StructType(key_fields + longs("_chunk", "_super")).add("exits", ARRAY).add("lasts", ARRAY)

    def to_map(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position, ignore_index=True)
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        exits, lasts = _exits(make_step(cols), int(cols["_own"].sum()), reach)
        if max(exits, default=0) >= reach:
            raise ValueError(f"a piece of chunk {pdf.at[0, '_chunk']} has more than {reach} rows")
        first = pdf.iloc[0]
        return pd.DataFrame([[*[first[k] for k in keys], first["_chunk"], first["_chunk"] // SUPER, exits, lasts]],
                            columns=map_schema.names)

    maps = rows.join(longer, keys, "left_semi").groupBy(*keys, "_chunk").applyInPandas(to_map, map_schema)
    super_schema = StructType(key_fields + longs("_super")).add("exits", ARRAY)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk", ignore_index=True)
        total = np.asarray(pdf.at[0, "exits"])
        for e in pdf["exits"].iloc[1:]:
            total = np.asarray(e)[np.minimum(total, len(e) - 1)]  # an entry past a short last chunk has no chunk after it
        first = pdf.iloc[0]
        return pd.DataFrame([[*[first[k] for k in keys], first["_super"], total.tolist()]], columns=super_schema.names)

    entry_schema = StructType(key_fields + longs("_super", "_enter"))

    def enter_supers(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_super", ignore_index=True)
        out, entry = [], 0
        for _, r in pdf.iterrows():
            out.append([*[r[k] for k in keys], r["_super"], entry])
            entry = r["exits"][min(entry, len(r["exits"]) - 1)]
        return pd.DataFrame(out, columns=entry_schema.names)

    supers = maps.groupBy(*keys, "_super").applyInPandas(compose, super_schema)
    super_entries = supers.groupBy(*keys).applyInPandas(enter_supers, entry_schema)
    chunk_schema = StructType(key_fields + longs("_chunk", "_entry", "_open"))

    def enter_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk", ignore_index=True)
        out, entry = [], int(pdf.at[0, "_enter"])
        for _, r in pdf.iterrows():
            at = min(entry, len(r["exits"]) - 1)
            entry = int(r["exits"][at])
            out.append([*[r[k] for k in keys], r["_chunk"] + 1, entry, r["_chunk"] * size + int(r["lasts"][at])])
        return pd.DataFrame(out, columns=chunk_schema.names)

    return maps.join(super_entries, [*keys, "_super"]).groupBy(*keys, "_super").applyInPandas(enter_chunks, chunk_schema)


def cut_pieces(
    df: DataFrame, keys: list[str], position: str, make_step: Callable[[Columns], Callable[[int], int]],
    reach: int, size: int = 16384, name: str = "head", keep: list[str] | None = None,
) -> DataFrame:
    """Adds ``name``: the position of the first row of each row's piece (to the columns ``keep``, if given).

    ``position`` is dense and 0-based per key.  ``make_step(columns)`` gets the rows of a chunk as arrays and
    returns a function giving, for a piece that starts at row i, the row where the next piece starts (the
    number of rows when none does).
    """
    size = max(size, reach)
    chunk = chunk_of(position, size)
    near = (F.col(position) % size < reach) & (chunk > 0)
    rows = df.withColumn(
        "_chunk", F.explode(F.when(near, F.array(chunk, chunk - 1)).otherwise(F.array(chunk)))
    ).withColumn("_own", F.col("_chunk") == chunk)
    entries = entry_rows(df, rows, keys, position, make_step, reach, size)

    # An entry travels as one extra row that sorts before the rows of its chunk; one shuffle serves both.
    group = [*keys, "_chunk"]
    both = rows
    if entries is not None:
        marks = entries.withColumn(position, F.lit(-1).cast(df.schema[position].dataType))
        both = rows.withColumn("_entry", F.lit(None).cast("long")).withColumn("_open", F.lit(None).cast("long")).unionByName(
            marks, allowMissingColumns=True)
    columns = keep or df.columns
    out_schema = StructType([*[StructField(c, df.schema[c].dataType, True) for c in columns], StructField(name, LongType())])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in whole_groups(batches, group):
            arrays = {c: pdf[c].to_numpy() for c in pdf.columns}
            ends = np.append(starts[1:], len(pdf))
            head = np.full(len(pdf), -2, dtype="int64")
            at = arrays[position]
            for a, b in zip(starts, ends):
                i, opened = 0, -1
                while a < b and at[a] == -1:
                    i, opened = int(arrays["_entry"][a]), int(arrays["_open"][a])
                    a += 1
                if a == b:
                    continue
                own = int(arrays["_own"][a:b].astype(bool).sum())
                step = make_step({c: v[a:b] for c, v in arrays.items()})
                head[a:a + min(i, own)] = opened
                while i < own:
                    j = step(i)
                    head[a + i:a + min(j, own)] = at[a + i]
                    i = j
            own_rows = head != -2
            out = pdf.loc[own_rows, columns].copy()
            out[name] = head[own_rows]
            yield out

    return both.repartition(*group).sortWithinPartitions(*group, position).mapInPandas(cut, out_schema)
