"""Steps on meetings of bounded length: their rows lie whole in one partition, in order, and one call takes many meetings.

Nothing is carried between chunks there, so one shuffle serves several steps. Meetings of more words or turns go through the
chunked operators of :mod:`assemble`, whose results these steps equal (tested by moving the border between the two).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from .folds import FEW_KEYS
from .ordered import settle

#: Rows of one call, and pairs of a word and a turn looked at together; no result depends on them.
ROWS, PAIRS = 1 << 16, 1 << 20
TURN, WORD, PATCH = 0, 1, 2


def by_length(words: DataFrame, others: list[DataFrame], size: int) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """``words`` and ``others`` of the meetings of at most ``size`` rows, and those of the longer ones (None without one)."""
    long = words.groupBy("meeting_id").agg(F.max("word_idx").alias("_n")).where(F.col("_n") >= size).select("meeting_id")
    for o in others:
        long = long.unionByName(o.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size).select("meeting_id"))
    long = settle(long.distinct())
    n = long.count()
    if not n:
        return [words, *others], None
    long = F.broadcast(long) if n <= FEW_KEYS else long
    return [d.join(long, "meeting_id", "left_anti") for d in (words, *others)], [settle(d.join(long, "meeting_id", "left_semi")) for d in (words, *others)]


def lay(words: DataFrame, turns: DataFrame, updates: DataFrame | None = None) -> DataFrame:
    """One shuffle: per meeting its turns, its words in order, then the patches of its words."""
    both = words.drop("speaker").withColumn("_kind", F.lit(WORD)).unionByName(turns.select(
        "meeting_id", F.col("turn_no").alias("word_idx"), "start_ms", "end_ms", "speaker", F.lit(TURN).alias("_kind")), allowMissingColumns=True)
    if updates is not None:
        both = both.unionByName(updates.select(
            "meeting_id", "word_idx", "conf", "disputed", "alt", F.lit(PATCH).alias("_kind")), allowMissingColumns=True)
    return both.repartition("meeting_id").sortWithinPartitions("meeting_id", "_kind", "word_idx")


def run(laid: DataFrame, step: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """``step`` on tables of whole meetings; rows stay in order, so that another step can follow without a shuffle."""
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in meetings(batches):
            yield from step(table).to_batches()

    return laid.mapInArrow(over, schema)


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n < ROWS:
            continue
        table = pa.Table.from_batches(held)
        starts = np.flatnonzero(opens(table))
        last = int(starts[-1])
        if last:
            yield table.slice(0, last)
        held, n = table.slice(last).to_batches(), table.num_rows - last
    if n:
        yield pa.Table.from_batches(held)


def opens(table: pa.Table) -> np.ndarray:
    """Whether a row is the first of its meeting."""
    ids = values(table, "meeting_id")
    return np.append(True, ids[1:] != ids[:-1])


def values(table: pa.Table, name: str, null=None) -> np.ndarray:
    c = table[name] if null is None else pc.fill_null(table[name], null)
    return c.to_numpy()


def known(table: pa.Table, name: str) -> np.ndarray:
    return pc.is_valid(table[name]).to_numpy()


def codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    """Places of the values among the distinct ones in Spark's order; -1 for null."""
    distinct = sorted((v for v in pc.unique(column).to_pylist() if v is not None), key=lambda v: v.encode())
    if not distinct:
        return np.full(len(column), -1), distinct
    return pc.fill_null(pc.index_in(column, pa.array(distinct, column.type)), -1).to_numpy().astype("int64"), distinct


def speak(table: pa.Table) -> pa.Table:
    """Laid rows to words with their speaker, as ``assign_speakers`` and ``fill_missing_speakers`` give it, patched if there are patches."""
    group, kind = np.cumsum(opens(table)), values(table, "_kind")
    code, names = codes(table["speaker"])
    start, end = values(table, "start_ms", 0), values(table, "end_ms", 0)
    has_start, has_end = known(table, "start_ms"), known(table, "end_ms")
    t = np.flatnonzero((kind == TURN) & has_start & has_end)
    w = np.flatnonzero(kind == WORD)
    if not len(w):
        return table.drop_columns(["_kind"]).slice(0, 0)
    who = _votes(group[w], start[w], end[w], has_start[w] & has_end[w], group[t], start[t], end[t], code[t])
    who = _filled(group[w], start[w], end[w], has_start[w], has_end[w], who)
    out = table.take(w) if len(w) < table.num_rows else table
    out = _put(out, "speaker", pc.take(pa.array(names, pa.string()), pa.array(who, mask=who < 0)))
    p = np.flatnonzero(kind == PATCH)
    if len(p):
        out = _patched(out, table.take(p), group[w], group[p])
    return out.drop_columns(["_kind"])


def _put(table: pa.Table, name: str, column) -> pa.Table:
    return table.set_column(table.schema.get_field_index(name), table.schema.field(name), column)


def _patched(words: pa.Table, patches: pa.Table, g: np.ndarray, gp: np.ndarray) -> pa.Table:
    idx, of = values(words, "word_idx"), values(patches, "word_idx")
    span = int(max(idx.max(), of.max())) + 1
    key, keys = gp * span + of, g * span + idx
    at = np.minimum(np.searchsorted(key, keys), len(key) - 1)
    rows = pa.array(at, mask=key[at] != keys)
    for name in ("conf", "disputed", "alt"):
        new = patches[name].combine_chunks().take(rows)
        words = _put(words, name, pc.coalesce(new, words[name].combine_chunks()))
    return words


def _votes(g, s, e, ok, gt, ts, te, code) -> np.ndarray:
    """Per word the speaker of the turn with most overlap, else of the nearest within reach; -1 without one. Turns come by number."""
    who = np.full(len(g), -1)
    if not len(gt):
        return who
    pad = C.NEAREST_TURN_MS
    times, rank = np.unique(np.concatenate([s, e, ts - pad, te + pad]), return_inverse=True)
    key = np.concatenate([g, g, gt, gt]) * len(times) + rank
    key_s, key_e, key_from, key_to = np.split(key, np.cumsum([len(g), len(g), len(gt)]))
    order = np.argsort(key_from, kind="stable")
    reach = np.maximum.accumulate(key_to[order])
    lo, hi = np.searchsorted(reach, key_s, "left"), np.searchsorted(key_from[order], key_e, "right")
    many = np.where(ok, np.maximum(hi - lo, 0), 0)
    upto, a = np.cumsum(many), 0
    while a < len(g):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
        n = many[a:b]
        word = np.repeat(np.arange(a, b), n)
        turn = order[np.arange(len(word)) - np.repeat(upto[a:b] - n - done, n) + lo[word]]
        near = key_to[turn] >= key_s[word]
        word, turn = word[near], turn[near]
        overlap = np.minimum(e[word], te[turn]) - np.maximum(s[word], ts[turn])
        _first(who, word, code[turn], overlap > 0, turn, -overlap)
        twice = s[word] + e[word]
        dist = np.minimum(np.abs(twice - 2 * ts[turn]), np.abs(twice - 2 * te[turn]))
        _first(who, word, code[turn], (dist <= 2 * pad) & (who[word] < 0), code[turn], dist)
        a = b
    return who


def _first(who, word, code, able, *order) -> None:
    """Gives each word the code that comes first by ``order``, whose last key counts most."""
    at = np.flatnonzero(able)
    at = at[np.lexsort((*[o[at] for o in order], word[at]))]
    first = np.append(True, word[at][1:] != word[at][:-1])[:len(at)]
    who[word[at][first]] = code[at][first]


def _filled(g, s, e, has_s, has_e, who) -> np.ndarray:
    n, at = len(g), np.arange(len(g))
    new = np.append(True, g[1:] != g[:-1])
    before = lambda x: np.append(x[:1], x[:-1])
    broke = new | ~before(has_e) | (has_s & (s - before(e) > C.PAUSE_MS))
    last_break = np.maximum.accumulate(np.where(broke, at, 0))
    last = np.maximum.accumulate(np.where(who >= 0, at, -1))
    following = np.minimum.accumulate(np.where(who >= 0, at, n)[::-1])[::-1]
    nxt = np.minimum(following, n - 1)
    soon = (following < n) & (g[nxt] == g) & has_s[nxt] & has_e & (s[nxt] - e <= C.PAUSE_MS)
    return np.where(last >= last_break, who[last], np.where(soon, who[nxt], -1))


def glue(table: pa.Table) -> pa.Table:
    """Split tokens become one word, as ``glue_pieces`` does; ``_starts`` and ``_closes`` tell which words meet."""
    glued = np.append(0, values(table, "_closes")[:-1]) & values(table, "_starts")
    heads = np.flatnonzero((glued == 0) | opens(table))
    tails = np.append(heads[1:], table.num_rows) - 1
    conf, unsure = values(table, "conf", np.nan), values(table, "disputed", False)
    has_conf = np.logical_or.reduceat(known(table, "conf"), heads)
    out = table.take(heads)
    pieces = pa.ListArray.from_arrays(pa.array(np.append(heads, table.num_rows), pa.int32()), pc.fill_null(table["w"], "").combine_chunks())
    alone = pa.array((heads == tails) & ~known(out, "w"))
    out = _put(out, "w", pc.if_else(alone, pa.scalar(None, pa.string()), pc.binary_join(pieces, "")))
    out = _put(out, "end_ms", table["end_ms"].take(tails))
    out = _put(out, "conf", pa.array(np.fmin.reduceat(conf, heads), mask=~has_conf))
    out = _put(out, "disputed", pa.array(np.logical_or.reduceat(unsure.astype(bool), heads)))
    first = np.flatnonzero(opens(out))
    number = np.arange(out.num_rows) - np.repeat(first, np.diff(np.append(first, out.num_rows)))
    return _put(out, "word_idx", pa.array(number)).drop_columns(["_starts", "_closes"])


def heads_of(table: pa.Table, make_step) -> np.ndarray:
    """Per row the row where its line begins; ``make_step`` is the rule that ``cut_pieces`` takes."""
    cols = {"start_ms": values(table, "start_ms"), "end_ms": values(table, "end_ms"), "_ends": values(table, "_ends"),
            "speaker": codes(table["speaker"])[0], "stt_seg": values(table, "stt_seg")}
    head, first = np.empty(table.num_rows, dtype="int64"), np.flatnonzero(opens(table))
    for a, b in zip(first, np.append(first[1:], table.num_rows)):
        step, i = make_step({c: v[a:b] for c, v in cols.items()}), 0
        while i < b - a:
            j = step(i)
            head[a + i:a + j] = a + i
            i = j
    return head


def line_ends(table: pa.Table, make_step) -> pa.Table:
    """``head``, words and latest end of each line."""
    at = np.flatnonzero(heads_of(table, make_step) == np.arange(table.num_rows))
    has = known(table, "end_ms")
    latest = np.maximum.reduceat(np.where(has, values(table, "end_ms", 0), np.iinfo("int64").min), at)
    return pa.table({"meeting_id": table["meeting_id"].take(at), "head": table["word_idx"].take(at), "n_words": np.diff(np.append(at, table.num_rows)),
                     "end_ms": pa.array(latest, mask=~np.logical_or.reduceat(has, at))})


def lines(table: pa.Table, make_step) -> pa.Table:
    """Lines with their number in the meeting and their words (column ``word``) nested."""
    at = np.flatnonzero(heads_of(table, make_step) == np.arange(table.num_rows))
    last = np.append(at[1:], table.num_rows) - 1
    has = known(table, "start_ms")
    earliest = np.minimum.reduceat(np.where(has, values(table, "start_ms", 0), np.iinfo("int64").max), at)
    meeting = table["meeting_id"].take(at)
    first = np.flatnonzero(opens(table.select(["meeting_id"]).take(at)))
    number = np.arange(1, len(at) + 1) - np.repeat(first, np.diff(np.append(first, len(at))))
    words = pa.ListArray.from_arrays(pa.array(np.append(at, table.num_rows), pa.int32()), table["word"].combine_chunks())
    return pa.table({"meeting_id": meeting, "ord": number, "start_ms": pa.array(earliest, mask=~np.logical_or.reduceat(has, at)),
                     "end_ms": table["end_ms"].take(last), "speaker": table["speaker"].take(at), "words": words})
