"""Live views over progress events and recognised words.

Each function takes a streaming or a static DataFrame; on a static one it is the batch twin of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as C
from ..operators.assemble import cut_segments
from ..operators.intervals import island_starts
from ..operators.ordered import TIME_CHUNK_MS, chunk_of, dense_order, settle
from ..operators.progress import overall_progress


def latest_progress(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Newest event per meeting (update mode); a later event with the same time wins by its id."""
    rows = events.withWatermark("event_time", delay) if events.isStreaming else events
    last = F.max_by(F.struct("stage", "status", "within_pct", "event_time"), F.struct("event_time", "event_id"))
    out = rows.groupBy("meeting_id").agg(last.alias("x")).select("meeting_id", "x.*")
    done = F.when(F.col("status") == "completed", 1.0).otherwise(overall_progress(F.col("stage"), F.col("within_pct") / 100))
    return out.withColumn("progress", done)


def completion_feed(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Completed and failed events, each delivered once."""
    ends = events.where(F.col("status").isin(*C.TERMINAL))
    if events.isStreaming:
        return ends.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])
    return ends.dropDuplicates(["event_id"])


def speech_sessions(events: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Sessions separated by a pause of at least ``gap``; on a stream, rows later than ``delay`` are dropped."""
    if events.isStreaming:
        rows = events.withWatermark("event_time", delay)
        return rows.groupBy("meeting_id", F.session_window("event_time", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
            "meeting_id", F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "n")
    # Static rows use interval islands, which split a busy meeting by time instead of sorting it in one task.
    length = F.expr(f"interval {gap}")
    at = F.col("event_time")
    t0 = F.lit("1970-01-01").cast(events.schema["event_time"].dataType)
    us = F.timestamp_diff("MICROSECOND", t0, at)
    rows = events.groupBy("meeting_id", us.alias("a"), at.alias("_from")).agg(F.count(F.lit(1)).alias("n")).withColumn("_to", F.col("_from") + length)
    spans = rows.withColumn("b", F.timestamp_diff("MICROSECOND", t0, F.col("_to")) - 1)
    runs = island_starts(spans, ["meeting_id"], "a", "b", 86_400_000_000)
    return runs.groupBy("meeting_id", "island").agg(
        F.min("_from").alias("start_time"), F.max("_to").alias("end_time"), F.sum("n").alias("n")).drop("island")


def dispute_alerts(words: DataFrame, threshold: float = C.LOWCONF_DISPUTE) -> DataFrame:
    return words.where(F.col("conf") < threshold)


_OUT = "meeting_id long, start_ms long, end_ms long, n_words long, speaker string"
_WORD = "meeting_id long, stt_seg long, start_ms long, end_ms long, w string, speaker string"
_OPEN = _WORD + ", at long"


def _ends(word: str) -> bool:
    import re

    return bool(re.search(C.SENTENCE_CLOSE, word)) and word.strip().lower() not in C.ABBREVIATIONS


class LiveLines:
    """A stream of words that ``run_to_table`` cuts into lines, one micro-batch after the other."""

    def __init__(self, words: DataFrame):
        self.words = words


def cut_batch(words: DataFrame, opened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that end in a micro-batch, and the words of each meeting's open line (at most 60), the only state.

    ``opened`` are the words left open by the batch before; they precede those of this one.  Words are cut per
    (meeting, chunk), so no task holds a meeting's words.
    """
    schema = opened.schema
    rows = settle(words.select([F.col(f.name).cast(f.dataType) for f in schema if f.name != "at"]))
    ended = rows.where(F.col("w").isNull()).select("meeting_id").distinct()
    both = opened.unionByName(rows.where(F.col("w").isNotNull()).withColumn("at", F.lit(None).cast("long")))
    fresh = F.col("at").isNull()
    order = [fresh, "at", "start_ms", "stt_seg", "end_ms", "w", "speaker"]
    bucket = F.struct(fresh.alias("f"), F.when(fresh, chunk_of("start_ms", TIME_CHUNK_MS)).alias("t"))
    numbered = settle(dense_order(both, ["meeting_id"], order, bucket, "_n").withColumn("word_idx", F.col("_n").cast("long") - 1).drop("_n", "at"))
    cut = settle(cut_segments(numbered))
    lines = settle(cut.groupBy("meeting_id", "head").agg(
        F.min_by("start_ms", "word_idx").alias("start_ms"), F.max_by("end_ms", "word_idx").alias("end_ms"), F.count(F.lit(1)).alias("n_words"),
        F.max_by("speaker", "word_idx").alias("speaker")))
    last = settle(lines.groupBy("meeting_id").agg(F.max("head").alias("head")).join(ended, "meeting_id", "left_anti"))
    left = cut.join(last, ["meeting_id", "head"], "left_semi").withColumn("at", F.col("word_idx"))
    return lines.join(last, ["meeting_id", "head"], "left_anti").drop("head"), left.select(*schema.names)


def live_lines(words: DataFrame) -> LiveLines | DataFrame:
    """Transcript lines as their last word becomes known; the state is one open line per meeting.

    ``words``: meeting_id, stt_seg, start_ms, end_ms, w, speaker.  Words of a micro-batch are put in time
    order; a meeting's words must reach the stream in order of micro-batches.  A row whose ``w`` is NULL ends the
    meeting: its open line comes out and its state is dropped.  On static rows, the lines of one batch.
    """
    if words.isStreaming:
        return LiveLines(words)
    return cut_batch(words, words.sparkSession.createDataFrame([], _OPEN))[0]


_SWEPT = "meeting_id long, stage string, status string, error_code string, error_detail string"


def interrupted_meetings(events: DataFrame, silence_ms: int, delay: str = "1 hour") -> DataFrame:
    """Meetings that were waiting or running and then sent no event for ``silence_ms`` of event time."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            stage, status, _ = state.get
            state.remove()
            if status in ("queued", "running"):
                yield pd.DataFrame([[key[0], "failed", "failed", "E_INTERNAL", C.INTERRUPTED_DETAIL]],
                                   columns=["meeting_id", "stage", "status", "error_code", "error_detail"])
            return
        best = state.get if state.exists else ("", "", -1)
        for pdf in batches:
            last = pdf.loc[pdf["_ms"].idxmax()]
            if last["_ms"] > best[2]:
                best = (last["stage"], last["status"], int(last["_ms"]))
        state.update(best)
        state.setTimeoutTimestamp(max(best[2] + silence_ms, state.getCurrentWatermarkMs() + 1))

    rows = events.withColumn("_ms", F.unix_millis(F.col("event_time"))).withWatermark("event_time", delay)
    return rows.select("meeting_id", "event_time", "stage", "status", "_ms").groupBy("meeting_id").applyInPandasWithState(
        watch, _SWEPT, "stage string, status string, last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame | LiveLines, folder: str) -> DataFrame:
    """Drain the available input into Parquet files and read them back."""
    out = f"{folder}/rows"
    if isinstance(stream, LiveLines):
        return _lines_to_table(stream.words, folder, out)
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start(out)
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def _lines_to_table(words: DataFrame, folder: str, out: str) -> DataFrame:
    """Each micro-batch writes its lines and its open lines to folders of its number, so a repeated batch replaces its own."""
    spark = words.sparkSession
    spark.createDataFrame([], _OUT).write.mode("ignore").parquet(f"{out}/none")

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.sparkSession
        opened = own.read.schema(_OPEN).parquet(f"{folder}/open/{number - 1}") if number else own.createDataFrame([], _OPEN)
        lines, left = cut_batch(rows, opened)
        left.write.mode("overwrite").parquet(f"{folder}/open/{number}")
        lines.write.mode("overwrite").parquet(f"{out}/{number}")

    q = words.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(_OUT).option("recursiveFileLookup", "true").parquet(out)
