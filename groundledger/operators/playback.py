"""What the player needs: the word or line at a time, jump targets, pins, re-timed words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from .intervals import point_in_interval
from .ordered import with_neighbours


def retime(text: Column, start_s: Column, end_s: Column) -> Column:
    """Words of a retyped line, spread evenly over the line (half a second at least)."""
    tokens = F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda x: x != "")
    step = F.greatest(F.lit(0.5), end_s - start_s) / F.size(tokens)
    return F.transform(
        tokens,
        lambda w, i: F.struct(
            w.alias("w"), F.round(start_s + i * step, 2).alias("start_s"), F.round(start_s + (i + 1) * step, 2).alias("end_s"),
            F.lit(1.0).alias("conf"),
        ),
    )


def active_lines(times: DataFrame, segments: DataFrame) -> DataFrame:
    """First line that holds each playback time (end excluded)."""
    hits = point_in_interval(times, segments, ["meeting_id"], F.col("t_ms"), ("start_ms", "end_ms"), closed=False)
    return hits.groupBy("meeting_id", "t_ms").agg(F.min_by("seg_id", F.col("ord")).alias("seg_id"))


def active_words(times: DataFrame, words: DataFrame) -> DataFrame:
    """First word whose time reaches up to the next word (0.35 s after the last one)."""
    reach = with_neighbours(
        words, ["meeting_id"], "ord", 0, 1,
        lambda w: {"_next": F.lead("start_ms").over(w)}, order=["ord", "pos"],
    )
    until = F.greatest("end_ms", F.coalesce("_next", F.col("end_ms") + 350))
    spans = reach.withColumn("until_ms", until)
    hits = point_in_interval(times, spans, ["meeting_id"], F.col("t_ms"), ("start_ms", "until_ms"), closed=False)
    return hits.groupBy("meeting_id", "t_ms").agg(
        F.min(F.struct("ord", "pos", "w")).alias("x")
    ).select("meeting_id", "t_ms", "x.ord", "x.pos", "x.w")


def jump_targets(items: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest cited line per item and where playback starts (two seconds earlier)."""
    cited = items.select("meeting_id", *keys, F.explode("evidence_ids").alias("seg_id"))
    hits = cited.join(segments.select("meeting_id", "seg_id", "start_ms", "ord"), ["meeting_id", "seg_id"])
    first = hits.groupBy("meeting_id", *keys).agg(F.min(F.struct("start_ms", "ord", "seg_id")).alias("x"))
    return first.select(
        "meeting_id", *keys, "x.seg_id", F.greatest(F.lit(0), F.col("x.start_ms") - C.LEAD_IN_MS).alias("play_ms")
    )
