"""Line, word and job predicates; transcript assembly lives in ``assemble``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions.repeats import repeated_phrase_col


def low_confidence(words: DataFrame, threshold: float = C.LOWCONF_DISPUTE) -> DataFrame:
    """Words to mark disputed when no second recogniser ran; a threshold of zero turns it off."""
    if threshold <= 0:
        return words.limit(0)
    return words.where(F.coalesce("conf", F.lit(1.0)) < threshold).withColumn("disputed", F.lit(True))


def hallucination_reason(segments: DataFrame) -> DataFrame:
    """Adds ``drop_reason``: NULL for lines to keep, else the first failing guard."""
    silent = (F.coalesce("no_speech_prob", F.lit(0.0)) > 0.6) & (F.coalesce("avg_logprob", F.lit(0.0)) < -1.0)
    reason = (
        F.when(silent, "no_speech")
        .when(F.coalesce("compression_ratio", F.lit(0.0)) > 2.4, "compression_ratio")
        .when(repeated_phrase_col(F.col("text")), "repetition")
    )
    return segments.withColumn("drop_reason", reason)


def language_warning(language: Column, probability: Column) -> Column:
    return F.when((language != "en") | (probability < 0.5), "W_NON_ENGLISH")


def visible_jobs(jobs: DataFrame, device_id: str) -> DataFrame:
    """Jobs of one device; an empty device sees nothing."""
    return jobs.where((F.col("device_id") == device_id.strip()) & (F.lit(device_id.strip()) != ""))


def ready_flags(meetings: DataFrame, stage_outputs: DataFrame) -> DataFrame:
    """Which transcripts and records exist, from the stage outputs present."""
    has = lambda s: F.max(F.when(F.col("stage") == s, True).otherwise(False))
    flags = stage_outputs.groupBy("meeting_id").agg(
        has("raw_saved").alias("raw_ready"), has("guarding").alias("refined_ready"), has("verifying").alias("record_ready")
    )
    names = ["raw_ready", "refined_ready", "record_ready"]
    return meetings.join(flags, "meeting_id", "left").select(
        "meeting_id", *[F.coalesce(n, F.lit(False)).alias(n) for n in names]
    )
