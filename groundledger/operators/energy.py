"""Cheap loudness gate over audio samples given as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from .ordered import chunk_of, dense_order


def loud_frames(samples: DataFrame, per_frame: int) -> DataFrame:
    """RMS per whole frame against the floor; a last partial frame is dropped."""
    frame = F.floor(F.col("i") / per_frame)
    rms = F.sqrt(F.avg(F.col("x") * F.col("x")))
    return (
        samples.groupBy("meeting_id", frame.alias("frame"))
        .agg((rms > 10 ** (C.ENERGY_FLOOR_DB / 20)).alias("loud"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == per_frame).drop("_n")
    )


def loud_regions(frames: DataFrame, frame_ms: int) -> DataFrame:
    """Maximal runs of loud frames."""
    loud = dense_order(frames.where("loud"), ["meeting_id"], ["frame"], chunk_of("frame", 65536), "_rn")
    runs = loud.groupBy("meeting_id", (F.col("frame") - F.col("_rn")).alias("_g")).agg(
        F.min("frame").alias("_a"), F.max("frame").alias("_b")
    )
    return runs.select("meeting_id", (F.col("_a") * frame_ms).alias("start_ms"), ((F.col("_b") + 1) * frame_ms).alias("end_ms"))


def speech_total(regions: DataFrame) -> DataFrame:
    """Speech per meeting, with the error code when there is too little."""
    total = F.sum(F.col("end_ms") - F.col("start_ms"))
    return regions.groupBy("meeting_id").agg(
        total.alias("speech_ms"), F.when(total < C.MIN_SPEECH_MS, "E_NO_SPEECH").alias("error")
    )
