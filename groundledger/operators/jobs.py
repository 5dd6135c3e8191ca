"""The job index: listing, reuse of finished work, changes and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions import text as T


def find_job(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.where(F.col("id") == job_id)


def list_jobs(jobs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first (the page is the feature)."""
    return jobs.orderBy(F.col("created_s").desc(), F.col("job_no").desc()).offset(offset).limit(limit)


def newest_completed(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Newest completed job per file hash (and device)."""
    done = jobs.where(F.col("status") == "completed")
    return done.groupBy(*keys).agg(
        F.max_by(F.struct("id", "lm2"), F.struct("created_s", "job_no")).alias("_j")
    ).select(*keys, F.col("_j.id").alias("reuse_id"), F.contains("_j.lm2", F.lit("(cloud)")).alias("made_with_cloud"))


def already_processed(manifest: DataFrame, jobs: DataFrame, keys: list[str], cloud: str = "wants_cloud") -> DataFrame:
    """Uploads with the finished job to reuse, when it was made the same way."""
    j = manifest.join(newest_completed(jobs, keys), keys, "left")
    return j.withColumn("reuse_id", F.when(F.col("made_with_cloud") == F.col(cloud), F.col("reuse_id"))).drop("made_with_cloud")


def error_messages(spark: SparkSession) -> DataFrame:
    from ..catalog.bindings import local_rows

    return local_rows(spark, list(C.ERROR_MESSAGES.items()), "error_code string, message string")


def with_messages(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """User-facing text per error code; unknown codes read as an internal error."""
    m = F.broadcast(error_messages(spark))
    return rows.join(m, "error_code", "left").withColumn(
        "message", F.when(F.col("error_code").isNotNull(), F.coalesce("message", F.lit(C.ERROR_MESSAGES["E_INTERNAL"]))))


def apply_changes(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """A new version of the job table from a change feed (``rename``, ``cancel``, ``retry``, ``delete``).

    Per job and kind the latest change counts.  A running job is not deleted, a blank title keeps the old
    one, only waiting or running jobs can be cancelled and only failed ones retried.
    """
    last = changes.groupBy("id").pivot("kind", ["rename", "cancel", "retry", "delete"]).agg(F.max_by(F.struct("title", "ts"), "ts"))
    j = jobs.join(last, "id", "left")
    active = F.col("status").isin("queued", "running")
    title = F.substring(F.trim(F.coalesce("rename.title", F.lit(""))), 1, 100)
    cancel = F.col("cancel").isNotNull() & active
    retry = F.col("retry").isNotNull() & (F.col("status") == "failed")
    kept = j.where(F.col("delete").isNull() | active)
    status = F.when(cancel, "failed").when(retry, "queued").otherwise(F.col("status"))
    code = F.when(cancel, "E_CANCELLED")
    return kept.select(
        *[c for c in jobs.columns if c not in ("title", "status", "stage")],
        F.when(title != "", title).otherwise(F.col("title")).alias("title"),
        status.alias("status"), F.when(cancel | retry, status).otherwise(F.col("stage")).alias("stage"), code.alias("error_code"),
        F.when(cancel, C.CANCELLED_DETAIL).alias("error_detail"),
    )


def sweep_interrupted(jobs: DataFrame, code: str = "E_INTERNAL") -> DataFrame:
    """Jobs that were waiting or running at a restart become failed."""
    hit = F.col("status").isin("queued", "running")
    return jobs.withColumn("error_code", F.when(hit, code)).withColumn("error_detail", F.when(hit, C.INTERRUPTED_DETAIL)).withColumn(
        "stage", F.when(hit, "failed").otherwise(F.col("stage"))).withColumn("status", F.when(hit, "failed").otherwise(F.col("status")))


def unfinished(inputs: DataFrame, stage_output: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs a stage still has to process."""
    return inputs.join(stage_output.select(*keys).distinct(), keys, "left_anti")


def stage_timings(timings: DataFrame) -> DataFrame:
    """Seconds per stage, slowest first, with the total."""
    per = timings.groupBy("stage").agg(F.round(F.sum("seconds"), 2).alias("seconds"))
    return per.orderBy(F.col("seconds").desc(), "stage")


def describe_meetings(meetings: DataFrame, stt: DataFrame, recheck: DataFrame, diarization: DataFrame, lm: DataFrame) -> DataFrame:
    """One description row per meeting: models used (or why a step was skipped) and warnings."""
    j = meetings.join(stt, "meeting_id", "left").join(recheck, "meeting_id", "left").join(diarization, "meeting_id", "left").join(lm, "meeting_id", "left")
    checked = F.coalesce("recheck_model", F.concat(
        F.lit("skipped: "), F.coalesce("recheck_reason", F.lit("n/a")),
        F.when(F.coalesce("fallback", F.lit(False)), "; low-confidence words marked disputed instead").otherwise("")))
    voices = F.coalesce("diarization_model", F.concat(F.lit("skipped: "), F.coalesce("diarization_reason", F.lit("off"))))
    models = F.create_map(
        F.lit("stt"), F.coalesce("stt_model", F.lit("faster-whisper")), F.lit("stt_check"), checked, F.lit("diarization"), voices,
        F.lit("lm1"), F.col("lm1"), F.lit("lm2"), F.col("lm2"))
    return j.select(
        "meeting_id", "title", "source_file", F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"),
        F.coalesce("language", F.lit("en")).alias("language"), F.coalesce("language_probability", F.lit(1.0)).alias("language_probability"),
        models.alias("models"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))
