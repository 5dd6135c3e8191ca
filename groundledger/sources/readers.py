"""Reading transcripts, provider answers, model answers and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions import text as T
from ..operators.ordered import settle

WORD = "struct<w:string,start_ms:bigint,end_ms:bigint,conf:double,disputed:boolean,alt:string>"
SEGMENT = f"meeting_id bigint, seg_id string, ord bigint, start_ms bigint, end_ms bigint, speaker string, text string, words array<{WORD}>"
UTTERANCES = "array<struct<start:bigint,end:bigint,speaker:string>>"
CORRUPT = "_corrupt"
EDIT = "segment_id string, original string, replacement string, category string, rationale string, confidence double"


def read_transcripts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Transcript lines from JSON or Parquet files; ``unreadable_transcripts`` has the malformed JSON rows."""
    if fmt == "json":
        rows = _json_rows(spark, path).where(F.col(f"p.{CORRUPT}").isNull() & F.col("p").isNotNull())
        folders = [c for c in rows.columns if c not in ("value", "path", "p")]  # columns that stand in folder names
        got = rows.select("p.*", *[F.col(c).alias(f"_in_{c}") for c in folders]).drop(CORRUPT)
        for c in folders:
            got = got.withColumn(c, F.col(f"_in_{c}").cast(got.schema[c].dataType) if c in got.columns else F.col(f"_in_{c}")).drop(f"_in_{c}")
        return got
    return spark.read.schema(SEGMENT).parquet(path)


def unreadable_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Malformed rows of JSON transcripts: the file (path) and what stands there (content)."""
    return _json_rows(spark, path).where(F.col("p").isNull() | F.col(f"p.{CORRUPT}").isNotNull()).select("path", F.col("value").alias("content"))


def _json_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows as text with what they hold (p); all columns are parsed, so a row is good or bad whatever is selected later."""
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("path", F.col("_metadata.file_path"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return rows.withColumn("p", F.from_json("value", f"{SEGMENT}, {CORRUPT} string", options))


def _parsed(column: str) -> Column:
    return F.from_json(column, f"array<struct<{SEGMENT.replace(' bigint', ':bigint').replace(' string', ':string').replace(' array', ':array')}>>")


def parse_transcripts(docs: DataFrame, column: str) -> DataFrame:
    """Transcripts held as JSON text, one array of lines per row; ``unparsed_transcripts`` has the rows without."""
    return docs.select(F.explode(_parsed(column)).alias("s")).select("s.*").where(F.col("seg_id").isNotNull())


def unparsed_transcripts(docs: DataFrame, column: str) -> DataFrame:
    """Rows whose text is no array of lines, or holds a line without an id."""
    lines = _parsed(column)
    return docs.where(lines.isNull() | F.exists(lines, lambda s: s.isNull() | s["seg_id"].isNull()))


def provider_turns(answers: DataFrame, column: str) -> DataFrame:
    """Diarizer utterances in milliseconds to turns in seconds; a missing label is ``A``."""
    keys = [c for c in answers.columns if c != column]
    u = answers.select(*keys, F.posexplode(F.from_json(column, UTTERANCES)).alias("turn_no", "u"))
    return u.select(
        *keys, "turn_no", (F.col("u.start") / 1000).alias("start_s"), (F.col("u.end") / 1000).alias("end_s"),
        F.coalesce("u.speaker", F.lit("A")).alias("label"))


def ingest_answers(raw: DataFrame, column: str, schema: str, list_field: str = "edits") -> tuple[DataFrame, DataFrame]:
    """``(typed rows, quarantine)`` from raw model answers: think blocks, fences and chatter are stripped."""
    typed = ", ".join(f"{p.split()[0]}: {' '.join(p.split()[1:])}" for p in schema.split(", "))
    # Answers are dealt anew, as few bytes of them may be much work; exploding a list of one keeps each step from running again
    # wherever its result is used.
    once = lambda x, name: F.explode(F.array(x)).alias(name)
    dealt = raw.repartition(max(raw.sparkSession.sparkContext.defaultParallelism, int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parsed = dealt.select("*", once(T.extract_json(F.col(column)), "_body")).select("*", once(
        F.from_json("_body", f"struct<{list_field}: array<struct<{typed}>>, _corrupt: string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}), "_p"))
    reason = F.when(F.col("_body").isNull(), "no JSON object found").when(
        F.col("_p._corrupt").isNotNull() | F.col("_p").isNull(), "invalid JSON")
    marked = settle(parsed.withColumn("reason", reason))
    good = marked.where(F.col("reason").isNull()).select(*[c for c in raw.columns if c != column], F.posexplode(f"_p.{list_field}").alias("i", "x"))
    return good.select("*", "x.*").drop("x"), marked.where(F.col("reason").isNotNull()).select(*raw.columns, "reason")


def within_bounds(edits: DataFrame) -> DataFrame:
    """Edits with a known category and a confidence between zero and one."""
    return edits.where(F.col("category").isin(*C.EDIT_CATEGORIES) & F.col("confidence").between(0, 1))


def cited_only(items: DataFrame) -> DataFrame:
    return items.where(F.size("evidence_ids") > 0)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def manifest_error(path: Column, size: Column, duration_s: Column) -> Column:
    """First failing check of a recording, NULL when it may be processed."""
    return (
        F.when(size == 0, "E_EMPTY_FILE")
        .when(size > C.MAX_FILE_MB * 1024 * 1024, "E_TOO_LARGE")
        .when(~extension(path).isin(*C.ALLOWED_EXT), "E_UNSUPPORTED_FORMAT")
        .when(duration_s > C.MAX_DURATION_MIN * 60, "E_TOO_LONG")
    )


def read_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path and size of recordings; file contents are not read.

    Spark's file source does not list zero-length files: where those matter, use an upload table instead.
    """
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("size_bytes"))


def read_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.sha2("content", 256).alias("sha256"))
