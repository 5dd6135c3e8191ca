"""Hand-edit renames: a corrected word of a speaker's name is carried through the record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

_EDGE = r"^[^\p{L}\p{N}']+|[^\p{L}\p{N}']+$"


def bare(word: Column) -> Column:
    """A word without surrounding punctuation."""
    return F.regexp_replace(word, _EDGE, "")


def replace_word(text: Column, old: Column, new: Column) -> Column:
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), T.escape(old), F.lit(r"(?![\p{L}\p{N}])"))
    return F.regexp_replace(text, pattern, F.regexp_replace(new, r"([\\$])", r"\\$1"))


def changed_words(old_text: Column, new_text: Column) -> Column:
    """``(old, new)`` pairs of a retyped line with the same number of words."""
    a, b = F.split(F.trim(old_text), r"(?U)\s+"), F.split(F.trim(new_text), r"(?U)\s+")
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("old"), y.alias("new")))
    same = F.filter(pairs, lambda p: bare(p["old"]) != bare(p["new"]))
    return F.when(F.size(a) == F.size(b), same).otherwise(F.slice(pairs, 1, 0))


def speaker_renames(segments: DataFrame, corrections: DataFrame) -> DataFrame:
    """``(meeting_id, speaker, renamed)`` for named speakers whose name holds a corrected word."""
    fixes = corrections.select(
        "meeting_id", bare(F.col("old")).alias("old"), bare(F.col("new")).alias("new"), F.trim("new").alias("_raw")
    ).where((F.col("old") != "") & (F.col("new") != "") & (F.col("old") != F.col("new")) & ~F.col("_raw").rlike(r"\s"))
    names = segments.select("meeting_id", "speaker").distinct().where(T.named(F.col("speaker")))
    parts = names.select("meeting_id", "speaker", F.explode(F.split("speaker", r"(?U)\s+")).alias("_part"))
    hit = parts.withColumn("_key", F.lower(bare(F.col("_part")))).join(
        fixes.withColumn("_key", F.lower("old")), ["meeting_id", "_key"]
    )
    return hit.select(
        "meeting_id", "speaker", "old", "new", replace_word(F.col("speaker"), F.col("old"), F.col("new")).alias("renamed")
    ).distinct()
