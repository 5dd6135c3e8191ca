"""Word lists as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def scan(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lower-cased terms of a text table: blank lines and ``#`` comments dropped."""
    kept = lines.where((F.trim(column) != "") & ~F.col(column).startswith("#"))
    return kept.select(F.lower(F.trim(column)).alias("term")).distinct()


def packaged(spark: SparkSession) -> DataFrame:
    """The packaged places and technical terms (a few hundred rows)."""
    from ..catalog.bindings import local_rows
    from .speakers import known_terms

    return local_rows(spark, [(t,) for t in known_terms()], "term string")
