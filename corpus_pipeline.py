"""A corpus from raw documents to packed sequences: language, quality, near-duplicates, packing.

Every stage but the last returns rows of ``documents`` as they are, extra columns included. Null texts, texts without letters and
texts whose letters are far less likely than those of the labelled texts of their language go in the first stage. A group of
near copies keeps the row of its smallest id; a group without ids keeps one row as well. Empty tables pass through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundledger.llm import langid, packing, quality, simhash
from groundledger.llm.common import fold, free_names, table
from groundledger.llm.queries import tokenizer
from groundledger.session import checkpoint_dir

#: Rows must be more likely than not in one language, and at most this many times as strange as the strangest labelled text; quality as
#: in the query of its own.
LANGUAGE_SCORE, SURPRISE, QUALITY_SCORE = 0.5, 2.5, 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages of the labelled ones."""
    model = langid.fit(docs.where(fold("doc_id", 4) != 2), tokenizer("piece_bpe_32k.model"))
    told, score, surprise = free_names(docs, "lang_pred", "score", "surprise")
    kept = langid.identify(docs, model, names=(told, score, surprise)).where(
        (F.col(told) != langid.UND) & (F.col(score) >= LANGUAGE_SCORE) & (F.col(surprise) <= SURPRISE))
    return kept.select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier, learned from the labels of what came in, takes for good ones."""
    labels = table(spark, sf_dir, "labels")
    known = quality.labelled(docs.where(fold("doc_id", 5) != 0).select("doc_id", "text"), labels)
    model = quality.fit(quality.with_statistics(known), labels)
    score, = free_names(docs, "score")
    return quality.score_texts(docs, model, name=score).where(F.col(score) >= QUALITY_SCORE).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component."""
    return simhash.representatives(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 ids."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", quality_filter), ("near_duplicates", near_duplicates), ("packing", pack)]

#: SQL has no sentencepiece, XXH64 with a seed or differencing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
