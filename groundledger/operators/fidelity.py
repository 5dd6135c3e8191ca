"""How faithful a record is to its transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

KEYS = ["meeting_id"]


def preserved(raw: DataFrame, refined: DataFrame) -> DataFrame:
    """Numbers and negations in the raw lines, and how many sit in lines that kept them unchanged."""
    f = refined.select("meeting_id", "seg_id", F.col("text").alias("_after"))
    rows = raw.select("meeting_id", "seg_id", "text").join(f, ["meeting_id", "seg_id"], "left")
    after = F.coalesce("_after", "text")
    # Most lines are as they were, which says that nothing in them has changed.
    same = lambda of: F.when(F.col("text") == after, True).otherwise(of(F.col("text")) == of(after))
    rows = rows.select(
        "meeting_id", T.number_count(F.col("text")).alias("_n"), same(T.numbers).alias("_ns"),
        T.negation_count(F.col("text")).alias("_g"), same(T.negation_count).alias("_gs"),
    )
    kept = lambda n, same: F.sum(F.when(F.col(same), F.col(n)).otherwise(0)).cast("long")
    return rows.groupBy(*KEYS).agg(
        kept("_n", "_ns").alias("numbers_kept"), F.sum("_n").cast("long").alias("numbers_total"),
        kept("_g", "_gs").alias("negations_kept"), F.sum("_g").cast("long").alias("negations_total"),
    )


def cited_ids(*items: DataFrame) -> DataFrame:
    """Every line id cited anywhere in the record."""
    parts = [i.select("meeting_id", F.explode("evidence_ids").alias("seg_id")) for i in items]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def coverage(raw: DataFrame, cited: DataFrame) -> DataFrame:
    """Share of the raw lines that the record cites, in percent with one decimal."""
    flagged = raw.select("meeting_id", "seg_id").join(
        cited.select("meeting_id", "seg_id", F.lit(1).alias("_hit")), ["meeting_id", "seg_id"], "left")
    c = flagged.groupBy(*KEYS).agg(F.count("_hit").alias("cited_lines"), F.count(F.lit(1)).alias("total_lines"))
    return c.withColumn("coverage_pct", share(F.col("cited_lines"), F.col("total_lines")))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(100 * part / whole, 1)).otherwise(0.0)


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(name))


def scorecard(
    raw: DataFrame, refined: DataFrame, accepted: DataFrame, rejected: DataFrame, tasks: DataFrame, demoted: DataFrame,
    dropped: DataFrame, removed_sentences: DataFrame, cited: DataFrame,
) -> DataFrame:
    """One row per meeting."""
    disputed = raw.groupBy(*KEYS).agg(
        F.sum(F.size(F.filter("words", lambda w: w["disputed"]))).cast("long").alias("disputed_words"))
    downgraded = tasks.where(F.arrays_overlap("flags", F.array(F.lit("owner_downgraded"), F.lit("deadline_downgraded"))))
    out = preserved(raw, refined).join(coverage(raw, cited), KEYS, "left").join(disputed, KEYS, "left")
    parts = {"edits_accepted": accepted, "edits_rejected": rejected, "_down": downgraded, "_demoted": demoted,
             "_dropped": dropped, "sentences_removed": removed_sentences}
    # Counts are one row per meeting: one union and one aggregation instead of a join each.
    counts = None
    for name, df in parts.items():
        one = df.select("meeting_id", F.lit(name).alias("kind"))
        counts = one if counts is None else counts.unionByName(one)
    wide = counts.groupBy(*KEYS).agg(*[F.count_if(F.col("kind") == n).alias(n) for n in parts])
    out = out.join(wide, KEYS, "left").na.fill(0, list(parts))
    pair = lambda k, n: F.concat(F.col(k).cast("string"), F.lit("/"), F.col(n).cast("string"))
    return out.select(
        "meeting_id", pair("numbers_kept", "numbers_total").alias("numbers_preserved"),
        pair("negations_kept", "negations_total").alias("negations_preserved"), "edits_accepted", "edits_rejected",
        "disputed_words", (F.col("_down") + F.col("_demoted") + F.col("_dropped")).alias("items_downgraded"),
        "sentences_removed", "coverage_pct",
    )
