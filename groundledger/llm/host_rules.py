"""Quality rules with verdicts per host, in DataFrame expressions only.

Base rules look at one document. Their failures are then counted by host; a host's failure rate is shrunk with a beta
prior whose mean and weight are fitted to the rates of all hosts (method of moments), so a small host needs more evidence
than a large one. Documents of a host whose shrunk rate passes ``limit`` are not kept.

Words are runs of characters other than blank, tab, line feed, vertical tab, form feed and return. A null or empty text
has no words and fails. A null host has no verdict: its documents are judged alone. Repeated rows count each time. An
empty table gives no rows. Counts per host are partial aggregates, so a hot host is no hot task; verdicts are one row per
host and join back by broadcast only below a counted bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS

SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Hosts whose verdicts may be broadcast: at most this many, at about 100 bytes each.
SMALL_HOSTS = 200_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.translate(x, BLANKS, "") != "")


def with_repeated_words(rows: DataFrame, words: str, name: str) -> DataFrame:
    """Adds the number of words that lie in a window of three words which the text has at least twice.

    Windows are sorted with their positions; those equal to a neighbour are the repeated ones, and the words they cover
    are counted from the gaps between their positions. Each array is a column before a lambda looks into it, since a
    lambda would build an expression anew for every element.
    """
    n = F.size(words)
    window = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.struct(
        F.concat_ws(" ", F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("w"), i.alias("i")))
    none = F.array().cast("array<struct<w:string,i:int>>")
    order = F.col("_order")
    twice = F.filter(F.transform(order, lambda x, k: F.when(
        (x["w"] == F.get(order, k - 1)["w"]) | (x["w"] == F.get(order, k + 1)["w"]), x["i"])), lambda i: i.isNotNull())
    covered = F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - p, F.lit(3))))
    return (
        rows.withColumn("_order", F.sort_array(F.when(n > 3, window).otherwise(none)))
        .withColumn("_at", F.sort_array(twice)).drop("_order")
        .withColumn(name, F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long")).drop("_at")
    )


def measure(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source") -> DataFrame:
    """``doc_id, host`` and the counts of the base rules with ``base_failed``."""
    t = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).cast("string").alias("_text"))
    rows = rows.select(
        "doc_id", "host", words_of(F.col("_text")).alias("_words"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines_of(F.col("_text")).alias("_lines"),
    )
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    rows = with_repeated_words(rows, "_words", "n_repeat_words").drop("_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame, limit: float = 0.6) -> DataFrame:
    """``host, n, failures, rate, host_failed``; ``rate`` is the posterior mean under the fitted beta prior.

    With ``m`` the mean and ``v`` the variance of the hosts' rates, the prior's weight is ``m (1 - m) / v - 1`` after
    the variance expected from counting alone is taken off, at least 1 and at most a million (all hosts alike).
    """
    per_host = rows.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    raw = F.col("failures") / F.col("n")
    m, v, c = per_host.agg(F.avg(raw), F.var_pop(raw), F.avg(1 / F.col("n"))).first()  # three numbers
    unit = (m or 0.0) * (1 - (m or 0.0))
    between = max((v or 0.0) - unit * (c or 0.0), 0.0)
    weight = 1_000_000.0 if between * 1_000_001 <= unit else max(unit / between - 1, 1.0)
    rate = (F.col("failures") + (m or 0.0) * weight) / (F.col("n") + weight)
    return per_host.select("host", "n", "failures", rate.alias("rate"), (rate > limit).alias("host_failed"))


def judge(docs: DataFrame, limit: float = 0.6, text: str = "text", doc_id: str = "doc_id", host: str = "source") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host, host_rate``."""
    from .common import settle

    rows = settle(measure(docs, text, doc_id, host))
    verdicts = settle(host_verdicts(rows, limit)).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), "host_failed")
    if verdicts.count() <= SMALL_HOSTS:
        verdicts = F.broadcast(verdicts)
    joined = rows.join(verdicts, F.col("host") == F.col("_host"), "left")
    kept = ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         kept.alias("kept"), "host", "host_rate")
