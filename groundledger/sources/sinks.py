"""Writing records: JSON documents, plain text and Markdown.

A document is written in parts of at most ``PART`` lines, so no meeting has to pass through one task whole;
an ordinary meeting is one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions import text as T
from ..operators.ordered import chunk_of, dense_order, settle

PART = 4096


def in_parts(lines: DataFrame, order: list[str], line: str = "line", sep: str = "\n", name: str = "text") -> DataFrame:
    """Lines with a dense ``n`` (1-based) joined into parts."""
    row = F.struct("n", line)
    rows = lines.withColumn("part", chunk_of(F.col("n") - 1, PART))
    return rows.groupBy("meeting_id", "part").agg(F.array_sort(F.collect_list(row)).alias("_x")).select(
        "meeting_id", "part", F.concat(F.array_join(F.transform("_x", lambda r: r[line]), sep), F.lit(sep)).alias(name))


def transcript_text(segments: DataFrame) -> DataFrame:
    """``[HH:MM:SS] Speaker: text`` per line."""
    who = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat("speaker", F.lit(": "))).otherwise("")
    line = F.concat(F.lit("["), T.hms(F.col("start_ms")), F.lit("] "), who, F.col("text"))
    return in_parts(segments.select("meeting_id", F.col("ord").alias("n"), line.alias("line")), ["n"])


def transcript_json(segments: DataFrame) -> DataFrame:
    """Lines with their words as a JSON array per part."""
    row = F.struct("ord", "seg_id", "start_ms", "end_ms", "speaker", "text", "words")
    rows = segments.withColumn("part", chunk_of(F.col("ord") - 1, PART))
    return rows.groupBy("meeting_id", "part").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("transcript"))


def record_json(segments: DataFrame, sentences: DataFrame, decisions: DataFrame, proposals: DataFrame, tasks: DataFrame,
                fidelity: DataFrame) -> DataFrame:
    """The record as JSON arrays, one row per meeting, section and part of at most ``PART`` lines or items.

    Sections are independent of each other, so items of a meeting without lines come out, too.
    """
    def items(df: DataFrame, name: str, bucket: Column, *cols: str) -> DataFrame:
        rows = dense_order(settle(df.select("meeting_id", *cols)), ["meeting_id"], list(cols), bucket, "_n")
        rows = rows.withColumn("part", chunk_of(F.col("_n") - 1, PART))
        body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_n", *cols))), lambda x: F.struct(*[x[c].alias(c) for c in cols])))
        return rows.groupBy("meeting_id", "part").agg(body.alias("record")).select("meeting_id", F.lit(name).alias("section"), "part", "record")

    by_line = F.coalesce(chunk_of("first_ord"), F.lit(-1).cast("long"))
    score = F.struct(*[c for c in fidelity.columns if c != "meeting_id"])
    parts = [
        transcript_json(segments).select("meeting_id", F.lit("transcript").alias("section"), "part", F.col("transcript").alias("record")),
        items(sentences, "sentences", F.struct("section", chunk_of("pos")), "section", "pos", "topic", "text", "evidence_ids"),
        items(decisions, "decisions", by_line, "first_ord", "pos", "id", "decision", "agreement", "evidence_ids"),
        items(proposals, "open_proposals", by_line, "first_ord", "demoted", "pos", "proposal", "evidence_ids"),
        items(tasks, "action_items", by_line, "first_ord", "pos", "id", "task", "owner", "deadline", "quote", "evidence_ids", "flags"),
        fidelity.select("meeting_id", F.lit("fidelity").alias("section"), F.lit(0).cast("long").alias("part"), F.to_json(score).alias("record")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_replacing(df: DataFrame, path: str, by: str, fmt: str = "json") -> None:
    """Replace exactly the partitions present in ``df``; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).format(fmt).save(path)


SECTIONS = ["summary", "minutes", "decisions", "proposals", "tasks"]
HEADINGS = {"summary": "## Summary", "minutes": "## Minutes", "decisions": "## Key decisions", "proposals": "## Not agreed (open proposals)",
            "tasks": "## Action items"}
EMPTY = {"summary": C.NO_SUMMARY, "minutes": C.NO_MINUTES, "decisions": C.NO_DECISIONS, "proposals": C.NO_PROPOSALS, "tasks": C.NO_TASKS}


def _fixed(meetings: DataFrame, section: int, a: int, line: Column) -> DataFrame:
    return meetings.select("meeting_id", F.lit(section).alias("s"), F.lit(a).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit("").alias("c"), line.alias("line"))


def markdown_lines(meetings: DataFrame, sentences: DataFrame, decisions: DataFrame, proposals: DataFrame, tasks: DataFrame) -> DataFrame:
    """The record as Markdown, one row per line, ordered by ``(s, a, b, c)`` within a meeting.

    ``meetings``: meeting_id, title.  Items carry ``evidence_ids`` and an order column ``pos``.
    """
    cite = T.citation(F.col("evidence_ids"))
    blank = F.lit("").alias("c")
    cols = ["meeting_id", "s", "a", "b", "c", "line"]
    s = sentences.where(F.col("section") == "summary").select(
        "meeting_id", F.lit(1).alias("s"), F.lit(1).cast("long").alias("a"), F.col("pos").alias("b"), blank, F.concat("text", F.lit(" "), cite).alias("line"))
    pts = sentences.where(F.col("section") == "minutes").withColumn("_k", F.lower(F.trim("topic")))
    heads = pts.groupBy("meeting_id", "_k").agg(F.min("pos").alias("a"), F.min_by("topic", "pos").alias("topic"))
    topics = heads.select("meeting_id", F.lit(2).alias("s"), (F.col("a") + 1).alias("a"), F.lit(-1).cast("long").alias("b"), blank, F.concat(F.lit("### "), F.trim("topic")).alias("line"))
    points = pts.join(heads.select("meeting_id", "_k", "a"), ["meeting_id", "_k"]).select(
        "meeting_id", F.lit(2).alias("s"), (F.col("a") + 1).alias("a"), F.col("pos").alias("b"), blank, F.concat(F.lit("- "), F.col("text"), F.lit(" "), cite).alias("line"))
    d = decisions.select("meeting_id", F.lit(3).alias("s"), F.lit(1).cast("long").alias("a"), F.col("pos").alias("b"), blank, F.concat(
        F.lit("- **"), F.col("id"), F.lit("** "), F.col("decision"), F.lit(' (agreement: "'), F.col("agreement"), F.lit('") '), cite).alias("line"))
    p = proposals.select("meeting_id", F.lit(4).alias("s"), F.lit(1).cast("long").alias("a"), F.col("pos").alias("b"), blank, F.concat(
        F.lit("- "), F.col("proposal"), F.when(F.col("demoted"), " _(no clear agreement)_").otherwise(""), F.lit(" "), cite).alias("line"))
    k = tasks.select("meeting_id", F.lit(5).alias("s"), F.lit(2).cast("long").alias("a"), F.col("pos").alias("b"), blank, F.concat(
        F.lit("| "), F.col("id"), F.lit(" | "), T.table_cell(F.col("task")), F.lit(" | "), T.table_cell(F.col("owner")), F.lit(" | "),
        T.table_cell(F.col("deadline")), F.lit(" | "), F.array_join("evidence_ids", ", "), F.lit(" |")).alias("line"))
    body = s.select(*cols)
    for part in (topics, points, d, p, k):
        body = body.unionByName(part.select(*cols))
    body = settle(body)
    has = body.groupBy("meeting_id").pivot("s", [1, 2, 3, 4, 5]).agg(F.count(F.lit(1)))
    state = meetings.join(has, "meeting_id", "left")
    out = body.unionByName(_fixed(meetings, 0, 0, F.concat(F.lit("# "), F.col("title"))))
    for i, name in enumerate(SECTIONS, 1):
        out = out.unionByName(_fixed(meetings, i, 0, F.lit(HEADINGS[name])))
        out = out.unionByName(_fixed(state.where(F.col(str(i)).isNull()), i, 1, F.lit(EMPTY[name])))
    table = state.where(F.col("5").isNotNull())
    return out.unionByName(_fixed(table, 5, 1, F.lit("| # | Task | Owner | Deadline | Evidence |\n|---|---|---|---|---|")))


def fidelity_lines(fidelity: DataFrame) -> DataFrame:
    """The fidelity list of the Markdown export."""
    rows = [
        ("Numbers preserved: ", F.col("numbers_preserved")), ("Negations preserved: ", F.col("negations_preserved")),
        ("Edits accepted / rejected: ", F.concat_ws(" / ", "edits_accepted", "edits_rejected")), ("Disputed words: ", F.col("disputed_words").cast("string")),
        ("Items downgraded by verifier: ", F.col("items_downgraded").cast("string")), ("Sentences removed by verifier: ", F.col("sentences_removed").cast("string")),
        ("Transcript coverage: ", F.concat(F.col("coverage_pct").cast("string"), F.lit("%"))),
    ]
    lines = F.array(F.lit("## Fidelity"), *[F.concat(F.lit("- " + t), v) for t, v in rows])
    return fidelity.select("meeting_id", F.posexplode(lines).alias("a", "line")).select(
        "meeting_id", F.lit(6).alias("s"), F.col("a").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit("").alias("c"), "line")


def markdown_documents(lines: DataFrame) -> DataFrame:
    n = dense_order(settle(lines), ["meeting_id"], ["s", "a", "b", "c"], F.col("s").cast("long"), "n")
    return in_parts(n, ["n"])


def export_manifest(meetings: DataFrame) -> DataFrame:
    """Files of each meeting's export."""
    files = F.create_map(*[F.lit(x) for kv in C.EXPORT_FILES.items() for x in kv])
    return meetings.select("meeting_id", "title", files.alias("files"))


def overlay_edits(base: DataFrame, edited: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Hand corrections over pipeline rows; the first pipeline value stays in ``original_*``."""
    e = edited.select(*keys, *[F.col(c).alias(f"_e_{c}") for c in columns])
    j = base.join(e, keys, "left")
    return j.select(
        *keys, *[F.coalesce(f"_e_{c}", c).alias(c) for c in columns],
        *[F.when(F.col(f"_e_{c}").isNotNull(), F.coalesce(f"original_{c}" if f"original_{c}" in base.columns else F.lit(None), c)).alias(f"original_{c}") for c in columns])
