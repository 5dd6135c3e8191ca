"""Candidate lines, prompts and merging of per-part model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..functions import text as T
from ..functions.fuzzy import token_set_col
from .ordered import chunk_of, dense_order, settle, with_neighbours

KEYS = ["meeting_id"]


def timeline_pins(items: DataFrame, segments: DataFrame) -> DataFrame:
    """Items by the time of their first cited line, with the pins before and after."""
    cited = items.select("meeting_id", "kind", "pos", F.explode("evidence_ids").alias("seg_id"))
    pins = cited.join(segments.select("meeting_id", "seg_id", "start_ms"), ["meeting_id", "seg_id"]).groupBy(
        "meeting_id", "kind", "pos").agg(F.min("start_ms").alias("time_ms"))
    order = ["time_ms", "kind", "pos"]
    n = dense_order(pins, KEYS, order, chunk_of("time_ms", 1_800_000), "_n")
    return with_neighbours(
        n, KEYS, "_n", 1, 1, lambda w: {"prev_pos": F.lag("pos").over(w), "next_pos": F.lead("pos").over(w)}
    ).drop("_n")


def find_candidates(lines: DataFrame) -> DataFrame:
    """Lines that look like tasks, decisions or proposals; ``lines`` carry the next line as ``nxt``."""
    text = F.col("text")
    task, decision, proposal = T.cue(text, C.TASK_CUE), T.cue(text, C.DECISION_CUE), T.cue(text, C.PROPOSAL_CUE)
    base = F.array_compact(F.array(F.when(task, "task"), F.when(decision, "decision"), F.when(proposal, "proposal")))
    reply = F.col("nxt").isNotNull() & T.agreeing_reply(F.col("speaker"), F.col("nxt.speaker"), F.col("nxt.text"))
    agreed = reply & ((F.size("_k") > 0) | F.contains(text, F.lit("?")))
    promoted = F.array_distinct(F.concat(
        F.filter("_k", lambda k: k != "proposal"),
        F.array(F.when(F.array_contains("_k", "task"), "task").otherwise("decision"))))
    rows = lines.withColumn("_k", base).withColumn("_a", F.coalesce(agreed, F.lit(False)))
    return rows.select(
        "meeting_id", "ord", "seg_id", "text",
        F.when(F.col("_a"), F.array("seg_id", "nxt.seg_id")).otherwise(F.array("seg_id")).alias("ids"),
        F.when(F.col("_a"), promoted).otherwise(F.col("_k")).alias("kinds"),
    ).where(F.size("kinds") > 0)


def checklist(candidates: DataFrame, groups: list[str]) -> DataFrame:
    """The checklist block per group of lines (a chunk under a token budget)."""
    line = F.concat(F.lit("- ["), F.array_join("ids", ", "), F.lit("] looks like: "), F.array_join("kinds", " / "))
    rows = candidates.select(*groups, F.struct("ord", line.alias("line")).alias("x"))
    listed = rows.groupBy(*groups).agg(F.array_sort(F.collect_list("x")).alias("_x"))
    return listed.select(*groups, F.concat(
        F.lit(C.CHECKLIST_HEAD), F.array_join(F.transform("_x", lambda r: r["line"]), "\n")).alias("checklist"))


def merge_vocabulary(terms: DataFrame, glossary: DataFrame | None = None, cap: int = C.VOCABULARY_CAP) -> DataFrame:
    """One row per term and meeting: case-insensitive, sorted unions, first spelling, capped in first-seen order."""
    key = F.lower(F.trim("term"))
    rows = terms.withColumn("key", key).where(F.col("key") != "")
    merged = rows.groupBy("meeting_id", "key").agg(
        F.min_by("term", "pos").alias("term"), F.min("pos").alias("first_pos"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("heard_as")))).alias("heard_as"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence_ids")))).alias("evidence_ids"),
    )
    merged = merged.withColumn("_late", F.lit(0))
    extra = F.lit(0)
    if glossary is not None:
        g = glossary.select("meeting_id", F.posexplode("terms").alias("i", "term")).withColumn("term", F.trim("term")).where(
            F.col("term") != "").withColumn("key", F.lower("term"))
        new = g.groupBy("meeting_id", "key").agg(F.max_by("term", F.col("i")).alias("_t"), F.min_by("term", F.col("i")).alias("term"), F.min("i").alias("i"))
        new = new.join(merged.select("meeting_id", "key"), ["meeting_id", "key"], "left_anti").select(
            "meeting_id", "key", "term", F.col("i").cast("long").alias("first_pos"), F.array().cast("array<string>").alias("heard_as"),
            F.array().cast("array<string>").alias("evidence_ids"), F.lit(1).alias("_late"))
        merged = merged.unionByName(new).join(
            glossary.select("meeting_id", F.size("terms").alias("_g")), "meeting_id", "left")
        extra = F.coalesce("_g", F.lit(0))
    n = dense_order(merged, KEYS, ["_late", "first_pos", "key"], F.col("_late") * 1_000_000_000 + chunk_of("first_pos"), "rank")
    return n.where(F.col("rank") <= cap + extra).select("meeting_id", "rank", "term", "heard_as", "evidence_ids")


def first_domain(terms: DataFrame) -> DataFrame:
    """First non-empty domain over the parts of a meeting."""
    return terms.groupBy("meeting_id").agg(
        F.coalesce(F.min_by("domain", F.when(F.col("domain") != "", F.col("pos"))), F.lit("unknown")).alias("domain"))


def merge_topics(points: DataFrame) -> DataFrame:
    """Points grouped by topic name; a text that an earlier part already has is not repeated."""
    key = F.lower(F.trim("topic"))
    rows = points.withColumn("key", key)
    topics = rows.groupBy("meeting_id", "key").agg(F.min_by("topic", "pos").alias("topic"), F.min("pos").alias("topic_pos"))
    texts = rows.groupBy("meeting_id", "key", "text").agg(
        F.min("pos").alias("pos"), F.min_by("evidence_ids", "pos").alias("evidence_ids"))
    return texts.join(topics, ["meeting_id", "key"]).select("meeting_id", "topic_pos", "topic", "pos", "text", "evidence_ids")


def last_by(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Last writer wins."""
    return rows.groupBy(*keys).agg(F.max_by(value, "pos").alias(value))


def text_classes(items: DataFrame, keys: list[str]) -> DataFrame:
    """The different word sets of the texts, ``class`` (the sorted words), each with one text."""
    return items.groupBy(*keys, "class").agg(F.min("text").alias("text")).where(F.col("class") != "")


def _groups_of_three(words: Column) -> Column:
    """Letter groups of the words with a mark on both sides, copies numbered."""
    marked = F.transform(words, lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    groups = F.array_sort(F.flatten(F.transform(marked, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))
    return F.transform(groups, lambda g, i: F.struct(g.alias("g"), (i - F.array_position(groups, g).cast("int")).alias("k")))


def similar_classes(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs ``class, other`` of word sets with a ratio of at least ``DEDUPE_RATIO``, in both directions and with themselves.

    Of two such texts one has all but ``0.5 n`` of its letter groups in the other, ``n`` its length: a letter left out breaks three
    groups, one put in two, and at a ratio of 90 there are few of them; where all or most words of one are shared even more stay.
    So one of its rarest groups, so many that not all can be missing, is among all groups of the other. Pairs that meet there are
    compared once each.
    """
    words = F.split("class", " ")
    n = F.length("class")
    rows = settle(classes.select(*keys, "class", "text", n.alias("n"), F.explode(_groups_of_three(words)).alias("x")).select(*keys, "class", "text", "n", "x.g", "x.k"))
    common = rows.groupBy("g", "k").agg(F.count(F.lit(1)).alias("often"))
    w = Window.partitionBy(*keys, "class")
    ranked = rows.join(common, ["g", "k"]).withColumn("r", F.row_number().over(w.orderBy("often", "g", "k"))).withColumn("all", F.count(F.lit(1)).over(w))
    need = F.greatest(F.lit(1), F.ceil(F.col("all") - F.col("n") * (5 * (1 - C.DEDUPE_RATIO / 100)) - 1e-9))
    asked = ranked.where(F.col("r") <= F.col("all") - need + 1).select(*keys, "g", "k", "class", "text")
    held = rows.select(*keys, "g", "k", F.col("class").alias("other"), F.col("text").alias("other_text"))
    met = asked.join(held, [*keys, "g", "k"]).where(F.col("class") != F.col("other"))
    first = F.col("class") < F.col("other")
    pairs = met.select(*keys, *[F.when(first, F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in (
        ("class", "class", "other"), ("other", "other", "class"), ("text", "text", "other_text"), ("other_text", "other_text", "text"))]).distinct()
    near = settle(pairs.withColumn("ratio", token_set_col(F.col("text"), F.col("other_text"))).where(F.col("ratio") >= C.DEDUPE_RATIO).select(*keys, "class", "other"))
    own = classes.select(*keys, "class", F.col("class").alias("other"))
    return near.unionByName(near.select(*keys, F.col("other").alias("class"), F.col("class").alias("other"))).unionByName(own)


def dedupe_items(items: DataFrame, text: str, keys: list[str] | None = None) -> DataFrame:
    """Near-duplicate items that share evidence become one: walking by ``pos``, an item joins the first kept one with a similar text
    that has one of its lines, own or taken over, and hands its lines over; else it is kept.

    Decided in rounds of joins over all meetings. What an item does depends only on earlier items that cite one of its lines and
    whose text is similar to its own, or to one similar to its own; once these are decided, it is decided. Gives ``pos, text,
    evidence_ids, merged_into``; joined items have no lines left. No evidence or no words: kept.
    """
    keys = keys or KEYS
    lines = F.coalesce("evidence_ids", F.array().cast("array<string>"))
    words = F.array_sort(F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")))
    rows = settle(items.select(*keys, "pos", F.col(text).alias("text"), lines.alias("evidence_ids"), F.coalesce(F.array_join(words, " "), F.lit("")).alias("class")))
    near = settle(similar_classes(text_classes(rows, keys), keys).distinct())
    beyond = near.select(*keys, "class", F.col("other").alias("_o")).join(near.select(*keys, F.col("class").alias("_o"), "other"), [*keys, "_o"]).select(
        *keys, "class", "other").distinct()
    flat = settle(rows.select(*keys, "pos", "class", F.posexplode("evidence_ids").alias("at", "seg_id")))
    alone = rows.select(*keys, "pos").join(flat.select(*keys, "pos").distinct(), [*keys, "pos"], "left_anti")
    decided = alone.withColumn("merged_into", F.lit(None).cast("long"))
    owned, left = None, flat
    while not left.isEmpty():
        # items behind no undecided one
        ahead = left.groupBy(*keys, F.col("class").alias("other"), "seg_id").agg(F.min("pos").alias("_first"))
        waits = left.join(beyond, [*keys, "class"]).join(ahead, [*keys, "other", "seg_id"]).where(F.col("_first") < F.col("pos")).select(*keys, "pos").distinct()
        ready = left.join(waits, [*keys, "pos"], "left_anti")
        each = ready.groupBy(*keys, "pos").agg(F.first("class").alias("class"))
        if owned is None:
            now = settle(each.withColumn("merged_into", F.lit(None).cast("long")))
        else:
            found = ready.join(near, [*keys, "class"]).join(owned, [*keys, "other", "seg_id"]).where(
                (F.col("_keeper") < F.col("pos")) & (F.col("_since") < F.col("pos"))).groupBy(*keys, "pos").agg(F.min("_keeper").alias("merged_into"))
            now = settle(each.join(found, [*keys, "pos"], "left"))
        decided = decided.unionByName(now.select(*keys, "pos", "merged_into"))
        # the keeper's class is that of the item it was, so it comes with the first line it owns
        news = flat.join(now.withColumnRenamed("class", "_c"), [*keys, "pos"]).select(
            *keys, F.coalesce("merged_into", "pos").alias("_keeper"), F.when(F.col("merged_into").isNull(), F.col("class")).alias("_class"), "seg_id", F.col("pos").alias("_since"))
        every = news if owned is None else owned.withColumnRenamed("other", "_class").unionByName(news)
        named = every.where(F.col("_class").isNotNull()).groupBy(*keys, "_keeper").agg(F.min("_class").alias("other"))
        owned = settle(every.groupBy(*keys, "_keeper", "seg_id").agg(F.min("_since").alias("_since")).join(named, [*keys, "_keeper"]))
        left = left.join(now.select(*keys, "pos"), [*keys, "pos"], "left_anti")
    taken = flat.join(decided.where(F.col("merged_into").isNotNull()), [*keys, "pos"]).groupBy(*keys, "merged_into", "seg_id").agg(F.min(F.struct("pos", "at")).alias("_w"))
    more = taken.groupBy(*keys, "merged_into").agg(F.array_sort(F.collect_list(F.struct("_w", "seg_id"))).alias("_m")).select(
        *keys, F.col("merged_into").alias("pos"), F.col("_m.seg_id").alias("_more"))
    out = rows.join(decided, [*keys, "pos"]).join(more, [*keys, "pos"], "left")
    extra = F.coalesce(F.array_except("_more", "evidence_ids"), F.array().cast("array<string>"))
    kept = F.when(F.col("merged_into").isNull(), F.concat("evidence_ids", extra)).otherwise(F.array().cast("array<string>"))
    return out.select(*keys, "pos", "text", kept.alias("evidence_ids"), "merged_into")


def pick_summary(sentences: DataFrame, picks: DataFrame | None = None, cap: int = C.SUMMARY_CAP) -> DataFrame:
    """At most five summary sentences per meeting: the picked ones that exist, else the first five."""
    numbered = dense_order(sentences, KEYS, ["pos"], chunk_of("pos"), "_i").withColumn("_i", F.col("_i") - 1)
    if picks is None:
        return numbered.where(F.col("_i") < cap).drop("_i")
    want = picks.select("meeting_id", F.posexplode(F.array_distinct("keep")).alias("_rank", "_i"))
    sizes = sentences.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    usable = want.join(sizes, KEYS).where((F.col("_n") > cap) & (F.col("_i") >= 0) & (F.col("_i") < F.col("_n")))
    chosen = numbered.join(usable.drop("_n"), ["meeting_id", "_i"])
    rest = numbered.join(usable.select("meeting_id").distinct(), KEYS, "left_anti").where(F.col("_i") < cap)
    return chosen.select(*sentences.columns).unionByName(rest.select(*sentences.columns))


def cross_populate(sentences: DataFrame, cap: int = C.SUMMARY_CAP) -> DataFrame:
    """A meeting without minutes gets them from its summary, one without summary from its first points."""
    has = sentences.groupBy("meeting_id").agg(
        F.max(F.col("section") == "summary").alias("_s"), F.max(F.col("section") == "minutes").alias("_m"))
    rows = sentences.join(has, KEYS).where(F.size("evidence_ids") > 0)
    minutes = rows.where(~F.col("_m") & F.col("_s")).withColumn("section", F.lit("minutes")).withColumn("topic", F.lit("General Discussion"))
    summary = pick_summary(rows.where(~F.col("_s") & F.col("_m")).drop("_s", "_m"), None, cap).withColumn(
        "section", F.lit("summary")).withColumn("topic", F.lit(""))
    return sentences.unionByName(minutes.select(*sentences.columns)).unionByName(summary.select(*sentences.columns))


def prompt_batches(segments: DataFrame, max_tokens: int = C.DOCUMENT_TOKENS) -> DataFrame:
    """One prompt text per chunk of a meeting: its lines (with overlap) and their checklist."""
    from .verify import line_context
    from .windows import token_chunks

    chunks = settle(token_chunks(segments, max_tokens))
    found = find_candidates(line_context(segments)).select("meeting_id", "seg_id", "ids", "kinds")
    lists = checklist(chunks.join(found, ["meeting_id", "seg_id"]), ["meeting_id", "chunk_no"])
    # A chunk holds at most max_tokens, so its text is bounded.
    text = chunks.groupBy("meeting_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("_x"))
    return text.join(lists, ["meeting_id", "chunk_no"], "left").select(
        "meeting_id", "chunk_no", F.size("_x").alias("n_lines"),
        F.concat(F.lit("TRANSCRIPT\n"), F.array_join(F.transform("_x", lambda r: r["line"]), "\n"), F.coalesce("checklist", F.lit(""))).alias("prompt"))


def refine_prompts(segments: DataFrame, size: int = C.REFINE_WINDOW, context: int = C.REFINE_CONTEXT) -> DataFrame:
    """Context and marked target lines per refine window."""
    from .windows import refine_windows

    w = refine_windows(segments, size, context)
    plain = T.prompt_line(F.col("seg_id"), F.col("text"))
    marked = F.to_json(F.struct(F.col("seg_id").alias("id"), T.marked_text(F.col("words"), F.col("text")).alias("text")))
    row = F.struct("ord", "part", plain.alias("plain"), marked.alias("marked"))
    per = w.groupBy("meeting_id", "win").agg(F.array_sort(F.collect_list(row)).alias("_x"))
    ctx = F.array_join(F.transform(F.filter("_x", lambda r: r["part"] != "target"), lambda r: r["plain"]), "\n")
    target = F.array_join(F.transform(F.filter("_x", lambda r: r["part"] == "target"), lambda r: r["marked"]), ", ")
    return per.select("meeting_id", "win", F.concat(
        F.lit("CONTEXT (read-only)\n"), F.when(ctx == "", "(none)").otherwise(ctx), F.lit("\n\nTARGET\n["), target, F.lit("]")).alias("prompt"))
