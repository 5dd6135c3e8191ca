"""Checks of proposed sentences, decisions and tasks against the transcript."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions import text as T
from ..functions.fuzzy import partial_ratio
from .guard import disputed_under, words_in_doubt
from .ordered import chunk_of, dense_order, settle, with_neighbours

KEYS = ["meeting_id"]
LINE = "struct<ord:bigint,seg_id:string,speaker:string,text:string>"


def line_context(segments: DataFrame) -> DataFrame:
    """Lines with the next line attached as ``nxt``; returned as they are if they have it."""
    if "nxt" in segments.columns:
        return segments
    slim = segments.select("meeting_id", "ord", "seg_id", "speaker", "text")
    line = F.struct("ord", "seg_id", "speaker", "text")
    return with_neighbours(slim, KEYS, "ord", 0, 1, lambda w: {"nxt": F.lead(line).over(w)})


def known_evidence(items: DataFrame, segments: DataFrame) -> DataFrame:
    """Items with ``cited``: their existing lines, each once, in the order given (empty when none exists).

    ``pos`` is unique among the items of a meeting.
    """
    has_next = "nxt" in segments.columns
    ids = ["meeting_id", "pos"]
    flat = items.select(*ids, F.posexplode(F.array_distinct("evidence_ids")).alias("i", "seg_id"))
    line = F.struct("i", "ord", "seg_id", "speaker", "text", *(["nxt"] if has_next else []))
    cols = ["meeting_id", "seg_id", "ord", "speaker", "text", *(["nxt"] if has_next else [])]
    hits = flat.join(segments.select(*cols), ["meeting_id", "seg_id"])
    cited = hits.groupBy(*ids).agg(F.array_sort(F.collect_list(line)).alias("cited"))
    joined = items.join(cited, ids, "left")
    return joined.withColumn("cited", F.when(F.col("cited").isNull(), F.array().cast(cited.schema["cited"].dataType)).otherwise(F.col("cited")))


def ids_of(cited: Column) -> Column:
    return F.transform(cited, lambda c: c["seg_id"])


def plain_lines(cited: Column) -> Column:
    return F.transform(cited, lambda c: F.struct(c["ord"].alias("ord"), c["seg_id"].alias("seg_id"), c["speaker"].alias("speaker"), c["text"].alias("text")))


def may_match(quote: Column, text: Column, threshold: float) -> Column:
    """False only if no window of the longer text comes near the shorter one; a test by groups of three letters.

    With ``e = 1 - threshold / 100`` a window of ``w <= m`` letters is at most ``e (m + w)`` letters put in or left out away from
    the ``m`` letters of the shorter text. A letter left out breaks three of its groups, one put in two of them. So all but
    ``loss m`` of its ``m - 2`` groups stand in the longer text, wherever they stand.
    """
    e = 1 - threshold / 100
    loss = 5 * e + e * max(0.0, 1 - 5 * e) / (1 + e)

    def kept(short: Column, long: Column) -> Column:
        m = F.length(short)
        places = F.when(m > 2, F.sequence(F.lit(1), m - 2)).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(places, lambda i: F.contains(long, F.substring(short, i, F.lit(3))))) >= m - 2 - loss * m - 1e-9

    gap = F.length(quote) - F.length(text)
    return F.when(gap < 0, kept(quote, text)).when(gap > 0, kept(text, quote)).otherwise(kept(quote, text) | kept(text, quote))


def likely_texts(quote: Column, texts: Column, threshold: float) -> Column:
    """Of the lines, and of all of them joined, those that the quote may stand in."""
    every = F.concat(texts, F.array(F.array_join(texts, " ")))
    return F.filter(every, lambda t: F.coalesce(may_match(quote, t, threshold), F.lit(False)))


def _score(quote: Column, texts: Column, threshold: float) -> Column:
    """Whether the quote comes near one of the texts; each pair of a batch is compared once."""
    @F.pandas_udf("boolean")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], bool] = {}

        def near(a: str, x: str) -> bool:
            if (a, x) not in known:
                known[a, x] = partial_ratio(a, x, threshold) >= threshold
            return known[a, x]

        return pd.Series([None if a is None or lines is None else any(near(a, x) for x in lines) for a, lines in zip(q, t)], dtype="object")

    return run(quote, texts)


def quote_matches(items: DataFrame, quote: Column, name: str, threshold: float = C.QUOTE_MATCH) -> DataFrame:
    """Adds ``name``: the quote fuzzily occurs in a cited line or in all of them joined.

    Verbatim quotes and items without lines are settled in the JVM; of the rest, only lines that :func:`may_match` lets through
    go to Python.
    """
    q = F.lower(F.trim(quote))
    texts = F.transform("cited", lambda c: F.lower(c["text"]))
    verbatim = F.coalesce((q != "") & F.contains(F.array_join(texts, " "), q), F.lit(False))
    open_ = (F.coalesce(q, F.lit("")) != "") & ~verbatim & (F.size("cited") > 0)
    likely = F.when(open_, likely_texts(q, texts, threshold))
    items = items.withColumn("_likely", F.when(F.size(likely) > 0, likely))
    scored = _score(F.when(F.col("_likely").isNotNull(), q), F.col("_likely"), threshold)
    return items.withColumn(name, verbatim | F.coalesce(scored, F.lit(False))).drop("_likely")


def unsupported(sentence: Column, cited_text: Column) -> Column:
    """Numbers and likely names of a sentence that the cited text does not hold."""
    have = T.numbers(cited_text)
    nums = F.filter(T.numbers(sentence), lambda n: ~F.array_contains(have, n))
    names = F.filter(T.capitalized_non_initial(sentence), lambda t: ~T.contains_word(cited_text, t))
    return F.concat(nums, names)


def cited_text(cited: Column) -> Column:
    return F.array_join(F.transform(cited, lambda c: F.concat(F.coalesce(c["speaker"], F.lit("")), F.lit(" "), c["text"])), " ")


def verify_sentences(sentences: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, removed)``; a missing fact may be borrowed from the line next to a cited one."""
    found = known_evidence(sentences.withColumnRenamed("text", "sentence"), segments)
    found = found.withColumn("cited", plain_lines(F.col("cited"))).withColumn(
        "_missing", unsupported(F.col("sentence"), cited_text(F.col("cited"))))
    found = settle(found)
    ids = ["meeting_id", "pos"]
    needy = found.where((F.size("cited") > 0) & (F.size("_missing") > 0))
    offsets = F.array(*[F.lit(k) for k in range(-C.NEIGHBOUR_LINES, C.NEIGHBOUR_LINES + 1)])
    around = F.array_except(
        F.flatten(F.transform("cited", lambda c: F.transform(offsets, lambda k: c["ord"] + k))),
        F.transform("cited", lambda c: c["ord"]),
    )
    near = needy.select(*ids, F.explode(F.array_distinct(around)).alias("ord")).join(
        segments.select("meeting_id", "ord", "seg_id", "speaker", "text"), ["meeting_id", "ord"]
    ).groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("ord", "seg_id", "speaker", "text"))).alias("_near"))
    both = found.join(near, ids, "left")
    borrowed = F.filter(
        F.transform("_missing", lambda m: F.try_element_at(F.filter("_near", lambda n: T.contains_word(n["text"], m)), F.lit(1))),
        lambda x: x.isNotNull(),
    )
    more = F.array_sort(F.array_distinct(F.concat("cited", F.coalesce(borrowed, F.array().cast(f"array<{LINE}>")))))
    both = both.withColumn("cited", F.when(F.size("_missing") > 0, more).otherwise(F.col("cited"))).withColumn(
        "_missing", F.when(F.size("_missing") > 0, unsupported(F.col("sentence"), cited_text(F.col("cited")))).otherwise(F.col("_missing")))
    out = settle(both.select(
        "meeting_id", "pos", "section", "topic", F.col("sentence").alias("text"), ids_of(F.col("cited")).alias("evidence_ids"),
        ((F.size("cited") > 0) & (F.size("_missing") == 0)).alias("_ok"),
    ))
    return out.where("_ok").drop("_ok"), out.where(~F.col("_ok")).drop("_ok")


def _settled_context(segments: DataFrame) -> DataFrame:
    return segments if "nxt" in segments.columns else settle(line_context(segments))


def _last(cited: Column) -> Column:
    """The cited line that comes last in the transcript."""
    return F.array_max(F.transform(cited, lambda c: F.struct(c["ord"].alias("ord"), c["seg_id"].alias("seg_id"), c["speaker"].alias("speaker"),
                                                             c["text"].alias("text"), c["nxt"].alias("nxt"))))


def _with_line(cited: Column, line: Column) -> Column:
    """Cited lines plus one more, in transcript order."""
    one = F.array(F.struct(line["ord"].alias("ord"), line["seg_id"].alias("seg_id"), line["speaker"].alias("speaker"), line["text"].alias("text")))
    return F.array_sort(F.array_distinct(F.concat(plain_lines(cited), one)))


def verify_decisions(decisions: DataFrame, proposals: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(decisions, open proposals, dropped)``: a decision needs a stated agreement, else it is a proposal.

    ``segments`` with ``nxt`` are taken as settled.
    """
    ctx = _settled_context(segments)
    d = quote_matches(known_evidence(decisions, ctx), F.col("agreement"), "_match")
    stated = T.cue(F.col("agreement"), C.AGREEMENT_CUE) & F.col("_match")
    line = F.try_element_at(F.filter("cited", lambda c: T.cue(c["text"], C.AGREEMENT_CUE) & ~T.cue(c["text"], C.PROPOSAL_CUE)), F.lit(1))
    last = _last(F.col("cited"))
    d = settle(d.withColumn("_stated", stated).withColumn("_line", line["text"]).withColumn("_last", last))
    nxt = F.col("_last.nxt")
    replies = F.coalesce(
        nxt.isNotNull() & T.agreeing_reply(F.col("_last.speaker"), nxt["speaker"], nxt["text"]), F.lit(False))
    by_line = ~F.col("_stated") & F.col("_line").isNotNull()
    by_reply = ~F.col("_stated") & F.col("_line").isNull() & replies
    cited = (
        F.when(by_reply, _with_line(F.col("cited"), nxt))
        .when(by_line, F.array_sort(plain_lines(F.col("cited"))))
        .otherwise(plain_lines(F.col("cited")))
    )
    judged = settle(d.select(
        "meeting_id", "pos", "decision",
        F.when(by_line, F.col("_line")).when(by_reply, nxt["text"]).otherwise(F.col("agreement")).alias("agreement"),
        cited.alias("cited"),
        F.when(F.size("cited") == 0, "dropped").when(F.col("_stated") | by_line | by_reply, "decision").otherwise("demoted").alias("outcome"),
    ))
    numbered = renumber(judged.where("outcome = 'decision'"), "D").select(
        "meeting_id", "id", "decision", "agreement", ids_of(F.col("cited")).alias("evidence_ids"), "first_ord", "pos")
    opened = known_evidence(proposals, ctx.drop("nxt"))
    alive = opened.where(F.size("cited") > 0).select(
        "meeting_id", "pos", "proposal", plain_lines(F.col("cited")).alias("cited"), F.lit(False).alias("demoted"))
    demoted = judged.where("outcome = 'demoted'").select(
        "meeting_id", "pos", F.col("decision").alias("proposal"), "cited", F.lit(True).alias("demoted"))
    both = alive.unionByName(demoted).withColumn("first_ord", F.array_min(F.transform("cited", lambda c: c["ord"])))
    dropped = judged.where("outcome = 'dropped'").select("meeting_id", "pos", F.lit("decision").alias("kind")).unionByName(
        opened.where(F.size("cited") == 0).select("meeting_id", "pos", F.lit("proposal").alias("kind")))
    return numbered, both.select("meeting_id", "pos", "proposal", ids_of(F.col("cited")).alias("evidence_ids"), "demoted", "first_ord"), dropped


def renumber(items: DataFrame, letter: str) -> DataFrame:
    """``D1``, ``D2``, ... by first cited line, ties in the order proposed."""
    first = items.withColumn("first_ord", F.array_min(F.transform("cited", lambda c: c["ord"])))
    numbered = dense_order(first, KEYS, ["first_ord", "pos"], chunk_of("first_ord"), "_n")
    return numbered.withColumn("id", F.concat(F.lit(letter), F.col("_n").cast("string"))).drop("_n")


def pointed_ids(tasks: DataFrame) -> DataFrame:
    """Every line id that the pointers of tasks name."""
    ids = F.explode(F.array("owner_seg", "deadline_seg"))
    return tasks.select("meeting_id", ids.alias("seg_id")).where(F.col("seg_id").isNotNull()).distinct()


def pointer_lines(items: DataFrame, segments: DataFrame, seg_col: str, name: str) -> DataFrame:
    """Attach the line a pointer names, with its words."""
    line = segments.select("meeting_id", F.col("seg_id").alias(seg_col), F.struct("ord", "speaker", "text", "words").alias(name))
    return items.join(line, ["meeting_id", seg_col], "left")


def resolve_pointer(line: Column, seg: Column, words: Column, cited: Column, kind: str, diarized: bool) -> tuple[Column, Column]:
    """``(text copied from the transcript or Unspecified, flag)`` for one pointer."""
    text = line["text"]
    at = F.call_function("locate", F.lower(words), F.lower(text))
    invalid = text.isNull() | (F.trim(F.coalesce(words, F.lit(""))) == "") | F.coalesce(at < 1, F.lit(True))
    inside = F.exists(cited, lambda c: c["seg_id"] == seg)
    if kind == "deadline":
        near = F.exists(cited, lambda c: F.abs(c["ord"] - line["ord"]) <= C.DEADLINE_ADJACENCY)
        elsewhere = F.when(~near, "pointer_invalid")
    elif not diarized:
        elsewhere = F.lit("self_assignment_unverified")
    else:
        intro = F.regexp_like(text, F.concat(F.lit("(?iU)" + C.INTRO), T.escape(words)))
        same = F.exists(cited, lambda c: F.coalesce((c["speaker"] != "") & (c["speaker"] == line["speaker"]), F.lit(False)))
        elsewhere = F.when(~(intro & same), "self_assignment_unverified")
    flag = (
        F.when(seg.isNull(), F.lit(None).cast("string"))
        .when(invalid, "pointer_invalid")
        .when(disputed_under(text, line["words"], words), "audio_unclear")
        .when(~inside, elsewhere)
    )
    value = F.when(seg.isNotNull() & flag.isNull(), F.substring(text, at, F.length(words))).otherwise(C.UNSPECIFIED)
    return value, flag


def spoken_owner(cited: Column) -> Column:
    """``struct<owner, extra>``: the named speaker who took the task on, with their reply line if it counts."""
    none = F.lit(None).cast(LINE)
    own = F.filter(cited, lambda c: T.cue(c["text"], C.FIRST_PERSON_COMMIT) & ~T.cue(c["text"], C.REQUEST) & T.named(c["speaker"]))
    asked = F.filter(cited, lambda c: F.coalesce(
        T.cue(c["text"], C.REQUEST) & c["nxt"].isNotNull() & T.named(c["nxt"]["speaker"])
        & ~c["nxt"]["speaker"].eqNullSafe(c["speaker"])
        & (T.agreeing_reply(c["speaker"], c["nxt"]["speaker"], c["nxt"]["text"]) | T.cue(c["nxt"]["text"], C.FIRST_PERSON_COMMIT)),
        F.lit(False)))
    reply = F.try_element_at(asked, F.lit(1))["nxt"]
    return (
        F.when(F.size(own) > 0, F.struct(F.element_at(own, 1)["speaker"].alias("owner"), none.alias("extra")))
        .when(F.size(asked) > 0, F.struct(reply["speaker"].alias("owner"), reply.cast(LINE).alias("extra")))
    )


def verify_tasks(
    tasks: DataFrame, segments: DataFrame, diarized: bool = True, words: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(tasks, dropped)``: owner and deadline come only from pointers into the transcript or from who spoke.

    ``words`` holds the words of the lines by ``meeting_id, seg_id`` if ``segments`` doesn't.
    """
    ctx = _settled_context(segments)
    if words is not None:
        ids = ["meeting_id", "seg_id"]
        pointed = segments.join(pointed_ids(tasks), ids, "left_semi").select(*ids, "ord", "speaker", "text")
        segments = settle(pointed.join(words.select(*ids, words_in_doubt(F.col("words")).alias("words")), ids))
    t = quote_matches(known_evidence(tasks, ctx), F.col("quote"), "_match")
    line = F.try_element_at(F.filter("cited", lambda c: T.cue(c["text"], C.TASK_CUE)), F.lit(1))["text"]
    t = t.withColumn("_line", line).withColumn("quote", F.when(~F.col("_match") & F.col("_line").isNotNull(), F.col("_line")).otherwise(F.col("quote")))
    t = t.withColumn("_ok", (F.size("cited") > 0) & (F.col("_match") | F.col("_line").isNotNull()))
    t = settle(t)
    dropped = t.where(~F.col("_ok")).select("meeting_id", "pos", F.lit("task").alias("kind"))
    kept = pointer_lines(pointer_lines(t.where("_ok"), segments, "owner_seg", "_ol"), segments, "deadline_seg", "_dl")
    owner, why = resolve_pointer(F.col("_ol"), F.col("owner_seg"), F.col("owner_words"), F.col("cited"), "owner", diarized)
    kept = kept.withColumn("_owner", owner).withColumn("_why", why)
    kept = kept.withColumn("_spoken", F.when((F.col("_owner") == C.UNSPECIFIED) & F.lit(diarized), spoken_owner(F.col("cited"))))
    kept = settle(kept)
    found = F.col("_spoken").isNotNull()
    extra = F.col("_spoken.extra")
    cited = F.when(found & extra.isNotNull(), _with_line(F.col("cited"), extra)).when(
        found, F.array_sort(plain_lines(F.col("cited")))).otherwise(plain_lines(F.col("cited")))
    down = (F.col("_owner") == C.UNSPECIFIED) & F.col("owner_seg").isNotNull()
    keep_why = F.when(found & (F.col("_why") != "audio_unclear"), F.lit(None).cast("string")).otherwise(F.col("_why"))
    owner_flags = F.array_compact(F.array(F.when(down & ~found, "owner_downgraded"), F.when(down, keep_why), F.when(found, "owner_from_speaker")))
    kept = kept.withColumn("cited", cited).withColumn("_of", owner_flags).withColumn("owner", F.when(found, F.col("_spoken.owner")).otherwise(F.col("_owner")))
    deadline, late = resolve_pointer(F.col("_dl"), F.col("deadline_seg"), F.col("deadline_words"), F.col("cited"), "deadline", diarized)
    kept = kept.withColumn("deadline", deadline).withColumn("_late", late)
    missed = (F.col("deadline") == C.UNSPECIFIED) & F.col("deadline_seg").isNotNull()
    flags = F.array_distinct(F.concat("_of", F.array_compact(F.array(F.when(missed, "deadline_downgraded"), F.when(missed, F.col("_late"))))))
    done = renumber(settle(kept.select("meeting_id", "pos", "task", "owner", "deadline", "quote", "cited", flags.alias("flags"))), "T")
    return done.select("meeting_id", "id", "task", "owner", "deadline", "quote", ids_of(F.col("cited")).alias("evidence_ids"), "flags", "first_ord", "pos"), dropped
