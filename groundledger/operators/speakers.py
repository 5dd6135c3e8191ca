"""Speaker labels and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..functions import text as T
from .matching import greedy_matching
from .ordered import settle, with_neighbours

KEYS = ["meeting_id"]
_LEXICON: list[str] | None = None


def relabel_by_appearance(turns: DataFrame, label: str) -> DataFrame:
    """``Speaker n`` per raw label, in order of first appearance."""
    first = turns.groupBy("meeting_id", label).agg(F.min("start_ms").alias("_first"))
    w = Window.partitionBy("meeting_id").orderBy("_first", label)
    return first.select(
        "meeting_id", label, F.concat(F.lit("Speaker "), F.dense_rank().over(w).cast("string")).alias("speaker")
    )


def known_terms() -> list[str]:
    """Lower-cased entries of the packaged word lists (places and technical terms)."""
    global _LEXICON
    if _LEXICON is None:
        from importlib.resources import files

        lines: list[str] = []
        for name in ("places.txt", "tech_terms.txt"):
            lines += (files("groundledger") / "lexicons" / name).read_text(encoding="utf-8").splitlines()
        _LEXICON = sorted({ln.strip().lower() for ln in lines if ln.strip() and not ln.startswith("#")})
    return _LEXICON


def _in(word: Column, values: list[str]) -> Column:
    return F.lower(word).isin(*values)


def clean_name(name: Column) -> Column:
    """Title-cased name without common words; NULL for common words, places and technical terms."""
    stop = sorted(C.NOT_NAMES)
    kept = F.filter(F.split(F.trim(name), r"(?U)\s+"), lambda w: (w != "") & ~_in(w, stop))
    full = F.array_join(F.transform(kept, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")
    fixed = F.create_map(*[F.lit(x) for kv in C.NAME_SPELLINGS.items() for x in kv])
    terms = known_terms()
    return (
        F.when(F.size(kept) == 0, F.lit(None).cast("string"))
        .when(F.lower(full).isin(*C.NAME_SPELLINGS), F.try_element_at(fixed, F.lower(full)))
        .when(_in(full, terms) | _in(F.try_element_at(kept, F.lit(1)), terms), F.lit(None).cast("string"))
        .otherwise(full)
    )


def found_names(text: Column, rules: list[str], allow_lower: Column) -> Column:
    """Names matched by the rules, in rule order; duplicates kept."""
    hits = F.flatten(F.array(*[T.find_all(text, r, 1) for r in rules]))

    def candidate(hit: Column) -> Column:
        parts = F.split(hit, r"(?U)\s+")
        first, second = F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))
        upper = lambda w: w.rlike(r"(?U)^\p{Lu}")
        two = F.when(F.coalesce(upper(second), F.lit(False)), F.concat(first, F.lit(" "), second)).otherwise(first)
        plain = allow_lower & ~F.lower(first).rlike(C.NOT_NAME_SUFFIX) & (F.length(first) >= 3)
        return F.when(upper(first), two).when(plain, first)

    names = F.transform(hits, lambda h: clean_name(candidate(h)))
    return F.filter(names, lambda n: n.isNotNull())


def lower_case_share(segments: DataFrame) -> DataFrame:
    """Share of lines that start with a lower-case letter, among lines that start with a letter."""
    first = F.substring(F.trim("text"), 1, 1)
    lines = segments.where(first.rlike(r"(?U)^\p{L}"))
    low = F.when(first.rlike(r"(?U)^\p{Ll}"), 1).otherwise(0)
    return lines.groupBy("meeting_id").agg(F.sum(low).alias("n_lower"), F.count(F.lit(1)).alias("n_lines"))


def name_lines(segments: DataFrame) -> DataFrame:
    """Lines with the names they introduce and address, and their next lines' speakers."""
    share = lower_case_share(segments).select(
        "meeting_id", (F.col("n_lower") / F.col("n_lines") > 0.5).alias("_low")
    )
    rows = segments.join(share, "meeting_id", "left").withColumn("_low", F.coalesce("_low", F.lit(False)))
    rows = rows.withColumn("self_names", F.array_distinct(found_names(F.col("text"), C.SELF_INTRO_RULES, F.lit(True))))
    rows = rows.withColumn("said_to", found_names(F.col("text"), C.ADDRESS_RULES, F.col("_low")))
    return with_neighbours(
        rows.drop("_low"), KEYS, "ord", 0, C.REPLY_WINDOW,
        lambda w: {
            "_n": F.array(*[F.lead("speaker", k).over(w) for k in range(1, C.REPLY_WINDOW + 1)]),
            "next_said_to": F.lead("said_to").over(w), "next_speaker": F.lead("speaker").over(w),
            "next_seg": F.lead("seg_id").over(w), "next_text": F.lead("text").over(w),
        },
    ).withColumn(
        "reply", F.try_element_at(F.filter("_n", lambda s: s.isNotNull() & (s != "") & (s != F.col("speaker"))), F.lit(1))
    ).drop("_n")


def mutual_greetings(lines: DataFrame) -> DataFrame:
    """First pair of consecutive lines in which two speakers address each other by different names."""
    a, b = F.try_element_at("said_to", F.lit(1)), F.try_element_at("next_said_to", F.lit(1))
    pair = (F.lower(a) != F.lower(b)) & (F.col("speaker") != "") & (F.col("next_speaker") != "") & (
        F.col("speaker") != F.col("next_speaker"))
    hits = lines.where(F.coalesce(pair, F.lit(False)))
    first = hits.groupBy("meeting_id").agg(F.min_by(F.struct(
        "ord", "seg_id", "text", "speaker", "next_seg", "next_text", "next_speaker", a.alias("name_a"), b.alias("name_b")), "ord").alias("g"))
    return first.select("meeting_id", "g.*")


def name_votes(lines: DataFrame) -> DataFrame:
    """One row per piece of evidence: who a speaker is, or is not, and how much it counts."""
    spoken = lines.where(F.coalesce(F.col("speaker") != "", F.lit(False)))
    own = spoken.select(
        "meeting_id", "ord", "seg_id", "text", F.col("speaker").alias("spk"), F.posexplode("self_names").alias("k", "name"),
    ).select("meeting_id", "ord", "seg_id", "text", "spk", "name", F.lit(C.SELF_WEIGHT).alias("weight"), F.lit("self_introduction").alias("kind"),
             (F.col("ord") * (1 << 20) + F.col("k")).alias("seq"))
    addressed = spoken.select(
        "meeting_id", "ord", "seg_id", "text", "speaker", "reply",
        F.posexplode(F.filter(F.array_distinct("said_to"), lambda n: ~F.array_contains(F.col("self_names"), n))).alias("k", "name"),
    )
    seq = F.col("ord") * (1 << 20) + (1 << 19) + 2 * F.col("k")  # the reply's vote stands before the denial
    cols = ["meeting_id", "ord", "seg_id", "text", "spk", "name", "weight", "kind", "seq"]
    answers = addressed.where(F.col("reply").isNotNull()).withColumn("spk", F.col("reply")).withColumn(
        "weight", F.lit(C.ADDRESS_WEIGHT)).withColumn("kind", F.lit("addressed")).withColumn("seq", seq)
    denials = addressed.withColumn("spk", F.col("speaker")).withColumn("weight", F.lit(-C.ADDRESS_WEIGHT)).withColumn(
        "kind", F.lit(None).cast("string")).withColumn("seq", seq + 1)
    return own.select(*cols).unionByName(answers.select(*cols)).unionByName(denials.select(*cols))


def name_scores(votes: DataFrame, greetings: DataFrame) -> DataFrame:
    """Summed weights per (speaker, name); a mutual greeting lifts its two pairs to at least five."""
    base = votes.groupBy("meeting_id", F.col("spk").alias("speaker"), "name").agg(
        F.sum("weight").alias("weight"), F.min("seq").alias("seq"))
    lift = greetings.select("meeting_id", F.explode(F.array(
        F.struct(F.col("speaker").alias("speaker"), F.col("name_b").alias("name")),
        F.struct(F.col("next_speaker").alias("speaker"), F.col("name_a").alias("name")),
    )).alias("x")).select("meeting_id", "x.*", F.lit(C.MUTUAL_WEIGHT).alias("_lift"))
    joined = base.join(lift, ["meeting_id", "speaker", "name"], "full_outer")
    return joined.select(
        "meeting_id", "speaker", "name",
        F.when(F.col("_lift").isNotNull(), F.greatest(F.coalesce("weight", F.lit(0.0)), "_lift")).otherwise(F.col("weight")).alias("weight"),
        F.coalesce("seq", F.lit(1 << 60)).alias("seq"),
    )


def assign_names(scores: DataFrame) -> DataFrame:
    """Strongest pairs first, each speaker and each name used once.

    With S speakers in a meeting at most S - 1 names are taken by others, so a speaker's name is among its S
    best; only those pairs reach the per-meeting fold.
    """
    first = Window.partitionBy("meeting_id", "speaker")
    # Ties keep the order in which speakers, then their names, first got evidence of any sign.
    positive = scores.withColumn("_spk_seq", F.min("seq").over(first)).where(F.col("weight") > 0)
    n = positive.groupBy("meeting_id").agg(F.count_distinct("speaker").alias("_s"))
    ranked = positive.withColumn(
        "_r", F.row_number().over(first.orderBy(F.col("weight").desc(), "seq", "name")))
    best = ranked.join(n, "meeting_id").where(F.col("_r") <= F.col("_s"))
    pair = F.struct((-F.col("weight")).alias("w"), "_spk_seq", "seq", "speaker", "name")
    empty = F.array().cast("array<struct<speaker:string,name:string>>")

    def add(acc: Column, p: Column) -> Column:
        used = F.exists(acc, lambda k: (k["speaker"] == p["speaker"]) | (k["name"] == p["name"]))
        return F.when(used, acc).otherwise(F.concat(acc, F.array(F.struct(p["speaker"].alias("speaker"), p["name"].alias("name")))))

    lists = best.groupBy("meeting_id").agg(F.array_sort(F.collect_list(pair)).alias("_p"))
    return lists.select("meeting_id", F.explode(F.aggregate("_p", empty, add)).alias("x")).select("meeting_id", "x.*")


def name_speakers(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(speaker -> name, evidence)`` from what the meeting itself says."""
    lines = settle(name_lines(segments))
    votes, greetings = settle(name_votes(lines)), mutual_greetings(lines)
    names = settle(assign_names(name_scores(votes, greetings)))
    greet = greetings.select("meeting_id", "ord", F.explode(F.array(
        F.struct(F.col("speaker").alias("spk"), F.col("name_b").alias("name"), F.col("seg_id").alias("seg_id"), F.col("text").alias("text")),
        F.struct(F.col("next_speaker").alias("spk"), F.col("name_a").alias("name"), F.col("next_seg").alias("seg_id"), F.col("next_text").alias("text")),
    )).alias("x")).select("meeting_id", "ord", "x.*", F.lit("mutual_greeting").alias("kind"))
    proof = votes.where(F.col("kind").isNotNull()).select("meeting_id", "ord", "spk", "name", "seg_id", "text", "kind").unionByName(
        greet.select("meeting_id", "ord", "spk", "name", "seg_id", "text", "kind"))
    evidence = proof.withColumnRenamed("spk", "speaker").join(names, ["meeting_id", "speaker", "name"], "left_semi")
    return names, evidence


def relabel(rows: DataFrame, names: DataFrame, column: str = "speaker") -> DataFrame:
    """Replace labels by names where one is known."""
    n = names.select("meeting_id", F.col("speaker").alias(column), F.col("name").alias("_name"))
    return rows.join(n, ["meeting_id", column], "left").withColumn(column, F.coalesce("_name", column)).select(*rows.columns)


def verify_fixes(fixes: DataFrame, segments: DataFrame) -> DataFrame:
    """Short lines that may move to another existing speaker; all are void when there are too many."""
    seg = segments.select("meeting_id", "seg_id", "speaker", "text")
    speakers = segments.where(F.col("speaker") != "").select("meeting_id", F.col("speaker").alias("target")).distinct()
    ok = (
        fixes.withColumn("target", F.trim("target")).join(seg, ["meeting_id", "seg_id"])
        .join(speakers, ["meeting_id", "target"], "left_semi")
        .where((F.col("speaker") != "") & (F.col("target") != F.col("speaker")) & (F.size(T.words_of(F.col("text"))) <= C.FIX_MAX_WORDS))
    )
    last = ok.groupBy("meeting_id", "seg_id").agg(F.max_by("target", "pos").alias("target"))
    sizes = segments.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("_lines"))
    counts = last.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("_fixes"))
    limit = F.greatest(F.lit(1), F.floor(F.col("_lines") * C.FIX_MAX_SHARE))
    fine = counts.join(sizes, "meeting_id").where(F.col("_fixes") <= limit)
    return last.join(fine, "meeting_id", "left_semi")


def previous_speaker(segments: DataFrame) -> DataFrame:
    """Adds ``before``: the last earlier speaker who is not the line's own."""
    from .ordered import chunk_of, last_known, running_max

    # Runs of one speaker: the speaker before a run is the wanted one for each line of the run.
    known = segments.select("meeting_id", "seg_id", "ord", "speaker").where(F.coalesce(F.col("speaker") != "", F.lit(False)))
    prev = last_known(known, KEYS, ["ord"], chunk_of("ord"), F.col("speaker"), "_last", inclusive=False)
    prev = settle(prev.withColumn("_new", F.when(~F.col("_last").eqNullSafe(F.col("speaker")), F.struct("ord", "_last"))))
    runs = running_max(prev, KEYS, ["ord"], chunk_of("ord"), F.col("_new"), "_run")
    return runs.select("meeting_id", "seg_id", F.col("_run._last").alias("before"))


def verify_names(proposals: DataFrame, segments: DataFrame) -> DataFrame:
    """Proposed names that the cited line supports; first per label and per name."""
    seg = with_neighbours(
        segments.select("meeting_id", "seg_id", "ord", "speaker", "text"), KEYS, "ord", 0, C.MODEL_REPLY_WINDOW,
        lambda w: {"after": F.array(*[F.lead("speaker", k).over(w) for k in range(1, C.MODEL_REPLY_WINDOW + 1)])},
    ).join(previous_speaker(segments), ["meeting_id", "seg_id"], "left")
    labels = segments.select("meeting_id", F.col("speaker").alias("label")).distinct()
    taken = labels.where(T.named(F.col("label"))).select("meeting_id", F.lower("label").alias("_low"))
    short = F.array_join(F.slice(F.split(F.trim("name"), r"(?U)\s+"), 1, 2), " ")
    p = (
        proposals.withColumn("name", clean_name(short)).where(F.col("name").isNotNull() & F.col("label").rlike(C.NUMBERED_SPEAKER))
        .withColumn("_low", F.lower("name"))
        .join(labels, ["meeting_id", "label"], "left_semi").join(taken, ["meeting_id", "_low"], "left_anti")
        .join(seg, ["meeting_id", "seg_id"])
    )
    first = F.element_at(F.split("name", " "), 1)
    at = F.concat(F.lit(r"(?<!\w)(?:"), T.escape(first), F.lit(r")(?!\w)"))
    # The cues are tested around the first occurrence of the name only.
    upto = F.regexp_substr("text", F.concat(F.lit("(?iUs)^.*?"), at))
    prefix = F.substring(upto, F.lit(1), F.length(upto) - F.length(first))
    rest = F.substring("text", F.length(upto) + 1, F.length("text"))
    itself = T.cue(prefix, f"(?:{C.SELF_CUE})$") | T.cue(rest, f"^{C.AFTER_SELF}")
    addressed = T.cue(prefix, C.ADDRESSED_BEFORE + "$") & T.cue(rest, "^" + C.ADDRESSED_AFTER)
    answers = F.array_contains(F.filter("after", lambda s: s.isNotNull()), F.col("label")) | F.coalesce(
        F.col("before") == F.col("label"), F.lit(False))
    ok = F.when(F.col("speaker") == F.col("label"), itself).otherwise(addressed & answers)
    good = settle(p.where(upto.isNotNull() & (upto != "") & ok))
    # First come, first served on labels and on names: one row a pair, then rounds over all meetings at once.
    best = good.groupBy("meeting_id", "label", "name", "_low").agg(F.min(F.struct("pos", "seg_id", "text")).alias("x"))
    first_come = F.struct(F.col("x.pos").alias("pos"), "label", "name")
    return greedy_matching(best, KEYS, "label", "_low", first_come).select(
        "meeting_id", F.col("label").alias("speaker"), "name", F.col("x.seg_id").alias("seg_id"))


def rename_items(items: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Labels inside model-written text become the verified names."""
    per = names.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("speaker", "name"))).alias("_names"))
    renamed = F.aggregate(
        F.coalesce("_names", F.array().cast("array<struct<speaker:string,name:string>>")), F.col(column),
        lambda t, n: T.rename_label(t, n["speaker"], n["name"]))
    return items.join(per, "meeting_id", "left").withColumn(column, renamed).drop("_names")
