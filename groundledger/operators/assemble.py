"""From recognised words and voice turns to transcript lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .. import constants as C
from . import whole
from .folds import cut_pieces
from .intervals import ROW, follow_marks, forward_asof, overlap_pairs
from .ordered import carry_in, chunk_of, dense_order, running_max, running_sum, settle, with_neighbours

KEYS = ["meeting_id"]
WORD_CHUNK = 16384
#: Words (turns, patches) up to which a meeting goes through all steps in one call; no result depends on it.
WHOLE = 1 << 17


def place_words(stt_segments: DataFrame, n_words: Column) -> DataFrame:
    """Adds ``first_idx``, the 0-based index per meeting of each segment's first word; no word is shuffled or sorted."""
    upto = running_sum(stt_segments, KEYS, ["stt_seg"], chunk_of("stt_seg", 512), n_words.cast("long"), "_upto")
    return upto.withColumn("first_idx", F.col("_upto") - n_words).drop("_upto")


def flatten_words(stt_segments: DataFrame) -> DataFrame:
    """Nested recogniser segments to words with a 0-based global index per meeting; segments may be placed already."""
    if "first_idx" not in stt_segments.columns:
        stt_segments = place_words(stt_segments, F.greatest(F.coalesce(F.size("words"), F.lit(0)), F.lit(0)))
    return stt_segments.select("meeting_id", "stt_seg", "first_idx", F.posexplode("words").alias("pos", "word")).select(
        "meeting_id", "stt_seg", F.col("pos").cast("long").alias("pos"), "word.*", (F.col("first_idx") + F.col("pos")).alias("word_idx"))


def apply_updates(words: DataFrame, updates: DataFrame) -> DataFrame:
    """Per-word patches from the re-check: confidence, disputed flag and alternative."""
    u = updates.select(
        "meeting_id", "word_idx", F.col("conf").alias("_conf"), F.col("disputed").alias("_disputed"), F.col("alt").alias("_alt")
    )
    joined = words.join(u, ["meeting_id", "word_idx"], "left")
    return (
        joined.withColumn("conf", F.coalesce("_conf", "conf"))
        .withColumn("disputed", F.coalesce("_disputed", "disputed"))
        .withColumn("alt", F.coalesce("_alt", "alt"))
        .drop("_conf", "_disputed", "_alt")
    )


def turn_votes(words: DataFrame, turns: DataFrame, id_cols: list[str]) -> DataFrame:
    """Best-overlapping speaker and nearest speaker within half a second, per word, from one range join."""
    near = turns.select(
        "meeting_id", "turn_no", F.col("start_ms").alias("t_start"), F.col("end_ms").alias("t_end"),
        F.col("speaker").alias("t_speaker"), (F.col("start_ms") - C.NEAREST_TURN_MS).alias("t_from"),
        (F.col("end_ms") + C.NEAREST_TURN_MS).alias("t_to"),
    )
    spans = words.select("meeting_id", *id_cols, "start_ms", "end_ms")
    pairs = overlap_pairs(spans, near, KEYS, ("start_ms", "end_ms"), ("t_from", "t_to"))
    overlap = F.least("end_ms", "t_end") - F.greatest("start_ms", "t_start")
    twice_mid = F.col("start_ms") + F.col("end_ms")
    dist = F.least(F.abs(twice_mid - 2 * F.col("t_start")), F.abs(twice_mid - 2 * F.col("t_end")))
    return pairs.groupBy("meeting_id", *id_cols).agg(
        F.max_by("t_speaker", F.when(overlap > 0, F.struct(overlap, -F.col("turn_no")))).alias("overlap_speaker"),
        F.max(F.when(overlap > 0, overlap)).alias("overlap_ms"),
        F.min_by("t_speaker", F.when(dist <= 2 * C.NEAREST_TURN_MS, F.struct(dist, "t_speaker"))).alias("near_speaker"),
    )


def assign_speakers(words: DataFrame, turns: DataFrame, id_cols: list[str]) -> DataFrame:
    votes = turn_votes(words, turns, id_cols)
    return words.join(votes, ["meeting_id", *id_cols], "left").withColumn(
        "speaker", F.coalesce("overlap_speaker", "near_speaker")
    ).drop("overlap_speaker", "near_speaker", "overlap_ms")


def fill_missing_speakers(words: DataFrame) -> DataFrame:
    """A word between turns takes the previous word's speaker (chained over gaps of at most a second),
    else the next known speaker within a second."""
    gaps = with_neighbours(
        words, KEYS, "word_idx", 1, 0, lambda w: {"_prev_end": F.lag("end_ms").over(w)}, size=WORD_CHUNK
    )
    b = gaps.withColumn("_bucket", chunk_of("word_idx", WORD_CHUNK))
    broke = F.when(F.col("_prev_end").isNull() | (F.col("start_ms") - F.col("_prev_end") > C.PAUSE_MS), F.col("word_idx"))
    known = F.when(F.col("speaker").isNotNull(), F.struct("word_idx", "speaker", "start_ms"))
    b = b.withColumn("_broke", broke).withColumn("_known", known)
    b = carry_in(
        b, KEYS, "_bucket", {"_broke_in": F.max("_broke"), "_known_in": F.max("_known")}, lambda n, w: F.max(n).over(w),
        {"_next_in": F.min("_known")}, lambda n, w: F.min(n).over(w),
    )
    back = Window.partitionBy(*KEYS, "_bucket").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, 0)
    # "Next" scans run as a backward order, so that the frame grows and needs no full buffer per row.
    ahead = Window.partitionBy(*KEYS, "_bucket").orderBy(F.col("word_idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    b = (
        b.withColumn("_last_break", F.greatest(F.max("_broke").over(back), F.col("_broke_in")))
        .withColumn("_last", F.coalesce(F.max("_known").over(back), F.col("_known_in")))
        .withColumn("_next", F.coalesce(F.min("_known").over(ahead), F.col("_next_in")))
    )
    chained = F.when(F.col("_last.word_idx") >= F.coalesce("_last_break", F.lit(0)), F.col("_last.speaker"))
    following = F.when(F.col("_next.start_ms") - F.col("end_ms") <= C.PAUSE_MS, F.col("_next.speaker"))
    return b.withColumn("speaker", F.coalesce("speaker", chained, following)).select(*words.columns)


def _fields(df: DataFrame, names: list[str], *more: StructField) -> StructType:
    return StructType([*[StructField(n, df.schema[n].dataType) for n in names], *more])


def _spoken(laid: DataFrame) -> DataFrame:
    """Laid words with their speaker, still in order."""
    return whole.run(laid, whole.speak, _fields(laid, [c for c in laid.columns if c != "_kind"]))


def speak(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Words with the speaker of their turn or, between turns, of the words around them."""
    short, long = whole.by_length(words, [turns], WHOLE)
    out = _spoken(whole.lay(*short))
    return out if long is None else out.unionByName(fill_missing_speakers(settle(assign_speakers(*long, ["word_idx"]))).select(*out.columns))


def _glues(prev: Column, piece: Column) -> Column:
    last = F.substring(prev, -1, 1)
    digit = last.rlike(r"(?U)^\d$")
    return F.coalesce(
        (prev != "") & (piece != "") & (
            (piece.rlike(r"(?U)^[,.]\d") & digit)
            | (piece.rlike(r"(?U)^-\w") & last.rlike(r"(?U)^[\p{L}\p{N}]$"))
            | (piece.startswith("%") & digit)
        ),
        F.lit(False),
    )


def glue_pieces(words: DataFrame) -> DataFrame:
    """Split tokens ("2" ",75" ",000") become one word with the times of its first and last piece."""
    near = with_neighbours(
        words, KEYS, "word_idx", 1, 1, lambda w: {"_prev": F.lag("w").over(w), "_next": F.lead("w").over(w)}, size=WORD_CHUNK)
    own, piece = F.trim("w"), F.struct("word_idx", F.trim("w").alias("w"))
    near = settle(
        near.withColumn("_glued", _glues(F.trim("_prev"), own)).withColumn("_opens", _glues(own, F.trim("_next"))).drop("_prev", "_next"))
    # Most words stand alone; only pieces and the words they belong to are grouped.
    parts = near.where(F.col("_glued") | F.col("_opens"))
    headed = running_max(
        parts, KEYS, ["word_idx"], chunk_of("word_idx", WORD_CHUNK), F.when(~F.col("_glued"), F.col("word_idx")), "_head")
    first = [c for c in words.columns if c not in ("meeting_id", "word_idx", "w", "end_ms", "conf", "disputed")]
    glued = headed.groupBy("meeting_id", F.col("_head").alias("word_idx")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["w"]), "").alias("w"),
        *[F.min_by(c, "word_idx").alias(c) for c in first],
        F.max_by("end_ms", "word_idx").alias("end_ms"), F.min("conf").alias("conf"),
        F.max(F.coalesce("disputed", F.lit(False))).alias("disputed"),
    )
    alone = near.where(~F.col("_glued") & ~F.col("_opens")).withColumn("disputed", F.coalesce("disputed", F.lit(False))).withColumn("w", own)
    both = alone.select(*words.columns).unionByName(glued.select(*words.columns))
    return dense_order(both, KEYS, ["word_idx"], chunk_of("word_idx", WORD_CHUNK), "_n").withColumn(
        "word_idx", F.col("_n") - 1
    ).select(*words.columns)


def _meets(words: DataFrame) -> DataFrame:
    """Trimmed words with what ``_glues`` asks of either side: a piece meets the word before it if the two share a bit."""
    w, last = F.trim("w"), F.substring(F.trim("w"), -1, 1)
    bits = lambda *tests: sum((F.when(F.coalesce(t, F.lit(False)), 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    return words.withColumn(
        "_starts", bits(w.rlike(r"(?U)^[,.]\d") | w.startswith("%"), w.rlike(r"(?U)^-\w"))
    ).withColumn("_closes", bits(last.rlike(r"(?U)^\d$"), last.rlike(r"(?U)^[\p{L}\p{N}]$"))).withColumn("w", w)


def ends_sentence(word: Column) -> Column:
    return word.rlike(C.SENTENCE_CLOSE) & ~F.lower(F.trim(word)).isin(*C.ABBREVIATIONS)


def _segment_step(rows: dict):
    start, end = rows["start_ms"], rows["end_ms"]
    n, most, few = len(start), C.MAX_SEGMENT_WORDS, C.SOFT_SEGMENT_WORDS
    at = np.arange(n)

    def first_from(marked, begin):
        """Per row, the first marked row at or after row ``begin``; n if there is none."""
        found = np.append(np.minimum.accumulate(np.where(marked, at, n)[::-1])[::-1], n)
        return found[np.minimum(begin, n)]

    limit = start + C.MAX_SEGMENT_MS
    known = np.where(np.isnan(end), -np.inf, end) if end.dtype.kind == "f" else end
    reached = np.maximum.accumulate(known)
    late = np.searchsorted(reached, limit, side="right")
    nexts = np.minimum.reduce([
        first_from(rows["_hard"].astype(bool), at + 1), first_from(rows["_soft"].astype(bool), at + few), np.minimum(at + most, n)])
    # Where an earlier word, or the line's first, ends past the limit already, the words are looked at one by one.
    for i in np.flatnonzero(late <= at):
        over = np.flatnonzero(known[i + 1:nexts[i]] > limit[i])
        late[i] = i + 1 + over[0] if len(over) else n
    return np.minimum(nexts, late).tolist().__getitem__


def _differs(a):
    """Whether each value differs from the one before it; the first does."""
    same = a[1:] == a[:-1]
    if a.dtype.kind == "f":
        same |= np.isnan(a[1:]) & np.isnan(a[:-1])
    return np.append(True, ~same.astype(bool))[:len(a)]


def _line_step(rows: dict):
    """Steps from words; a cut never looks at the first row of a chunk, so none needs the row before it."""
    if "_ms" in rows:
        rows = {**rows, "end_ms": rows["start_ms"] + rows["_ms"]}
    before = lambda x, first: np.append([first], x[:-1])
    ended = before(rows["_ends"].astype(bool), False)
    near = rows["start_ms"][1:] - rows["end_ms"][:-1] <= C.PAUSE_MS
    hard = _differs(rows["speaker"]) | np.append(True, ~near) | (ended & _differs(rows["stt_seg"]))
    return _segment_step({**rows, "_hard": hard, "_soft": ended})


def cut_segments(words: DataFrame) -> DataFrame:
    """Adds ``head``, the index of the first word of each transcript line."""
    marked = words.withColumn("_ends", F.coalesce(ends_sentence(F.col("w")), F.lit(False)))
    return cut_pieces(marked, KEYS, "word_idx", _line_step, C.MAX_SEGMENT_WORDS, WORD_CHUNK).drop("_ends")


def line_heads(words: DataFrame) -> DataFrame:
    """``meeting_id``, ``word_idx``, ``end_ms`` and ``head`` as in ``cut_segments``; the words themselves stay where they are."""
    # Lengths repeat where ends never do, so they shuffle in fewer bytes.
    marked = words.select(
        "meeting_id", "word_idx", "start_ms", (F.col("end_ms") - F.col("start_ms")).alias("_ms"), "speaker", "stt_seg",
        F.coalesce(ends_sentence(F.col("w")), F.lit(False)).alias("_ends"))
    cut = cut_pieces(marked, KEYS, "word_idx", _line_step, C.MAX_SEGMENT_WORDS, WORD_CHUNK, keep=["meeting_id", "word_idx", "start_ms", "_ms"])
    return cut.select("meeting_id", "word_idx", (F.col("start_ms") + F.col("_ms")).alias("end_ms"), "head")


def _word_ends(words: DataFrame) -> DataFrame:
    return words.withColumn("_ends", F.coalesce(ends_sentence(F.col("w")), F.lit(False)))


def spoken_line_ends(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Lines of words without speakers: ``head`` as in ``cut_segments``, number of words and latest end."""
    short, long = whole.by_length(words, [turns], WHOLE)
    slim = lambda df: _word_ends(df).select("meeting_id", "word_idx", "stt_seg", "start_ms", "end_ms", "_ends")
    spoken = _spoken(whole.lay(slim(short[0]), short[1]))
    kinds = "meeting_id {}, head long, n_words long, end_ms long".format(words.schema["meeting_id"].dataType.simpleString())
    out = whole.run(spoken, lambda rows: whole.line_ends(rows, _line_step), kinds)
    if long is None:
        return out
    cut = cut_segments(settle(fill_missing_speakers(settle(assign_speakers(*long, ["word_idx"]))).select(
        "meeting_id", "word_idx", "stt_seg", "w", "start_ms", "end_ms", "speaker")))
    return out.unionByName(cut.groupBy("meeting_id", "head").agg(F.count(F.lit(1)).alias("n_words"), F.max("end_ms").alias("end_ms")))


def number_segments(lines: DataFrame) -> DataFrame:
    """``S001``, ``S002``, ... in time order."""
    numbered = dense_order(lines, KEYS, ["head"], chunk_of("head", WORD_CHUNK))
    return numbered.withColumn("seg_id", F.format_string("S%03d", F.col("ord")))


def _nested(words: DataFrame) -> DataFrame:
    return words.withColumn("word", F.struct(
        "word_idx", "w", "start_ms", "end_ms", "conf", F.coalesce("disputed", F.lit(False)).alias("disputed"), "alt"))


def _whole_lines(words: DataFrame, updates: DataFrame | None, turns: DataFrame) -> DataFrame:
    """Numbered lines of meetings of at most ``WHOLE`` words, from one shuffle of their words."""
    laid = whole.lay(_meets(words), turns, updates)
    glued = whole.run(laid, lambda rows: whole.glue(whole.speak(rows)), _fields(laid, [c for c in laid.columns if c not in ("_kind", "_starts", "_closes")]))
    marked = _nested(_word_ends(glued)).select("meeting_id", "stt_seg", "start_ms", "end_ms", "speaker", "_ends", "word")
    schema = _fields(marked, ["meeting_id"], StructField("ord", LongType()), *[marked.schema[c] for c in ("start_ms", "end_ms", "speaker")],
                     StructField("words", ArrayType(marked.schema["word"].dataType)))
    return whole.run(marked, lambda rows: whole.lines(rows, _line_step), schema)


def _chunked_lines(words: DataFrame, updates: DataFrame | None, turns: DataFrame | None) -> DataFrame:
    """Numbered lines of meetings of any length, chunk by chunk."""
    if updates is not None:
        words = apply_updates(words, updates)
    if turns is not None:
        words = settle(fill_missing_speakers(settle(assign_speakers(words, turns, ["word_idx"]))))
    elif "speaker" not in words.columns:
        words = words.withColumn("speaker", F.lit(None).cast("string"))
    cut = _nested(cut_segments(settle(glue_pieces(words))))
    # A line holds at most MAX_SEGMENT_WORDS words, so the nested array is small.
    lines = settle(cut.groupBy("meeting_id", "head").agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "word_idx").alias("end_ms"),
        F.min_by("speaker", "word_idx").alias("speaker"), F.array_sort(F.collect_list("word")).alias("words"),
    ))
    return dense_order(lines, KEYS, ["head"], chunk_of("head", WORD_CHUNK)).drop("head")


def assemble_transcript(words: DataFrame, updates: DataFrame | None, turns: DataFrame | None) -> DataFrame:
    """Raw transcript lines from words (``word_idx``, ``stt_seg``), word patches and voice turns."""
    if turns is None:
        lines = _chunked_lines(words, updates, None)
    else:
        short, long = whole.by_length(words, [turns, *([] if updates is None else [updates])], WHOLE)
        lines = _whole_lines(short[0], short[2] if len(short) > 2 else None, short[1])
        if long is not None:
            lines = lines.unionByName(_chunked_lines(long[0], long[2] if len(long) > 2 else None, long[1]).select(*lines.columns))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("words", lambda w: F.trim(w["w"])), " "), r"(?U)\s+", " "))
    return lines.select(
        "meeting_id", "ord", F.format_string("S%03d", F.col("ord")).alias("seg_id"), "start_ms", "end_ms", "speaker", text.alias("text"),
        F.transform("words", lambda w: w.dropFields("word_idx")).alias("words"),
    )


def _burst_step(rows: dict):
    start, end, seg = (rows[c].tolist() for c in ("start_ms", "end_ms", "stt_seg"))
    n = len(start)

    def step(i: int) -> int:
        reached = end[i]
        for j in range(i + 1, n):
            gap = start[j] - reached
            if gap >= C.BURST_GAP_MS or end[j] - start[i] > C.MAX_BURST_MS or (
                    seg[j] != seg[j - 1] and gap >= C.BURST_SEG_GAP_MS):
                return j
            reached = max(reached, end[j])
        return n

    return step


def speech_bursts(words: DataFrame) -> DataFrame:
    """Bursts of speech: split at pauses, at recogniser segments with a short pause, and every eight seconds."""
    slim = words.select("meeting_id", "word_idx", "stt_seg", "start_ms", "end_ms")
    # The words of a burst start within eight seconds, so in two neighbouring slots of that length.
    slot = F.floor(F.col("start_ms") / C.MAX_BURST_MS)
    densest = slim.groupBy("meeting_id", slot).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    cut = cut_pieces(slim, KEYS, "word_idx", _burst_step, 2 * densest + 1, WORD_CHUNK)
    bursts = cut.groupBy("meeting_id", "head").agg(
        F.min_by("start_ms", "word_idx").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_words")
    )
    numbered = dense_order(bursts, KEYS, ["head"], chunk_of("head", WORD_CHUNK), "burst_idx")
    return numbered.withColumn("burst_idx", F.col("burst_idx") - 1).drop("head")


def pad_short_bursts(bursts: DataFrame) -> DataFrame:
    """Short bursts get a little surrounding audio, never reaching into their neighbours."""
    near = with_neighbours(
        bursts, KEYS, "burst_idx", 1, 1,
        lambda w: {"_before": F.lag("end_ms").over(w), "_after": F.lead("start_ms").over(w)},
    )
    short = F.col("end_ms") - F.col("start_ms") < C.SHORT_BURST_MS
    lo = F.greatest(F.col("start_ms") - C.SHORT_PAD_MS, F.coalesce("_before", F.lit(0)), F.lit(0))
    hi = F.least(F.col("end_ms") + C.SHORT_PAD_MS, F.coalesce("_after", F.col("end_ms") + C.SHORT_PAD_MS))
    return near.withColumn("pad_start_ms", F.when(short, lo).otherwise(F.col("start_ms"))).withColumn(
        "pad_end_ms", F.when(short, hi).otherwise(F.col("end_ms"))
    ).drop("_before", "_after")


def words_to_segments(words: DataFrame, stt_segments: DataFrame) -> DataFrame:
    """Flat provider words assigned to the first segment that ends after they start (1 ms tolerance)."""
    marks = stt_segments.withColumn("_until", F.col("end_ms") - 1)
    return forward_asof(words, marks, KEYS, "start_ms", "_until", "stt_seg", "stt_seg")


def normalize_provider(words: DataFrame, stt_segments: DataFrame) -> DataFrame:
    """Words per segment with the segment's confidence; a segment without words gets its text spread evenly.

    Words after the end of the last segment belong to it, besides its own words or spread text.
    """
    conf = F.round(F.exp(F.least(F.lit(0.0), F.coalesce("avg_logprob", F.lit(0.0)))), 4)
    segs = stt_segments.select("meeting_id", F.col("stt_seg").alias("_seg"), "start_ms", "end_ms", "text", conf.alias("conf"))
    timed = words.select("meeting_id", F.trim("w").alias("w"), "start_ms", "end_ms").where(F.col("w") != "")
    marks = segs.withColumn("_until", F.col("end_ms") - 1).withColumnRenamed("conf", "_conf")
    seen = follow_marks(timed, marks, KEYS, "start_ms", "_until", F.struct(F.col("_seg").alias("stt_seg"), F.col("_conf").alias("conf")))
    # Words and spread texts leave in one pass: a word as a list of itself, a segment as the words of its text or not at all.
    said = F.col("_kind") == ROW
    tokens = F.when(said, F.array("w")).when(~F.col("_taken"), F.filter(F.split("text", r"(?U)\s+"), lambda x: x != ""))
    laid = seen.where(F.col("_mark").isNotNull()).withColumn("_tokens", tokens)
    step = (F.col("end_ms") - F.col("start_ms")) / F.greatest(F.lit(1), F.col("_n"))
    at = lambda k, own: F.when(said, F.col(own)).otherwise(F.floor(F.col("start_ms") + k * step))
    return laid.select(
        "meeting_id", "_mark", "_kind", "start_ms", "end_ms", F.size("_tokens").alias("_n"), F.posexplode("_tokens").alias("k", "w")
    ).select("meeting_id", "_mark.stt_seg", "w", at(F.col("k"), "start_ms").alias("start_ms"), at(F.col("k") + 1, "end_ms").alias("end_ms"), "_mark.conf")


def language_code(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("en")))
    codes = F.create_map(*[F.lit(x) for kv in C.LANGUAGE_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(codes, low), F.substring(low, 1, 2))
