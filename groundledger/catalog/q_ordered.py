"""Windows, islands, folds and interval joins."""

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import assemble as A, energy, intervals, ordered, playback, progress as P, recheck as R, windows
from .oracle_views import lit
from .q_features import KEY
from .registry import query

WIDX = {"v_widx": "SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY ord, pos) - 1 AS word_idx FROM v_words"}


def stt_words(t):
    return t.settled_words


def voiced(t):
    return A.assign_speakers(t.words, t.turns, ["ord", "pos"])


_VOTES = """SELECT w.meeting_id, w.ord, w.pos, t.speaker, t.turn_no, least(w.end_ms, t.end_ms) - greatest(w.start_ms, t.start_ms) AS ov,
    least(abs(w.start_ms + w.end_ms - 2 * t.start_ms), abs(w.start_ms + w.end_ms - 2 * t.end_ms)) AS d2
    FROM v_words w JOIN v_turns t USING (meeting_id)"""
VOTES = {"v_votes": _VOTES, **WIDX,
         "v_spoken": """SELECT w.*, coalesce(o.speaker, n.speaker) AS speaker FROM v_widx w
    LEFT JOIN (SELECT meeting_id, ord, pos, arg_max(speaker, (ov, -turn_no)) AS speaker FROM v_votes WHERE ov > 0 GROUP BY ALL) o USING (meeting_id, ord, pos)
    LEFT JOIN (SELECT meeting_id, ord, pos, arg_min(speaker, (d2, speaker)) AS speaker FROM v_votes WHERE d2 <= 1000 GROUP BY ALL) n USING (meeting_id, ord, pos)"""}


@query("jn4_word_turn_overlap", """SELECT meeting_id, ord, pos, arg_max(speaker, (ov, -turn_no)) AS speaker, max(ov) AS overlap_ms
    FROM v_votes WHERE ov > 0 GROUP BY meeting_id, ord, pos""", VOTES)
def jn4(t):
    v = A.turn_votes(t.words, t.turns, ["ord", "pos"]).where(F.col("overlap_ms").isNotNull())
    return v.select("meeting_id", "ord", "pos", F.col("overlap_speaker").alias("speaker"), "overlap_ms")


@query("jn5_nearest_turn", "SELECT meeting_id, ord, pos, speaker FROM v_spoken", VOTES)
def jn5(t):
    return voiced(t).select("meeting_id", "ord", "pos", "speaker")


@query("jn9_word_segment_asof", """SELECT w.meeting_id, w.ord, w.pos, coalesce(min(s.ord), (SELECT max(ord) FROM v_segments x WHERE x.meeting_id = w.meeting_id)) AS stt_seg
    FROM v_words w LEFT JOIN v_segments s ON s.meeting_id = w.meeting_id AND s.end_ms - 400 - 1 > w.start_ms GROUP BY w.meeting_id, w.ord, w.pos""")
def jn9(t):
    segs = t.segments.select("meeting_id", F.col("ord").alias("stt_seg"), (F.col("end_ms") - 400).alias("end_ms"))
    return A.words_to_segments(t.words, segs).select("meeting_id", "ord", "pos", "stt_seg")


@query("jn14_word_in_span", """SELECT w.meeting_id, w.ord, w.pos, t.start_ms AS span_start FROM v_words w JOIN v_turns t
    ON w.meeting_id = t.meeting_id AND w.start_ms + w.end_ms BETWEEN 2 * t.start_ms AND 2 * t.end_ms""")
def jn14(t):
    return R.words_in_spans(t.words, t.turns).select("meeting_id", "ord", "pos", "span_start")


@query("jn15_word_updates", """SELECT meeting_id, word_idx, CASE WHEN word_idx % 3 = 0 THEN 0.95::DOUBLE ELSE conf END AS conf,
    word_idx % 3 = 0 OR disputed AS disputed FROM v_widx""", WIDX)
def jn15(t):
    w = stt_words(t)
    u = w.where(F.col("word_idx") % 3 == 0).select(
        "meeting_id", "word_idx", F.lit(0.95).alias("conf"), F.lit(True).alias("disputed"), F.lit(None).cast("string").alias("alt")
    )
    return A.apply_updates(w, u).select("meeting_id", "word_idx", "conf", "disputed")


@query("jn20_active_line", """SELECT q.meeting_id, q.t_ms, arg_min(s.seg_id, s.ord) AS seg_id FROM
    (SELECT meeting_id, start_ms + 777 AS t_ms FROM v_segments) q JOIN v_segments s ON s.meeting_id = q.meeting_id
    AND q.t_ms >= s.start_ms AND q.t_ms < s.end_ms GROUP BY q.meeting_id, q.t_ms""")
def jn20(t):
    times = t.segments.select("meeting_id", (F.col("start_ms") + 777).alias("t_ms"))
    return playback.active_lines(times, t.segments)


@query("jn20_active_word", """SELECT q.meeting_id, q.t_ms, min((w.ord, w.pos, w.w)).ord AS ord, min((w.ord, w.pos, w.w)).pos AS pos FROM
    (SELECT meeting_id, start_ms + 777 AS t_ms FROM v_segments) q JOIN
    (SELECT *, greatest(end_ms, coalesce(lead(start_ms) OVER (PARTITION BY meeting_id ORDER BY ord, pos), end_ms + 350)) AS until_ms FROM v_words) w
    ON w.meeting_id = q.meeting_id AND q.t_ms >= w.start_ms AND q.t_ms < w.until_ms GROUP BY q.meeting_id, q.t_ms""".replace(
        "min((w.ord, w.pos, w.w)).ord", "min(w.ord)").replace("min((w.ord, w.pos, w.w)).pos", "arg_min(w.pos, w.ord * 1000 + w.pos)"))
def jn20w(t):
    times = t.segments.select("meeting_id", (F.col("start_ms") + 777).alias("t_ms"))
    return playback.active_words(times, t.words).select("meeting_id", "t_ms", "ord", "pos")


@query("src2_explode_words", "SELECT meeting_id, ord AS stt_seg, word_idx, w, start_ms, end_ms, conf FROM v_widx", WIDX)
def src2(t):
    words = A.flatten_words(t.segments_words.withColumnRenamed("ord", "stt_seg"))
    return words.select("meeting_id", "stt_seg", "word_idx", "w", "start_ms", "end_ms", "conf")


@query("wn1_relabel", "SELECT meeting_id, label, speaker FROM v_labels")
def wn1(t):
    return t.labels


@query("wn2_segment_ids", "SELECT meeting_id, turn, printf('S%03d', ord) AS seg_id FROM v_lines")
def wn2(t):
    lines = t.given("conversations").select(F.col("conv_id").alias("meeting_id"), "turn", F.col("turn").alias("head"))
    return A.number_segments(lines).select("meeting_id", "turn", "seg_id")


@query("wn3_low_conf_window", """SELECT meeting_id, stt_seg, CASE WHEN low THEN s2 ELSE start_ms END AS start_ms, end_ms FROM
    (SELECT *, coalesce((c2 + c1 + conf) / 3 < 0.7, false) AS low FROM (SELECT *, ord AS stt_seg, lag(conf, 1) OVER o AS c1, lag(conf, 2) OVER o AS c2,
     lag(start_ms, 2) OVER o AS s2 FROM v_widx WINDOW o AS (PARTITION BY meeting_id ORDER BY word_idx))) WHERE conf < 0.6 OR low""", WIDX)
def wn3(t):
    return R.low_confidence_spans(stt_words(t)).drop("risk")


_SPANS = {"v_spans": """SELECT user_id AS meeting_id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + 1000 * CAST(floor(value * 900) AS BIGINT) AS end_ms,
    CAST(event_id % 3 AS INTEGER) AS risk FROM events""",
    "v_merged": """SELECT meeting_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(risk) AS risk FROM (
    SELECT *, sum(opens) OVER (PARTITION BY meeting_id ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    THEN 0 ELSE 1 END AS opens FROM v_spans)) GROUP BY meeting_id, island"""}


def event_spans(t):
    start = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ts)")
    return t.given("events").select(
        F.col("user_id").alias("meeting_id"), start.alias("start_ms"),
        (start + 1000 * F.floor(F.col("value") * 900)).alias("end_ms"), (F.col("event_id") % 3).cast("int").alias("risk"),
    )


@query("wn4_merge_spans", "SELECT * FROM v_merged", _SPANS)
def wn4(t):
    return intervals.merge_overlaps(event_spans(t), ["meeting_id"], "start_ms", "end_ms", "risk")


@query("wn5_risk_budget", """SELECT meeting_id, start_ms, end_ms, risk FROM (SELECT m.*, d.duration_ms, sum(end_ms - start_ms) OVER (
    PARTITION BY meeting_id ORDER BY risk DESC, start_ms ROWS UNBOUNDED PRECEDING) AS used FROM v_merged m JOIN
    (SELECT meeting_id, max(end_ms) - min(start_ms) AS duration_ms FROM v_spans GROUP BY ALL) d USING (meeting_id)) WHERE used <= duration_ms * 0.35::DOUBLE""", _SPANS)
def wn5(t):
    spans = event_spans(t)
    durations = spans.groupBy("meeting_id").agg((F.max("end_ms") - F.min("start_ms")).alias("duration_ms"))
    return R.budgeted(intervals.merge_overlaps(spans, ["meeting_id"], "start_ms", "end_ms", "risk"), durations)


@query("wn6_audit_sample")
def wn6(t):
    return R.audit_sample(t.segments.withColumnRenamed("ord", "stt_seg"), "seed", 0.3).select("meeting_id", "stt_seg")


_FRAMES = {"v_samples": """SELECT user_id AS meeting_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i,
    CASE WHEN event_id % 5 < 2 THEN value / 100000 ELSE value / 100 END AS x FROM events""",
    "v_frames": """SELECT meeting_id, i // 4 AS frame, sqrt(avg(x * x)) > power(10, -45 / 20) AS loud FROM v_samples
    GROUP BY meeting_id, i // 4 HAVING count(*) = 4"""}


def samples(t):
    e = t.given("events").select(F.col("user_id").alias("meeting_id"), "event_id", F.when(
        F.col("event_id") % 5 < 2, F.col("value") / 100000).otherwise(F.col("value") / 100).alias("x"))
    s = ordered.dense_order(e, ["meeting_id"], ["event_id"], ordered.chunk_of("event_id", 65536), "i")
    return s.withColumn("i", F.col("i") - 1)


@query("ag20_loud_frames", "SELECT meeting_id, frame, loud FROM v_frames", _FRAMES)
def ag20(t):
    return energy.loud_frames(samples(t), 4)


@query("wn7_loud_regions", """SELECT meeting_id, min(frame) * 30 AS start_ms, (max(frame) + 1) * 30 AS end_ms FROM
    (SELECT *, frame - row_number() OVER (PARTITION BY meeting_id ORDER BY frame) AS g FROM v_frames WHERE loud) GROUP BY meeting_id, g""", _FRAMES)
def wn7(t):
    return energy.loud_regions(energy.loud_frames(samples(t), 4), C.FRAME_MS)


@query("ag6_speech_seconds", """SELECT meeting_id, sum(end_ms - start_ms)::BIGINT AS speech_ms, CASE WHEN sum(end_ms - start_ms) < 2000
    THEN 'E_NO_SPEECH' END AS error FROM (SELECT meeting_id, min(frame) * 30 AS start_ms, (max(frame) + 1) * 30 AS end_ms FROM
    (SELECT *, frame - row_number() OVER (PARTITION BY meeting_id ORDER BY frame) AS g FROM v_frames WHERE loud) GROUP BY meeting_id, g) GROUP BY meeting_id""", _FRAMES)
def ag6(t):
    return energy.speech_total(energy.loud_regions(energy.loud_frames(samples(t), 4), C.FRAME_MS))


FILL = {**VOTES, "v_filled": """SELECT meeting_id, word_idx, ord, w, start_ms, end_ms, coalesce(speaker, CASE WHEN known_at >= broke_at THEN known END,
    CASE WHEN next_start - end_ms <= 1000 THEN nxt END) AS speaker FROM (SELECT *,
    max(broke) OVER b AS broke_at, max(CASE WHEN speaker IS NOT NULL THEN word_idx END) OVER b AS known_at,
    last_value(speaker IGNORE NULLS) OVER b AS known, first_value(speaker IGNORE NULLS) OVER f AS nxt,
    first_value(CASE WHEN speaker IS NOT NULL THEN start_ms END IGNORE NULLS) OVER f AS next_start FROM
    (SELECT *, CASE WHEN coalesce(start_ms - lag(end_ms) OVER (PARTITION BY meeting_id ORDER BY word_idx) > 1000, true) THEN word_idx END AS broke FROM v_spoken)
    WINDOW b AS (PARTITION BY meeting_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           f AS (PARTITION BY meeting_id ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""}


@query("wn8_fill_speakers", "SELECT meeting_id, word_idx, speaker FROM v_filled", FILL)
def wn8(t):
    # A word's text and marks have no part in it.
    w = t.placed_words.select("meeting_id", "word_idx", "start_ms", "end_ms")
    return A.speak(w, t.turns).select("meeting_id", "word_idx", "speaker")


_PIECES = {"v_pieces": """SELECT meeting_id, word_idx, w || CASE WHEN word_idx % 7 < 3 THEN '2' ELSE '' END AS w0, start_ms, end_ms, conf, disputed,
    CASE WHEN word_idx % 7 IN (1, 2) THEN ',' || word_idx % 10 || '5' WHEN word_idx % 7 = 3 THEN '%' WHEN word_idx % 7 = 5 THEN '-air'
    ELSE w || CASE WHEN word_idx % 7 = 0 THEN '2' ELSE '' END END AS w FROM v_widx""", **WIDX}


def pieces(words):
    i = F.col("word_idx")
    w = (
        F.when((i % 7).isin(1, 2), F.concat(F.lit(","), (i % 10).cast("string"), F.lit("5")))
        .when(i % 7 == 3, "%").when(i % 7 == 5, "-air")
        .otherwise(F.concat("w", F.when(i % 7 == 0, "2").otherwise("")))
    )
    return words.withColumn("w", w)


@query("wn9_glue_pieces", """SELECT meeting_id, head AS first_idx, string_agg(w, '' ORDER BY word_idx) AS w, min(start_ms) AS start_ms,
    arg_max(end_ms, word_idx) AS end_ms, min(conf) AS conf, bool_or(disputed) AS disputed FROM (SELECT *, max(CASE WHEN NOT glue THEN word_idx END)
    OVER (PARTITION BY meeting_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS head FROM (SELECT *, coalesce(
      (regexp_matches(w, '^[,.]\\d') AND regexp_matches(prev, '\\d$')) OR (regexp_matches(w, '^-\\w') AND regexp_matches(prev, '[\\p{L}\\p{N}]$'))
      OR (w[1] = '%' AND regexp_matches(prev, '\\d$')), false) AS glue FROM
      (SELECT *, lag(w) OVER (PARTITION BY meeting_id ORDER BY word_idx) AS prev FROM v_pieces))) GROUP BY meeting_id, head""", _PIECES)
def wn9(t):
    w = pieces(stt_words(t)).withColumn("first_idx", F.col("word_idx"))
    return A.glue_pieces(w).select("meeting_id", "first_idx", "w", "start_ms", "end_ms", "conf", "disputed")


_ABBR = lit(C.ABBREVIATIONS)
CUT = {**FILL, "v_prev": """SELECT *, lag(speaker) OVER o AS ps, lag(end_ms) OVER o AS pe, lag(w) OVER o AS pw, lag(ord) OVER o AS po FROM v_filled
    WINDOW o AS (PARTITION BY meeting_id ORDER BY word_idx)""",
       "v_ended": f"SELECT *, regexp_matches(pw, '[.!?…][''\"”)]*$') AND NOT list_contains({_ABBR}, lower(trim(pw))) AS ended FROM v_prev",
       "v_cut": """SELECT meeting_id, word_idx, word_idx AS head, start_ms AS hs, end_ms FROM v_ended WHERE word_idx = 0 UNION ALL
    SELECT meeting_id, word_idx, CASE WHEN split THEN word_idx ELSE head END, CASE WHEN split THEN start_ms ELSE hs END, end_ms FROM
    (SELECT n.*, c.head, c.hs, n.speaker IS DISTINCT FROM n.ps OR n.start_ms - n.pe > 1000 OR n.end_ms - c.hs > 30000 OR n.word_idx - c.head >= 60
     OR (n.ended AND (n.ord <> n.po OR n.word_idx - c.head >= 12)) AS split FROM v_cut c JOIN v_ended n ON n.meeting_id = c.meeting_id AND n.word_idx = c.word_idx + 1)"""}


@query("wn10_segment_cut", "SELECT meeting_id, head, count(*) AS n_words, max(end_ms) AS end_ms FROM v_cut GROUP BY meeting_id, head", CUT)
def wn10(t):
    return A.spoken_line_ends(t.placed_words, t.turns)


def monologue(t):
    """Every document read out as one long recording by one voice (up to 20 000 words)."""
    w = t.given("documents").select(
        F.col("doc_id").alias("meeting_id"), F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("word_idx", "w")
    )
    i = F.col("word_idx").cast("long")
    return w.select(
        "meeting_id", i.alias("word_idx"), F.floor(i / 40).alias("stt_seg"), "w", (i * 320).alias("start_ms"),
        (i * 320 + 240).alias("end_ms"), F.lit("Speaker 1").alias("speaker"),
    )


@query("wn10_monologue_cut")
def wn10m(t):
    return A.line_heads(monologue(t)).groupBy("meeting_id", "head").agg(
        F.count(F.lit(1)).alias("n_words"), F.max("end_ms").alias("end_ms")
    )


BURST = {**WIDX, "v_burst": """SELECT meeting_id, word_idx, ord, word_idx AS head, start_ms AS hs, end_ms AS reached FROM v_widx WHERE word_idx = 0 UNION ALL
    SELECT meeting_id, word_idx, ord, CASE WHEN split THEN word_idx ELSE head END, CASE WHEN split THEN start_ms ELSE hs END,
    CASE WHEN split THEN end_ms ELSE greatest(end_ms, reached) END FROM
    (SELECT n.*, c.head, c.hs, c.reached, n.start_ms - c.reached >= 280 OR n.end_ms - c.hs > 8000 OR (n.ord <> c.ord AND n.start_ms - c.reached >= 180) AS split
     FROM v_burst c JOIN v_widx n ON n.meeting_id = c.meeting_id AND n.word_idx = c.word_idx + 1)"""}


@query("wn11_speech_bursts", """SELECT meeting_id, min(hs) AS start_ms, max(reached) AS end_ms, count(*) AS n_words,
    row_number() OVER (PARTITION BY meeting_id ORDER BY head) - 1 AS burst_idx FROM v_burst GROUP BY meeting_id, head""", BURST)
def wn11(t):
    return A.speech_bursts(stt_words(t))


@query("wn12_refine_windows", """SELECT w.meeting_id, w.win, s.seg_id, CASE WHEN s.ord < w.lo THEN 'before' WHEN s.ord > w.hi THEN 'after' ELSE 'target' END AS part
    FROM (SELECT meeting_id, (ord - 1) // 3 AS win, min(ord) AS lo, max(ord) AS hi FROM v_segments GROUP BY ALL) w
    JOIN v_segments s ON s.meeting_id = w.meeting_id AND s.ord BETWEEN w.lo - 2 AND w.hi + 2""")
def wn12(t):
    return windows.refine_windows(t.segments, 3, 2).select("meeting_id", "win", "seg_id", "part")


CHUNKS = {"v_cost": "SELECT *, greatest(1, length('[' || seg_id || '] (' || speaker || ') ' || text) // 4) + 1 AS cost FROM v_segments",
          "v_chunk": """SELECT meeting_id, ord, seg_id, ord AS head, cost AS used FROM v_cost WHERE ord = 1 UNION ALL
    SELECT n.meeting_id, n.ord, n.seg_id, CASE WHEN c.used + n.cost > 54 THEN n.ord ELSE c.head END, CASE WHEN c.used + n.cost > 54 THEN n.cost ELSE c.used + n.cost END
    FROM v_chunk c JOIN v_cost n ON n.meeting_id = c.meeting_id AND n.ord = c.ord + 1""",
          "v_numbered": """SELECT *, dense_rank() OVER (PARTITION BY meeting_id ORDER BY head) AS chunk_no, count(*) OVER (PARTITION BY meeting_id, head) AS n,
    row_number() OVER (PARTITION BY meeting_id, head ORDER BY ord) AS i FROM v_chunk"""}


MEMBERS = """SELECT meeting_id, chunk_no, seg_id, false AS overlap FROM v_numbered UNION ALL
    SELECT a.meeting_id, a.chunk_no + 1, a.seg_id, true FROM v_numbered a WHERE a.i > a.n - greatest(1, a.n // 10)
    AND EXISTS (SELECT 1 FROM v_numbered b WHERE b.meeting_id = a.meeting_id AND b.chunk_no = a.chunk_no + 1)"""


@query("wn13_token_chunks", MEMBERS, CHUNKS)
def wn13(t):
    return windows.token_chunks(t.segments, 60).select("meeting_id", "chunk_no", "seg_id", "overlap")


@query("wn19_overall_progress", f"""SELECT event_id, (v // 10 + CASE WHEN v % 10 > 5 OR (v % 10 = 5 AND v // 10 % 2 = 1) THEN 1 ELSE 0 END) / 1000 AS progress FROM (
    SELECT event_id, CAST(before * 100 + weight * within_pct AS BIGINT) AS v FROM v_progress JOIN
    (SELECT stage, weight, sum(weight) OVER (ORDER BY i) - weight AS before FROM (SELECT unnest({lit([s for s, _ in C.STAGES])}) AS stage,
     unnest({lit([w for _, w in C.STAGES])}) AS weight, unnest(range(13)) AS i)) USING (stage))""")
def wn19(t):
    return t.progress.select("event_id", P.overall_progress(F.col("stage"), F.col("within_pct") / 100).alias("progress"))


@query("wn21_padded_bursts", """SELECT meeting_id, ord, CASE WHEN end_ms - start_ms < 1500 THEN greatest(start_ms - 250, coalesce(lag(end_ms) OVER o, 0), 0) ELSE start_ms END AS pad_start_ms,
    CASE WHEN end_ms - start_ms < 1500 THEN least(end_ms + 250, coalesce(lead(start_ms) OVER o, end_ms + 250)) ELSE end_ms END AS pad_end_ms
    FROM v_segments WINDOW o AS (PARTITION BY meeting_id ORDER BY ord)""")
def wn21(t):
    b = t.segments.withColumnRenamed("ord", "burst_idx")
    return A.pad_short_bursts(b).select("meeting_id", F.col("burst_idx").alias("ord"), "pad_start_ms", "pad_end_ms")


@query("jb1_assemble")
def jb1(t):
    w = pieces(t.placed_words)
    u = w.where(F.col("word_idx") % 5 == 0).select(
        "meeting_id", "word_idx", F.lit(0.95).alias("conf"), F.lit(True).alias("disputed"), F.lit("x").alias("alt")
    )
    return A.assemble_transcript(w, u, t.turns).select("meeting_id", "seg_id", "start_ms", "end_ms", "speaker", "text", F.size("words").alias("n_words"))


@query("jb2_risky_spans")
def jb2(t):
    return R.flag_risky_spans(t.segments.withColumnRenamed("ord", "stt_seg"), stt_words(t), "seed")


def second_reading(t):
    """A second recogniser that hears some words differently, some as fillers, and adds some."""
    i = F.col("word_idx")
    said = F.when(i % 11 == 5, "uh").when(i % 9 == 2, F.concat("w", F.lit("s"))).when(i % 13 == 4, F.concat(F.lit("really "), F.col("w"))).otherwise(F.col("w"))
    return stt_words(t).select("meeting_id", i.alias("other_idx"), "start_ms", "end_ms", F.explode(F.split(said, " ")).alias("w"))


@query("jn13_cross_check")
def jn13(t):
    return R.cross_check(stt_words(t), t.turns, second_reading(t)).select("meeting_id", "word_idx", "conf", "disputed", "alt")


@query("jb3_span_report")
def jb3(t):
    w, second = stt_words(t), second_reading(t)
    spans = R.flag_risky_spans(t.segments.withColumnRenamed("ord", "stt_seg"), w, "seed")
    rows = R.readings(w, spans, second)
    return R.span_report(w, spans, second, R.cross_check(w, spans, second, rows=rows), rows)


@query("ag19_duration", "SELECT meeting_id, max(end_ms) AS duration_ms, count(*) FILTER (disputed) AS disputed_words FROM v_words GROUP BY meeting_id")
def ag19(t):
    return t.words.groupBy("meeting_id").agg(F.max("end_ms").alias("duration_ms"), F.count_if("disputed").alias("disputed_words"))
