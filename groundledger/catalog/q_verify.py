"""Evidence joins, verified items and the scorecard."""

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..operators import fidelity as FI, lexicon, playback, verify as V
from ..operators.ordered import settle, with_neighbours
from ..plans import record
from .q_features import KEY, TOKEN_SQL, ascii_sql, count_sql, has_sql, numbers_sql
from .registry import query


def ids(col="evidence_ids"):
    return F.array_join(col, "|").alias("ids")


def proposals_of(t):
    return record.Proposals(
        t.edits, t.vocab_terms, t.sentences, t.decisions, t.proposals, t.tasks, t.name_proposals, t.speaker_fixes)


def whole_record(t):
    return record.build_record(t.segments_words, proposals_of(t), lexicon.packaged(t.spark))


CITED = {"v_flat": """SELECT meeting_id, pos, seg, min(i) AS i FROM (SELECT meeting_id, pos, unnest(evidence_ids) AS seg,
    unnest(range(len(evidence_ids))) AS i FROM v_sentences) GROUP BY ALL""",
    "v_known": "SELECT f.meeting_id, f.pos, f.seg, f.i, s.ord FROM v_flat f JOIN v_segments s ON s.meeting_id = f.meeting_id AND s.seg_id = f.seg",
    "v_all_ids": """SELECT DISTINCT meeting_id, seg FROM (SELECT meeting_id, unnest(evidence_ids) AS seg FROM v_sentences UNION ALL
    SELECT meeting_id, unnest(evidence_ids) FROM v_decisions UNION ALL SELECT meeting_id, unnest(evidence_ids) FROM v_tasks)"""}


def caps_sql(col: str) -> str:
    """Capitalised tokens that do not start a sentence, for plain ASCII text."""
    toks, pre = f"regexp_extract_all({col}, '{TOKEN_SQL}', 2)", f"regexp_extract_all({col}, '{TOKEN_SQL}', 1)"
    return f"""list_filter(list_transform(list_filter(range(1, len({toks}) + 1), lambda i: regexp_matches({toks}[i], '^[A-Z]')
    AND NOT regexp_full_match(rtrim({toks}[i], '.'), 'I(''(m|ll|d|ve))?') AND NOT regexp_matches(CASE WHEN trim({pre}[i]) = '' THEN
    CASE WHEN i = 1 THEN '.' ELSE {toks}[i - 1] END ELSE trim({pre}[i]) END, '[.!?:;"''(\\[]$')), lambda i: regexp_replace(rtrim({toks}[i], '.'), '''s$', '')), lambda x: x <> '')"""


# Facts of a sentence, one row each (k = 'n' for numbers, 'c' for names), and whether a text holds one.
_HOLDS = "CASE WHEN f.k = 'n' THEN list_contains({nums}, f.fact) ELSE regexp_matches(lower({low}), '(^|[^\\w])' || replace(lower(f.fact), '.', '\\.') || '([^\\w]|$)') END"
_JOINED = "(SELECT meeting_id, pos, string_agg(speaker || ' ' || text, ' ' ORDER BY o) AS t FROM {0} GROUP BY meeting_id, pos)"
FACTS = {**CITED,
    "v_facts": f"""SELECT DISTINCT meeting_id, pos, 'n' AS k, unnest({numbers_sql('text')}) AS fact FROM v_sentences
    UNION SELECT DISTINCT meeting_id, pos, 'c', unnest({caps_sql('text')}) FROM v_sentences""",
    "v_c1": f"SELECT k.meeting_id, k.pos, k.i AS o, k.ord, s.seg_id, s.speaker, {ascii_sql('s.text')} AS text FROM v_known k JOIN v_segments s ON s.meeting_id = k.meeting_id AND s.ord = k.ord",
    "v_miss1": f"""SELECT f.* FROM v_facts f LEFT JOIN {_JOINED.format('v_c1')} c USING (meeting_id, pos)
    WHERE NOT coalesce({_HOLDS.format(nums=numbers_sql('c.t'), low='c.t')}, false)""",
    "v_borrow": f"""SELECT f.meeting_id, f.pos, f.k, f.fact, min(s.ord) AS ord FROM v_miss1 f JOIN v_c1 c USING (meeting_id, pos) JOIN v_segments s ON s.meeting_id = f.meeting_id
    AND abs(s.ord - c.ord) = 1 WHERE NOT EXISTS (SELECT 1 FROM v_c1 x WHERE x.meeting_id = f.meeting_id AND x.pos = f.pos AND x.ord = s.ord)
    AND regexp_matches(lower({ascii_sql('s.text')}), '(^|[^\\w])' || replace(lower(f.fact), '.', '\\.') || '([^\\w]|$)') GROUP BY f.meeting_id, f.pos, f.k, f.fact""",
    "v_c2": f"""SELECT meeting_id, pos, CASE WHEN EXISTS (SELECT 1 FROM v_miss1 m WHERE m.meeting_id = c.meeting_id AND m.pos = c.pos) THEN ord ELSE o END AS o, ord, seg_id, speaker, text FROM v_c1 c
    UNION SELECT DISTINCT b.meeting_id, b.pos, b.ord, b.ord, s.seg_id, s.speaker, {ascii_sql('s.text')} FROM v_borrow b JOIN v_segments s ON s.meeting_id = b.meeting_id AND s.ord = b.ord""",
    "v_miss2": f"""SELECT f.* FROM v_miss1 f JOIN {_JOINED.format('v_c2')} c USING (meeting_id, pos)
    WHERE NOT coalesce({_HOLDS.format(nums=numbers_sql('c.t'), low='c.t')}, false)""",
    "v_ok": "SELECT * FROM v_c2 c WHERE NOT EXISTS (SELECT 1 FROM v_miss2 m WHERE m.meeting_id = c.meeting_id AND m.pos = c.pos)",
    "v_checked": """SELECT s.meeting_id, s.section, s.pos, c.ids IS NOT NULL AS kept, c.ids FROM v_sentences s LEFT JOIN
    (SELECT meeting_id, pos, string_agg(seg_id, '|' ORDER BY o) AS ids FROM v_ok GROUP BY meeting_id, pos) c USING (meeting_id, pos)"""}


@query("pr21_known_ids", "SELECT meeting_id, pos, string_agg(seg, '|' ORDER BY i) AS ids FROM v_known GROUP BY meeting_id, pos", CITED)
def pr21(t):
    k = V.known_evidence(t.sentences.withColumnRenamed("text", "sentence"), t.segments).where(F.size("cited") > 0)
    return k.select("meeting_id", "pos", F.array_join(V.ids_of(F.col("cited")), "|").alias("ids"))


@query("jn2_evidence_lines", """SELECT s.meeting_id, s.pos, coalesce(k.n, 0) AS n_known, k.joined FROM v_sentences s LEFT JOIN
    (SELECT k.meeting_id, k.pos, count(*) AS n, string_agg(t.text, ' ' ORDER BY k.i) AS joined FROM v_known k JOIN v_segments t
     ON t.meeting_id = k.meeting_id AND t.seg_id = k.seg GROUP BY k.meeting_id, k.pos) k USING (meeting_id, pos)""", CITED)
def jn2(t):
    k = V.known_evidence(t.sentences.withColumnRenamed("text", "sentence"), t.segments)
    joined = F.array_join(F.transform("cited", lambda c: c["text"]), " ")
    return k.select("meeting_id", "pos", F.size("cited").cast("long").alias("n_known"), F.when(F.size("cited") > 0, joined).alias("joined"))


_POINTER = """SELECT t.meeting_id, t.pos, CASE WHEN deadline_seg IS NULL THEN NULL
    WHEN s.text IS NULL OR trim(deadline_words) = '' OR NOT contains(lower(s.text), lower(deadline_words)) THEN 'pointer_invalid'
    WHEN (SELECT bool_or(w.disputed AND w.a < instr(lower(s.text), lower(deadline_words)) - 1 + length(deadline_words)
          AND instr(lower(s.text), lower(deadline_words)) - 1 < w.b) FROM v_wspans w WHERE w.meeting_id = s.meeting_id AND w.ord = s.ord) THEN 'audio_unclear'
    WHEN NOT list_contains(t.evidence_ids, deadline_seg) AND NOT (SELECT coalesce(bool_or(abs(c.ord - s.ord) <= 2), false) FROM v_segments c
          WHERE c.meeting_id = t.meeting_id AND list_contains(t.evidence_ids, c.seg_id)) THEN 'pointer_invalid' END AS flag,
    CASE WHEN deadline_seg IS NOT NULL THEN substr(s.text, instr(lower(s.text), lower(deadline_words)), length(deadline_words)) END AS found
    FROM v_tasks t LEFT JOIN v_segments s ON s.meeting_id = t.meeting_id AND s.seg_id = t.deadline_seg"""
POINTER = {"v_wspans": """SELECT meeting_id, ord, disputed, sum(length(w) + 1) OVER o - length(w) - 1 AS a, sum(length(w) + 1) OVER o - 1 AS b
    FROM v_words WINDOW o AS (PARTITION BY meeting_id, ord ORDER BY pos)""", "v_pointer": _POINTER}


@query("jn3_pointer_resolution", "SELECT meeting_id, pos, flag, CASE WHEN flag IS NULL AND found IS NOT NULL THEN found ELSE 'Unspecified' END AS deadline FROM v_pointer", POINTER)
def jn3(t):
    k = V.known_evidence(t.tasks, t.segments)
    k = V.pointer_lines(k, t.segments_words, "deadline_seg", "line")
    value, flag = V.resolve_pointer(F.col("line"), F.col("deadline_seg"), F.col("deadline_words"), F.col("cited"), "deadline", True)
    return k.select("meeting_id", "pos", flag.alias("flag"), value.alias("deadline"))


@query("jn6_self_introduction")
def jn6(t):
    k = V.known_evidence(t.tasks, t.segments)
    k = V.pointer_lines(k, t.segments_words, "owner_seg", "line")
    value, flag = V.resolve_pointer(F.col("line"), F.col("owner_seg"), F.col("owner_words"), F.col("cited"), "owner", True)
    return k.select("meeting_id", "pos", flag.alias("flag"), value.alias("owner"))


@query("jn7_deadline_adjacency", """SELECT DISTINCT t.meeting_id, t.pos FROM (SELECT meeting_id, pos, deadline_seg, unnest(evidence_ids) AS seg FROM v_tasks) t
    JOIN v_segments a ON a.meeting_id = t.meeting_id AND a.seg_id = t.deadline_seg JOIN v_segments b ON b.meeting_id = t.meeting_id AND b.seg_id = t.seg
    WHERE abs(a.ord - b.ord) <= 2""")
def jn7(t):
    at = t.segments.select("meeting_id", F.col("seg_id").alias("deadline_seg"), F.col("ord").alias("_at"))
    k = V.known_evidence(t.tasks, t.segments).join(at, ["meeting_id", "deadline_seg"])
    return k.where(F.exists("cited", lambda c: F.abs(c["ord"] - F.col("_at")) <= C.DEADLINE_ADJACENCY)).select("meeting_id", "pos")


@query("jn8_neighbour_evidence", "SELECT meeting_id, pos, ids FROM v_checked WHERE kept", FACTS)
def jn8(t):
    kept, _ = V.verify_sentences(t.sentences, t.segments)
    return kept.select("meeting_id", "pos", ids())


@query("jn10_raw_refined", """SELECT s.meeting_id, s.seg_id, coalesce(r.text, s.text) AS refined FROM v_segments s LEFT JOIN
    (SELECT meeting_id, seg_id, upper(replace(text, 'ß', 'ss')) AS text FROM v_segments WHERE ord % 2 = 0) r USING (meeting_id, seg_id)""")
def jn10(t):
    r = t.segments.where(F.col("ord") % 2 == 0).select(*KEY, F.upper(F.replace("text", F.lit("ß"), F.lit("ss"))).alias("after"))
    return t.segments.join(r, KEY, "left").select(*KEY, F.coalesce("after", "text").alias("refined"))


@query("jn12_cited_uncited", """SELECT s.meeting_id, s.seg_id, c.seg IS NOT NULL AS cited FROM v_segments s LEFT JOIN v_all_ids c
    ON c.meeting_id = s.meeting_id AND c.seg = s.seg_id""", CITED)
def jn12(t):
    c = FI.cited_ids(t.sentences, t.decisions, t.tasks).withColumn("_hit", F.lit(True))
    return t.segments.join(c, KEY, "left").select(*KEY, F.coalesce("_hit", F.lit(False)).alias("cited"))


@query("jn17_next_reply", f"""SELECT meeting_id, seg_id, nxt AS reply_id FROM (SELECT meeting_id, seg_id, speaker, lead(seg_id) OVER o AS nxt, lead(speaker) OVER o AS ns,
    lead({has_sql('text', C.BARE_AGREE)} OR (len(string_split(text, ' ')) <= 12 AND {has_sql('text', C.REPLY_AGREE)})) OVER o AS agrees
    FROM v_segments WINDOW o AS (PARTITION BY meeting_id ORDER BY ord)) WHERE agrees AND ns <> speaker""")
def jn17(t):
    s = V.line_context(t.segments)
    ok = T.agreeing_reply(F.col("speaker"), F.col("nxt.speaker"), F.col("nxt.text"))
    return s.where(F.col("nxt").isNotNull() & ok).select(*KEY, F.col("nxt.seg_id").alias("reply_id"))


@query("ag1_preserved", f"""SELECT meeting_id, sum(CASE WHEN a = b THEN len(a) ELSE 0 END)::BIGINT AS numbers_kept, sum(len(a))::BIGINT AS numbers_total,
    sum(CASE WHEN c = d THEN c ELSE 0 END)::BIGINT AS negations_kept, sum(c)::BIGINT AS negations_total FROM (SELECT meeting_id,
    {numbers_sql('text')} AS a, {numbers_sql("replace(text, '15', '16')")} AS b, {count_sql('text', C.NEGATION)} AS c,
    {count_sql("replace(text, 'should not', 'should')", C.NEGATION)} AS d FROM v_segments) GROUP BY meeting_id""")
def ag1(t):
    edited = F.replace(F.replace("text", F.lit("15"), F.lit("16")), F.lit("should not"), F.lit("should"))
    return FI.preserved(t.segments, t.segments.withColumn("text", edited))


@query("ag2_coverage", """SELECT meeting_id, count(c.seg) AS cited_lines, count(*) AS total_lines, round_even(100.0 * count(c.seg) / count(*), 1)::DOUBLE AS coverage_pct
    FROM v_segments s LEFT JOIN v_all_ids c USING (meeting_id) WHERE false GROUP BY meeting_id""".replace("USING (meeting_id) WHERE false", "ON c.meeting_id = s.meeting_id AND c.seg = s.seg_id").replace("SELECT meeting_id,", "SELECT s.meeting_id,").replace("GROUP BY meeting_id", "GROUP BY s.meeting_id"), CITED)
def ag2(t):
    return FI.coverage(t.segments, FI.cited_ids(t.sentences, t.decisions, t.tasks))


@query("pr22_unsupported_facts", "SELECT s.meeting_id, s.pos, coalesce((SELECT string_agg(m.fact, '|' ORDER BY m.fact) FROM v_miss1 m WHERE m.meeting_id = s.meeting_id AND m.pos = s.pos), '') AS missing FROM v_sentences s", FACTS)
def pr22(t):
    k = V.known_evidence(t.sentences.withColumnRenamed("text", "sentence"), t.segments)
    return k.select("meeting_id", "pos", F.array_join(F.array_sort(F.array_distinct(V.unsupported(F.col("sentence"), V.cited_text(F.col("cited"))))), "|").alias("missing"))


@query("jb10_kept_sentences", "SELECT meeting_id, section, pos, kept FROM v_checked", FACTS)
def jb10_kept(t):
    kept, removed = V.verify_sentences(t.sentences, t.segments)
    return kept.withColumn("kept", F.lit(True)).unionByName(removed.withColumn("kept", F.lit(False))).select("meeting_id", "section", "pos", "kept")


@query("jb10_sentences")
def jb10(t):
    kept, removed = V.verify_sentences(t.sentences, t.segments)
    return kept.withColumn("kept", F.lit(True)).unionByName(removed.withColumn("kept", F.lit(False))).select(
        "meeting_id", "section", "pos", "kept", ids())


@query("jb11_decisions")
def jb11(t):
    d, p, _ = V.verify_decisions(t.decisions, t.proposals, t.segments)
    return d.select("meeting_id", "id", F.col("decision").alias("item"), "agreement", ids()).unionByName(
        p.select("meeting_id", F.when(F.col("demoted"), "demoted").otherwise("proposal").alias("id"), F.col("proposal").alias("item"),
                 F.lit(None).cast("string").alias("agreement"), ids()))


@query("jb12_tasks")
def jb12(t):
    tasks, _ = V.verify_tasks(t.tasks, t.segments_words)
    return tasks.select("meeting_id", "id", "task", "owner", "deadline", "quote", ids(), F.array_join("flags", "|").alias("flags"))


_FIRST = """SELECT meeting_id, pos, min(s.ord) AS first_ord FROM (SELECT meeting_id, pos, unnest(evidence_ids) AS seg FROM {0}) i
    JOIN v_segments s USING (meeting_id) WHERE s.seg_id = i.seg GROUP BY meeting_id, pos"""


@query("wn16_renumber", f"SELECT meeting_id, pos, 'T' || row_number() OVER (PARTITION BY meeting_id ORDER BY first_ord, pos) AS id FROM ({_FIRST.format('v_tasks')})")
def wn16(t):
    k = V.known_evidence(t.tasks, t.segments).where(F.size("cited") > 0)
    return V.renumber(k, "T").select("meeting_id", "pos", "id")


@query("tk5_jump_target", """SELECT meeting_id, pos, arg_min(s.seg_id, s.start_ms) AS seg_id, greatest(0, min(s.start_ms) - 2000) AS play_ms FROM
    (SELECT meeting_id, pos, unnest(evidence_ids) AS seg FROM v_tasks) i JOIN v_segments s USING (meeting_id) WHERE s.seg_id = i.seg GROUP BY meeting_id, pos""")
def tk5(t):
    return playback.jump_targets(t.tasks, t.segments, ["pos"])


@query("wn20_timeline_pins", f"""SELECT *, lag(pos) OVER o AS prev_pos, lead(pos) OVER o AS next_pos FROM (SELECT meeting_id, kind, pos, min(s.start_ms) AS time_ms FROM
    (SELECT meeting_id, 'decision' AS kind, pos, unnest(evidence_ids) AS seg FROM v_decisions UNION ALL SELECT meeting_id, 'task', pos, unnest(evidence_ids) FROM v_tasks) i
    JOIN v_segments s USING (meeting_id) WHERE s.seg_id = i.seg GROUP BY meeting_id, kind, pos) WINDOW o AS (PARTITION BY meeting_id ORDER BY time_ms, kind, pos)""")
def wn20(t):
    from ..operators.items import timeline_pins

    both = t.decisions.select("meeting_id", F.lit("decision").alias("kind"), "pos", "evidence_ids").unionByName(
        t.tasks.select("meeting_id", F.lit("task").alias("kind"), "pos", "evidence_ids"))
    return timeline_pins(both, t.segments)


@query("st2_distinct_ids", "SELECT meeting_id, pos, string_agg(seg, '|' ORDER BY i) AS ids FROM v_flat GROUP BY meeting_id, pos", CITED)
def st2(t):
    return t.sentences.where(F.size("evidence_ids") > 0).select("meeting_id", "pos", ids(F.array_distinct("evidence_ids")))


@query("st3_shared_evidence", """SELECT d.meeting_id, d.pos, p.pos AS other_pos FROM v_decisions d JOIN v_proposals p USING (meeting_id)
    WHERE len(list_intersect(d.evidence_ids, p.evidence_ids)) > 0""")
def st3(t):
    flat = lambda df, n: df.select("meeting_id", F.col("pos").alias(n), F.explode("evidence_ids").alias("seg_id")).distinct()
    return flat(t.decisions, "pos").join(flat(t.proposals, "other_pos"), KEY).select("meeting_id", "pos", "other_pos").distinct()


@query("st4_neighbours_minus_cited", """SELECT DISTINCT k.meeting_id, k.pos, s.seg_id FROM v_known k JOIN v_segments s ON s.meeting_id = k.meeting_id
    AND abs(s.ord - k.ord) = 1 ANTI JOIN v_known x ON x.meeting_id = k.meeting_id AND x.pos = k.pos AND x.seg = s.seg_id""", CITED)
def st4(t):
    k = V.known_evidence(t.sentences.withColumnRenamed("text", "sentence"), t.segments)
    near = F.array_except(
        F.flatten(F.transform("cited", lambda c: F.array(c["ord"] - 1, c["ord"] + 1))), F.transform("cited", lambda c: c["ord"]))
    return k.select("meeting_id", "pos", F.explode(near).alias("ord")).join(
        t.segments.select("meeting_id", "ord", "seg_id"), ["meeting_id", "ord"]).select("meeting_id", "pos", "seg_id")


@query("ag3_scorecard")
def ag3(t):
    return whole_record(t).fidelity


@query("jb14_fidelity", f"""SELECT s.meeting_id, n.k || '/' || n.n AS numbers_preserved, s.total_lines, s.cited_lines, coalesce(e.reasons, 0) AS rejected, w.disputed_words FROM
    (SELECT s.meeting_id, count(*) AS total_lines, count(c.seg) AS cited_lines FROM v_segments s LEFT JOIN v_all_ids c ON c.meeting_id = s.meeting_id AND c.seg = s.seg_id GROUP BY s.meeting_id) s
    JOIN (SELECT meeting_id, sum(CASE WHEN a = b THEN len(a) ELSE 0 END)::BIGINT AS k, sum(len(a))::BIGINT AS n FROM (SELECT meeting_id, {numbers_sql('text')} AS a,
          {numbers_sql("replace(text, '15 slides', '50 slides')")} AS b FROM v_segments) GROUP BY meeting_id) n USING (meeting_id)
    LEFT JOIN (SELECT meeting_id, count(*) AS reasons FROM v_edits e LEFT JOIN v_segments s USING (meeting_id, seg_id) WHERE trim(original) <> trim(replacement)
          AND (confidence < 0.7 OR s.text IS NULL OR NOT contains(s.text, original)) GROUP BY meeting_id) e USING (meeting_id)
    JOIN (SELECT meeting_id, count(*) FILTER (disputed) AS disputed_words FROM v_words GROUP BY meeting_id) w USING (meeting_id)""", CITED)
def jb14(t):
    """Scorecard parts that plain SQL can say: preserved numbers, coverage, early rejections, disputed words."""
    lines = t.segments_words
    edited = lines.withColumn("text", F.replace("text", F.lit("15 slides"), F.lit("50 slides")))
    bad = t.edits.where(F.trim("original") != F.trim("replacement")).join(t.segments.select(*KEY, "text"), KEY, "left").where(
        (F.col("confidence") < C.MIN_EDIT_CONFIDENCE) | F.col("text").isNull() | ~F.contains("text", F.col("original")))
    rejected = bad.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("rejected"))
    disputed = lines.groupBy("meeting_id").agg(F.sum(F.size(F.filter("words", lambda w: w["disputed"]))).cast("long").alias("disputed_words"))
    cover = FI.coverage(lines, FI.cited_ids(t.sentences, t.decisions, t.tasks))
    return (
        FI.preserved(lines, edited).join(cover, "meeting_id").join(rejected, "meeting_id", "left").join(disputed, "meeting_id")
        .select("meeting_id", F.concat(F.col("numbers_kept").cast("string"), F.lit("/"), F.col("numbers_total").cast("string")).alias("numbers_preserved"),
                "total_lines", "cited_lines", F.coalesce("rejected", F.lit(0)).alias("rejected"), "disputed_words")
    )
