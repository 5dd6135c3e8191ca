"""Names said in the meeting, names proposed by a model, and relabelling."""

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..operators import guard as G, speakers as S
from ..operators.ordered import settle, with_neighbours
from ..plans import record
from .oracle_views import lit
from .q_features import KEY
from .registry import query

_STOP = lit(sorted(C.NOT_NAMES))


@query("pr12_said_names")
def pr12(t):
    return S.name_lines(t.segments).select(
        *KEY, F.array_join("self_names", "|").alias("introduced"), F.array_join("said_to", "|").alias("addressed"))


def _clean_sql():
    return f"""SELECT meeting_id, seg_id, CASE WHEN len(k) = 0 OR list_contains({lit(S.known_terms())}, lower(array_to_string(k, ' ')))
    OR list_contains({lit(S.known_terms())}, lower(k[1])) THEN NULL ELSE array_to_string(list_transform(k, lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') END AS name
    FROM (SELECT meeting_id, seg_id, list_filter(string_split(replace(text, 'ß', 's'), ' '), lambda w: NOT list_contains({_STOP}, lower(w))) AS k FROM v_segments)"""


@query("pr13_clean_names", _clean_sql())
def pr13(t):
    return t.segments.select(*KEY, S.clean_name(F.replace("text", F.lit("ß"), F.lit("s"))).alias("name"))


@query("pr14_people_names")
def pr14(t):
    return G.people_names(t.segments)


@query("pr15_person_context")
def pr15(t):
    names = t.segments.select(*KEY, "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0)))).alias("token"))
    return names.select(*KEY, "token", G.person_context(F.col("text"), F.col("token")).alias("person"))


@query("jn18_next_different_speaker", """SELECT s.meeting_id, s.seg_id, arg_min(n.speaker, n.ord) FILTER (n.ord > s.ord AND n.ord <= s.ord + 2) AS reply,
    arg_max(n.speaker, n.ord) FILTER (n.ord < s.ord) AS before FROM v_segments s LEFT JOIN v_segments n ON n.meeting_id = s.meeting_id AND n.speaker <> s.speaker
    GROUP BY s.meeting_id, s.seg_id""")
def jn18(t):
    ahead = with_neighbours(t.segments, ["meeting_id"], "ord", 0, 2, lambda w: {"_n": F.array(F.lead("speaker", 1).over(w), F.lead("speaker", 2).over(w))})
    reply = F.try_element_at(F.filter("_n", lambda s: s.isNotNull() & (s != F.col("speaker"))), F.lit(1))
    return ahead.select(*KEY, reply.alias("reply")).join(S.previous_speaker(t.segments), KEY)


@query("ag7_name_votes")
def ag7(t):
    lines = settle(S.name_lines(t.segments))
    return S.name_scores(S.name_votes(lines), S.mutual_greetings(lines)).select("meeting_id", "speaker", "name", "weight")


@query("ag8_name_evidence")
def ag8(t):
    _, evidence = S.name_speakers(t.segments)
    return evidence.select("meeting_id", "speaker", "name", "seg_id", "kind")


@query("ag9_lower_case_share", """SELECT meeting_id, count(*) FILTER (regexp_matches(c, '^\\p{Ll}')) AS n_lower, count(*) AS n_lines FROM
    (SELECT meeting_id, substr(trim(CASE WHEN ord % 3 > 0 THEN lower(text) ELSE text END), 1, 1) AS c FROM v_segments) WHERE regexp_matches(c, '^\\p{L}') GROUP BY meeting_id""")
def ag9(t):
    s = t.segments.withColumn("text", F.when(F.col("ord") % 3 > 0, F.lower("text")).otherwise(F.col("text")))
    return S.lower_case_share(s)


@query("wn15_assign_names")
def wn15(t):
    lines = settle(S.name_lines(t.segments))
    return S.assign_names(S.name_scores(S.name_votes(lines), S.mutual_greetings(lines)))


@query("wn17_mutual_greeting")
def wn17(t):
    return S.mutual_greetings(S.name_lines(t.segments)).select("meeting_id", "ord", "speaker", "name_b", "next_speaker", "name_a")


@query("jb6_name_speakers")
def jb6(t):
    names, _ = S.name_speakers(t.segments)
    return S.relabel(t.segments, names).select(*KEY, "speaker")


@query("jn21_verify_names")
def jn21(t):
    return S.verify_names(t.name_proposals, t.segments)


_FIXES = {"v_ok": """SELECT f.meeting_id, f.seg_id, arg_max(f.target, f.pos) AS target FROM v_fixes f JOIN v_segments s USING (meeting_id, seg_id)
    SEMI JOIN v_labels l ON l.meeting_id = f.meeting_id AND l.speaker = f.target WHERE f.target <> s.speaker AND len(string_split(s.text, ' ')) <= 6 GROUP BY f.meeting_id, f.seg_id""",
    "v_fixed": """SELECT o.* FROM v_ok o JOIN (SELECT meeting_id, count(*) AS n FROM v_ok GROUP BY ALL) c USING (meeting_id)
    JOIN (SELECT meeting_id, count(*) AS m FROM v_segments GROUP BY ALL) s USING (meeting_id) WHERE n <= greatest(1, floor(m * 0.2))"""}


@query("jn22_verify_fixes", "SELECT meeting_id, seg_id, target FROM v_fixed", _FIXES)
def jn22(t):
    return S.verify_fixes(t.speaker_fixes, t.segments)


@query("jn23_relabel", "SELECT meeting_id, seg_id, CASE WHEN speaker = 'Speaker 1' AND meeting_id % 2 = 0 THEN 'Priya' ELSE speaker END AS speaker FROM v_segments")
def jn23(t):
    names = t.labels.where((F.col("speaker") == "Speaker 1") & (F.col("meeting_id") % 2 == 0)).select(
        "meeting_id", "speaker", F.lit("Priya").alias("name"))
    return S.relabel(t.segments, names).select(*KEY, "speaker")


@query("jb13_apply_names")
def jb13(t):
    from .q_verify import proposals_of

    raw = settle(t.segments)
    _, refined, p = record.apply_model_names(raw, raw, proposals_of(t))
    return refined.select("meeting_id", F.lit("line").alias("kind"), "seg_id", "speaker", "text").unionByName(
        p.sentences.select("meeting_id", F.col("section").alias("kind"), F.col("pos").cast("string").alias("seg_id"), F.col("topic").alias("speaker"), "text"))


@query("jb13_hand_rename", """SELECT DISTINCT meeting_id, speaker, replace(speaker, 'Priya', 'Prya') AS renamed FROM
    (SELECT meeting_id, CASE WHEN speaker = 'Speaker 1' THEN 'Priya Rao' ELSE speaker END AS speaker FROM v_segments) WHERE speaker = 'Priya Rao'""")
def jb13_hand(t):
    from ..operators.rename import speaker_renames

    s = t.segments.withColumn("speaker", F.when(F.col("speaker") == "Speaker 1", "Priya Rao").otherwise(F.col("speaker")))
    fix = s.select("meeting_id", F.lit("priya,").alias("old"), F.lit("Prya").alias("new")).distinct()
    fix = fix.withColumn("old", F.lit("Priya,"))
    return speaker_renames(s, fix).select("meeting_id", "speaker", "renamed")
