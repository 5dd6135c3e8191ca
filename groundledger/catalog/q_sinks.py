"""Documents written from a record."""

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import jobs as J
from ..sources import sinks as K
from .oracle_views import lit
from .q_features import KEY
from .q_verify import whole_record
from .registry import query

_TXT = """SELECT meeting_id, 0::BIGINT AS part, string_agg('[' || printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) || '] ' || speaker || ': ' || text,
    chr(10) ORDER BY ord) || chr(10) AS text FROM v_segments GROUP BY meeting_id"""


@query("snk2_transcript_text", _TXT)
def snk2(t):
    return K.transcript_text(t.segments)


@query("snk1_record_json")
def snk1(t):
    r = whole_record(t)
    return K.record_json(r.refined, r.sentences, r.decisions, r.open_proposals, r.tasks, r.fidelity)


def items(t):
    d = t.decisions.select("meeting_id", "pos", F.concat(F.lit("D"), F.col("pos").cast("string")).alias("id"), "decision", "agreement", "evidence_ids")
    p = t.proposals.withColumn("demoted", F.col("pos") % 2 == 0)
    k = t.tasks.select("meeting_id", "pos", F.concat(F.lit("T"), F.col("pos").cast("string")).alias("id"), F.concat("task", F.lit("|")).alias("task"),
                       F.coalesce("owner_words", F.lit(C.UNSPECIFIED)).alias("owner"), F.coalesce("deadline_words", F.lit(C.UNSPECIFIED)).alias("deadline"), "evidence_ids")
    return d, p, k


def meetings(t):
    return t.given("conversations").select(F.col("conv_id").alias("meeting_id")).distinct().withColumn(
        "title", F.concat(F.lit("Meeting "), F.col("meeting_id").cast("string")))


_CITE = "array_to_string(list_transform(evidence_ids, lambda i: '[' || i || ']'), ' ')"
MD = {"v_meet": "SELECT DISTINCT meeting_id, 'Meeting ' || meeting_id AS title FROM v_lines",
      "v_minutes": "SELECT *, lower(trim(topic)) AS k, min(pos) OVER (PARTITION BY meeting_id, lower(trim(topic))) AS a0, first_value(topic) OVER (PARTITION BY meeting_id, lower(trim(topic)) ORDER BY pos) AS t0 FROM v_sentences WHERE section = 'minutes'",
      "v_body": f"""SELECT meeting_id, 1 AS s, 1 AS a, pos AS b, text || ' ' || {_CITE} AS line FROM v_sentences WHERE section = 'summary'
    UNION ALL SELECT DISTINCT meeting_id, 2, a0 + 1, -1, '### ' || trim(t0) FROM v_minutes
    UNION ALL SELECT meeting_id, 2, a0 + 1, pos, '- ' || text || ' ' || {_CITE} FROM v_minutes
    UNION ALL SELECT meeting_id, 3, 1, pos, '- **D' || pos || '** ' || decision || ' (agreement: "' || agreement || '") ' || {_CITE} FROM v_decisions
    UNION ALL SELECT meeting_id, 4, 1, pos, '- ' || proposal || CASE WHEN pos % 2 = 0 THEN ' _(no clear agreement)_' ELSE '' END || ' ' || {_CITE} FROM v_proposals
    UNION ALL SELECT meeting_id, 5, 2, pos, '| T' || pos || ' | ' || replace(task || '|', '|', '\\|') || ' | ' || coalesce(owner_words, 'Unspecified') || ' | ' || coalesce(deadline_words, 'Unspecified') || ' | ' || array_to_string(evidence_ids, ', ') || ' |' FROM v_tasks""",
      "v_md": f"""SELECT * FROM v_body UNION ALL SELECT meeting_id, 0, 0, -1, '# ' || title FROM v_meet
    UNION ALL SELECT meeting_id, x.s, 0, -1, x.h FROM v_meet, (SELECT unnest([1, 2, 3, 4, 5]) AS s, unnest({lit([K.HEADINGS[s] for s in K.SECTIONS])}) AS h) x
    UNION ALL SELECT m.meeting_id, x.s, 1, -1, x.e FROM v_meet m, (SELECT unnest([1, 2, 3, 4, 5]) AS s, unnest({lit([K.EMPTY[s] for s in K.SECTIONS])}) AS e) x
      WHERE NOT EXISTS (SELECT 1 FROM v_body b WHERE b.meeting_id = m.meeting_id AND b.s = x.s)
    UNION ALL SELECT DISTINCT meeting_id, 5, 1, -1, '| # | Task | Owner | Deadline | Evidence |' || chr(10) || '|---|---|---|---|---|' FROM v_body WHERE s = 5""",
      "v_mddoc": "SELECT meeting_id, 0::BIGINT AS part, string_agg(line, chr(10) ORDER BY s, a, b) || chr(10) AS text FROM v_md GROUP BY meeting_id"}


@query("snk3_record_markdown", "SELECT meeting_id, part, text FROM v_mddoc", MD)
def snk3(t):
    d, p, k = items(t)
    return K.markdown_documents(K.markdown_lines(meetings(t), t.sentences, d, p, k))


@query("jb16_render", f"SELECT 'md' AS fmt, meeting_id, part, text FROM v_mddoc UNION ALL SELECT 'txt_raw', * FROM ({_TXT})", MD)
def jb16(t):
    d, p, k = items(t)
    md = K.markdown_documents(K.markdown_lines(meetings(t), t.sentences, d, p, k))
    return md.withColumn("fmt", F.lit("md")).unionByName(K.transcript_text(t.segments).withColumn("fmt", F.lit("txt_raw")))


@query("snk4_export_manifest", "SELECT meeting_id, title, 'record.md' AS md, 'transcript_raw.txt' AS txt_raw FROM v_meet", MD)
def snk4(t):
    m = K.export_manifest(meetings(t))
    return m.select("meeting_id", "title", F.col("files")["md"].alias("md"), F.col("files")["txt_raw"].alias("txt_raw"))


@query("snk4_all_files")
def snk4_all(t):
    return K.export_manifest(meetings(t)).select("meeting_id", "title", *[F.col("files")[k].alias(k) for k in C.EXPORT_FILES])


@query("snk5_hand_edits", """SELECT meeting_id, seg_id, CASE WHEN ord % 3 = 0 THEN 'fixed ' || text ELSE text END AS text, CASE WHEN ord % 3 = 0 THEN text END AS original_text FROM v_segments""")
def snk5(t):
    edited = t.segments.where(F.col("ord") % 3 == 0).select(*KEY, F.concat(F.lit("fixed "), "text").alias("text"))
    return K.overlay_edits(t.segments, edited, KEY, ["text"])


CHANGES = {"v_changes": """SELECT id, (['rename', 'cancel', 'retry', 'delete'])[job_no % 4 + 1] AS kind, CASE WHEN job_no % 8 = 0 THEN '  ' ELSE ' New ' || job_no END AS title FROM v_jobs WHERE job_no % 3 <> 2"""}


@query("snk6_job_changes", """SELECT j.id, CASE WHEN c.kind = 'rename' AND trim(c.title) <> '' THEN trim(c.title) ELSE j.title END AS title,
    CASE WHEN c.kind = 'cancel' AND active THEN 'failed' WHEN c.kind = 'retry' AND status = 'failed' THEN 'queued' ELSE status END AS status,
    CASE WHEN c.kind = 'cancel' AND active THEN 'E_CANCELLED' END AS error_code FROM (SELECT *, status IN ('queued', 'running') AS active FROM v_jobs) j LEFT JOIN v_changes c USING (id)
    WHERE c.kind IS NULL OR c.kind <> 'delete' OR active""", CHANGES)
def snk6(t):
    n = F.col("job_no")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("rename", "cancel", "retry", "delete")]), (n % 4 + 1).cast("int"))
    changes = t.jobs.where(n % 3 != 2).select(
        "id", kind.alias("kind"), F.when(n % 8 == 0, "  ").otherwise(F.concat(F.lit(" New "), n.cast("string"))).alias("title"), F.col("created_s").alias("ts"))
    return J.apply_changes(t.jobs, changes).select("id", "title", "status", "error_code")
