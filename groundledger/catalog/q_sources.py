"""Scans and ingest."""

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..operators import assemble as A, jobs as J, lexicon, transcripts
from ..sources import readers as R
from .oracle_views import lit
from .q_features import KEY
from .registry import query


@query("src1_transcripts", "SELECT meeting_id, seg_id, speaker, text, len(string_split(text, ' '))::BIGINT AS n_words FROM v_segments WHERE (meeting_id + ord) % 5 <> 0")
def src1(t):
    return R.parse_transcripts(transcript_docs(t), "doc").select("meeting_id", "seg_id", "speaker", "text", F.size("words").cast("long").alias("n_words"))


def transcript_docs(t):
    """Lines as JSON documents, one in five of them damaged."""
    row = F.struct("meeting_id", "seg_id", "ord", "start_ms", "end_ms", "speaker", "text", "words")
    return t.segments_words.select("meeting_id", "ord", F.when(
        (F.col("meeting_id") + F.col("ord")) % 5 == 0, "[{broken").otherwise(F.to_json(F.array(row))).alias("doc"))


@query("src1_unparsed", "SELECT meeting_id, ord, '[{broken' AS doc FROM v_segments WHERE (meeting_id + ord) % 5 = 0")
def src1_unparsed(t):
    return R.unparsed_transcripts(transcript_docs(t), "doc")


_SPREAD = """SELECT meeting_id, ord AS stt_seg, w, start_ms + floor((i - 1) * (end_ms - start_ms) / n)::BIGINT AS start_ms, conf FROM (SELECT meeting_id, ord, start_ms, end_ms, conf, n,
    unnest(string_split(text, ' ')) AS w, unnest(range(1, n + 1)) AS i FROM (SELECT *, len(string_split(text, ' ')) AS n, round(exp(least(0, -(ord % 7) / 10)), 4) AS conf FROM v_segments
    WHERE ord % 4 = 0))"""


@query("src3_provider_words", f"""SELECT w.meeting_id, w.ord AS stt_seg, w.w, w.start_ms, round(exp(least(0, -(w.ord % 7) / 10)), 4) AS conf FROM v_words w WHERE ord % 4 <> 0
    UNION ALL {_SPREAD}""")
def src3(t):
    segs = t.segments.withColumnRenamed("ord", "stt_seg").withColumn("avg_logprob", -(F.col("stt_seg") % 7) / 10)
    segs = segs.withColumn("end_ms", F.col("end_ms") + 200).withColumn("end_ms", F.col("end_ms") - 200)
    words = t.words.where(F.col("ord") % 4 != 0).select("meeting_id", "w", "start_ms", "end_ms")
    return A.normalize_provider(words, segs).select("meeting_id", "stt_seg", "w", "start_ms", "conf")


@query("src3_language", f"SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'de' WHEN 'fr' THEN 'fr' ELSE substr(lang, 1, 2) END AS code FROM documents")
def src3_language(t):
    names = {"en": "English", "de": "german", "fr": "French", "es": "spanish"}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return t.given("documents").select("doc_id", A.language_code(F.coalesce(F.try_element_at(m, F.col("lang")), "lang")).alias("code"))


@query("src4_provider_turns", "SELECT meeting_id, ord AS answer_no, 0 AS turn_no, start_ms / 1000 AS start_s, end_ms / 1000 AS end_s, CASE WHEN ord % 4 = 1 THEN 'A' ELSE speaker END AS label FROM v_segments")
def src4(t):
    u = F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), F.when(F.col("ord") % 4 != 1, F.col("speaker")).alias("speaker"))
    answers = t.segments.select("meeting_id", F.col("ord").alias("answer_no"), F.to_json(F.array(u)).alias("body"))
    return R.provider_turns(answers, "body")


@query("src5_lexicon", """SELECT DISTINCT lower(trim(line)) AS term FROM (SELECT replace(unnest(string_split(text, chr(10))), 'ß', 's') AS line FROM documents)
    WHERE trim(line) <> '' AND line[1] <> '#'""")
def src5(t):
    lines = t.given("documents").select(F.explode(F.split(F.replace("text", F.lit("ß"), F.lit("s")), "\n")).alias("value"))
    return lexicon.scan(lines)


@query("src6_ingest_answers")
def src6(t):
    body = F.to_json(F.struct(F.array(F.struct(
        F.col("seg_id").alias("segment_id"), "original", "replacement", "category", F.lit("").alias("rationale"), "confidence")).alias("edits")))
    raw = t.edits.select("meeting_id", "edit_idx", F.when(F.col("edit_idx") % 7 == 0, "sorry, no answer").when(
        F.col("edit_idx") % 7 == 1, F.concat(F.lit("<think>{no}</think>\n```json\n"), body, F.lit("\n```"))).when(
        F.col("edit_idx") % 7 == 2, F.lit('{"edits": [oops]}')).otherwise(F.concat(F.lit("Here: "), body, F.lit(" Done."))).alias("answer"))
    good, bad = R.ingest_answers(raw, "answer", R.EDIT)
    return good.select("meeting_id", "edit_idx", "original", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("meeting_id", "edit_idx", F.lit(None).cast("string").alias("original"), "reason"))


@query("src7_bounds", f"""SELECT meeting_id, 'edit' AS kind, edit_idx AS k FROM v_edits WHERE category IN ('acronym', 'technical_term', 'proper_noun', 'product', 'homophone', 'symbol')
    AND confidence * 1.1::DOUBLE BETWEEN 0 AND 1 UNION ALL SELECT meeting_id, 'sentence', pos FROM v_sentences WHERE len(evidence_ids) > 0""")
def src7(t):
    e = R.within_bounds(t.edits.withColumn("confidence", F.col("confidence") * 1.1))
    return e.select("meeting_id", F.lit("edit").alias("kind"), F.col("edit_idx").alias("k")).unionByName(
        R.cited_only(t.sentences).select("meeting_id", F.lit("sentence").alias("kind"), F.col("pos").alias("k")))


@query("src8_manifest", """SELECT file_id, CASE WHEN size_bytes = 0 THEN 'E_EMPTY_FILE' WHEN size_bytes > 209715200 THEN 'E_TOO_LARGE'
    WHEN lower(regexp_extract(path, '\\.([^./]*)$', 1)) NOT IN ('mp3', 'wav', 'm4a', 'ogg', 'flac', 'webm', 'mp4', 'aac') THEN 'E_UNSUPPORTED_FORMAT'
    WHEN duration_s > 7200 THEN 'E_TOO_LONG' END AS error_code FROM v_manifest""")
def src8(t):
    return t.manifest.select("file_id", R.manifest_error(F.col("path"), F.col("size_bytes"), F.col("duration_s")).alias("error_code"))


@query("src9_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def src9(t):
    return t.given("documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("src10_job_lookup", "SELECT id, title, status FROM v_jobs WHERE id = md5('17')")
def src10(t):
    import hashlib

    return J.find_job(t.jobs, hashlib.md5(b"17").hexdigest()).select("id", "title", "status")


@query("jn11_lexicon_membership", "SELECT meeting_id, ord, pos, w FROM v_words WHERE lower(regexp_replace(replace(w, 'ß', 's'), '[^\\w]', '', 'g')) IN ('whisper', 'rahul', 'gmail') AND length(w) > 0".replace(
    "IN ('whisper', 'rahul', 'gmail')", "IN (SELECT lower(x) FROM (SELECT unnest({terms}) AS x))"))
def jn11(t):
    word = F.lower(F.regexp_replace(F.replace("w", F.lit("ß"), F.lit("s")), r"[^A-Za-z0-9_]", ""))
    return t.words.withColumn("term", word).join(F.broadcast(lexicon.packaged(t.spark)), "term", "left_semi").select("meeting_id", "ord", "pos", "w")


def _patch_terms():
    from ..operators.speakers import known_terms
    from .registry import ORACLES

    ORACLES["jn11_lexicon_membership"] = ORACLES["jn11_lexicon_membership"].replace("{terms}", lit(known_terms()))


_patch_terms()


@query("jn16_already_processed", """SELECT j.id, CASE WHEN c.cloud = (j.job_no % 3 = 0) THEN c.id END AS reuse_id FROM v_jobs j LEFT JOIN
    (SELECT file_sha256, device_id, arg_max(id, (created_s, job_no)) AS id, contains(arg_max(lm2, (created_s, job_no)), '(cloud)') AS cloud FROM v_jobs
     WHERE status = 'completed' GROUP BY file_sha256, device_id) c USING (file_sha256, device_id)""")
def jn16(t):
    uploads = t.jobs.select("id", "file_sha256", "device_id", (F.col("job_no") % 3 == 0).alias("wants_cloud"))
    return J.already_processed(uploads, t.jobs, ["file_sha256", "device_id"]).select("id", "reuse_id")


@query("jb17_dedupe_recordings", """SELECT d.doc_id, CASE WHEN c.cloud = (d.doc_id % 2 = 0) THEN c.id END AS reuse_id FROM documents d LEFT JOIN
    (SELECT file_sha256, arg_max(id, (created_s, job_no)) AS id, contains(arg_max(lm2, (created_s, job_no)), '(cloud)') AS cloud FROM v_jobs
     WHERE status = 'completed' GROUP BY file_sha256) c ON c.file_sha256 = sha256(d.text)""")
def jb17(t):
    uploads = t.given("documents").select("doc_id", F.sha2("text", 256).alias("file_sha256"), (F.col("doc_id") % 2 == 0).alias("wants_cloud"))
    return J.already_processed(uploads, t.jobs, ["file_sha256"]).select("doc_id", "reuse_id")


@query("jn24_error_messages", f"""SELECT file_id, e.error_code, CASE WHEN e.error_code IS NOT NULL THEN coalesce(m.message, 'Something unexpected went wrong. Please try again.') END AS message FROM
    (SELECT file_id, CASE WHEN size_bytes = 0 THEN 'E_EMPTY_FILE' WHEN file_id % 4 = 1 THEN 'E_WHATEVER' WHEN file_id % 4 = 2 THEN 'E_TOO_LONG' END AS error_code FROM v_manifest) e
    LEFT JOIN (SELECT unnest({lit(list(C.ERROR_MESSAGES))}) AS error_code, unnest({lit(list(C.ERROR_MESSAGES.values()))}) AS message) m USING (error_code)""")
def jn24(t):
    i = F.col("file_id") % 4
    rows = t.manifest.select("file_id", F.when(F.col("size_bytes") == 0, "E_EMPTY_FILE").when(i == 1, "E_WHATEVER").when(i == 2, "E_TOO_LONG").alias("error_code"))
    return J.with_messages(rows, t.spark)


@query("ag16_listing_total", "SELECT device_id, count(*) AS total FROM v_jobs GROUP BY device_id")
def ag16(t):
    return t.jobs.groupBy("device_id").agg(F.count(F.lit(1)).alias("total"))


@query("tk1_newest_jobs", "SELECT id, created_s FROM v_jobs ORDER BY created_s DESC, job_no DESC LIMIT 50 OFFSET 10")
def tk1(t):
    return J.list_jobs(t.jobs, 50, 10).select("id", "created_s")


@query("ag17_stage_timings", "SELECT stage, sum(within_pct)::DOUBLE AS seconds FROM v_progress GROUP BY stage")
def ag17(t):
    return J.stage_timings(t.progress.select("stage", F.col("within_pct").cast("double").alias("seconds")))


@query("jb18_describe", """SELECT doc_id AS meeting_id, coalesce(CASE WHEN doc_id % 4 <> 0 THEN lang END, 'en') AS language,
    CASE WHEN doc_id % 2 = 0 THEN 'parakeet' ELSE 'skipped: ' || CASE WHEN doc_id % 3 = 0 THEN 'n/a' ELSE 'off' END || CASE WHEN doc_id % 5 = 0 THEN '; low-confidence words marked disputed instead' ELSE '' END END AS stt_check,
    CASE WHEN doc_id % 7 = 0 THEN 'skipped: off' ELSE 'ecapa' END AS diarization FROM documents""")
def jb18(t):
    d, i = t.given("documents"), F.col("doc_id")
    key = i.alias("meeting_id")
    none = F.lit(None).cast("string")
    m = d.select(key, F.lit("t").alias("title"), F.col("source").alias("source_file"), F.lit(1.0).alias("duration_s"))
    stt = d.where(i % 4 != 0).select(key, "lang", F.lit("whisper").alias("stt_model")).withColumnRenamed("lang", "language").withColumn(
        "language_probability", F.lit(0.9)).withColumn("warnings", F.array(F.lit("W_NON_ENGLISH")))
    rc = d.select(key, F.when(i % 2 == 0, "parakeet").alias("recheck_model"), F.when(i % 3 != 0, "off").alias("recheck_reason"), (i % 5 == 0).alias("fallback"))
    di = d.where(i % 7 != 0).select(key, F.lit("ecapa").alias("diarization_model"), none.alias("diarization_reason"))
    lm = d.select(key, F.lit("a").alias("lm1"), F.lit("b").alias("lm2"))
    out = J.describe_meetings(m, stt, rc, di, lm)
    return out.select("meeting_id", "language", F.col("models")["stt_check"].alias("stt_check"), F.col("models")["diarization"].alias("diarization"))
