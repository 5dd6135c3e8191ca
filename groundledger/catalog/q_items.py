"""Candidate lines, prompts, and merging of per-part outputs."""

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..operators import items as I, verify as V
from ..operators.ordered import settle
from .q_features import KEY, agree_sql, has_sql
from .oracle_views import lit
from .q_ordered import CHUNKS, MEMBERS
from .registry import query


_ACCEPT = f"({has_sql('text', C.BARE_AGREE)} OR (len(string_split(text, ' ')) <= 12 AND {has_sql('text', C.REPLY_AGREE)}))"
CAND = {"v_cues": f"""SELECT *, coalesce(lead({_ACCEPT}) OVER o AND lead(speaker) OVER o <> speaker, false) AS replied, lead(seg_id) OVER o AS nxt,
    {has_sql('text', C.TASK_CUE)} AS t, {agree_sql('text', C.DECISION_CUE)} AS d, {has_sql('text', C.PROPOSAL_CUE)} AS p0 FROM v_segments
    WINDOW o AS (PARTITION BY meeting_id ORDER BY ord)""",
        "v_cand": """SELECT meeting_id, seg_id, CASE WHEN agreed THEN seg_id || '|' || nxt ELSE seg_id END AS ids,
    array_to_string(list_filter([CASE WHEN t THEN 'task' END, CASE WHEN d OR (agreed AND NOT t) THEN 'decision' END, CASE WHEN p0 AND NOT agreed THEN 'proposal' END],
    lambda x: x IS NOT NULL), '|') AS kinds FROM (SELECT *, replied AND (t OR d OR p0 OR contains(text, '?')) AS agreed FROM v_cues) WHERE t OR d OR p0 OR agreed"""}


@query("wn18_candidates", "SELECT meeting_id, seg_id, ids, kinds FROM v_cand", CAND)
def wn18(t):
    return I.find_candidates(V.line_context(t.segments)).select(*KEY, F.array_join("ids", "|").alias("ids"), F.array_join("kinds", "|").alias("kinds"))


@query("jb7_candidates", "SELECT meeting_id, replace(kinds, '|', '/') AS kinds, count(*) AS n FROM v_cand GROUP BY ALL", CAND)
def jb7(t):
    c = I.find_candidates(V.line_context(t.segments))
    return c.groupBy("meeting_id", F.array_join("kinds", "/").alias("kinds")).agg(F.count(F.lit(1)).alias("n"))


_CHECK = """{head} || string_agg('- [' || replace(c.ids, '|', ', ') || '] looks like: ' || replace(c.kinds, '|', ' / '), chr(10) ORDER BY s.ord)""".format(head=lit(C.CHECKLIST_HEAD))


@query("sf26_checklist", f"""SELECT s.meeting_id, s.ord // 4 AS part, {_CHECK} AS checklist FROM v_cand c JOIN v_segments s USING (meeting_id, seg_id)
    GROUP BY s.meeting_id, s.ord // 4""", CAND)
def sf26(t):
    c = I.find_candidates(V.line_context(t.segments)).withColumn("part", F.floor(F.col("ord") / 4))
    return I.checklist(c, ["meeting_id", "part"])


_BATCH = {**CHUNKS, **CAND, "v_members": f"SELECT m.*, s.ord, s.speaker, s.text FROM ({MEMBERS}) m JOIN v_segments s USING (meeting_id, seg_id)",
          "v_checks": f"SELECT s.meeting_id, s.chunk_no, {_CHECK} AS checklist FROM v_members s JOIN v_cand c USING (meeting_id, seg_id) GROUP BY s.meeting_id, s.chunk_no"}


@query("jb8_prompt_batches", """SELECT meeting_id, chunk_no, CAST(count(*) AS INTEGER) AS n_lines, 'TRANSCRIPT' || chr(10)
    || string_agg('[' || seg_id || '] (' || speaker || ') ' || text, chr(10) ORDER BY ord) || coalesce(any_value(checklist), '') AS prompt
    FROM v_members LEFT JOIN v_checks USING (meeting_id, chunk_no) GROUP BY meeting_id, chunk_no""", _BATCH)
def jb8(t):
    return I.prompt_batches(t.segments, 60)


@query("jb8_refine_prompts")
def jb8_refine(t):
    return I.refine_prompts(t.segments_words, 3, 2)


_VOCAB = {"v_terms": "SELECT *, lower(trim(term)) AS key FROM v_vocab WHERE trim(term) <> ''"}


def _union(col):
    return f"(SELECT string_agg(DISTINCT x, '|' ORDER BY x) FROM (SELECT unnest({col}) AS x FROM v_terms u WHERE u.meeting_id = m.meeting_id AND u.key = m.key))"


@query("ag5_vocabulary", f"""SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY first_pos) AS rank, term, coalesce({_union('heard_as')}, '') AS heard,
    coalesce({_union('evidence_ids')}, '') AS ids FROM (SELECT meeting_id, key, arg_min(term, pos) AS term, min(pos) AS first_pos FROM v_terms GROUP BY meeting_id, key) m
    QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY first_pos) <= 60""", _VOCAB)
def ag5(t):
    return I.merge_vocabulary(t.vocab_terms).select("meeting_id", "rank", "term", F.array_join("heard_as", "|").alias("heard"), F.array_join("evidence_ids", "|").alias("ids"))


@query("ag5_domain", "SELECT meeting_id, coalesce(arg_min(domain, pos) FILTER (domain <> ''), 'unknown') AS domain FROM v_vocab GROUP BY meeting_id")
def ag5_domain(t):
    return I.first_domain(t.vocab_terms)


_MIN = {"v_min": "SELECT * FROM v_sentences WHERE section = 'minutes'"}


@query("ag10_topics", """SELECT x.meeting_id, topic_pos, t.topic, x.pos, x.text FROM (SELECT meeting_id, lower(trim(topic)) AS key, text, min(pos) AS pos FROM v_min GROUP BY ALL) x
    JOIN (SELECT meeting_id, lower(trim(topic)) AS key, arg_min(topic, pos) AS topic, min(pos) AS topic_pos FROM v_min GROUP BY meeting_id, lower(trim(topic))) t USING (meeting_id, key)""", _MIN)
def ag10(t):
    return I.merge_topics(t.sentences.where(F.col("section") == "minutes")).drop("evidence_ids")


@query("ag11_last_writer", """SELECT meeting_id, seg_id AS k, arg_max(target, pos) AS v FROM v_fixes GROUP BY meeting_id, seg_id
    UNION ALL SELECT meeting_id, label || '/' || lower(name), arg_max(seg_id, pos) FROM v_names GROUP BY meeting_id, label, lower(name)""")
def ag11(t):
    f = I.last_by(t.speaker_fixes, ["meeting_id", "seg_id"], "target").toDF("meeting_id", "k", "v")
    names = t.name_proposals.withColumn("k", F.concat("label", F.lit("/"), F.lower("name")))
    return f.unionByName(I.last_by(names, ["meeting_id", "k"], "seg_id").withColumnRenamed("seg_id", "v"))


@query("ag18_item_counts", """SELECT m.meeting_id, coalesce(d, 0) AS n_decisions, coalesce(k, 0) AS n_tasks FROM (SELECT DISTINCT meeting_id FROM v_lines) m
    LEFT JOIN (SELECT meeting_id, count(*) AS d FROM v_decisions GROUP BY ALL) x USING (meeting_id)
    LEFT JOIN (SELECT meeting_id, count(*) AS k FROM v_tasks GROUP BY ALL) y USING (meeting_id)""")
def ag18(t):
    both = t.decisions.select("meeting_id", F.lit("d").alias("k")).unionByName(t.tasks.select("meeting_id", F.lit("t").alias("k"))).unionByName(
        t.lines.select("meeting_id", F.lit("l").alias("k")))
    return both.groupBy("meeting_id").agg(F.count_if(F.col("k") == "d").alias("n_decisions"), F.count_if(F.col("k") == "t").alias("n_tasks"))


@query("st1_union_parts", """SELECT meeting_id, 'decision' AS kind, pos, decision AS item FROM v_decisions UNION ALL SELECT meeting_id, 'proposal', pos, proposal FROM v_proposals
    UNION ALL SELECT meeting_id, 'task', pos, task FROM v_tasks""")
def st1(t):
    return (
        t.decisions.select("meeting_id", F.lit("decision").alias("kind"), "pos", F.col("decision").alias("item"))
        .unionByName(t.proposals.select("meeting_id", F.lit("proposal").alias("kind"), "pos", F.col("proposal").alias("item")))
        .unionByName(t.tasks.select("meeting_id", F.lit("task").alias("kind"), "pos", F.col("task").alias("item")))
    )


_SUM = {"v_sum": "SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY meeting_id) AS n FROM v_sentences",
        "v_pick": "SELECT meeting_id, unnest([3, 0, 3, 77, 2]) AS i FROM (SELECT DISTINCT meeting_id FROM v_sentences WHERE meeting_id % 2 = 0)",
        "v_use": "SELECT DISTINCT p.meeting_id, p.i FROM v_pick p JOIN v_sum s ON s.meeting_id = p.meeting_id AND s.i = p.i AND s.n > 3"}


@query("tk2_summary_pick", """SELECT s.meeting_id, s.pos FROM v_sum s JOIN v_use u USING (meeting_id, i) UNION ALL SELECT s.meeting_id, s.pos FROM v_sum s
    ANTI JOIN v_use u USING (meeting_id) WHERE s.i < 3""", _SUM)
def tk2(t):
    keep = F.array(*[F.lit(k) for k in (3, 0, 3, 77, 2)]).cast("array<bigint>")
    picks = t.sentences.where(F.col("meeting_id") % 2 == 0).select("meeting_id").distinct().withColumn("keep", keep)
    return I.pick_summary(t.sentences, picks, 3).select("meeting_id", "pos")


_X = {"v_x": "SELECT s.* REPLACE (CASE meeting_id % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'minutes' ELSE section END AS section) FROM v_sentences s",
      "v_h": "SELECT meeting_id, bool_or(section = 'summary') AS s, bool_or(section = 'minutes') AS m FROM v_x GROUP BY meeting_id"}


@query("tk3_cross_populate", """SELECT meeting_id, section, topic, pos FROM v_x UNION ALL
    SELECT meeting_id, 'minutes', 'General Discussion', pos FROM v_x JOIN v_h USING (meeting_id) WHERE s AND NOT m AND len(evidence_ids) > 0 UNION ALL
    SELECT meeting_id, 'summary', '', pos FROM v_x JOIN v_h USING (meeting_id) WHERE m AND NOT s AND len(evidence_ids) > 0
    QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY pos) <= 5""", _X)
def tk3(t):
    m = F.col("meeting_id") % 3
    rows = t.sentences.withColumn("section", F.when(m == 0, "summary").when(m == 1, "minutes").otherwise(F.col("section")))
    return I.cross_populate(rows).select("meeting_id", "section", "topic", "pos")


@query("jn19_near_duplicates")
def jn19(t):
    both = t.decisions.select("meeting_id", "pos", F.col("decision").alias("item"), "evidence_ids").unionByName(
        t.proposals.select("meeting_id", (F.col("pos") + 100_000).alias("pos"), F.col("proposal").alias("item"), "evidence_ids"))
    return I.dedupe_items(both, "item").select("meeting_id", "pos", "merged_into", F.array_join("evidence_ids", "|").alias("ids"))


@query("jb9_merge_parts")
def jb9(t):
    topics = I.merge_topics(t.sentences.where(F.col("section") == "minutes"))
    both = t.decisions.select("meeting_id", F.lit("decision").alias("kind"), "pos", F.col("decision").alias("item"), "evidence_ids").unionByName(
        t.tasks.select("meeting_id", F.lit("task").alias("kind"), "pos", F.col("task").alias("item"), "evidence_ids"))
    kept = I.dedupe_items(both, "item", ["meeting_id", "kind"]).where(F.col("merged_into").isNull())
    out = topics.select("meeting_id", F.lit("point").alias("kind"), "pos", "text", "evidence_ids").unionByName(
        kept.select("meeting_id", "kind", "pos", "text", "evidence_ids"))
    return out.select("meeting_id", "kind", "pos", "text", F.array_join("evidence_ids", "|").alias("ids"))
