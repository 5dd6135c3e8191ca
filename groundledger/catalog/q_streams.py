"""Streams and their batch twins."""

import uuid

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import jobs as J
from ..session import checkpoint_dir
from ..streaming import live as L
from .bindings import SLOT_MS, WORD_MS
from .oracle_views import lit
from .registry import query


@query("sm1_latest_progress", """SELECT meeting_id, arg_max(stage, (event_time, event_id)) AS stage, arg_max(status, (event_time, event_id)) AS status,
    max(event_time) AS event_time FROM v_progress GROUP BY meeting_id""")
def sm1(t):
    return L.latest_progress(t.progress).select("meeting_id", "stage", "status", "event_time")


@query("sm2_completion_feed", "SELECT event_id, meeting_id, status FROM v_progress WHERE status IN ('completed', 'failed')")
def sm2(t):
    twice = t.progress.unionByName(t.progress.where(F.col("event_id") % 10 == 0))
    return L.completion_feed(twice).select("event_id", "meeting_id", "status")


@query("sm3_interrupted_sweep", """SELECT id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status,
    CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE stage END AS stage, CASE WHEN status IN ('queued', 'running') THEN 'E_INTERNAL' END AS error_code FROM v_jobs""")
def sm3(t):
    return J.sweep_interrupted(t.jobs).select("id", "status", "stage", "error_code")


@query("sm4_sessions", """SELECT meeting_id, min(event_time) AS start_time, max(event_time) + INTERVAL 6 HOUR AS end_time, count(*) AS n FROM
    (SELECT *, sum(opens) OVER (PARTITION BY meeting_id ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING) AS g FROM
     (SELECT *, CASE WHEN event_time - lag(event_time) OVER (PARTITION BY meeting_id ORDER BY event_time, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM v_progress))
    GROUP BY meeting_id, g""")
def sm4(t):
    return L.speech_sessions(t.progress, "6 hours")


def word_stream(t):
    """Conversation turns as a stream of words (times from the turn number); the last turn of each ends its meeting."""
    schema = t.given("conversations").schema
    turns = t.spark.readStream.schema(schema).parquet(f"{t.dir}/conversations.parque[t]")  # a file or a folder of parts
    last = t.given("conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.lit(True).alias("_last"))
    said = F.coalesce(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), F.array().cast("array<string>"))
    end = F.when(F.col("_last"), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    words = turns.join(last, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", F.posexplode(F.concat(said, end)).alias("i", "w"))
    start = F.col("turn") * SLOT_MS * 20 + F.col("i") * WORD_MS
    return words.select(
        F.col("conv_id").alias("meeting_id"), F.col("turn").alias("stt_seg"), start.alias("start_ms"), (start + WORD_MS - 50).alias("end_ms"),
        "w", F.col("role").alias("speaker"))


_ABBR = lit(C.ABBREVIATIONS)
LIVE = {
    "v_live": """SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, turn) - 1 AS word_idx FROM
    (SELECT conv_id AS meeting_id, turn, role AS speaker, w, turn * 108000 + i * 250 AS start_ms, turn * 108000 + i * 250 + 200 AS end_ms FROM
     (SELECT conv_id, turn, role, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM
      (SELECT *, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS ws FROM conversations)))""",
    "v_live_ended": f"""SELECT *, regexp_matches(pw, '[.!?…][''\"”)]*$') AND NOT list_contains({_ABBR}, lower(trim(pw))) AS ended FROM
    (SELECT *, lag(speaker) OVER o AS ps, lag(end_ms) OVER o AS pe, lag(w) OVER o AS pw, lag(turn) OVER o AS pt FROM v_live
     WINDOW o AS (PARTITION BY meeting_id ORDER BY word_idx))""",
    "v_live_cut": """SELECT meeting_id, word_idx, word_idx AS head, start_ms AS hs, end_ms, speaker FROM v_live_ended WHERE word_idx = 0 UNION ALL
    SELECT meeting_id, word_idx, CASE WHEN split THEN word_idx ELSE head END, CASE WHEN split THEN start_ms ELSE hs END, end_ms, speaker FROM
    (SELECT n.*, c.head, c.hs, n.speaker IS DISTINCT FROM n.ps OR n.start_ms - n.pe > 1000 OR n.end_ms - c.hs > 30000 OR n.word_idx - c.head >= 60
     OR (n.ended AND (n.turn <> n.pt OR n.word_idx - c.head >= 12)) AS split
     FROM v_live_cut c JOIN v_live_ended n ON n.meeting_id = c.meeting_id AND n.word_idx = c.word_idx + 1)""",
}


@query("sm5_live_lines", """SELECT meeting_id, min(hs) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words, min(speaker) AS speaker
    FROM v_live_cut GROUP BY meeting_id, head""", LIVE)
def sm5(t):
    folder = f"{checkpoint_dir(t.spark)}/live-{uuid.uuid4().hex}"
    return L.run_to_table(L.live_lines(word_stream(t)), folder)


@query("sm6_dispute_alerts", "SELECT meeting_id, ord, pos, w FROM v_words WHERE pct < 45")
def sm6(t):
    return L.dispute_alerts(t.words).select("meeting_id", "ord", "pos", "w")


@query("sm7_resume", """SELECT DISTINCT meeting_id FROM v_progress WHERE meeting_id NOT IN
    (SELECT meeting_id FROM v_progress WHERE stage = 'verifying' AND status = 'completed')""")
def sm7(t):
    done = t.progress.where((F.col("stage") == "verifying") & (F.col("status") == "completed"))
    return J.unfinished(t.progress.select("meeting_id").distinct(), done, ["meeting_id"])
