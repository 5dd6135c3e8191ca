"""The derived tables of ``bindings`` as DuckDB common table expressions."""

from __future__ import annotations

import re

from . import cases
from .bindings import LINE_WORDS, OPENING_WORDS
from .. import constants as C


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return str(v)
    if isinstance(v, (list, tuple)):
        if not v:
            return "[]"
        inner = ", ".join(lit(x) for x in v)
        kind = "VARCHAR[]" if isinstance(v[0], str) else "INTEGER[]"
        return f"[{inner}]::{kind}"
    return "'" + str(v).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows) + f") AS t({columns})"


def _case(rows: list[tuple], columns: str, select: str) -> str:
    return f"SELECT l.meeting_id, {select} FROM v_lines l JOIN {values(rows, columns)} ON t.p = l.p"


_IDS = "list_transform(t.offs, lambda o: printf('S%03d', l.ord + o)) AS evidence_ids"
_POS = "l.ord * 10 + t.k"
_STAGE_LIST = lit([s for s, _ in C.STAGES])

VIEWS = {
    "v_lines": """SELECT conv_id AS meeting_id, turn, role, text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord,
        CAST((conv_id * 7 + turn * 3) % 24 AS INTEGER) AS p FROM conversations""",
    "v_labels": """SELECT conv_id AS meeting_id, role AS label, 'Speaker ' || dense_rank() OVER (
        PARTITION BY conv_id ORDER BY min(turn), role) AS speaker FROM conversations GROUP BY conv_id, role""",
    "v_said": f"""SELECT l.meeting_id, l.turn, s.speaker, t.phrase, t.whole, CASE WHEN t.whole THEN 0 ELSE {OPENING_WORDS} END AS taken,
        string_split(trim(regexp_replace(l.text, '\\s+', ' ', 'g')), ' ') AS said
        FROM v_lines l JOIN {values(cases.PHRASES, 'p, phrase, whole')} ON t.p = l.p
        JOIN v_labels s ON s.meeting_id = l.meeting_id AND s.label = l.role""",
    "v_parts": f"""SELECT *, unnest(range(0, 1 + CAST(ceil(greatest(len(said) - taken, 0) / {LINE_WORDS}) AS BIGINT))) AS part FROM v_said""",
    "v_seg0": f"""SELECT meeting_id, turn, speaker, text, row_number() OVER (PARTITION BY meeting_id ORDER BY part > 0, turn, part) AS ord
        FROM (SELECT meeting_id, turn, speaker, part, CASE
            WHEN part > 0 THEN array_to_string(said[taken + (part - 1) * {LINE_WORDS} + 1:taken + part * {LINE_WORDS}], ' ')
            WHEN whole THEN phrase ELSE phrase || ' ' || array_to_string(said[1:{OPENING_WORDS}], ' ') END AS text FROM v_parts)
        WHERE part = 0 OR text <> ''""",
    "v_segments": """SELECT meeting_id, ord, printf('S%03d', ord) AS seg_id, speaker, text,
        (ord - 1) * 5400 + CASE WHEN (meeting_id + turn) % 4 = 0 THEN 700 ELSE 0 END AS start_ms,
        (ord - 1) * 5400 + CASE WHEN (meeting_id + turn) % 4 = 0 THEN 700 ELSE 0 END
            + len(string_split(text, ' ')) * 250 AS end_ms FROM v_seg0""",
    "v_words": """SELECT meeting_id, ord, pos, w, start_ms + (pos - 1) * 250 AS start_ms,
        start_ms + (pos - 1) * 250 + CASE WHEN pct % 5 = 0 THEN 250 ELSE 200 END AS end_ms, pct / 100 AS conf,
        pct, pct < 12 AS disputed, CASE WHEN pct < 12 THEN '~' || w END AS alt
        FROM (SELECT *, (meeting_id * 37 + ord * 13 + pos * 11) % 100 AS pct
              FROM (SELECT meeting_id, ord, start_ms, unnest(string_split(text, ' ')) AS w,
                           unnest(range(1, len(string_split(text, ' ')) + 1)) AS pos FROM v_segments))""",
    "v_turns": """SELECT meeting_id, ord AS turn_no,
        start_ms + CASE WHEN ord % 2 = 0 THEN 120 ELSE -120 END AS start_ms,
        CASE WHEN (meeting_id + ord) % 5 = 0 THEN start_ms + 200 ELSE end_ms END
            + CASE WHEN ord % 2 = 0 THEN 120 ELSE -120 END AS end_ms, speaker FROM v_segments""",
    "v_edits": _case(
        cases.EDITS, "p, k, original, replacement, category, pct, off",
        f"{_POS} AS edit_idx, printf('S%03d', l.ord + t.off) AS seg_id, original, replacement, category, "
        "pct / 100 AS confidence",
    ),
    "v_sentences": _case(
        cases.SENTENCES, "p, k, section, topic, text, offs", f"section, topic, {_POS} AS pos, t.text, {_IDS}"
    ),
    "v_decisions": _case(
        cases.DECISIONS, "p, k, decision, agreement, offs", f"{_POS} AS pos, decision, agreement, {_IDS}"
    ),
    "v_proposals": _case(cases.PROPOSALS, "p, k, proposal, offs", f"{_POS} AS pos, proposal, {_IDS}"),
    "v_tasks": _case(
        cases.TASKS, "p, k, task, quote, oo, owner_words, dd, deadline_words, offs",
        f"{_POS} AS pos, task, quote, CASE WHEN oo IS NOT NULL THEN printf('S%03d', l.ord + oo) END AS owner_seg, "
        f"owner_words, CASE WHEN dd IS NOT NULL THEN printf('S%03d', l.ord + dd) END AS deadline_seg, deadline_words, "
        + _IDS,
    ),
    "v_names": _case(cases.NAMES, "p, k, label, name", f"{_POS} AS pos, label, name, printf('S%03d', l.ord) AS seg_id"),
    "v_fixes": _case(cases.FIXES, "p, k, target", f"{_POS} AS pos, printf('S%03d', l.ord) AS seg_id, target"),
    "v_vocab": _case(
        cases.VOCABULARY, "p, k, domain, term, heard_as, offs",
        f"l.ord // 3 AS part, {_POS} AS pos, domain, term, heard_as, {_IDS}",
    ),
    "v_jobs": f"""SELECT md5(CAST(doc_id AS VARCHAR)) AS id, doc_id AS job_no, 'Recording ' || doc_id AS title,
        'rec' || doc_id || '.mp3' AS source_file, sha256(text) AS file_sha256, status,
        CASE WHEN status = 'running' THEN ({_STAGE_LIST})[doc_id % 13 + 1] ELSE status END AS stage,
        'dev' || (doc_id % 7) AS device_id, 1700000000 + doc_id * 61 % 50021 AS created_s,
        CASE WHEN doc_id % 3 = 0 THEN 'gpt (cloud)' ELSE 'local model' END AS lm2
        FROM (SELECT doc_id, text, (['completed', 'failed', 'queued', 'running', 'completed'])[doc_id % 5 + 1] AS status
              FROM documents)""",
    "v_manifest": """SELECT page_id AS file_id, url || '/call.' || (['mp3', 'wav', 'txt', 'MP4', 'flac'])[page_id % 5 + 1]
        AS path, CASE WHEN page_id % 11 = 0 THEN 0 ELSE length(html) * 30000 END AS size_bytes,
        length(html) % 9000 AS duration_s FROM pages""",
    "v_progress": f"""SELECT user_id AS meeting_id, event_id, ts AS event_time,
        ({_STAGE_LIST})[event_id % 13 + 1] AS stage,
        CASE event_type WHEN 'signup' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'queued'
             ELSE 'running' END AS status, event_id * 7 % 50 * 2 AS within_pct FROM events""",
    "v_voices": """SELECT vec_id % 5 AS meeting_id, vec_id AS burst_idx, label, 0.5::DOUBLE + (vec_id * 7 % 40) / 10 AS dur_s,
        embedding FROM embeddings""",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with exactly the views it needs."""
    views = {**VIEWS, **(extra or {})}
    needed: set[str] = set()
    queue = [sql]
    while queue:
        for name in re.findall(r"\bv_\w+", queue.pop()):
            if name in views and name not in needed:
                needed.add(name)
                queue.append(views[name])
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in re.findall(r"\bv_\w+", views[name]):
            if dep in views and dep != name and dep not in order:
                visit(dep)
        order.append(name)

    for name in sorted(needed):
        visit(name)
    if not order:
        return sql
    recursive = any(re.search(rf"\b{n}\b", views[n]) for n in order)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({views[n]})" for n in order) + "\n" + sql
