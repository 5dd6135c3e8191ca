"""Predicates and projections over lines, words and documents."""

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..functions.repeats import repeated_phrase_col
from ..operators import transcripts
from .oracle_views import lit
from .registry import query

_WORDS = lit(list(C.WORD_DIGITS))
_DIGITS = lit(list(C.WORD_DIGITS.values()))


def ascii_sql(col: str) -> str:
    """Accented letters become plain ones, so that RE2's ASCII word boundaries agree with Unicode ones."""
    return f"regexp_replace({col}, '[^\\x00-\\x7F]', 'q', 'g')"


def rx(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def norm_sql(t: str) -> str:
    n = f"trim(regexp_replace(lower({t}), '[^\\w'']+', '', 'g'), '''')"
    return f"coalesce(({_DIGITS})[list_position({_WORDS}, {n})], {n})"


def numbers_sql(col: str) -> str:
    return f"list_sort(list_transform(regexp_extract_all({ascii_sql(col)}, {rx(C.NUMBER)}), lambda x: {norm_sql('x')}))"


def count_sql(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({ascii_sql(col)}, {rx(pattern)}))"


def modal_sql(col: str) -> str:
    return (f"list_sort(list_distinct(list_transform(regexp_extract_all({ascii_sql(col)}, {rx(C.MODAL)}), "
            "lambda x: lower(x))))")


def has_sql(col: str, pattern: str) -> str:
    return f"regexp_matches({ascii_sql(col)}, {rx(pattern)})"


_EXCLUDED = "what|that|as|here|there|how|where|who|which|this"
_LOOKAHEAD = r"|\b(?!(?:" + _EXCLUDED + r")\b)[A-Za-z0-9]+ it is[.!]"


def agree_sql(col: str, pattern: str) -> str:
    """RE2 has no look-ahead: the excluded first words of "... it is." are tested on the extracted word."""
    rest = pattern.replace(_LOOKAHEAD, "")
    words = lit(_EXCLUDED.split("|"))
    found = f"regexp_extract_all({ascii_sql(col)}, '(?i)\\b([A-Za-z0-9]+) it is[.!]', 1)"
    return f"({has_sql(col, rest)} OR len(list_filter({found}, lambda w: NOT list_contains({words}, lower(w)))) > 0)"


TOKEN_SQL = r"([^A-Za-z]*?)([A-Za-z][\w''.-]*)"
CAPS = {"v_caps": f"""SELECT meeting_id, seg_id, text, list_filter(list_transform(list_filter(range(1, len(toks) + 1), lambda i:
    regexp_matches(toks[i], '^[A-Z]') AND NOT regexp_full_match(rtrim(toks[i], '.'), 'I(''(m|ll|d|ve))?')
    AND NOT regexp_matches(CASE WHEN trim(pre[i]) = '' THEN CASE WHEN i = 1 THEN '.' ELSE toks[i - 1] END ELSE trim(pre[i]) END, '[.!?:;"''(\\[]$')),
    lambda i: regexp_replace(rtrim(toks[i], '.'), '''s$', '')), lambda x: x <> '') AS caps
    FROM (SELECT meeting_id, seg_id, text, regexp_extract_all({ascii_sql('text')}, '{TOKEN_SQL}', 2) AS toks,
    regexp_extract_all({ascii_sql('text')}, '{TOKEN_SQL}', 1) AS pre FROM v_segments)"""}

KEY = ["meeting_id", "seg_id"]


@query("pr1_numbers", f"SELECT doc_id, array_to_string({numbers_sql('text')}, '|') AS nums FROM documents")
def pr1(t):
    return t.given("documents").select("doc_id", F.array_join(T.numbers(F.col("text")), "|").alias("nums"))


@query("pr2_negations", f"SELECT doc_id, {count_sql('text', C.NEGATION)} AS negations FROM documents")
def pr2(t):
    return t.given("documents").select("doc_id", T.negation_count(F.col("text")).cast("long").alias("negations"))


@query("pr3_modals", f"SELECT meeting_id, seg_id, array_to_string({modal_sql('text')}, '|') AS modals FROM v_segments")
def pr3(t):
    return t.segments.select(*KEY, F.array_join(T.modal_set(F.col("text")), "|").alias("modals"))


@query("pr4_capitalized", "SELECT meeting_id, seg_id, array_to_string(caps, '|') AS names FROM v_caps", CAPS)
def pr4(t):
    names = F.array_join(T.capitalized_non_initial(F.col("text")), "|")
    return t.segments.select(*KEY, F.regexp_replace(names, r"[^\x00-\x7F]", "q").alias("names"))


@query("pr5_high_stakes", f"SELECT meeting_id, seg_id, {has_sql('text', '|'.join((C.NUMBER, C.NEGATION, C.MODAL, C.TIME_WORD, C.COMMITMENT)))} "
       "OR len(caps) > 0 AS high_stakes FROM v_caps", CAPS)
def pr5(t):
    return t.segments.select(*KEY, T.high_stakes(F.col("text")).alias("high_stakes"))


@query("pr6_task_cue", f"SELECT meeting_id, seg_id, {has_sql('text', C.TASK_CUE)} AS task_cue FROM v_segments")
def pr6(t):
    return t.segments.select(*KEY, T.cue(F.col("text"), C.TASK_CUE).alias("task_cue"))


@query("pr7_decision_cue", f"SELECT meeting_id, seg_id, {agree_sql('text', C.DECISION_CUE)} AS decision_cue FROM v_segments")
def pr7(t):
    return t.segments.select(*KEY, T.cue(F.col("text"), C.DECISION_CUE).alias("decision_cue"))


@query("pr8_proposal_cue", f"SELECT meeting_id, seg_id, {has_sql('text', C.PROPOSAL_CUE)} AS proposal_cue FROM v_segments")
def pr8(t):
    return t.segments.select(*KEY, T.cue(F.col("text"), C.PROPOSAL_CUE).alias("proposal_cue"))


@query("pr9_commit_request", f"SELECT meeting_id, seg_id, {has_sql('text', C.FIRST_PERSON_COMMIT)} AS commits, "
       f"{has_sql('text', C.REQUEST)} AS requests FROM v_segments")
def pr9(t):
    text = F.col("text")
    return t.segments.select(
        *KEY, T.cue(text, C.FIRST_PERSON_COMMIT).alias("commits"), T.cue(text, C.REQUEST).alias("requests")
    )


@query("pr10_agreeing_text", f"SELECT meeting_id, seg_id, {has_sql('text', C.BARE_AGREE)} AS bare, "
       f"len(string_split(text, ' ')) <= 12 AND {has_sql('text', C.REPLY_AGREE)} AS short_reply FROM v_segments")
def pr10(t):
    text = F.col("text")
    short = (F.size(T.words_of(text)) <= C.REPLY_MAX_WORDS) & T.cue(text, C.REPLY_AGREE)
    return t.segments.select(*KEY, T.bare_agree(text).alias("bare"), short.alias("short_reply"))


@query("pr11_agreement_cue", f"SELECT meeting_id, seg_id, {agree_sql('text', C.AGREEMENT_CUE)} AS agreement_cue FROM v_segments")
def pr11(t):
    return t.segments.select(*KEY, T.cue(F.col("text"), C.AGREEMENT_CUE).alias("agreement_cue"))


@query("pr16_named_speaker", "SELECT meeting_id, seg_id, NOT regexp_full_match(speaker, 'Speaker \\d+') AS named FROM "
       "(SELECT meeting_id, seg_id, CASE WHEN ord % 3 = 0 THEN 'Priya' ELSE speaker END AS speaker FROM v_segments)")
def pr16(t):
    s = t.segments.withColumn("speaker", F.when(F.col("ord") % 3 == 0, "Priya").otherwise(F.col("speaker")))
    return s.select(*KEY, T.named(F.col("speaker")).alias("named"))


@query("pr17_low_confidence", "SELECT meeting_id, ord, pos, w FROM v_words WHERE pct < 45")
def pr17(t):
    return transcripts.low_confidence(t.words).select("meeting_id", "ord", "pos", "w")


@query("pr18_hallucination_guard")
def pr18(t):
    d = F.col("doc_id")
    segs = t.given("documents").select(
        "doc_id", "text", (d % 10 / 10).alias("no_speech_prob"), (F.lit(-0.3) - d % 4 / 4).alias("avg_logprob"),
        (F.lit(1.0) + d % 17 / 10).alias("compression_ratio"),
    )
    return transcripts.hallucination_reason(segs).select("doc_id", "drop_reason")


@query("pr19_repeated_phrase")
def pr19(t):
    return t.given("documents").select("doc_id", repeated_phrase_col(F.col("text")).alias("repeated"))


@query("pr20_non_english", "SELECT doc_id, CASE WHEN lang <> 'en' OR doc_id % 10 / 10 < 0.5 THEN 'W_NON_ENGLISH' END "
       "AS warning FROM documents")
def pr20(t):
    prob = F.col("doc_id") % 10 / 10
    return t.given("documents").select("doc_id", transcripts.language_warning(F.col("lang"), prob).alias("warning"))


@query("pr27_visible_jobs", "SELECT id, title FROM v_jobs WHERE device_id = 'dev3'")
def pr27(t):
    return transcripts.visible_jobs(t.jobs, "dev3").select("id", "title")


@query("pr28_ready_flags", """SELECT meeting_id, bool_or(stage = 'raw_saved' AND status = 'completed') AS raw_ready,
    bool_or(stage = 'guarding' AND status = 'completed') AS refined_ready,
    bool_or(stage = 'verifying' AND status = 'completed') AS record_ready FROM v_progress GROUP BY meeting_id""")
def pr28(t):
    done = t.progress.where(F.col("status") == "completed").select("meeting_id", "stage")
    return transcripts.ready_flags(t.progress.select("meeting_id").distinct(), done)


@query("pr29_unspecified", """SELECT meeting_id, pos, coalesce(trim(deadline_words), '') = '' OR
    lower(trim(deadline_words)) = 'unspecified' AS unspecified FROM v_tasks""")
def pr29(t):
    return t.tasks.select("meeting_id", "pos", T.unspecified(F.trim("deadline_words")).alias("unspecified"))
