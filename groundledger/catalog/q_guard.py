"""Edit checks, refined lines and spoken symbols."""

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..operators import guard as G, lexicon
from ..operators.ordered import settle
from .q_features import KEY, count_sql, has_sql, modal_sql, numbers_sql
from .oracle_views import lit
from .registry import query

_EARLY = f"""CASE WHEN e.confidence < 0.7 THEN 'low_confidence' WHEN s.text IS NULL OR e.original = '' OR NOT contains(s.text, e.original) THEN 'not_found'
    WHEN {numbers_sql('e.original')} <> {numbers_sql('e.replacement')} THEN 'number_changed'
    WHEN {count_sql('e.original', C.NEGATION)} <> {count_sql('e.replacement', C.NEGATION)} THEN 'negation_changed'
    WHEN {modal_sql('e.original')} <> {modal_sql('e.replacement')} THEN 'modal_changed' END"""
EARLY = {"v_early": f"SELECT e.*, s.text, {_EARLY} AS reason FROM v_edits e LEFT JOIN v_segments s USING (meeting_id, seg_id) WHERE trim(original) <> trim(replacement)"}
EARLY_REASONS = ["low_confidence", "not_found", "number_changed", "negation_changed", "modal_changed"]


def guarded(t):
    lines = settle(t.segments_words)
    return G.guard_edits(lines, t.edits, t.vocab_terms, lexicon.packaged(t.spark))


def checked(t):
    return G.check_edits(t.edits, settle(t.segments_words), t.vocab_terms, lexicon.packaged(t.spark))


@query("jn1_edit_segment", "SELECT e.meeting_id, e.edit_idx, e.seg_id, s.text, s.text IS NULL AS missing FROM v_edits e LEFT JOIN v_segments s USING (meeting_id, seg_id)")
def jn1(t):
    j = t.edits.join(t.segments.select(*KEY, "text"), KEY, "left")
    return j.select("meeting_id", "edit_idx", "seg_id", "text", F.col("text").isNull().alias("missing"))


@query("pr23_edit_reasons")
def pr23(t):
    return checked(t).select("meeting_id", "edit_idx", "reject_reason")


@query("pr23_early_reasons", "SELECT meeting_id, edit_idx, reason AS reject_reason FROM v_early WHERE reason IS NOT NULL", EARLY)
def pr23e(t):
    return checked(t).where(F.col("reject_reason").isin(*EARLY_REASONS)).select("meeting_id", "edit_idx", "reject_reason")


@query("pr24_name_changed")
def pr24(t):
    return checked(t).select("meeting_id", "edit_idx", (F.col("reject_reason") == "name_changed").alias("name_changed"))


_SPANS = """(SELECT *, sum(length(w) + 1) OVER o - length(w) - 1 AS a, sum(length(w) + 1) OVER o - 1 AS b FROM v_words
          WINDOW o AS (PARTITION BY meeting_id, ord ORDER BY pos))"""


@query("pr25_disputed_frozen", f"""SELECT e.meeting_id, e.edit_idx, coalesce(bool_or(w.disputed AND w.a < e.at + length(e.original) AND e.at < w.b
    AND {has_sql('w.w', '|'.join((C.NUMBER, C.NEGATION, C.MODAL)))}), false) AS touches FROM (SELECT meeting_id, ord, edit_idx, original, instr(text, original) - 1 AS at
    FROM v_edits JOIN v_segments USING (meeting_id, seg_id) WHERE contains(text, original)) e JOIN {_SPANS} w USING (meeting_id, ord) GROUP BY e.meeting_id, e.edit_idx""")
def pr25(t):
    at = F.call_function("locate", F.col("original"), F.col("text")) - 1
    j = t.edits.join(t.segments_words, KEY).withColumn("at", at).where("at >= 0")
    touch = G.disputed_frozen(F.col("text"), F.col("words"), F.col("at"), F.col("at") + F.length("original"))
    return j.select("meeting_id", "edit_idx", touch.alias("touches"))


@query("pr26_disputed_under_quote", """SELECT e.meeting_id, e.edit_idx, coalesce(bool_or(w.disputed AND w.a < e.at + length(e.original) AND e.at < w.b), false) AS disputed FROM
    (SELECT meeting_id, seg_id, ord, edit_idx, original, instr(lower(text), lower(original)) - 1 AS at FROM v_edits JOIN v_segments USING (meeting_id, seg_id)
     WHERE contains(lower(text), lower(original))) e
    JOIN (SELECT *, sum(length(w) + 1) OVER o - length(w) - 1 AS a, sum(length(w) + 1) OVER o - 1 AS b FROM v_words
          WINDOW o AS (PARTITION BY meeting_id, ord ORDER BY pos)) w USING (meeting_id, ord) GROUP BY e.meeting_id, e.edit_idx""")
def pr26(t):
    j = t.edits.join(t.segments_words, KEY).where(F.contains(F.lower("text"), F.lower("original")))
    return j.select("meeting_id", "edit_idx", G.disputed_under(F.col("text"), F.col("words"), F.col("original")).alias("disputed"))


@query("sf13_word_spans", """SELECT meeting_id, ord, pos, (sum(length(w) + 1) OVER o - length(w) - 1)::INTEGER AS a, (sum(length(w) + 1) OVER o - 1)::INTEGER AS b
    FROM v_words WINDOW o AS (PARTITION BY meeting_id, ord ORDER BY pos)""")
def sf13(t):
    s = t.segments_words.select("meeting_id", "ord", F.posexplode(T.word_spans(F.col("text"), F.col("words"))).alias("pos", "x"))
    return s.select("meeting_id", "ord", (F.col("pos") + 1).cast("long").alias("pos"), "x.a", "x.b")


@query("wn14_overlap_resolution")
def wn14(t):
    return G.keep_disjoint(settle(checked(t))).where(F.col("reject_reason").isNull()).select("meeting_id", "edit_idx", "at")


@query("sf12_apply_edits")
def sf12(t):
    refined = guarded(t)[0]
    return refined.select(*KEY, "text", F.array_join(F.transform("words", lambda w: w["w"]), "_").alias("words"))


@query("jb4_guard")
def jb4(t):
    _, accepted, rejected = guarded(t)
    return accepted.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejected).select(
        "meeting_id", "edit_idx", "original", "replacement", "reject_reason")


@query("ag4_rejections", f"""SELECT reason AS reject_reason, count(*) AS n FROM v_early WHERE reason IS NOT NULL GROUP BY reason""", EARLY)
def ag4(t):
    return checked(t).where(F.col("reject_reason").isin(*EARLY_REASONS)).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("ag4_all_rejections")
def ag4_all(t):
    return checked(t).where(F.col("reject_reason").isNotNull()).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


def _symbol_hit(pattern: str) -> str:
    """First match of a rule; DuckDB can't look ahead, so the rule that must not meet "of" takes the first match of those left."""
    plain, ahead = pattern.replace(r"(?!of\b)", ""), r"(?!of\b)" in pattern
    if not ahead:
        return f"regexp_extract(t, {lit('(?i)' + plain)}, 0)"
    return f"coalesce(list_filter(regexp_extract_all(t, {lit('(?i)' + plain)}), lambda x: NOT regexp_matches(x, {lit('(?i)^' + C.SPOKEN_AT + ' of' + chr(92) + 'b')}))[1], '')"


def _symbol_written(k: int, pattern: str, written: str) -> str:
    into = written.replace("$", chr(92))
    return f"regexp_replace(h{k}, {lit('(?i)' + pattern.replace('(?!of' + chr(92) + 'b)', ''))}, {lit(into)})"


_HITS = ", ".join(f"{_symbol_hit(p)} AS h{k}" for k, (p, _, _) in enumerate(C.SYMBOL_RULES))
_FIRST = lambda what: "CASE " + " ".join(f"WHEN h{k} <> '' THEN {what(k, *r)}" for k, r in enumerate(C.SYMBOL_RULES)) + " END"
SYMBOLS = {"v_fold": f"""SELECT doc_id, 0 AS pass, 'see user underscore id at ' || text AS t, '' AS original, '' AS replacement, '' AS rationale FROM documents
    WHERE text IS NOT NULL UNION ALL SELECT doc_id, pass + 1, substr(t, 1, strpos(t, hit) - 1) || written || substr(t, strpos(t, hit) + length(hit)), hit, written, why FROM (
    SELECT *, {_FIRST(lambda k, p, r, why: f'h{k}')} AS hit, {_FIRST(lambda k, p, r, why: _symbol_written(k, p, r))} AS written,
      {_FIRST(lambda k, p, r, why: lit(why))} AS why FROM (SELECT doc_id, pass, t, {_HITS} FROM v_fold WHERE pass < {C.SYMBOL_PASSES}))
    WHERE hit IS NOT NULL"""}


@query("sf11_symbols", "SELECT doc_id, original, replacement, rationale FROM v_fold WHERE pass > 0", SYMBOLS)
def sf11(t):
    d = t.given("documents").select("doc_id", F.concat(F.lit("see user underscore id at "), "text").alias("text"))
    edits = d.select("doc_id", F.explode(G.symbol_edits(F.col("text"))).alias("e"))
    return edits.select("doc_id", "e.original", "e.replacement", "e.rationale")


@query("jb5_rewrite_symbols")
def jb5(t):
    lines, _ = G.rewrite_symbols(t.segments_words)
    return lines.select(*KEY, "text", F.size("words").alias("n_words"))


@query("sf23_annotate")
def sf23(t):
    lines = settle(t.segments_words)
    _, accepted, rejected = G.guard_edits(lines, t.edits, t.vocab_terms, lexicon.packaged(t.spark))
    return G.annotate(lines, accepted, rejected)


@query("st5_edits_in_window", """SELECT meeting_id, edit_idx FROM v_edits e SEMI JOIN v_segments s USING (meeting_id, seg_id) WHERE original <> replacement""")
def st5(t):
    from ..operators.windows import refine_windows

    targets = refine_windows(t.segments).where(F.col("part") == "target").select("meeting_id", "seg_id")
    stripped = t.edits.withColumn("original", T.strip_markers(F.col("original"))).withColumn("replacement", T.strip_markers(F.col("replacement")))
    return stripped.where(F.col("original") != F.col("replacement")).join(targets, KEY, "left_semi").select("meeting_id", "edit_idx")
