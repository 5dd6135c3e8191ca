"""The derived tables themselves."""

from pyspark.sql import functions as F

from .registry import query

PIPE = "|"


@query("base_segments", "SELECT meeting_id, ord, seg_id, speaker, text, start_ms, end_ms FROM v_segments")
def base_segments(t):
    return t.segments


@query("base_words", "SELECT meeting_id, ord, pos, w, start_ms, end_ms, conf, disputed, alt FROM v_words")
def base_words(t):
    return t.words
