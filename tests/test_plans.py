"""Plan shapes: no nested loops, pruned scans, JVM-side text features."""

import pytest

import __spark_entry__ as entry
from conftest import SF
from groundledger.catalog.bindings import Tables
from groundledger.operators import assemble, recheck
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["jn4_word_turn_overlap", "jn7_deadline_adjacency", "jn14_word_in_span", "jn20_active_line", "wn12_refine_windows",
                                  "st3_shared_evidence", "ag14_separation", "jn16_already_processed"])
def test_joins_are_by_equality(spark, name):
    p = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_text_features_stay_in_the_jvm_and_scans_are_pruned(spark):
    p = plan(entry.queries()["pr1_numbers"](spark, SF))
    assert "Python" not in p and "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_filters_reach_the_scan(spark):
    p = plan(Tables(spark, SF).given("documents").where(F.col("lang") == "en").select("doc_id"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p


def test_range_join_and_neighbours_need_no_window_over_a_whole_meeting(spark):
    t = Tables(spark, SF)
    w = assemble.flatten_words(t.segments_words.withColumnRenamed("ord", "stt_seg"))
    p = plan(recheck.low_confidence_spans(w))
    windows = [ln for ln in p.splitlines() if "Window [" in ln or "WindowExec" in ln]
    assert windows and all("_chunk" in ln or "_bucket" in ln for ln in windows)


def test_record_writes_words_twice_and_pointed_lines_once(spark, monkeypatch):
    """What carries the words of all lines is most of the disk that a record takes."""
    from groundledger.catalog.q_verify import whole_record
    from groundledger.operators import guard, ordered, speakers, verify
    from groundledger.plans import record

    with_words = []

    def noted(df):
        out = ordered.settle(df)
        if "words" in df.columns:
            with_words.append(out.count())
        return out

    for module in (guard, record, speakers, verify):
        monkeypatch.setattr(module, "settle", noted)
    t = Tables(spark, SF)
    lines = t.segments.count()
    refined = whole_record(t).refined
    assert with_words[:2] == [lines, lines] and len(with_words) == 3 and with_words[2] < lines / 2
    assert refined.columns == t.segments_words.columns and refined.count() == lines
