"""Derived tables on rows that the small samples do not hold."""

from __future__ import annotations

import duckdb
import pytest

from groundledger import catalog
from groundledger.catalog.bindings import Tables
from groundledger.operators import assemble
from groundledger.sources import readers

from conftest import SF


@pytest.mark.parametrize("name", ["src8_manifest", "jn24_error_messages"])
def test_sizes_of_long_pages_pass_two_gigabytes(spark, tmp_path, name):
    rows = [(i, "https://example.com/a", "x" * n) for i, n in enumerate([1, 10, 71_583, 71_582, 200_000, 6_990, 8_000, 101_528, 0, 9_000, 72_000])]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    rel = con.sql(catalog.oracles()[name])
    got = catalog.queries()[name](spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())


def test_model_answers_are_read_once(spark):
    edit = '{"segment_id": "S001", "original": "a", "replacement": "b", "category": "c", "rationale": "", "confidence": 0.5}'
    raw = spark.createDataFrame(
        [(1, "<think>{no}</think> ```json\n{\"edits\": [" + edit + "]}\n```"), (2, "sorry"), (3, "{\"edits\": [oops]}"), (4, None),
         (5, "Here: {\"edits\": []} Done.")], "id long, answer string")
    good, bad = readers.ingest_answers(raw, "answer", readers.EDIT)
    assert [(r.id, r.i, r.original, r.confidence) for r in good.collect()] == [(1, 0, "a", 0.5)]
    assert sorted((r.id, r.reason) for r in bad.collect()) == [(2, "no JSON object found"), (3, "invalid JSON"), (4, "no JSON object found")]
    plans = "".join(df._jdf.queryExecution().optimizedPlan().toString().lower() for df in (good, bad))
    assert "regexp" not in plans and "from_json" not in plans


def test_lines_are_derived_once(spark):
    t = Tables(spark, SF)
    placed = t.placed_words
    for df in (placed, t.words, t.turns, t.segments_words):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "conversations" not in plan and "regexp" not in plan.lower()
    nested = assemble.flatten_words(t.segments_words.withColumnRenamed("ord", "stt_seg"))
    assert sorted(map(str, placed.collect())) == sorted(map(str, nested.select(*placed.columns).collect()))


def test_words_are_numbered_past_segments_without_words(spark):
    word = "struct<w:string,start_ms:bigint>"
    rows = [(1, 600, [("d", 9)]), (1, 0, [("a", 0), ("b", 1)]), (1, 3, []), (1, 4, None), (1, 5, [("c", 5)]), (2, 1, [("x", 0)])]
    df = spark.createDataFrame(rows, f"meeting_id long, stt_seg long, words array<{word}>")
    got = assemble.flatten_words(df).orderBy("meeting_id", "word_idx").collect()
    assert [(r.meeting_id, r.w, r.pos, r.word_idx) for r in got] == [(1, "a", 0, 0), (1, "b", 1, 1), (1, "c", 0, 2), (1, "d", 0, 3), (2, "x", 0, 0)]
