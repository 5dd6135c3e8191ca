"""Registered queries against their SQL twins on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF
from tools.check import canon

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["base_words", "pr1_numbers", "jn3_pointer_resolution", "jn4_word_turn_overlap", "jn9_word_segment_asof", "wn4_merge_spans",
          "wn9_glue_pieces", "ag5_vocabulary", "ag14_separation", "snk3_record_markdown", "jb14_fidelity"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    mine = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    theirs = sorted(tuple(canon(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
    assert mine == theirs
