"""Text functions on odd texts."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from groundledger.functions import text as T

ODD = [None, "", " ", "\u00a0", "\t \n", "\u3000Plan\u2003", " Plan \n", "---", "\u0130stanbul \u212aiosk", "a" * 59 + " b", "\u00e9" * 300, "\u00e9" * 301, " " * 9 + "b" * 301 + " "]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["sf17_slug_title", "sf25_short_detail"])
def test_odd_texts_equal_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    df = entry.queries()[name](spark, odd)
    theirs = con.sql(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert len(theirs) == len(ODD)
    assert {r[0]: tuple(r) for r in df.collect()} == {r[0]: r for r in theirs}


def test_defaults_stand_in_for_blank_texts(spark):
    rows = spark.createDataFrame([(None,), (" \u00a0",), (" Plan ",)], "t string")
    title = T.default_title(F.lit("call.mp3"), F.col("t"), F.lit(datetime.date(2024, 1, 5)))
    got = rows.select(title.alias("title"), T.detail_for_user(F.col("t")).alias("detail")).collect()
    auto = "call.mp3 \u2013 5 Jan 2024"
    assert [tuple(r) for r in got] == [(auto, None), (auto, None), ("Plan", "Plan")]
