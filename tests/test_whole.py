"""Meetings taken whole and meetings taken chunk by chunk come to the same words, lines and texts."""

import random

import pytest
from pyspark.sql import functions as F

from groundledger.operators import assemble, whole

W = "meeting_id long, stt_seg long, word_idx long, w string, start_ms long, end_ms long, conf double, disputed boolean, alt string"
TURN = "meeting_id long, turn_no long, start_ms long, end_ms long, speaker string"
TOKENS = ["The", " costs", "9", ",400", ",5", "-way", "one", "%", "end.", "approx.", "", " ", None, "ok?\"", ".7", "-", "é", "٣"]


def odd_tables(spark):
    """Long and short meetings with gaps, nulls, words out of time, meetings without turns, and turns that hold others."""
    r, words, turns, patches = random.Random(7), [], [], []
    for m, n in enumerate([1, 2, 40, 700, 90, 300]):
        at = 0
        for i in range(n):
            at += r.choice([0, 60, 120, 900, 1000, 1001, 2600, -300]) if r.random() < .4 else 80
            start = None if r.random() < .02 else at
            words.append((m, i // 9, i, r.choice(TOKENS), start, None if r.random() < .02 else at + r.choice([0, 50, 250, 12_000 if i % 50 == 0 else 90]),
                          r.choice([None, .2, .7]), r.choice([True, False, None]), None))
            if r.random() < .3:
                patches.append((m, i, .95, True, "x"))
            at += 70
        if m == 4:
            continue
        where = 0
        for k in range(max(1, n // 6)):
            turns.append((m, k, where, where + r.choice([0, 200, 900, 4000, 60_000 if k % 9 == 0 else 700]), r.choice(["B", "A", "Ä", "Z", None if k % 11 == 0 else "A"])))
            where += r.choice([300, 900, 5200])
    return (spark.createDataFrame(words, W), spark.createDataFrame(turns, TURN),
            spark.createDataFrame(patches, "meeting_id long, word_idx long, conf double, disputed boolean, alt string"))


@pytest.mark.parametrize("border", [1 << 17, 60])
def test_whole_and_chunked_meetings_agree(spark, monkeypatch, border):
    w, t, u = (x.repartition(3).localCheckpoint() for x in odd_tables(spark))
    monkeypatch.setattr(assemble, "WORD_CHUNK", 64)
    rows = lambda df: sorted(map(repr, df.collect()))
    filled = assemble.fill_missing_speakers(assemble.assign_speakers(w, t, ["word_idx"]).localCheckpoint()).localCheckpoint()
    lines = assemble._chunked_lines(w, u, t).localCheckpoint()
    cut = assemble.cut_segments(filled).groupBy("meeting_id", "head").agg(F.count(F.lit(1)).alias("n_words"), F.max("end_ms").alias("end_ms"))
    ends = rows(cut)

    monkeypatch.setattr(assemble, "WHOLE", border)
    monkeypatch.setattr(whole, "PAIRS", 50)
    spoken = assemble.speak(w, t)
    assert rows(spoken) == rows(filled.select(*spoken.columns))
    assert rows(assemble.spoken_line_ends(w, t)) == ends
    got = assemble.assemble_transcript(w, u, t)
    assert rows(got.select("meeting_id", "ord", "start_ms", "end_ms", "speaker", "words")) == rows(lines.select(
        "meeting_id", "ord", "start_ms", "end_ms", "speaker", F.transform("words", lambda x: x.dropFields("word_idx")).alias("words")))


def test_words_are_dealt_out_once(spark):
    """The speakers of meetings of ordinary length cost one shuffle of their words and no join of them."""
    w, t, _ = (x.localCheckpoint() for x in odd_tables(spark))
    plan = assemble.speak(w, t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
