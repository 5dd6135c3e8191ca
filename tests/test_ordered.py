"""Ordered operators against plain loops, with chunks far smaller than a meeting."""

import random

import pytest
from pyspark.sql import functions as F

from groundledger.operators import assemble, folds, intervals, ordered, windows
from groundledger import constants as C


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(m, i, rng.choice([None, "a", "b", "c"]), rng.randint(-50, 50)) for m, n in ((1, 137), (2, 9), (3, 60)) for i in range(n)]
    return data, spark.createDataFrame(data, "k long, i long, s string, v long").repartition(5)


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: r[:2]):
        out.setdefault(r[0], []).append(r)
    return out


def test_dense_order_and_running_values(rows):
    data, df = rows
    bucket = ordered.chunk_of("i", 7)
    got = ordered.dense_order(df, ["k"], ["i"], bucket, "n")
    got = ordered.running_sum(got, ["k"], ["i"], bucket, F.col("v"), "total")
    got = ordered.running_max(got, ["k"], ["i"], bucket, F.col("v"), "top")
    have = {(r.k, r.i): (r.n, r.total, r.top) for r in got.collect()}
    for k, rs in by_key(data).items():
        total, top = 0, None
        for n, r in enumerate(rs, 1):
            total += r[3]
            top = r[3] if top is None else max(top, r[3])
            assert have[(k, r[1])] == (n, total, top)


@pytest.mark.parametrize("following", [False, True])
def test_last_known(rows, following):
    data, df = rows
    got = ordered.last_known(df, ["k"], ["i"], ordered.chunk_of("i", 7), F.col("s"), "x", following=following, inclusive=False)
    have = {(r.k, r.i): r.x for r in got.collect()}
    for k, rs in by_key(data).items():
        seq = rs[::-1] if following else rs
        last = None
        for r in seq:
            assert have[(k, r[1])] == last
            last = r[2] if r[2] is not None else last


def test_with_neighbours_crosses_chunk_borders(rows):
    data, df = rows
    got = ordered.with_neighbours(
        df, ["k"], "i", 2, 1, lambda w: {"b": F.lag("v", 2).over(w), "a": F.lead("v", 1).over(w)}, size=5)
    have = {(r.k, r.i): (r.b, r.a) for r in got.collect()}
    assert len(have) == len(data)
    for k, rs in by_key(data).items():
        for j, r in enumerate(rs):
            assert have[(k, r[1])] == (rs[j - 2][3] if j >= 2 else None, rs[j + 1][3] if j + 1 < len(rs) else None)


def test_merge_overlaps(spark):
    rng = random.Random(2)
    spans = [(k, s, s + rng.randint(0, 4_000_000), rng.randint(0, 2)) for k in (1, 2) for s in [rng.randint(0, 90_000_000) for _ in range(60)]]
    df = spark.createDataFrame(spans, "k long, a long, b long, r int")
    got = sorted((r.k, r.a, r.b, r.r) for r in intervals.merge_overlaps(df, ["k"], "a", "b", "r").collect())
    want = []
    for k in (1, 2):
        cur = None
        for _, a, b, r in sorted(s for s in spans if s[0] == k):
            if cur and a <= cur[2]:
                cur = (k, cur[1], max(cur[2], b), max(cur[3], r))
            else:
                want += [cur] if cur else []
                cur = (k, a, b, r)
        want.append(cur)
    assert got == sorted(want)


def test_overlap_pairs_once_each(spark):
    rng = random.Random(3)
    left = [(1, i, s, s + rng.randint(0, 40_000)) for i, s in enumerate(rng.sample(range(200_000), 40))]
    right = [(1, i, s, s + rng.randint(0, 40_000)) for i, s in enumerate(rng.sample(range(200_000), 40))]
    a = spark.createDataFrame(left, "k long, i long, a long, b long")
    b = spark.createDataFrame(right, "k long, j long, c long, d long")
    got = sorted((r.i, r.j) for r in intervals.overlap_pairs(a, b, ["k"], ("a", "b"), ("c", "d")).collect())
    assert got == sorted((x[1], y[1]) for x in left for y in right if x[2] <= y[3] and y[2] <= x[3])


def pieces(n, step):
    heads, i = [0] * n, 0
    while i < n:
        j = step(i)
        heads[i:j] = [i] * (min(j, n) - i)
        i = j
    return heads


@pytest.mark.parametrize("size", [70, 400])
def test_cut_pieces_equals_the_sequential_cut(spark, size):
    rng = random.Random(11)
    words, t = [], 0
    for i in range(3000):
        t += rng.choice([210, 220, 260, 260, 1500 if rng.random() < 0.02 else 230])
        words.append((1, i, i // 25, t, t + 190, rng.random() < 0.004, rng.random() < 0.06))
    words += [(2, i, 0, i * 300, i * 300 + 200, False, False) for i in range(500)]
    words += [(3, 0, 0, 0, 100, False, False)]
    df = spark.createDataFrame(words, "meeting_id long, word_idx long, stt_seg long, start_ms long, end_ms long, _hard boolean, _soft boolean")
    got = folds.cut_pieces(df.repartition(6), ["meeting_id"], "word_idx", assemble._segment_step, C.MAX_SEGMENT_WORDS, size)
    have = {(r.meeting_id, r.word_idx): r.head for r in got.collect()}
    assert len(have) == len(words)
    for m in (1, 2, 3):
        ws = [w for w in words if w[0] == m]
        cols = {"start_ms": [w[3] for w in ws], "end_ms": [w[4] for w in ws], "_hard": [w[5] for w in ws], "_soft": [w[6] for w in ws]}
        import numpy as np

        step = assemble._segment_step({k: np.array(v) for k, v in cols.items()})
        assert [have[(m, w[1])] for w in ws] == pieces(len(ws), step)


def test_token_chunks_never_split_lines_and_overlap(spark):
    segs = spark.createDataFrame(
        [(1, i + 1, f"S{i + 1:03d}", "Speaker 1", "word " * (3 + i % 5)) for i in range(40)], "meeting_id long, ord long, seg_id string, speaker string, text string")
    got = windows.token_chunks(segs, 60).collect()
    own = {r.seg_id: r.chunk_no for r in got if not r.overlap}
    assert len(own) == 40
    cost = lambda r: max(1, len(r.line) // 4) + 1
    for c in set(own.values()):
        mine = [r for r in got if r.chunk_no == c and not r.overlap]
        assert sum(cost(r) for r in mine) <= 54
        before = [r for r in got if r.chunk_no == c - 1 and not r.overlap]
        tail = sorted(r.seg_id for r in got if r.chunk_no == c and r.overlap)
        assert tail == (sorted(r.seg_id for r in before)[-max(1, len(before) // 10):] if before else [])


def test_a_piece_longer_than_its_reach_is_an_error(spark):
    df = spark.range(300).select(F.lit(1).alias("meeting_id"), F.col("id").alias("word_idx"))
    with pytest.raises(Exception, match="more than 8 rows"):
        folds.cut_pieces(df, ["meeting_id"], "word_idx", lambda c: lambda i: min(i + 20, len(c["word_idx"])), 8, 64).collect()


def test_line_heads_equal_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(assemble, "WORD_CHUNK", 70)
    rng, data, want = random.Random(3), [], {}
    for m, n in ((1, 900), (2, 150), (3, 1)):
        t, head, before = 0, 0, None
        for i in range(n):
            t += rng.choice([200, 300, 300, 1200, 900]) if rng.random() < 0.2 else 250
            end = t + (40_000 if rng.random() < 0.01 else rng.choice([180, 700]))
            w = (m, i, i // 9 if i % 50 else None, rng.choice(["so", "it", "ends.", "Dr."]), t, end, rng.choice(["A", None]) if rng.random() < 0.05 else "A")
            data.append(w)
            if before is not None:
                ended = before[3] == "ends."
                if (before[6] != w[6] or w[4] - before[5] > C.PAUSE_MS or w[5] - data[-1 - (i - head)][4] > C.MAX_SEGMENT_MS or i - head >= C.MAX_SEGMENT_WORDS
                        or (ended and (before[2] != w[2] or i - head >= C.SOFT_SEGMENT_WORDS))):
                    head = i
            want[m, i], before = (end, head), w
    df = spark.createDataFrame(data, "meeting_id long, word_idx long, stt_seg long, w string, start_ms long, end_ms long, speaker string").repartition(5)
    assert {(r.meeting_id, r.word_idx): (r.end_ms, r.head) for r in assemble.line_heads(df).collect()} == want
    assert {(r.meeting_id, r.word_idx): (r.end_ms, r.head) for r in assemble.cut_segments(df).collect()} == want


def test_lines_of_a_monologue_shuffle_their_words_once(spark):
    from groundledger import catalog

    plan = catalog.queries()["wn10_monologue_cut"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Window" not in plan
