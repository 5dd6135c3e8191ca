"""Alignment of long spans and matching in rounds beside plain versions."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from groundledger.operators import alignment, recheck
from groundledger.operators.matching import greedy_matching

KEYS = ["meeting_id"]


def sequences(rng, meetings):
    """Two readings of each meeting: equal stretches, replaced, dropped and added words, repeats, and nothing alike."""
    out = {}
    for m in range(meetings):
        vocabulary = [f"w{i}" for i in range(rng.choice([2, 5, 40]))]
        a = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 7, 30, 60]))]
        b = []
        for w in a:
            b += rng.choice([[w]] * 6 + [[], ["x"], [w, "uh"], [w, rng.choice(vocabulary)]])
        out[m] = (a, rng.choice([b, b, b, [], ["other"] * 20]))
    return out


def plain_blocks(a, b):
    return [tuple(x) for x in SequenceMatcher(a=a, b=b, autojunk=False).get_matching_blocks() if x.size]


def merged(blocks):
    out = []
    for i, j, n in sorted(blocks):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def test_long_sequences_are_cut_where_the_whole_alignment_cuts_them(spark):
    seqs = sequences(random.Random(7), 25)
    frame = lambda side: spark.createDataFrame(
        [(m, k, w) for m, s in seqs.items() for k, w in enumerate(s[side])], "meeting_id long, pos long, norm string")
    regions, blocks = alignment.split_regions(frame(0), frame(1), KEYS, 12)
    got = {m: [] for m in seqs}
    for r in blocks.collect():
        got[r["meeting_id"]].append((r["i"], r["j"], r["n"]))
    covered = {m: set() for m in seqs}
    for r in regions.collect():
        a, b = seqs[r["meeting_id"]][0][r["alo"]:r["ahi"]], seqs[r["meeting_id"]][1][r["blo"]:r["bhi"]]
        assert not r["matched"] or not a or (len(a) <= 12 and len(b) <= 12)
        found = plain_blocks(a, b)
        assert r["matched"] or not found
        got[r["meeting_id"]] += [(r["alo"] + i, r["blo"] + j, n) for i, j, n in found]
        covered[r["meeting_id"]] |= set(range(r["alo"], r["ahi"]))
    for m, (a, b) in seqs.items():
        assert merged(got[m]) == plain_blocks(a, b), m
        assert covered[m] | {k for i, _, n in got[m] for k in range(i, i + n)} == set(range(len(a)))


def test_updates_do_not_depend_on_the_cuts(spark):
    """One span holds most words; cut into regions of 40 words it gives what one row gives."""
    seqs = sequences(random.Random(3), 8)
    long = [f"w{k % 17}" for k in range(150)]
    seqs[99] = (long, [w for k, w in enumerate(long) if k % 23] + ["uh", "more", "words"])
    first = [(m, k, 100 * k, 100 * k + 50, w, 0.5 + (k % 5) / 10) for m, s in seqs.items() for k, w in enumerate(s[0])]
    second = [(m, k, 100 * k * max(1, len(s[0])) // max(1, len(s[1])), w) for m, s in seqs.items() for k, w in enumerate(s[1])]
    a = spark.createDataFrame(first, "meeting_id long, word_idx long, start_ms long, end_ms long, w string, conf double")
    b = spark.createDataFrame([(m, k, at, at + 50, w) for m, k, at, w in second], "meeting_id long, other_idx long, start_ms long, end_ms long, w string")
    spans = spark.createDataFrame([(m, 0, 10**6, 1) for m in seqs], "meeting_id long, start_ms long, end_ms long, risk int")
    whole, cut = (sorted(map(repr, recheck.cross_check(a, spans, b, leaf).collect())) for leaf in (4096, 40))
    assert whole == cut and len(whole) >= len(first)


@pytest.mark.parametrize("many", [1, 300])
def test_matching_equals_a_walk(spark, many):
    rng = random.Random(many)
    rows = [(m, p, f"l{rng.randrange(12)}", f"r{rng.randrange(12)}") for m in (1, 2) for p in range(many)]
    rows += [(3, p, f"l{p // 2}", f"r{(p + 1) // 2}") for p in range(20)]  # a chain, decided one after the other
    edges = spark.createDataFrame(rows, "meeting_id long, pos long, a string, b string")
    taken = set()
    for m, p, x, y in sorted(rows):
        if not any(t[0] == m and (t[2] == x or t[3] == y) for t in taken):
            taken.add((m, p, x, y))
    got = greedy_matching(edges, KEYS, "a", "b", F.struct("pos"))
    assert {tuple(r) for r in got.collect()} == taken
    assert greedy_matching(edges.limit(0), KEYS, "a", "b", F.struct("pos")).count() == 0
