"""One case per reject reason, applied edits and spoken symbols."""

import random
import re
import time
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from groundledger import constants as C
from groundledger.catalog import q_guard, q_sinks
from groundledger.functions import repeats
from groundledger.operators import guard, lexicon

CASES = [  # (text, original, replacement, category, confidence, disputed, expected)
    ("the order rose from sixteen to sixty crates", "sixteen", "sixty", "homophone", .9, (), "number_changed"),
    ("they couldn't open the hatch", "couldn't", "could", "homophone", .9, (), "negation_changed"),
    ("Petra must sign the lease", "must", "may", "homophone", .9, (), "modal_changed"),
    ("afterwards Petra left early", "Petra", "Pedro", "homophone", .9, (), "name_changed"),
    ("please call Petra at noon", "Petra", "Petrus", "proper_noun", .95, (), "name_changed"),
    ("store it behind the ay pee eye gateway", "ay pee eye", "warehouse", "technical_term", .9, (), "not_sound_alike"),
    ("commit the yaml file", "yaml", "a very long list of deployment settings", "technical_term", .9, (), "over_rewrite"),
    ("commit the file", "yaml", "YAML", "acronym", .9, (), "not_found"),
    ("commit the yaml file", "yaml", "YAML", "acronym", .6, (), "low_confidence"),
    ("we ordered seventeen crates", "seventeen crates", "seventeen Crates", "technical_term", .9, ("seventeen",), "touches_disputed_frozen"),
    ("store it behind the ay pee eye gateway", "ay pee eye", "API", "acronym", .9, (), None),
    ("commit the yaml file", "yaml", "YAML", "acronym", .9, (), None),
    ("the terror form plan is stale", "terror form", "Terraform", "technical_term", .9, (), None),
    ("the depot in Kerela closes", "Kerela", "Kerala", "proper_noun", .8, (), None),
    ("the model runs on Tensor Flow today", "Tensor Flow", "TensorFlow", "technical_term", .8, (), None),
]


def vocab(spark, meetings):
    return spark.createDataFrame([(m, t) for m in meetings for t in ("API", "Terraform", "YAML")], "meeting_id long, term string")


EDIT = "meeting_id long, edit_idx long, seg_id string, original string, replacement string, category string, confidence double"


def test_reject_reasons(spark, meeting):
    segs = meeting({i: [("Speaker 1", c[0], c[5])] for i, c in enumerate(CASES)})
    edits = spark.createDataFrame([(i, i, "S001", *c[1:5]) for i, c in enumerate(CASES)], EDIT)
    got = guard.check_edits(edits, segs, vocab(spark, range(len(CASES))), lexicon.packaged(spark)).collect()
    assert {r.meeting_id: r.reject_reason for r in got} == {i: c[6] for i, c in enumerate(CASES)}


def test_all_rejections_counts_every_reason(spark, meeting):
    segs = meeting({i: [("Speaker 1", c[0], c[5])] for i, c in enumerate(CASES)})
    edits = spark.createDataFrame([(i, i, "S001", *c[1:5]) for i, c in enumerate(CASES)], EDIT)
    t = SimpleNamespace(spark=spark, edits=edits, segments_words=segs, vocab_terms=vocab(spark, range(len(CASES))))
    got = {r.reject_reason: r.n for r in q_guard.ag4_all(t).collect()}
    assert got == Counter(c[6] for c in CASES if c[6]) and set(got) == set(C.REJECT_REASONS)


def test_all_files_names_each_file_of_an_export(spark):
    t = SimpleNamespace(given=lambda name: spark.createDataFrame([(7,)], "conv_id long"))
    (row,) = q_sinks.snk4_all(t).collect()
    assert row.asDict() == {"meeting_id": 7, "title": "Meeting 7", **C.EXPORT_FILES}


def test_overlap_keeps_the_confident_edit_and_the_timing(spark, meeting):
    segs = meeting({1: [("Speaker 1", "they couldn't merge the yaml file before the ay pee eye gateway starts")]})
    edits = spark.createDataFrame([
        (1, 1, "S001", "ay pee eye", "API", "acronym", .9), (1, 2, "S001", "yaml", "YAML", "acronym", .95),
        (1, 3, "S001", "ay pee eye gateway", "API gateway", "acronym", .7), (1, 4, "S001", "merge", "merge ", "acronym", .9),
    ], EDIT)
    refined, accepted, rejected = guard.guard_edits(segs, edits, vocab(spark, [1]), lexicon.packaged(spark))
    row = refined.collect()[0]
    assert row.text == "they couldn't merge the YAML file before the API gateway starts"
    assert [w.w for w in row.words] == row.text.split()
    assert sorted(r.edit_idx for r in accepted.collect()) == [1, 2]
    assert [(r.edit_idx, r.reject_reason) for r in rejected.collect()] == [(3, "not_found")]
    heard = {w.w: (w.start_ms, w.end_ms) for w in segs.collect()[0].words}
    merged = {w.w: (w.start_ms, w.end_ms) for w in row.words}
    assert merged["API"] == (heard["ay"][0], heard["eye"][1]) and merged["starts"] == heard["starts"]


SYMBOLS = [
    ("Rename row underscore count underscore total in report dot sql.", "Rename row_count_total in report.sql."),
    ("Write to helena at the rate printshop dot org first.", "Write to helena@printshop.org first."),
    ("Ping at the rate warehouse about the pallets.", "Ping @warehouse about the pallets."),
    ("Look at shop dot museum dot net and hashtag openday too.", "Look at shop.museum.net and #openday too."),
    ("Rent is due at the rate of 9 crowns.", "Rent is due at the rate of 9 crowns."),
    ("Our dot matrix printer broke and nobody minds.", "Our dot matrix printer broke and nobody minds."),
]


def test_words_of_a_line_are_located_once(meeting):
    lines = meeting({1: [("Speaker 1", "commit the yaml file")]})
    kept = lines.select("meeting_id", "seg_id", F.lit("yaml").alias("original"), F.lit("YAML").alias("replacement"), F.lit(11).alias("at"))
    done = guard.apply_edits(lines, kept)
    assert [w.w for w in done.first().words] == ["commit", "the", "YAML", "file"]
    assert done._jdf.queryExecution().optimizedPlan().toString().count("locate(") <= 1


def test_spoken_symbols(meeting):
    lines, edits = guard.rewrite_symbols(meeting({i: [(None, s)] for i, (s, _) in enumerate(SYMBOLS)}))
    got = {r.meeting_id: r for r in lines.collect()}
    for i, (_, written) in enumerate(SYMBOLS):
        assert got[i].text == written
        assert [w.w for w in got[i].words] == written.split() and got[i].words[0].start_ms == 0
    assert {r.meeting_id for r in edits.collect()} == {0, 1, 2, 3}


def rewritten(text, left=C.SYMBOL_PASSES):
    """Edits of a text, one after the other, by Python's own patterns."""
    for pattern, written, why in C.SYMBOL_RULES if left else ():
        if found := re.search(pattern, text, re.I):
            new = found.expand(written.replace("$", "\\"))
            return [(found[0], new, why), *rewritten(text.replace(found[0], new, 1), left - 1)]
    return []


def test_symbol_edits_on_random_lines(spark):
    rng = random.Random(1)
    bits = ["a", "user", "underscore", "dot", "com", "py", "at the rate", "at the rate of", "of", "5", "hashtag", "hash tag", "frontend", "gmail", "é", "x-y",
            "Underscore", "DOT", "md", "at sign", "at symbol", ".", ",", None]
    rows = [(" ".join(filter(None, (rng.choice(bits) for _ in range(rng.randint(1, 14))))),) for _ in range(1500)] + [("a underscore " * 40 + "b",), (None,)]
    for r in spark.createDataFrame(rows, "t string").select("t", guard.symbol_edits(F.col("t")).alias("e")).collect():
        assert [tuple(x) for x in r.e or []] == rewritten(r.t or ""), r.t


@pytest.mark.parametrize("a, b, want", [("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, want):
    from groundledger.functions.fuzzy import jaro_winkler

    assert abs(jaro_winkler(a, b) - want) < 1e-4


def test_fuzzy_helpers():
    from groundledger.functions import fuzzy

    assert fuzzy.metaphone("right") == fuzzy.metaphone("rite") and fuzzy.metaphone("knight") == fuzzy.metaphone("nite")
    assert fuzzy.partial_ratio("abcd", "xxabcdxx") == 100
    assert fuzzy.partial_ratio("the ladder stands behind the shed", "orders grew from twelve to ninety", 90) == 0
    assert fuzzy.token_set_ratio("blue door left", "left blue blue door") == 100


def test_repeated_phrase_against_brute_force(spark):
    def brute(toks):
        return any(toks[i:i + n] == toks[i + n:i + 2 * n] == toks[i + 2 * n:i + 3 * n]
                   for n in range(4, len(toks) // 3 + 1) for i in range(len(toks) - 3 * n + 1))

    rng = random.Random(1)
    said = [[rng.choice(pool) for _ in range(rng.randint(8, 40))] for pool in (["a", "b"], ["a", "b", "c'd"], ["é", "b", "2"], ["中", "x"]) for _ in range(300)]
    phrase = lambda: [rng.choice(["w1", "Ünder", "stop", "x²", "n"]) for _ in range(rng.randint(3, 7))]
    said += [[*phrase(), *(phrase() * rng.randint(2, 4)), *phrase()] for _ in range(300)]
    texts = [rng.choice([" ", ", ", " – "]).join(t if rng.random() < 0.7 else t.upper() for t in toks) for toks in said]
    want = [brute(re.findall(r"[\w']+", t.lower())) for t in texts]
    assert repeats.say_again(texts) == want and any(want) and not all(want)
    assert repeats.say_again([None, "", "and round we go again " * 3, "and round we go again " * 2, "red green blue " * 3, "no " * 12]) == [
        False, False, True, False, False, True]
    rows = spark.createDataFrame(list(enumerate([*texts, None, ""])), "i long, t string")
    got = {r.i: (r.may, r.hit) for r in rows.select("i", repeats.may_repeat(F.col("t")).alias("may"), repeats.repeated_phrase_col(F.col("t")).alias("hit")).collect()}
    assert [got[i][1] for i in range(len(texts))] == want and got[len(texts)][1] is False and got[len(texts) + 1][1] is False
    assert all(may or not hit for may, hit in got.values())
    plain = spark.createDataFrame([("The quick brown fox jumps over the lazy dog and runs on through the wood.",), ("le café é " * 4,)], "t string")
    assert [r[0] for r in plain.select(repeats.may_repeat(F.col("t"))).collect()] == [False, True]  # the first never reaches Python


def test_repeated_phrase_in_long_texts():
    rng = random.Random(2)
    loop = [f"w{k}" for k in range(30_000)]
    texts = [" ".join(loop * 3), " ".join(loop * 2 + loop[:-1]), " ".join(["a b c"] * 33_000), " ".join(f"v{rng.randrange(3)}" for _ in range(100_000))]
    began = time.perf_counter()
    assert repeats.say_again(texts[:2]) == [True, False]
    assert repeats.say_again([texts[2]]) == [True] and len(repeats.say_again([texts[3]])) == 1
    assert time.perf_counter() - began < 30  # seconds on a busy machine; a second or so a text on an idle one


def test_partial_ratio_floor_is_exact():
    import random

    from groundledger.functions.fuzzy import partial_ratio

    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 14)))
        b = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 30)))
        full = partial_ratio(a, b)
        assert partial_ratio(a, b, 90) == (full if full >= 90 else 0)
