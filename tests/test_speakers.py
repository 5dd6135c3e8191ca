"""Names said in meetings, names proposed by a model, and short-line fixes."""

import random

from groundledger.operators import items, speakers, verify
from groundledger.functions import text as T
from groundledger.functions.fuzzy import token_set_ratio
from pyspark.sql import functions as F

#: {meeting: (lines, names by speaker)}
MEETINGS = {
    1: ([("Speaker 1", "Hey Tomas, I'm Ines."), ("Speaker 2", "Morning Ines, good to have you.")], {"Speaker 1": "Ines", "Speaker 2": "Tomas"}),
    2: ([("Speaker 1", "hey tomas my name is ines"), ("Speaker 2", "fine")], {"Speaker 1": "Ines", "Speaker 2": "Tomas"}),
    3: ([("Speaker 1", "My name is Helena, from accounts."), ("Speaker 2", "This is Yusuf speaking.")], {"Speaker 1": "Helena", "Speaker 2": "Yusuf"}),
    4: ([("Speaker 1", "Tomas, could you open the gate?"), ("Speaker 2", "Of course."), ("Speaker 3", "Ines speaking.")],
        {"Speaker 2": "Tomas", "Speaker 3": "Ines"}),
    5: ([("Speaker 1", "I am sorry, thanks. This is Kafka again."), ("Speaker 2", "I'm in Berlin tonight.")], {}),
    6: ([("Speaker 1", "i am late today, i'm sharing it, i am the last"), ("Speaker 2", "hi folks")], {}),
    7: ([("Speaker 1", "Thank you Tomas."), ("Speaker 2", "I'm Ines, in fact."), ("Speaker 3", "Tomas speaking.")],
        {"Speaker 2": "Ines", "Speaker 3": "Tomas"}),
    8: ([(None, "Hey Tomas, I'm Ines.")], {}),
    9: ([("Speaker 1", "Hey Yusuf, the museum wants an offer for the 3rd of May."), ("Speaker 1", "First the paper, then the ink, then the transport."),
         ("Speaker 2", "Prices came in from two mills in Oslo."), ("Speaker 1", "Thanks, would you forward them?"), ("Speaker 2", "Gladly."),
         ("Speaker 2", "Helena, should the foil be part of it?"), ("Speaker 1", "Leave the foil out this year.")],
        {"Speaker 1": "Helena", "Speaker 2": "Yusuf"}),
    10: ([("Speaker 1", "myself yusuf"), ("Speaker 2", "fine")], {"Speaker 1": "Yusuf"}),
    11: ([("Speaker 1", "Thanks, could you raise the volume?"), ("Speaker 2", "Hi, shall we start?"), ("Speaker 1", "Hello, please do.")], {}),
}


def test_names_found(meeting):
    names, evidence = speakers.name_speakers(meeting({m: lines for m, (lines, _) in MEETINGS.items()}))
    got: dict = {m: {} for m in MEETINGS}
    for r in names.collect():
        got[r.meeting_id][r.speaker] = r.name
    assert got == {m: want for m, (_, want) in MEETINGS.items()}
    assert ("S001", "self_introduction") in {(r.seg_id, r.kind) for r in evidence.where("meeting_id = 3").collect()}


GATE = [
    ("Speaker 1", "Hey Ines, before the break we have to choose an offer for the gate."),
    ("Speaker 1", "The cheapest one would do, nobody looks at a gate."),
    ("Speaker 2", "Morning Tomas."),
    ("Speaker 2", "Too cheap for a yard like ours. Hinges rust within a year."),
    ("Speaker 2", "The steel one costs more but lasts, and the guard can open it."),
    ("Speaker 1", "Ok"),
]


def test_model_names(spark, meeting):
    proposed = [
        (1, "Speaker 2", "Ines", "S001"), (1, "Speaker 1", "Tomas", "S003"),  # each answers a greeting
        (1, "Speaker 1", "Helena", "S002"),  # nobody says it
        (2, "Speaker 1", "Hinges", "S004"), (3, "Speaker 2", "Tomas", "S002"), (4, "Speaker 2", "Ines", "S005"),  # no person, or not in that line
        (5, "Speaker 1", "Ines", "S001"), (6, "Speaker 9", "Ines", "S001"),  # who greets, and who does not speak
    ]
    p = spark.createDataFrame([(m, i, *x) for i, (m, *x) in enumerate(proposed)], "meeting_id long, pos long, label string, name string, seg_id string")
    got = speakers.verify_names(p, meeting({m: GATE for m in range(1, 7)})).collect()
    assert sorted((r.meeting_id, r.speaker, r.name) for r in got) == [(1, "Speaker 1", "Tomas"), (1, "Speaker 2", "Ines")]


def test_short_line_fixes(spark, meeting):
    fixes = [
        (1, "S006", "Speaker 1"),  # the only one allowed
        (2, "S004", "Speaker 1"), (3, "S006", "Speaker 9"), (4, "S006", "Speaker 2"),  # long line, unknown speaker, no change
        (5, "S003", "Speaker 1"), (5, "S006", "Speaker 1"),  # too many lines at once
    ]
    f = spark.createDataFrame([(m, i, *x) for i, (m, *x) in enumerate(fixes)], "meeting_id long, pos long, seg_id string, target string")
    lines = GATE[:-1] + [("Speaker 2", "Ok")]
    got = speakers.verify_fixes(f, meeting({m: lines for m in range(1, 6)})).collect()
    assert [(r.meeting_id, r.seg_id, r.target) for r in got] == [(1, "S006", "Speaker 1")]


def test_candidate_kinds(meeting):
    lines = meeting({1: [("Speaker 1", "Should we rent the hall?"), ("Speaker 2", "Agreed."), ("Speaker 1", "Perhaps a tent is enough."), ("Speaker 1", "where it is."),
                         ("Speaker 1", "Could you phone them by Monday?"), ("Speaker 2", "Yes.")]})
    got = {r.seg_id: (r.ids, r.kinds) for r in items.find_candidates(verify.line_context(lines)).collect()}
    assert got["S001"] == (["S001", "S002"], ["decision"])
    assert got["S003"] == (["S003"], ["proposal"]) and "S004" not in got
    assert got["S005"] == (["S005", "S006"], ["task"])


def test_capitalized_tokens_and_json(spark):
    df = spark.createDataFrame([("Later Nora rang Dr. Lund. Nobody: \"Hello World\" I'm Petra's U.K. aunt",)], "t string")
    got = df.select(T.capitalized_non_initial(F.col("t")).alias("x")).collect()[0].x
    assert got == ["Nora", "Dr", "World", "Petra", "U.K"]
    raw = spark.createDataFrame([("<think>{a}</think>```json\n{\"x\": {\"y\": 1}}\n```",), ("none",)], "t string")
    assert [r.x for r in raw.select(T.extract_json(F.col("t")).alias("x")).collect()] == ['{"x": {"y": 1}}', None]


def test_near_duplicates_merge_evidence(spark):
    d = spark.createDataFrame([
        (1, 1, "paint the north fence", ["S001", "S002"]), (1, 2, "paint the north fence now", ["S002", "S003"]),
        (1, 3, "north fence paint the", ["S003"]), (1, 4, "paint the north fence", ["S008"]), (1, 5, "something else", ["S001"])],
        "meeting_id long, pos long, item string, evidence_ids array<string>")
    got = {r.pos: (r.merged_into, r.evidence_ids) for r in items.dedupe_items(d, "item").collect()}
    assert got[1] == (None, ["S001", "S002", "S003"]) and got[2][0] == 1 and got[3][0] == 1
    assert got[4] == (None, ["S008"]) and got[5] == (None, ["S001"])


def test_ties_go_to_the_speaker_with_the_first_evidence_of_any_sign(spark, meeting):
    lines = meeting({1: [("Speaker 2", "Thanks Tomas."), ("Speaker 2", "Go on."), ("Speaker 2", "Go on."), ("Speaker 1", "I am Ines."), ("Speaker 2", "I am Ines.")]})
    names, _ = speakers.name_speakers(lines)
    assert {(r["speaker"], r["name"]) for r in names.collect() if r["name"] == "Ines"} == {("Speaker 2", "Ines")}


def test_capitals_after_many_blanks_start_a_sentence(spark):
    from groundledger.functions import text as T

    df = spark.createDataFrame([("Done." + " " * n + "Nora came with Petra",) for n in (1, 80)], "t string")
    assert [r[0] for r in df.select(T.capitalized_non_initial(F.col("t"))).collect()] == [["Petra"], ["Petra"]]


def walked(rows):
    """Kept and joined items of one meeting, by a walk over all earlier kept ones."""
    kept, out = {}, {}
    for pos, text, ids in sorted(rows):
        first = min((k for k, (said, own) in kept.items() if set(own) & set(ids or []) and token_set_ratio(said, text) >= 90), default=None)
        if first is None:
            kept[pos] = (text, list(ids or []))
        else:
            kept[first][1].extend(x for x in dict.fromkeys(ids) if x not in kept[first][1])
        out[pos] = first
    return {p: (m, kept[p][1] if m is None else []) for p, m in out.items()}


def test_near_duplicates_equal_a_walk(spark):
    """Random items; in one meeting, which holds a third of them, all cite the first and the last line."""
    rng = random.Random(9)
    base = ["paint the north fence", "paint the north fence now", "north fence the paint", "paint a fence", "colour of the doors", "color of the doors", "doors color of the",
            "x", "x y", "order ninety hinges at once", "order nine hinges at once", "", "  ", "call Petra", "calls Petra", "call petra and Tomas about hinges"]
    rows = []
    for m in range(7):
        for p in range(60 if m == 0 else 20):
            ids = ["S000", "S999"] if m == 0 and p % 3 else [f"S{rng.randrange(12 if m else 40):03d}" for _ in range(rng.randint(0, 3))]
            text = rng.choice(base) + (f" {rng.choice('abc')}" if rng.random() < 0.2 else "")
            rows.append((m, p, text, None if rng.random() < 0.03 else ids))
    df = spark.createDataFrame(rows, "meeting_id long, pos long, item string, evidence_ids array<string>")
    got = {}
    for r in items.dedupe_items(df, "item").collect():
        got.setdefault(r.meeting_id, {})[r.pos] = (r.merged_into, r.evidence_ids)
    for m in range(7):
        assert got[m] == walked([x[1:] for x in rows if x[0] == m]), m
    assert items.dedupe_items(df.limit(0), "item").count() == 0


def test_similar_word_sets_are_all_found(spark):
    rng = random.Random(10)
    pool = ["plan", "plans", "ab", "a", "b", "the", "doors", "door", "naïve", "ninety", "ninty", "qq", "qqq"]
    texts = sorted({" ".join(sorted({rng.choice(pool) for _ in range(rng.randint(1, 6))})) for _ in range(150)})
    df = spark.createDataFrame([(1, t, t) for t in texts], "meeting_id long, class string, text string")
    got = {(r["class"], r["other"]) for r in items.similar_classes(df, ["meeting_id"]).collect()}
    assert got == {(a, b) for a in texts for b in texts if a == b or token_set_ratio(a, b) >= 90}


def test_a_vector_is_measured_once_a_row(spark):
    """Lengths grow with the entries of a vector, not with their square (63 s, not 4, with a norm per entry)."""
    from time import monotonic

    from groundledger.functions import vectors

    rows = spark.range(400).select(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: (i + F.col("id")).cast("double")).alias("v"))
    began = monotonic()
    got = rows.select(vectors.unit(F.col("v")).alias("u")).select(vectors.dot(F.col("u"), F.col("u")).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert abs(got[0] - 1) < 1e-9 and abs(got[1] - 1) < 1e-9
    assert monotonic() - began < 30
    assert spark.sql("SELECT CAST(NULL AS ARRAY<FLOAT>) AS v").select(vectors.unit(F.col("v"))).first()[0] is None
