"""Streams against their batch twins, sinks and sources."""

import json
import os
import tempfile
import uuid

from conftest import SF, PRINT_SHOP
from groundledger.catalog.bindings import Tables
from groundledger.catalog.q_streams import word_stream
from groundledger.operators import assemble, jobs
from groundledger.session import checkpoint_dir
from groundledger.sources import readers, sinks
from groundledger.streaming import live
from pyspark.sql import functions as F


def event_stream(spark, t):
    raw = spark.readStream.schema(t.given("events").schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    stage = F.when(F.col("event_id") % 2 == 0, "refining").otherwise("verifying")
    status = F.when(F.col("event_type") == "signup", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return lambda df: df.select(F.col("user_id").alias("meeting_id"), "event_id", F.col("ts").cast("timestamp").alias("event_time"),
                                stage.alias("stage"), status.alias("status"), F.lit(50).alias("within_pct")), raw


def memory(df, mode):
    name = "m" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_progress_stream_equals_batch(spark):
    t = Tables(spark, SF)
    shape, raw = event_stream(spark, t)
    checkpoint_dir(spark)
    stream = memory(live.latest_progress(shape(raw)), "update")
    batch = live.latest_progress(shape(t.given("events")))
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_completion_feed_stream_equals_batch(spark):
    t = Tables(spark, SF)
    shape, raw = event_stream(spark, t)
    stream = memory(live.completion_feed(shape(raw)), "append")
    batch = live.completion_feed(shape(t.given("events")))
    assert sorted(r.event_id for r in stream.collect()) == sorted(r.event_id for r in batch.collect())


def test_interrupted_meetings_stream(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    schema = "meeting_id long, event_time timestamp, stage string, status string"
    base = "2024-01-01 00:00:00"
    first = spark.createDataFrame([(1, "refining", "running"), (2, "done", "completed")], "meeting_id long, stage string, status string").withColumn(
        "event_time", F.lit(base).cast("timestamp")).select("meeting_id", "event_time", "stage", "status")
    first.coalesce(1).write.parquet(f"{folder}/in/a")
    later = spark.createDataFrame([(3, "2024-01-01 09:00:00"), (3, "2024-01-01 09:30:00")], "meeting_id long, t string").select(
        "meeting_id", F.col("t").cast("timestamp").alias("event_time"), F.lit("refining").alias("stage"), F.lit("running").alias("status"))
    for name, df in (("b", later), ("c", later.withColumn("event_time", F.col("event_time") + F.expr("interval 1 minute")))):
        df.coalesce(1).write.parquet(f"{folder}/in/{name}")
    src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = memory(live.interrupted_meetings(src, 3_600_000, "1 minute"), "append")
    got = {(r.meeting_id, r.status) for r in out.collect()}
    assert (1, "failed") in got and not any(m == 2 for m, _ in got)


def test_live_lines_equal_a_plain_loop(spark):
    t = Tables(spark, SF)
    got = live.run_to_table(live.live_lines(word_stream(t)), tempfile.mkdtemp(prefix="spark-"))
    rows = t.given("conversations").orderBy("conv_id", "turn").collect()
    want, cur = [], None
    for r in rows:
        for i, w in enumerate(r.text.split()):
            start = r.turn * 5400 * 20 + i * 250
            end = start + 200
            if cur and (cur[0] != r.conv_id):
                want.append(tuple(cur[:5]))
                cur = None
            if cur and (r.role != cur[4] or start - cur[2] > 1000 or end - cur[1] > 30000 or cur[3] >= 60
                        or (live._ends(cur[5]) and (r.turn != cur[6] or cur[3] >= 12))):
                want.append((cur[0], cur[1], cur[2], cur[3], cur[4]))
                cur = None
            cur = [r.conv_id, start if cur is None else cur[1], end, 1 if cur is None else cur[3] + 1, r.role, w, r.turn]
    want.append(tuple(cur[:5]))
    lines = got.collect()
    assert sorted(map(tuple, lines)) == sorted(want)
    assert sum(r.n_words for r in lines) == sum(len(r.text.split()) for r in rows)


def test_words_of_a_table_in_parts_reach_the_stream(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    turns = Tables(spark, SF).given("conversations")
    turns.repartition(3).write.parquet(f"{folder}/conversations.parquet")
    parts, whole = (memory(word_stream(Tables(spark, d)), "append") for d in (folder, SF))
    assert parts.count() == whole.count() > 0


def test_open_lines_pass_from_batch_to_batch(spark, monkeypatch):
    monkeypatch.setattr(assemble, "WORD_CHUNK", 64)  # far fewer rows than the meeting
    word = lambda i: "so." if i % 7 == 0 else f"w{i}"
    rows = [(1, i // 40, i * 250, i * 250 + 200, word(i), "A") for i in range(500)] + [(2, 0, 0, 200, "alone", "B")]
    folder = tempfile.mkdtemp(prefix="spark-")
    for n, (a, b) in enumerate(((0, 137), (137, 301), (301, 501))):
        end = [(1, 99, 0, 0, None, "A")] if n == 2 else []
        spark.createDataFrame(rows[a:b] + end, live._WORD).coalesce(1).write.parquet(f"{folder}/in/{n}")
    src = spark.readStream.schema(live._WORD).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    assert isinstance(live.live_lines(src), live.LiveLines)
    got = live.run_to_table(live.live_lines(src), folder).collect()
    want, cur = [], None
    for m, seg, start, end, w, who in rows[:500]:
        if cur and (end - cur[1] > 30000 or cur[3] >= 60 or (live._ends(cur[5]) and (seg != cur[6] or cur[3] >= 12))):
            want.append(tuple(cur[:5]))
            cur = None
        cur = [m, start if cur is None else cur[1], end, 1 if cur is None else cur[3] + 1, who, w, seg]
    assert sorted(map(tuple, got)) == sorted([*want, tuple(cur[:5])])  # meeting 2 has not ended


def test_record_json_is_cut_in_parts_and_keeps_items_of_a_meeting_without_lines(spark, meeting, monkeypatch):
    monkeypatch.setattr(sinks, "PART", 3)
    ids = F.array(F.lit("S001")).alias("evidence_ids")
    n = spark.range(7).select(F.lit(2).cast("long").alias("meeting_id"), F.col("id").alias("pos"), F.when(F.col("id") > 0, F.lit(1).cast("long")).alias("first_ord"), ids)
    text = [F.lit("x").alias(c) for c in ("topic", "text", "id", "decision", "agreement", "proposal", "task", "owner", "deadline", "quote")]
    full = n.select("*", *text, F.lit("minutes").alias("section"), F.lit(False).alias("demoted"), F.array(F.lit("f")).alias("flags"))
    out = sinks.record_json(meeting({1: PRINT_SHOP}), full, full, full, full, spark.createDataFrame([(2, 5)], "meeting_id long, edits_accepted long")).collect()
    assert {(r.meeting_id, r.section, r.part) for r in out} == {(1, "transcript", p) for p in range(3)} | {(2, "fidelity", 0)} | {
        (2, s, p) for s in ("sentences", "decisions", "open_proposals", "action_items") for p in range(3)}
    said = [x["pos"] for r in sorted(out, key=lambda r: r.part) if r.section == "decisions" for x in json.loads(r.record)]
    assert said == list(range(7))


def test_transcripts_round_trip(spark, meeting):
    segs = meeting({1: PRINT_SHOP, 2: PRINT_SHOP[:2]})
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "t")
    sinks.write_replacing(segs, path, "meeting_id")
    with open(os.path.join(path, "meeting_id=2", "bad.json"), "w") as f:
        f.write("{broken\n")
    back = readers.read_transcripts(spark, path)
    assert sorted((r.meeting_id, r.seg_id, r.text, len(r.words)) for r in back.collect()) == sorted(
        (r.meeting_id, r.seg_id, r.text, len(r.words)) for r in segs.collect())
    (lost,) = readers.unreadable_transcripts(spark, path).collect()
    assert lost.content == "{broken" and lost.path.endswith("bad.json")
    sinks.write_replacing(meeting({2: PRINT_SHOP[:1]}), path, "meeting_id")
    assert readers.read_transcripts(spark, path).groupBy("meeting_id").count().orderBy("meeting_id").collect() == [(1, 8), (2, 1)]


def test_text_parts_keep_every_line(spark, monkeypatch):
    monkeypatch.setattr(sinks, "PART", 3)
    segs = spark.createDataFrame([(1, i + 1, i * 61_000, "A" if i % 2 else None, f"t{i}") for i in range(8)],
                                 "meeting_id long, ord long, start_ms long, speaker string, text string")
    parts = [r.text for r in sinks.transcript_text(segs).orderBy("part").collect()]
    assert len(parts) == 3 and "".join(parts).splitlines() == [
        f"[00:{i * 61 // 60:02d}:{i * 61 % 60:02d}] {'A: ' if i % 2 else ''}t{i}" for i in range(8)]


def test_manifest_and_job_reuse(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    open(f"{folder}/a.mp3", "wb").write(b"x" * 10)
    open(f"{folder}/b.txt", "wb").write(b"y")
    m = readers.read_manifest(spark, folder)
    got = {os.path.basename(r.path): r.e for r in m.select("path", readers.manifest_error(F.col("path"), F.col("size_bytes"), F.lit(8000)).alias("e")).collect()}
    assert got == {"a.mp3": "E_TOO_LONG", "b.txt": "E_UNSUPPORTED_FORMAT"}
    j = spark.createDataFrame([("1", 1, "h", "d", "completed", 5, "gpt (cloud)"), ("2", 2, "h", "d", "completed", 9, "local"), ("3", 3, "h", "d", "failed", 10, "x")],
                              "id string, job_no long, file_sha256 string, device_id string, status string, created_s long, lm2 string")
    up = spark.createDataFrame([("h", "d", True), ("h", "d", False), ("z", "d", False)], "file_sha256 string, device_id string, wants_cloud boolean")
    assert sorted((r.wants_cloud, r.reuse_id) for r in jobs.already_processed(up, j, ["file_sha256", "device_id"]).collect() if r.file_sha256 == "h") == [
        (False, "2"), (True, None)]
