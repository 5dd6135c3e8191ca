"""Records replaced in one step."""

import pytest
from pyspark.sql import functions as F

from groundledger.sources import versions


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_keys_are_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "records")
    make = lambda data: spark.createDataFrame(data, "meeting_id long, part long, record string")
    with pytest.raises(FileNotFoundError):
        versions.read_current(spark, path, "meeting_id")
    first = [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (None, 0, "n")]
    versions.replace_keys(make(first), path, "meeting_id")
    assert rows(versions.read_current(spark, path, "meeting_id")) == sorted(map(repr, first))
    versions.replace_keys(make([(1, 0, "A"), (3, 0, "d"), (None, 0, "N")]), path, "meeting_id")
    want = sorted(map(repr, [(1, 0, "A"), (2, 0, "c"), (3, 0, "d"), (None, 0, "N")]))
    assert rows(versions.read_current(spark, path, "meeting_id")) == want
    assert versions.read_current(spark, path, "meeting_id").columns == ["meeting_id", "part", "record"]


@pytest.mark.parametrize("step", ["parts", "manifest", "swap"])
def test_a_killed_write_leaves_the_old_record(spark, tmp_path, monkeypatch, step):
    """Stopped between the parts, before the manifest, and before the rename."""
    path = str(tmp_path / "records")
    old = spark.range(20).select((F.col("id") % 4).alias("meeting_id"), F.col("id").alias("part"), F.lit("old").alias("record"))
    versions.replace_keys(old, path, "meeting_id")
    new = old.withColumn("record", F.lit("new"))
    if step == "parts":  # one task of several fails
        bad = new.repartition(4).withColumn("record", F.when(F.col("part") == 7, F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("record")))
        with pytest.raises(Exception, match="killed"):
            versions.replace_keys(bad, path, "meeting_id")
    else:
        def killed(*_):
            raise RuntimeError("killed")

        monkeypatch.setattr(versions, "_manifest" if step == "manifest" else "_swap", killed)
        with pytest.raises(RuntimeError):
            versions.replace_keys(new, path, "meeting_id")
        monkeypatch.undo()
    assert rows(versions.read_current(spark, path, "meeting_id")) == rows(old)
    versions.replace_keys(new.where("meeting_id = 2"), path, "meeting_id")  # the next run is not in the way of the killed one
    assert rows(versions.read_current(spark, path, "meeting_id")) == rows(old.where("meeting_id <> 2").unionByName(new.where("meeting_id = 2")))


def test_stages_run_for_changed_meetings_only(spark, tmp_path):
    from groundledger.plans import stages

    path, seen = str(tmp_path / "stages"), []
    rows = lambda data: spark.createDataFrame(data, "meeting_id long, text string, words array<string>")

    def work(df):
        seen.append(sorted(r[0] for r in df.select("meeting_id").distinct().collect()))
        return df.where("text <> 'nothing'").select("meeting_id", F.upper("text").alias("text"))

    def run(data):
        return sorted(tuple(r) for r in stages.run_stage(spark, path, "upper", rows(data), "meeting_id", work).collect())

    first = [(1, "a", ["x"]), (1, "b", None), (2, "c", []), (3, "d", [])]
    assert run(first) == [(1, "A"), (1, "B"), (2, "C"), (3, "D")] and seen == [[1, 2, 3]]
    assert run(first[::-1]) == [(1, "A"), (1, "B"), (2, "C"), (3, "D")] and len(seen) == 1  # nothing changed, nothing done
    assert run([(1, "a", ["x"]), (1, "b", None), (2, "nothing", []), (4, "e", [])]) == [(1, "A"), (1, "B"), (4, "E")] and seen[1:] == [[2, 4]]
    assert run([(1, "a", ["x"]), (1, "a", ["x"]), (4, "e", [])]) == [(1, "A"), (1, "A"), (4, "E")] and seen[2:] == [[1]]


def test_a_stage_killed_before_the_ledger_runs_again(spark, tmp_path, monkeypatch):
    from groundledger.plans import stages

    path, rows = str(tmp_path / "stages"), spark.createDataFrame([(1, "a"), (2, "b")], "meeting_id long, text string")
    whole = versions.replace_keys

    def killed(df, at, *rest):
        if "ledger" in at:
            raise RuntimeError("killed")
        whole(df, at, *rest)

    monkeypatch.setattr(versions, "replace_keys", killed)
    with pytest.raises(RuntimeError):
        stages.run_stage(spark, path, "copy", rows, "meeting_id", lambda df: df)
    monkeypatch.undo()
    assert stages.run_stage(spark, path, "copy", rows, "meeting_id", lambda df: df).count() == 2
