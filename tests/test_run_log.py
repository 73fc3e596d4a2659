"""The run store's manifests: crashes, replays, rival writers, folding, and what is not read."""

import os
import shutil

import pytest
from pyspark.sql import types as T

from riskengine import schema as S
from riskengine.sources import run_log, store as ST
from riskengine.streaming import stream as R


def scored(spark, n=5, label="M", parts=2):
    rows = [(f"{label}{i}", *[float(i)] * 8, i / 10.0, int(i / 10.0 >= 0.3), "x") for i in range(n)]
    df = spark.createDataFrame(rows, "machine_label string, " + ", ".join(f"{c} double" for c in S.FEATURE_COLUMNS)
                               + ", risk_probability double, predicted_risk int, recommendation string")
    return df.repartition(parts)


def state(spark, root):
    """{run_id: (records in the log, labels stored)}"""
    runs, preds = ST.load(spark, root)
    labels = {}
    for r in preds.select("run_id", "machine_label").collect():
        labels.setdefault(r.run_id, set()).add(r.machine_label)
    return {r.run_id: (r.record_count, labels.get(r.run_id, set())) for r in runs.collect()}


def test_empty_batch_first_between_and_as_replay(spark, tmpdir_run):
    root = f"{tmpdir_run}/store"
    ST.save_batch(scored(spark, 0), root, "none", run_id="a")
    assert state(spark, root) == {"a": (0, set())}
    run = ST.load(spark, root)[0].first()
    assert (run.total_records, run.average_risk, run.high_risk, run.source_name) == (0, 0.0, 0, "none")
    ST.save_batch(scored(spark, 3), root, "some", run_id="b")
    ST.save_batch(scored(spark, 0), root, "none", run_id="c")
    assert state(spark, root) == {"a": (0, set()), "b": (3, {"M0", "M1", "M2"}), "c": (0, set())}
    ST.save_batch(scored(spark, 0), root, "none", run_id="b")
    assert state(spark, root)["b"] == (0, set()) and ST.load(spark, root)[1].count() == 0


STEPS = [("riskengine.sources.run_log", "write_text"), ("riskengine.sources.run_log", "move"), ("riskengine.sources.run_log", "commit"),
         ("riskengine.sources.store", "_commit"), ("riskengine.sources.store", "predictions_frame")]


@pytest.mark.parametrize("module,step", STEPS)
def test_a_crash_leaves_the_old_run_whole(spark, tmpdir_run, monkeypatch, module, step):
    root = f"{tmpdir_run}/store"
    ST.save_batch(scored(spark, 4, "OLD"), root, "first", run_id="r")
    before = state(spark, root)

    def die(*_, **__):
        raise RuntimeError("died")

    with monkeypatch.context() as m:
        m.setattr(f"{module}.{step}", die)
        for rid in ("r", "other"):
            with pytest.raises(RuntimeError):
                ST.save_batch(scored(spark, 2, "NEW"), root, "second", run_id=rid)
        assert state(spark, root) == before
    ST.save_batch(scored(spark, 2, "NEW"), root, "second", run_id="r")
    assert state(spark, root) == {"r": (2, {"NEW0", "NEW1"})}
    assert ST.vacuum(spark, root) >= 1 and state(spark, root) == {"r": (2, {"NEW0", "NEW1"})}


def test_a_crash_after_the_commit_leaves_the_new_run_whole(spark, tmpdir_run, monkeypatch):
    root = f"{tmpdir_run}/store"
    ST.save_batch(scored(spark, 4, "OLD"), root, "first", run_id="r")
    with monkeypatch.context() as m:
        m.setattr(run_log, "BUCKET", 1)              # folding comes right after the commit

        def die(*_):
            raise RuntimeError("died")

        m.setattr(run_log, "fold", die)
        with pytest.raises(RuntimeError):
            ST.save_batch(scored(spark, 2, "NEW"), root, "second", run_id="r")
        assert state(spark, root) == {"r": (2, {"NEW0", "NEW1"})}


def test_rival_writers_take_turns(spark, tmpdir_run, monkeypatch):
    """Another writer commits between a save's look at the log and its own commit."""
    root, real, rival = f"{tmpdir_run}/store", run_log.last, []

    def last(s, r):
        entry = real(s, r)
        if len(rival) == 1:                          # the second look is the one of the commit
            rival.append("done")
            ST.save_batch(scored(spark, 3, "B"), root, "rival", mode="integer")
        elif not rival:
            rival.append("look")
        return entry

    monkeypatch.setattr(run_log, "last", last)
    rid = ST.save_batch(scored(spark, 4, "A"), root, "own", mode="integer")
    monkeypatch.undo()
    assert rid == "2" and state(spark, root) == {"1": (3, {f"B{i}" for i in range(3)}), "2": (4, {f"A{i}" for i in range(4)})}
    ids = [r.id for r in ST.load(spark, root)[1].select("id").collect()]
    assert sorted(ids) == list(range(1, 8))


def test_a_taken_number_is_refused(spark, tmpdir_run):
    entry = {"seq": 0, "op": "delete", "run_id": "x"}
    run_log.commit(spark, tmpdir_run, entry)
    with pytest.raises(run_log.Taken):
        run_log.commit(spark, tmpdir_run, {**entry, "run_id": "y"})
    assert [r.run_id for r in run_log.entries(spark, tmpdir_run).collect()] == ["x"]


def test_a_save_opens_no_older_run(spark, tmpdir_run):
    """Saving works, with dense ids and the store's columns, after older rows are gone for good."""
    root = f"{tmpdir_run}/store"
    ST.create_store(spark, root, T.StructType([f for f in S.PREDICTIONS_SCHEMA if f.name != "pressure"]))
    ST.save_batch(scored(spark, 6, parts=3), root, "a", run_id="a")
    shutil.rmtree(f"{root}/machine_predictions")
    ST.save_batch(scored(spark, 2), root, "b", run_id="b")
    last = run_log.last(spark, root)
    assert (last["first_id"], last["next_id"]) == (7, 9) and "pressure" not in last["columns"]
    with pytest.raises(Exception):
        ST.load(spark, root)                         # the older run's rows are really missing
    assert ST.load_recent(spark, root, 2).count() == 2


def test_runs_of_several_schemas_are_one_table(spark, tmpdir_run):
    root = f"{tmpdir_run}/store"
    ST.save_batch(scored(spark, 2, "A"), root, "a", run_id="a")
    narrow = T.StructType([f for f in S.PREDICTIONS_SCHEMA if f.name not in ("pressure", "recommendation")])
    ST.create_store(spark, root, narrow)             # from here on the store has fewer columns
    ST.save_batch(scored(spark, 3, "B"), root, "b", run_id="b")
    _, preds = ST.load(spark, root)
    rows = {r.machine_label: r for r in preds.collect()}
    assert rows["A1"].pressure == 1.0 and rows["B1"].pressure is None and rows["B1"].recommendation is None
    assert sorted(r.id for r in rows.values()) == [1, 2, 3, 4, 5]


def test_folded_buckets(spark, tmpdir_run, monkeypatch):
    monkeypatch.setattr(run_log, "BUCKET", 4)
    root = f"{tmpdir_run}/store"
    for i in range(10):
        ST.save_batch(scored(spark, 1 + i % 2, f"R{i}-", 1), root, "s", run_id=f"run-{i % 7}")
    ST.delete_run(spark, root, "run-6")
    buckets = run_log.names(spark, f"{root}/_log")
    assert len(buckets) == 3
    assert [os.path.exists(f"{root}/_log/{b}/all.json") for b in buckets] == [True, True, False]
    assert len(run_log.paths(spark, root)) == 2 + 3
    assert state(spark, root) == {f"run-{i % 7}": (1 + i % 2, {f"R{i}-{k}" for k in range(1 + i % 2)}) for i in (3, 4, 5, 7, 8, 9)}
    times = [r.saved_us for r in run_log.entries(spark, root).where("op = 'save'").orderBy("seq").collect()]
    assert times == sorted(times)


def test_recent_reads_the_newest_folders_only(spark, tmpdir_run, monkeypatch):
    monkeypatch.setattr(run_log, "BUCKET", 2)
    root = f"{tmpdir_run}/store"
    for i in range(6):
        ST.save_batch(scored(spark, 3, f"R{i}-"), root, "s", run_id=f"run-{i}")
    ST.save_batch(scored(spark, 3, "again-"), root, "s", run_id="run-0")
    ST.delete_run(spark, root, "run-5")
    whole = ST.recent(*reversed(ST.load(spark, root)), 7).collect()
    old = {r.run_id: r.folder for r in run_log.live(run_log.entries(spark, root)).collect()}
    for rid in ("run-1", "run-2", "run-3"):
        shutil.rmtree(f"{root}/machine_predictions/{old[rid]}")
    got = ST.load_recent(spark, root, 6)
    assert [r.machine_label for r in got.collect()] == [r.machine_label for r in whole][:6]
    assert {os.path.basename(os.path.dirname(f)) for f in got.inputFiles() if "machine_predictions" in f} == {old["run-0"], old["run-4"]}
    assert ST.load_recent(spark, f"{tmpdir_run}/none", 5).count() == 0


def test_stream_goes_on_after_an_empty_first_batch(spark, tmpdir_run):
    src, root, ck = (f"{tmpdir_run}/{x}" for x in ("feed", "store", "ck"))
    scored(spark, 0, parts=1).write.parquet(src)
    schema = scored(spark, 0).schema
    for n in (0, 4, 0, 2):
        scored(spark, n, f"N{n}-", 1).write.mode("append").parquet(src)
        sdf = spark.readStream.schema(schema).parquet(src)
        R.sink_stream(sdf, root, ck, name="feed").awaitTermination(120)
    counts = sorted(n for n, _ in state(spark, root).values())
    assert sum(counts) == 6 and counts[-2:] == [2, 4]
