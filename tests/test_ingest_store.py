"""CSV ingestion (S1-S6) on awkward files and the run store."""

import os

import pytest
from pyspark.sql import functions as F

from riskengine import schema as S
from riskengine.sources import ingest as I
from riskengine.sources import store as ST


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_sniff_header_and_separator():
    lines = ["report", "generated today", "a;b;c", "1;2;3"]
    assert I.sniff(lines) == (2, ";")
    assert I.sniff(["x\ty\tz", "1\t2\t3"]) == (0, "\t")
    assert I.header_names('a,"b,c",,a', ",") == ["a", "b,c", "Unnamed: 2", "a.1"]


def test_preamble_semicolon_quotes_bad_lines(spark, tmpdir_run):
    body = "\n".join(f"M{i};{60 + i};{i % 9};{50 + i};{i % 4};{i % 2}" for i in range(90))
    text = ("Exported by plant system\nsite: north\n"
            "machine_id;temperature;vibration;load;errors;label\n"
            "S1;70\n\n" + body + '\nQ1;"90;5";7;90;4;1\nBAD;1;2;3;4;5;6;7\n')
    # (rows with more raw separators than the header must come after the 80 sniffed lines,
    # or they are taken as the header -- the reference's rule)
    p = _write(tmpdir_run, "plant.csv", text)
    raw = I.read_flexible_csv(spark, p)
    assert raw.columns[:6] == ["machine_id", "temperature", "vibration", "load", "errors", "label"]
    rows = {r.machine_id: r for r in raw.collect()}
    assert "BAD" not in rows and "Exported by plant system" not in rows
    assert rows["Q1"].temperature == "90;5"          # quoted separator kept in the field
    assert rows["S1"].vibration is None              # short row padded
    assert len(rows) == 92
    std = I.load_dataset(spark, p)
    r = {x.machine_label: x for x in std.collect()}
    assert r["Q1"].machine_temperature == S.FEATURE_DEFAULTS["machine_temperature"]  # "90;5" is not a number
    assert r["M3"].machine_temperature == 63.0 and r["M3"].downtime_risk == 1
    assert r["M3"].bearing_temperature == 69.0       # bearing missing everywhere: machine temp + 6


def test_ai4i_and_position_labels(spark, tmpdir_run):
    p = _write(tmpdir_run, "ai4i.csv",
               "UDI,Product ID,Air temperature [K],Process temperature [K],Rotational speed [rpm],Torque [Nm],"
               "Tool wear [min],Machine failure,TWF\n1,M14860,298.1,308.6,1551,42.8,0,0,0\n2,L47181,298.2,308.7,1408,46.3,3,1,1\n")
    out = {r.machine_label: r for r in I.load_dataset(spark, p).collect()}
    assert out["M14860"].bearing_temperature == 298.1 and out["L47181"].downtime_risk == 1
    q = _write(tmpdir_run, "nolabel.csv", "temperature,vibration\n70,1\n71,2\n72,3\n")
    labels = [r.machine_label for r in I.load_dataset(spark, q).orderBy("record").collect()]
    assert labels == ["MCH-0001", "MCH-0002", "MCH-0003"]


def test_unreadable_files(spark, tmpdir_run):
    with pytest.raises(ValueError):
        I.read_flexible_csv(spark, _write(tmpdir_run, "one.csv", "justonecolumn\n1\n2\n"))
    with pytest.raises(ValueError):
        I.read_flexible_csv(spark, _write(tmpdir_run, "hdr.csv", "a,b,c\n"))


def test_read_many_unions_by_name(spark, tmpdir_run):
    a = _write(tmpdir_run, "a.csv", "machine,temperature\nA1,70\nA2,80\n")
    b = _write(tmpdir_run, "b.csv", "asset_id;load\nB1;90\n")
    out = I.read_many(spark, {"first": a, "second": b})
    got = {(r.dataset, r.machine_label) for r in out.collect()}
    assert got == {("first", "A1"), ("first", "A2"), ("second", "B1")}


def _scored(spark, n=5, label_prefix="M"):
    rows = [(f"{label_prefix}{i}", *[float(i)] * 8, 0, i / 10.0, int(i / 10.0 >= 0.3), "x") for i in range(n)]
    return spark.createDataFrame(rows, "machine_label string, " + ", ".join(f"{c} double" for c in S.FEATURE_COLUMNS)
                                 + ", downtime_risk int, risk_probability double, predicted_risk int, recommendation string")


def test_store_roundtrip_idempotent_and_cascade(spark, tmpdir_run):
    root = os.path.join(tmpdir_run, "store")
    rid = ST.save_batch(_scored(spark), root, "batch-a")
    rid2 = ST.save_batch(_scored(spark, 3, "N"), root, "batch-b", run_id="fixed-id")
    ST.save_batch(_scored(spark, 3, "N"), root, "batch-b", run_id="fixed-id")   # replay: no duplicates
    runs, preds = ST.load(spark, root)
    assert runs.count() == 2 and preds.count() == 8
    summary = runs.filter(F.col("run_id") == rid).first()
    assert summary.record_count == 5 and summary.high_risk_count == 2 and abs(summary.average_risk - 0.2) < 1e-12
    assert summary.total_records == 5 and summary.source_name == "batch-a"
    recent = ST.recent(preds, runs, 25)
    assert recent.columns == ST.RECENT_COLUMNS and recent.count() == 8
    assert ST.orphans(preds, runs).count() == 0
    ST.delete_run(spark, root, rid2)
    runs, preds = ST.load(spark, root)
    assert runs.count() == 1 and preds.count() == 5
    assert ST.runs_join(preds, runs).count() == 5


def test_uncommitted_batch_is_invisible(spark, tmpdir_run):
    root = os.path.join(tmpdir_run, "store2")
    ST.save_batch(_scored(spark), root, "ok")
    # a writer that died after the predictions but before its manifest
    ST.predictions_frame(_scored(spark, 2, "Z"), "dead-run").write.parquet(f"{root}/machine_predictions/dead")
    runs, preds = ST.load(spark, root)
    assert preds.filter(F.col("machine_label").startswith("Z")).count() == 0 and preds.count() == 5
    # frames of other origin: rows without a run row
    dead = ST.predictions_frame(_scored(spark, 2, "Z"), "dead-run")
    assert ST.orphans(dead, runs).count() == 2 and ST.recent(dead, runs, 100).count() == 0


def test_align_to_schema_and_metrics(spark, tmpdir_run):
    df = spark.createDataFrame([("r1", 3)], "run_id string, record_count long")
    out = ST.align_to_schema(df, S.RUNS_SCHEMA)
    assert out.columns == [f.name for f in S.RUNS_SCHEMA.fields] and out.first().record_count == 3
    p = os.path.join(tmpdir_run, "metrics")
    assert ST.load_metrics(spark, p) == {}
    ST.save_metrics(spark, {"accuracy": 0.9765, "f1_score": 0.6466165413533834}, p)
    m = ST.load_metrics(spark, p)
    assert m["f1"] == 0.6466165413533834 and m["accuracy"] == 0.9765
    ST.write_csv(_scored(spark), os.path.join(tmpdir_run, "csv"), ["machine_label", "risk_probability"])
    back = spark.read.option("header", True).csv(os.path.join(tmpdir_run, "csv"))
    assert back.columns == ["machine_label", "risk_probability"] and back.count() == 5


def test_multiline_quoted_records(spark, tmpdir_run):
    p = _write(tmpdir_run, "ml.csv", 'note\nmachine,comment,temperature\nA,"line one\nline two",70\nB,plain,80\n')
    rows = {r.machine: r for r in I.read_flexible_csv(spark, p, multiline=True).collect()}
    assert rows["A"].comment == "line one\nline two" and rows["B"].temperature == "80" and len(rows) == 2


def test_quoted_separators_do_not_make_a_header(spark, tmpdir_run):
    p = _write(tmpdir_run, "q.csv", 'machine,comment,temperature,label\nM1,ok,70,0\nM2,"hot, loud, shaking, oily",99,1\nM3,"say ""hi"" now",71,0\n')
    rows = {r.machine: r for r in I.read_flexible_csv(spark, p).collect()}
    assert set(rows) == {"M1", "M2", "M3"}
    assert rows["M2"].comment == "hot, loud, shaking, oily" and rows["M3"].comment == 'say "hi" now'
    out = os.path.join(tmpdir_run, "quotes")
    ST.write_csv(spark.createDataFrame([("a", 'x "y", z')], "machine string, comment string"), out)
    assert I.read_flexible_csv(spark, out).first().comment == 'x "y", z'


def test_data_rows_equal_to_the_header_stay(spark, tmpdir_run):
    p = _write(tmpdir_run, "same.csv", "export\nmachine,temperature\nA,1\nexport\nmachine,temperature\nB,2\n")
    rows = I.read_flexible_csv(spark, p).collect()
    assert [r.machine for r in rows] == ["A", "export", "machine", "B"]


def test_files_with_other_headers_are_refused(spark, tmpdir_run):
    d = os.path.join(tmpdir_run, "mixed")
    os.makedirs(d)
    _write(d, "a.csv", "machine,temperature,load\nA1,70,50\n")
    _write(d, "b.csv", "machine,load,temperature\nB1,60,80\n")
    with pytest.raises(ValueError, match="header"):
        I.read_flexible_csv(spark, d)


def test_store_times_ids_labels_and_errors(spark, tmpdir_run):
    root = os.path.join(tmpdir_run, "store3")
    one = ST.save_batch(_scored(spark, 6).repartition(3), root, "a", mode="integer")
    two = ST.save_batch(_scored(spark, 4).drop("machine_label"), root, "b", mode="integer")
    assert (one, two) == ("1", "2")
    runs, preds = ST.load(spark, root)
    assert preds.select("id").distinct().count() == 10
    for rid in (one, two):
        times = {r.created_at for r in preds.where(F.col("run_id") == rid).collect()}
        times |= {r.created_at for r in runs.where(F.col("run_id") == rid).collect()}
        assert len(times) == 1
    assert {r.machine_label for r in preds.where("run_id = '2'").collect()} == {f"MCH-{i:04d}" for i in range(1, 5)}
    ST.save_batch(_scored(spark, 2), root, "again", run_id="2")          # a replay replaces the summary too
    runs, preds = ST.load(spark, root)
    again = runs.where("run_id = '2'").collect()
    assert len(again) == 1 and again[0].record_count == 2 and again[0].source_name == "again"
    ST.save_batch(_scored(spark, 0), root, "none", run_id="empty")
    assert ST.load(spark, root)[0].count() == 3
    broken = os.path.join(tmpdir_run, "broken", "machine_predictions")
    one = ST.save_batch(_scored(spark, 2), os.path.dirname(broken), "a")
    _write(os.path.join(broken, one), "part-1.parquet", "not parquet")
    with pytest.raises(Exception):
        ST.load(spark, os.path.dirname(broken))[1].count()


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _awkward_files(rng, folder, n_files):
    """Files of random records, some with fields too many; returns the records that stay."""
    parts = ["x", "long text of many words " * 6, 'say ""so""', ",", "\n", "\n\n", '""', "a,b", "\r\n", "é"]
    kept = []
    for f in range(n_files):
        text = "exported\nmachine,comment,temperature\n"
        for i in range(rng.randrange(120, 180)):
            field = "".join(rng.choices(parts, k=rng.randrange(0, 6)))
            # (plain ones first: the lines that the header is sniffed from)
            comment = f'"{field}"' if i > 80 and rng.random() < 0.8 else rng.choice(["plain", '5" pipe', "", "it's"])
            long = i > 90 and i % 7 == 0
            text += f"M{f}-{i},{comment},{i}" + (",9,9" if long else "") + rng.choice(["\n", "\r\n"])
            if rng.random() < 0.1:
                text += "\n"
            if not long:
                said = field.replace('""', '"') if comment.startswith('"') else comment
                kept.append((f"M{f}-{i}", said, str(i)))
        with open(os.path.join(folder, f"p{f}.csv"), "w", newline="") as out:
            out.write(text)
    return kept


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quoted_line_breaks_over_many_splits(spark, tmpdir_run, small_splits, seed):
    import random

    kept = _awkward_files(random.Random(seed), tmpdir_run, 3)
    raw = I.read_flexible_csv(spark, tmpdir_run, multiline=True)
    assert raw.select("_file", "_block").distinct().count() > 30
    rows = raw.orderBy("_pos").collect()
    assert [r.machine for r in rows] == [k[0] for k in kept]
    assert [(r.comment or "", r.temperature) for r in rows] == [k[1:] for k in kept]
    numbered = I.load_dataset(spark, tmpdir_run, multiline=True).orderBy("record").collect()
    assert [(r.record, r.machine_label) for r in numbered] == [(i, k[0]) for i, k in enumerate(kept)]


def test_positions_over_many_splits(spark, tmpdir_run, small_splits):
    n = 400
    for f in range(3):
        body = "".join(f"{f * n + i},{i % 5}" + (",9,9" if i % 50 == 49 and i > 90 else "") + "\n" + "\n" * (i % 13 == 0)
                       for i in range(n))
        _write(tmpdir_run, f"p{f}.csv", "site\ntemperature,vibration\n" + body)
    kept = [f * n + i for f in range(3) for i in range(n) if not (i % 50 == 49 and i > 90)]
    out = I.load_dataset(spark, tmpdir_run)
    assert [(r.record, r.machine_label, int(r.machine_temperature)) for r in out.orderBy("record").collect()] == [
        (i, f"MCH-{i + 1:04d}", t) for i, t in enumerate(kept)]
    plan = out._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "riskengine-index" not in plan


def test_a_file_that_ends_inside_quotes_is_refused(spark, tmpdir_run):
    p = _write(tmpdir_run, "open.csv", 'machine,comment\nA,"never closed\nB,x\n')
    with pytest.raises(ValueError, match="quoted"):
        I.read_flexible_csv(spark, p, multiline=True)


def _csv_parts(path, rows):
    for part in range(2):
        with open(os.path.join(path, f"p{part}.csv"), "w") as f:
            f.write("machine id,note,vibration\n" + "".join(rows(part, i) for i in range(50)))
    return path


def test_positions_take_no_shuffle_of_lines(spark, tmpdir_run):
    path = _csv_parts(tmpdir_run, lambda p, i: f"M{p}-{i},x,{i}.5\n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw = I.read_flexible_csv(spark, path)
        plan = raw._jdf.queryExecution().executedPlan().toString()
        got = [(r["machine id"], r["_pos"]) for r in raw.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan
    assert sorted(got, key=lambda g: g[1]) == [(f"M{p}-{i}", 50 * p + i) for p in range(2) for i in range(50)]


def test_records_with_line_breaks_are_found_once(spark, tmpdir_run):
    path = _csv_parts(tmpdir_run, lambda p, i: f'M{p}-{i},"a\n""b"",\n{i}",{i}.5\n')
    raw = I.read_flexible_csv(spark, path, multiline=True)
    assert all("riskengine-records-" in f for f in raw.inputFiles())      # later steps do not read the lines again
    got = [(r["machine id"], r["note"]) for r in raw.orderBy("_pos").collect()]
    assert got == [(f"M{p}-{i}", f'a\n"b",\n{i}') for p in range(2) for i in range(50)]
