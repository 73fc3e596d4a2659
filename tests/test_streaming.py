"""Structured Streaming: scoring, KPIs per window, crossings with state, idempotent sink."""

import os

from pyspark.sql import functions as F

from riskengine.sources import fixtures as FX
from riskengine.sources import store as ST
from riskengine.streaming import stream as R
from tests.conftest import SF_SMALL


def _files(spark, d, n_files=3):
    f = FX.fleet(spark, SF_SMALL).withColumn("ts", F.col("ts").cast("timestamp"))
    src = os.path.join(d, "feed")
    f.repartition(n_files).write.parquet(src)
    return src, f.schema


def _run_memory(sdf, name, mode="append"):
    q = sdf.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return q


def test_score_stream_matches_batch(spark, tmpdir_run):
    src, schema = _files(spark, tmpdir_run)
    sdf = spark.readStream.schema(schema).parquet(src)
    _run_memory(R.score_stream(sdf, keep=("record",), offset=5.0, scale=2.0), "scored_stream")
    got = spark.sql("select record, risk_probability from scored_stream")
    exp = FX.fleet_scored(spark, SF_SMALL).select("record", "risk_probability")
    assert got.count() == exp.count()
    diff = got.join(exp.withColumnRenamed("risk_probability", "e"), "record")
    assert diff.filter(F.abs(F.col("risk_probability") - F.col("e")) > 1e-12).count() == 0


def _run_updates(spark, sdf, d, keys):
    out = os.path.join(d, "updates")
    R.upsert_stream(sdf, out, os.path.join(d, "updates-ck"), keys).awaitTermination(300)
    return R.latest(spark, out, keys, sdf.schema)


def test_kpi_stream_has_every_window(spark, tmpdir_run):
    src, schema = _files(spark, tmpdir_run)
    sdf = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    scored = R.score_stream(sdf, keep=("record", "ts"), offset=5.0, scale=2.0)
    got = _run_updates(spark, R.kpi_stream(scored, width="1 day", delay="60 days"), tmpdir_run, ["window_start", "window_end"])
    n = FX.fleet(spark, SF_SMALL)
    assert got.agg(F.sum("total_assets")).first()[0] == n.count()
    assert got.count() == n.select(F.to_date("ts")).distinct().count()


def test_crossings_stream_equals_batch_out_of_order(spark, tmpdir_run):
    # a hot machine, rows shuffled over several micro-batches
    f = FX.fleet_scored(spark, SF_SMALL).withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "machine_label", F.when(F.col("record") % 2 == 0, "HOT").otherwise(F.col("machine_label")))
    f = f.select("record", "machine_label", "ts", "risk_probability")
    src = os.path.join(tmpdir_run, "feed")
    f.repartition(4, F.xxhash64("record")).write.parquet(src)
    sdf = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out, ck = os.path.join(tmpdir_run, "out"), os.path.join(tmpdir_run, "ck")
    R.crossings_stream(sdf, out, ck, width="6 hours", delay="60 days", compact_every=2).awaitTermination(300)
    got = [(r.record, r.crossing) for r in R.read_crossings(spark, out, 0.5).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(r.record, r.crossing) for r in R.crossings(f, 0.5, bucket=128).collect()}


def _readings(spark, n, seconds, shuffle=0):
    """One hot machine and others, a reading each ``seconds``, out of order by ``shuffle`` places."""
    import random

    r = random.Random(6)
    rows = [(i, "HOT" if i % 3 == 0 else f"M{i % 7}", i * seconds, r.choice([0.1, 0.4, 0.5, 0.9])) for i in range(n)]
    rows.sort(key=lambda x: x[0] + r.uniform(0, shuffle))
    return spark.createDataFrame(rows, "record long, machine_label string, s long, risk_probability double").select(
        "record", "machine_label", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "risk_probability")


def test_crossings_settle_once_and_state_stays_small(spark, tmpdir_run):
    """Batches in time order, each a little out of order: what the watermark has passed is
    given out once, and what is kept does not grow with the readings of a slice."""
    rows = _readings(spark, 3000, 60, shuffle=5).collect()
    src, out, ck = (os.path.join(tmpdir_run, x) for x in ("feed", "out", "ck"))
    schema = _readings(spark, 1, 1).schema
    kept, fields = [], R.T.StructType([f for f in R.CHANGES if f.name != "kind"])
    for i in range(0, 3000, 500):
        spark.createDataFrame(rows[i:i + 500], schema).coalesce(1).write.mode("append").parquet(src)
        sdf = spark.readStream.schema(schema).parquet(src)
        R.crossings_stream(sdf, out, ck, width="30 days", delay="20 minutes", compact_every=3).awaitTermination(120)
        slices = R.latest(spark, out, R.CROSSING_KEYS, fields, "kind=slice")
        kept.append(slices.agg(F.sum(F.size("open_us"))).first()[0])
        got = [(r.record, r.crossing) for r in R.read_crossings(spark, out, 0.5).collect()]
        expected = R.crossings(spark.createDataFrame(rows[:i + 500], schema), 0.5, bucket=128)
        assert len(got) == len(set(got)) and set(got) == {(r.record, r.crossing) for r in expected.collect()}
    assert max(kept) <= 500 + 60                         # the last micro-batch and some 20 minutes, one reading a minute
    # the newest base and the batches behind it, whatever the number of micro-batches
    assert len(R.version_folders(spark, out, "kind=slice")) <= 3


def test_crossings_of_many_machines_share_states(spark, tmpdir_run):
    """Few states for many machines, over batches, one machine without a name."""
    import random

    r = random.Random(8)
    rows = [(i, f"M{r.randrange(900)}" if i % 9 else None, (i + r.randrange(30)) * 60, r.choice([0.1, 0.4, 0.5, 0.9]))
            for i in range(3000)]
    src, out, ck = (os.path.join(tmpdir_run, x) for x in ("feed", "out", "ck"))
    frame = lambda some: spark.createDataFrame(some, "record long, machine_label string, s long, risk_probability double").select(
        "record", "machine_label", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "risk_probability")
    for some in (rows[:1000], rows[1000:]):
        frame(some).coalesce(1).write.mode("append").parquet(src)
        sdf = spark.readStream.schema(frame(some[:1]).schema).parquet(src)
        q = R.crossings_stream(sdf, out, ck, width="1 day", delay="12 hours", buckets=4)
        q.awaitTermination(120)
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 4 * 4
    got = [(x.record, x.machine_label, x.crossing) for x in R.read_crossings(spark, out, 0.5).collect()]
    expected = R.crossings(frame(rows), 0.5, bucket=128).collect()
    assert len(got) == len(expected) and set(got) == {(x.record, x.machine_label, x.crossing) for x in expected}


def test_upserts_are_folded_and_replays_change_nothing(spark, tmpdir_run):
    src, out, ck = (os.path.join(tmpdir_run, x) for x in ("feed", "out", "ck"))
    frame = lambda i: spark.range(i, i + 4).selectExpr(f"timestamp_seconds({i} * 100 + id) AS ts", "CAST(id AS DOUBLE) AS risk_probability",
                                                       "1 AS predicted_risk")
    for i in range(9):
        frame(i).coalesce(1).write.mode("append").parquet(src)
    sdf = spark.readStream.schema(frame(0).schema).option("maxFilesPerTrigger", 1).parquet(src)
    per = sdf.withWatermark("ts", "1 day").groupBy(F.window("ts", "5 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("w"), "n")
    R.upsert_stream(per, out, ck, ["w"], compact_every=4).awaitTermination(300)
    expected = {}
    for i in range(9):
        for k in range(i, i + 4):
            w = (i * 100 + k) // 300
            expected[w] = expected.get(w, 0) + 1
    read = lambda: {int(r.w.timestamp()) // 300: r.n for r in R.latest(spark, out, ["w"], per.schema).collect()}
    assert read() == expected and len(R.version_folders(spark, out)) <= 4
    names = os.listdir(out)
    R._fold(spark, out, 7, ["w"], per.schema, "")       # a batch that runs again
    assert read() == expected and set(os.listdir(out)) <= set(names)
    os.remove(os.path.join(out, "base=7", "_SUCCESS"))  # a base that was not finished
    assert read() == expected


def test_events_stream_reads_a_folder_of_parts(spark, tmpdir_run):
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(3).write.parquet(os.path.join(tmpdir_run, "events.parquet"))
    for d in (tmpdir_run, SF_SMALL):
        name = f"parts_{len(d)}"
        _run_memory(FX.events_stream(spark, d).select("event_id"), name)
        assert spark.table(name).count() == 1000


def test_sink_stream_is_idempotent(spark, tmpdir_run):
    src, schema = _files(spark, tmpdir_run)
    root, ck = os.path.join(tmpdir_run, "store"), os.path.join(tmpdir_run, "ck")
    sdf = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    scored = R.score_stream(sdf, offset=5.0, scale=2.0)
    q = R.sink_stream(scored, root, ck, name="feed")
    q.awaitTermination(300)
    runs, preds = ST.load(spark, root)
    n = FX.fleet(spark, SF_SMALL).count()
    assert runs.count() == 3 and preds.count() == n
    # a second start from the same checkpoint finds nothing new and writes nothing twice
    R.sink_stream(scored, root, ck, name="feed").awaitTermination(300)
    runs, preds = ST.load(spark, root)
    assert runs.count() == 3 and preds.count() == n
