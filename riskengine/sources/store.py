"""Scored-run store on Parquet.

Layout under ``root`` (a shared folder):
  machine_predictions/<folder>/part-*.parquet   -- one folder per save, under a name of its own
  _log/<bucket>/<sequence>.json                 -- one manifest per save or deletion (``run_log``)

A save writes its rows first and then commits by one rename of its manifest, which holds
the run's summary. Readers go by manifests: a folder without one does not exist for them, and
the last manifest of a run id counts. So a save that dies at any step leaves the old run, or the
new one, whole; an empty batch is a run of 0 records and no rows.

A row's id is the run's first id, the rows of the partitions written before, and its place in
its own partition: dense, and known from manifests without a scan of older runs.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine import schema as S
from riskengine.sources import run_log

RECENT_COLUMNS = [
    "machine_label", "predicted_risk", "risk_probability", "recommendation",
    *S.FEATURE_COLUMNS, "created_at",
]


def align_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Keep the sink's columns that the frame has (cast), add the rest as typed NULLs."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def predictions_frame(scored: DataFrame, run_id: Column | str, created_at: Column | None = None,
                      id_col: Column | None = None) -> DataFrame:
    """Project a scored frame to machine_predictions rows (absent numbers -> 0, text ->
    '', absent labels by position)."""
    if S.LABEL_COLUMN not in scored.columns:
        from riskengine.operators.indexing import with_record

        placed = with_record(scored.withColumn("_place", F.monotonically_increasing_id()), ["_place"], out="_n")
        scored = placed.withColumn(S.LABEL_COLUMN, F.format_string(S.DEFAULT_LABEL_FORMAT, F.col("_n") + 1))
    have = set(scored.columns)
    rid = F.lit(run_id) if isinstance(run_id, str) else run_id
    cols = [
        (id_col if id_col is not None else F.monotonically_increasing_id()).cast("long").alias("id"),
        rid.cast("string").alias("run_id"),
        F.col(S.LABEL_COLUMN).cast("string").alias(S.LABEL_COLUMN),
        (F.col("predicted_risk") if "predicted_risk" in have else F.lit(0)).cast("int").alias("predicted_risk"),
        (F.col("risk_probability") if "risk_probability" in have else F.lit(0.0)).cast("double").alias("risk_probability"),
        (F.col("recommendation") if "recommendation" in have else F.lit("")).cast("string").alias("recommendation"),
    ]
    cols += [(F.col(c) if c in have else F.lit(0.0)).cast("double").alias(c) for c in S.FEATURE_COLUMNS]
    cols.append((created_at if created_at is not None else F.current_timestamp()).cast("timestamp").alias("created_at"))
    return scored.select(*cols)


def run_summary(scored: DataFrame, by: str | None = None, source_name: Column | str = "batch",
                created_at: Column | None = None, ts_col: str | None = None) -> DataFrame:
    """Records, mean probability (0 if none), high-risk count (0 if none) per run."""
    aggs = [
        F.count(F.lit(1)).alias("record_count"),
        F.coalesce(F.avg("risk_probability"), F.lit(0.0)).alias("average_risk"),
        F.coalesce(F.sum("predicted_risk"), F.lit(0)).cast("long").alias("high_risk_count"),
    ]
    if ts_col:
        aggs.append(F.max(ts_col).cast("timestamp").alias("_ts"))
    g = scored.groupBy(by).agg(*aggs) if by else scored.agg(*aggs)
    src = F.lit(source_name) if isinstance(source_name, str) else source_name
    when = F.col("_ts") if ts_col else (created_at if created_at is not None else F.current_timestamp())
    out = g.select(
        (F.col(by) if by else F.lit(None)).cast("string").alias("run_id"),
        src.alias("source_name"),
        F.col("record_count").alias("total_records"),
        "record_count",
        "average_risk",
        F.col("high_risk_count").alias("high_risk"),
        "high_risk_count",
        when.cast("timestamp").alias("created_at"),
        when.cast("timestamp").alias("saved_at"),
    )
    return out


PLACE_BITS = 33                                          # of monotonically_increasing_id


def _columns(entry: dict | None) -> T.StructType:
    """The columns (and types) the store has; the full schema for a new one."""
    return T.StructType.fromJson(json.loads(entry["columns"])) if entry else S.PREDICTIONS_SCHEMA


def _next(entry: dict | None, **changes) -> dict:
    """The manifest after ``entry``: its running values carried on."""
    kept = {"next_id": 1, "largest_run": 0, "columns": S.PREDICTIONS_SCHEMA.json(), "saved_us": 0}
    kept |= {k: entry[k] for k in kept} if entry else {}
    return {**kept, "seq": entry["seq"] + 1 if entry else 0, **changes}


def _commit(spark: SparkSession, root: str, change) -> dict:
    """Commit ``change(last manifest)``; while other writers take its place, on their result."""
    while True:
        entry = change(run_log.last(spark, root))
        try:
            run_log.commit(spark, root, entry)
            return entry
        except run_log.Taken:
            continue


def create_store(spark: SparkSession, root: str, columns: T.StructType) -> None:
    """A store with prediction columns of its own, as an older version has left it."""
    _commit(spark, root, lambda last: _next(last, op="columns", columns=columns.json()))


def save_batch(scored: DataFrame, root: str, source_name: str, run_id: str | None = None, mode: str = "text") -> str:
    """Write one scored batch; returns its run id (S12, ``mode``: 'text' takes a
    uuid, 'integer' one more than the store's largest).

    The input is evaluated once: the rows are written, their summary is taken from what was
    written, and the manifest commits both. Saving a run again replaces it in the same commit."""
    spark = scored.sparkSession
    columns = _columns(run_log.last(spark, root))
    folder = uuid.uuid4().hex
    path = f"{root}/machine_predictions/{folder}"
    rows = align_to_schema(predictions_frame(scored, run_id or "").drop("run_id", "created_at"),
                           T.StructType([f for f in columns if f.name not in ("run_id", "created_at")]))
    rows = rows.withColumn("id", F.monotonically_increasing_id())
    rows.withColumn("_folder", F.lit(folder)).write.parquet(path)
    written = rows.schema.add("_folder", "string")
    summed = {c: F.sum(c) if c in rows.columns else F.lit(0.0) for c in ("risk_probability", "predicted_risk")}
    parts = spark.read.schema(written).parquet(path).groupBy(F.shiftright("id", PLACE_BITS).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), summed["risk_probability"].alias("risk"),
        summed["predicted_risk"].cast("long").alias("high")).orderBy("part").collect()   # a row per written partition
    n = sum(p.n for p in parts)
    before, at = [], 0
    for p in parts:
        before.append({"part": p.part, "before": at})
        at += p.n

    def change(last: dict | None) -> dict:
        number = (last["largest_run"] if last else 0) + 1
        rid = run_id or (str(number) if mode == "integer" else folder)
        now = max(int(datetime.now(timezone.utc).timestamp() * 1e6), last["saved_us"] if last else 0)
        first = last["next_id"] if last else 1
        return _next(
            last, op="save", run_id=rid, source_name=source_name, folder=folder if n else None, record_count=n,
            average_risk=sum(p.risk or 0.0 for p in parts) / n if n else 0.0, high_risk_count=sum(p.high or 0 for p in parts),
            saved_us=now, first_id=first, next_id=first + n, offsets=before, written=written.json(),
            largest_run=max(number - 1, int(rid) if rid.isascii() and rid.isdigit() else 0))

    entry = _commit(spark, root, change)
    if not n:
        run_log.delete(spark, path)
    return entry["run_id"]


def save_single(spark: SparkSession, root: str, values: dict, prediction: int, probability: float,
                recommendation: str, machine_label: str) -> str:
    """A one-row batch with source 'single_machine_demo'."""
    row = {**{c: float(values[c]) for c in S.FEATURE_COLUMNS}, "predicted_risk": int(prediction),
           "risk_probability": float(probability), "recommendation": recommendation,
           "machine_label": machine_label}
    df = spark.createDataFrame([row])
    return save_batch(df, root, "single_machine_demo")


def _runs(live: DataFrame) -> DataFrame:
    when = F.timestamp_micros("saved_us")
    return live.select("run_id", "source_name", F.col("record_count").alias("total_records"), "record_count", "average_risk",
                       F.col("high_risk_count").alias("high_risk"), "high_risk_count", when.alias("created_at"), when.alias("saved_at"))


def _predictions(spark: SparkSession, root: str, live: DataFrame) -> DataFrame:
    """The rows of live runs, in the full schema. Folders are read with the schema their
    manifest states, so no footer is opened to find columns; runs of one schema are one scan."""
    folders: dict[str, list[str]] = {}
    for r in live.where("folder is not null").select("folder", "written").collect():
        folders.setdefault(r.written, []).append(f"{root}/machine_predictions/{r.folder}")
    if not folders:
        return spark.createDataFrame([], S.PREDICTIONS_SCHEMA)
    wide = T.StructType([f for f in S.PREDICTIONS_SCHEMA if f.name not in ("run_id", "created_at")]).add("_folder", "string")
    scans = [align_to_schema(spark.read.schema(T.StructType.fromJson(json.loads(w))).parquet(*p), wide) for w, p in folders.items()]
    rows = scans[0]
    for more in scans[1:]:
        rows = rows.unionByName(more)
    runs = live.select(F.col("folder").alias("_folder"), "run_id", F.timestamp_micros("saved_us").alias("created_at"), "first_id",
                       F.inline("offsets").alias("_part", "_before"))
    place = F.col("id").bitwiseAND((1 << PLACE_BITS) - 1)
    joined = rows.withColumn("_part", F.shiftright("id", PLACE_BITS)).join(runs, ["_folder", "_part"])
    return align_to_schema(joined.withColumn("id", F.col("first_id") + F.col("_before") + place), S.PREDICTIONS_SCHEMA)


def load(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(runs, predictions) of a store as of now; runs may lack columns (NULL)."""
    live = run_log.live(run_log.entries(spark, root))
    return align_to_schema(_runs(live), S.RUNS_SCHEMA), _predictions(spark, root, live)


def load_recent(spark: SparkSession, root: str, n: int = 25) -> DataFrame:
    """The n newest predictions of a store. The log is read from its end, a bucket at a
    time, until its newest live runs hold n rows; only those runs' folders are read. Times
    never go back along the log, so no older run can hold a newer row."""
    seen: dict[str, str] = {}
    chosen, rows = [], 0
    for bucket in reversed(run_log.names(spark, f"{root}/_log")):
        found = run_log.entries(spark, root, [bucket]).where("run_id is not null").select("seq", "op", "run_id", "record_count")
        for e in found.orderBy(F.desc("seq")).collect():     # at most a bucket of manifests
            if rows >= n:
                break
            if e.run_id not in seen:
                seen[e.run_id] = e.op
                if e.op == "save" and e.record_count:
                    chosen.append((bucket, e.seq))
                    rows += e.record_count
        if rows >= n:
            break
    log = run_log.entries(spark, root, sorted({b for b, _ in chosen}))
    newest = _predictions(spark, root, log.where(F.col("seq").isin([s for _, s in chosen])))
    return newest.orderBy(F.desc("created_at"), F.desc("id")).limit(n).select(*RECENT_COLUMNS)


def committed(preds: DataFrame, runs: DataFrame) -> DataFrame:
    """J2 (semi form): predictions whose run row exists."""
    return preds.join(runs.select("run_id"), "run_id", "left_semi")


def orphans(preds: DataFrame, runs: DataFrame) -> DataFrame:
    """Predictions without a run row (anti join)."""
    return preds.join(runs.select("run_id"), "run_id", "left_anti")


def runs_join(preds: DataFrame, runs: DataFrame) -> DataFrame:
    """Predictions with their run's summary (equi join; Catalyst/AQE choose broadcast
    only when the run log is under the size threshold)."""
    r = runs.select("run_id", "source_name", F.col("average_risk").alias("run_average_risk"),
                    F.col("record_count").alias("run_records"))
    return preds.join(r, "run_id", "inner")


def recent(preds: DataFrame, runs: DataFrame, n: int = 25) -> DataFrame:
    """The n newest committed predictions (top-k, not a full sort)."""
    return committed(preds, runs).orderBy(F.desc("created_at"), F.desc("id")).limit(n).select(*RECENT_COLUMNS)


def delete_run(spark: SparkSession, root: str, run_id: str) -> None:
    """Remove a run and (cascade) its predictions: by a manifest first, then its folders."""
    _commit(spark, root, lambda last: _next(last, op="delete", run_id=run_id))
    gone = run_log.entries(spark, root).where((F.col("run_id") == run_id) & F.col("folder").isNotNull())
    for r in gone.select("folder").collect():                # one per save of this run
        run_log.delete(spark, f"{root}/machine_predictions/{r.folder}")


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete folders that no live run names: replaced saves and saves that died. For times
    without writers and readers; returns the number of folders."""
    named = {r.folder for r in run_log.live(run_log.entries(spark, root)).select("folder").collect()}
    unused = [f for f in run_log.names(spark, f"{root}/machine_predictions") if f not in named]
    for f in unused:
        run_log.delete(spark, f"{root}/machine_predictions/{f}")
    return len(unused)


def write_csv(df: DataFrame, path: str, cols: list[str] | None = None) -> None:
    """Chosen columns with a header, no index."""
    (df.select(*(cols or df.columns)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path))


def save_model(model, path: str) -> None:
    """MLlib writer; features, medians, means and deviations travel in the pipeline's
    first stage (``train.prep_parts`` reads them back)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def save_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    """Metrics as one JSON document."""
    spark.createDataFrame([(json.dumps(metrics),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_metrics(spark: SparkSession, path: str) -> dict:
    """{} when there is no file; ``f1_score`` is read as ``f1``."""
    if not run_log.exists(spark, path):
        return {}
    row = spark.read.text(path).first()
    if row is None:
        return {}
    d = json.loads(row[0])
    if "f1" not in d and "f1_score" in d:
        d["f1"] = d.pop("f1_score")
    return d
