"""Structured Streaming: score a live feed (R1), alert on threshold crossings (R2),
an idempotent run-store sink (R3) and event-time KPIs per window (R4).

R2 keeps per (machine, slice) the side of its last settled reading and the readings that
the watermark has not passed: a crossing is given out once, when no late reading can
change it, and a slice's state goes when the watermark closes it. The machines of a hash
bucket share one state per slice. R4 keeps JVM aggregates per window.
Both write what changed under its micro-batch number and fold that now and then, so
``latest`` reads a bounded number of versions; the newest readings and windows are there
too, long before the watermark closes them. The batch form of each works on a static DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine import schema as S
from riskengine.operators.analytics import kpi_aggs
from riskengine.operators.indexing import lag_by
from riskengine.sources import run_log


def crossings(df: DataFrame, threshold: float = 0.5, key: str = S.LABEL_COLUMN, ts: str = "ts",
              prob: str = "risk_probability", tiebreak: str = "record", bucket: int = 100_000,
              skew_safe: bool = True) -> DataFrame:
    """R2 (batch): rows where a machine's risk moves to the other side of ``threshold``.
    A machine starts below, so its first reading at or above the threshold is 'rising'."""
    lagged = lag_by(df, key, ts, prob, tiebreak=tiebreak, out="_prev", bucket=bucket, skew_safe=skew_safe)
    above = F.col(prob) >= F.lit(threshold)
    was = F.coalesce(F.col("_prev"), F.lit(-1.0)) >= F.lit(threshold)
    return lagged.filter(above != was).select(
        tiebreak, key, ts, prob, F.when(above, F.lit("rising")).otherwise(F.lit("falling")).alias("crossing")
    )


# kind 'event': a settled crossing inside a slice: its reading (us, record, risk_probability).
# kind 'slice': the slice as of a micro-batch: its first settled reading and the value of its
# last settled one (with ``settled``), and in order the readings that are not settled yet.
CHANGES = T.StructType([
    T.StructField("machine", T.StringType()), T.StructField("slice_us", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("crossing", T.StringType()), T.StructField("us", T.LongType()), T.StructField("record", T.LongType()),
    T.StructField("risk_probability", T.DoubleType()), T.StructField("settled", T.BooleanType()),
    T.StructField("last", T.DoubleType()), T.StructField("open_us", T.ArrayType(T.LongType())),
    T.StructField("open_record", T.ArrayType(T.LongType())), T.StructField("open_risk", T.ArrayType(T.DoubleType()))])
_STATE = T.StructType([
    T.StructField("machines", T.ArrayType(T.StringType())), T.StructField("told", T.BinaryType()), T.StructField("open", T.BinaryType())])
_DTYPE = [("us", "<i8"), ("record", "<i8"), ("risk_probability", "<f8")]
# Per machine of a state: its first settled reading, its last settled value, whether it has
# any, and how many of the open readings (held in machine order) are its own.
_TOLD = [*_DTYPE, ("last", "<f8"), ("settled", "?"), ("n_open", "<i8")]
STATE_BUCKETS = 512


def _settle(told, machine, readings, threshold: float):
    """Places of the crossings among settled ``readings``, in order of (machine, time); ``told``
    is brought up to date. A machine's first settled reading of a slice is no event."""
    import numpy as np

    if not len(readings):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.diff(machine, prepend=-1))
    ends = np.append(starts[1:], len(machine)) - 1
    whose = machine[starts]
    known = told["settled"][whose]
    above = readings["risk_probability"] >= threshold
    was = np.roll(above, 1)
    was[starts] = np.where(known, told["last"][whose] >= threshold, above[starts])
    for c in readings.dtype.names:
        told[c][whose[~known]] = readings[c][starts[~known]]
    told["last"][whose] = readings["risk_probability"][ends]
    told["settled"][whose] = True
    return np.flatnonzero(above != was)


def crossing_changes(sdf: DataFrame, threshold: float = 0.5, ts: str = "ts", width: str = "1 hour", delay: str = "10 minutes",
                     key: str = S.LABEL_COLUMN, buckets: int = STATE_BUCKETS) -> DataFrame:
    """R2 (stream): changes of every (machine, event-time slice), see ``CHANGES``. The machines of
    a hash bucket share a state per slice, so the number of states follows the slices and not
    the machines, and a busy machine is spread over many; the state holds the readings of the
    last ``delay`` only, however long the slice is, and two readings per machine. The number
    of ``buckets`` belongs to the checkpoint."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    src = sdf.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    w = F.window(ts, width)
    src = src.select(F.col(key).cast("string").alias("machine"), F.unix_micros(w["start"]).alias("slice_us"),
                     F.unix_micros(w["end"]).alias("end_us"), F.col(ts), F.unix_micros(F.col(ts)).alias("us"),
                     # A frame with a missing whole number would turn all of them into doubles.
                     F.coalesce(F.col("record").cast("long"), F.lit(-1 << 63)).alias("record"),
                     F.col("risk_probability").cast("double").alias("risk_probability"))
    src = src.withColumn("bucket", F.pmod(F.xxhash64("machine"), F.lit(buckets)))

    def advance(group, frames, state):
        slice_us, end_us = int(group[1]), int(group[2])
        machines, told, held = state.get if state.exists else ([], b"", b"")
        place = {m: i for i, m in enumerate(machines)}
        told = np.frombuffer(told, _TOLD)
        rows, whose = [np.frombuffer(held, _DTYPE)], [np.repeat(np.arange(len(told)), told["n_open"])]
        if not state.hasTimedOut:
            for f in frames:
                codes, names = pd.factorize(f["machine"], use_na_sentinel=False)
                at = [place.setdefault(m if isinstance(m, str) else None, len(place)) for m in names]
                rows.append(f[["us", "record", "risk_probability"]].to_records(index=False).astype(_DTYPE))
                whose.append(np.array(at, np.int64)[codes])
        told = np.concatenate([told, np.zeros(len(place) - len(told), _TOLD)])
        readings, machine = np.concatenate(rows), np.concatenate(whose)
        changed = np.zeros(len(place), bool)
        changed[machine[len(whose[0]):]] = True
        order = np.lexsort((readings["risk_probability"], readings["record"], readings["us"], machine))
        readings, machine = readings[order], machine[order]
        mark = state.getCurrentWatermarkMs() * 1000
        closed = state.hasTimedOut or mark >= end_us
        past = (readings["us"] < mark) | closed
        own, settled = machine[past], readings[past]
        found = _settle(told, own, settled, threshold)
        changed[own] = True
        left, left_own = readings[~past], machine[~past]
        told["n_open"] = np.bincount(left_own, minlength=len(told))
        stop = np.cumsum(told["n_open"])
        names, moved, n = list(place), settled[found], len(found)
        if n:
            yield pd.DataFrame({
                "machine": [names[i] for i in own[found]], "slice_us": slice_us, "kind": "event",
                "crossing": np.where(moved["risk_probability"] >= threshold, "rising", "falling").astype(object),
                **{c: moved[c] for c in moved.dtype.names}, "settled": True, "last": 0.0,
                **{c: [[]] * n for c in ("open_us", "open_record", "open_risk")}}, columns=CHANGES.names)
        some = np.flatnonzero(changed)
        parts = [(stop[i] - told["n_open"][i], stop[i]) for i in some]
        if len(some):
            yield pd.DataFrame({
                "machine": [names[i] for i in some], "slice_us": slice_us, "kind": "slice", "crossing": "",
                **{c: told[c][some] for c in (*left.dtype.names, "settled", "last")},
                **{f"open_{c.split('_')[0]}": [left[c][a:b].tolist() for a, b in parts] for c in left.dtype.names}},
                columns=CHANGES.names)
        if closed:
            state.remove()
        else:
            state.update((names, told.tobytes(), left.tobytes()))
            state.setTimeoutTimestamp(max(end_us // 1000, state.getCurrentWatermarkMs() + 1))

    return src.groupBy("bucket", "slice_us", "end_us").applyInPandasWithState(
        advance, CHANGES, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def stitched_crossings(events: DataFrame, slices: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All crossings so far: the settled ones, those among the readings still open, and those
    from a machine's slice to its next (one row per slice)."""
    reading = lambda us, record, risk: F.struct(us.alias("us"), record.alias("record"), risk.alias("risk_probability"))
    rows = slices.select("machine", "slice_us", F.when(F.col("settled"), F.col("last")).alias("settled"),
                         F.when(F.col("settled"), reading(F.col("us"), F.col("record"), F.col("risk_probability"))).alias("first"),
                         F.transform(F.arrays_zip("open_us", "open_record", "open_risk"),
                                     lambda o: reading(o["open_us"], o["open_record"], o["open_risk"])).alias("open"))
    last = F.coalesce(F.get("open", F.size("open") - 1)["risk_probability"], F.col("settled"))
    before = F.lag(last).over(Window.partitionBy("machine").orderBy("slice_us"))
    linked = rows.withColumn("before", F.coalesce(before, F.lit(-1.0)))
    t = F.lit(float(threshold))

    def move(r, was):
        above = r["risk_probability"] >= t
        return F.struct(r["us"].alias("us"), r["record"].alias("record"), r["risk_probability"].alias("risk_probability"),
                        F.when(above != (was >= t), F.when(above, "rising").otherwise("falling")).alias("crossing"))

    def opened(r, i):
        return move(r, F.when(i == 0, F.coalesce("settled", "before")).otherwise(F.get("open", i - 1)["risk_probability"]))

    firsts = F.filter(F.array("first"), lambda r: r.isNotNull())
    moves = F.concat(F.transform(firsts, lambda r: move(r, F.col("before"))), F.transform("open", opened))
    fresh = linked.select("machine", F.inline(F.filter(moves, lambda m: m["crossing"].isNotNull())))
    found = events.select("machine", "us", "record", "risk_probability", "crossing").unionByName(fresh)
    return found.select("record", F.col("machine").alias(S.LABEL_COLUMN), F.timestamp_micros("us").alias("ts"),
                        "risk_probability", "crossing")


COMPACT_EVERY = 20


def _fold(spark: SparkSession, path: str, batch_id: int, keys: list[str], schema: T.StructType, part: str) -> None:
    """One file set with each key's latest row up to ``batch_id``. A replay writes it anew; the
    base before it stays for readers, what is older goes."""
    older = [n for n in run_log.names(spark, path) if n.startswith("base=") and _number(n) < batch_id]
    latest(spark, path, keys, schema, part, upto=batch_id, version=True).write.mode("overwrite").parquet(f"{path}/base={batch_id}")
    if older:
        kept = max(map(_number, older))
        for n in run_log.names(spark, path):
            if _number(n) < kept and n.startswith("base="):
                run_log.delete(spark, f"{path}/{n}")
            elif _number(n) <= kept and n.startswith("batch="):
                run_log.delete(spark, f"{path}/{n}/{part}" if part else f"{path}/{n}")


def _number(name: str) -> int:
    return int(name.split("=")[1])


def upsert_stream(sdf: DataFrame, path: str, checkpoint: str, keys: list[str], trigger: dict | None = None,
                  part: str = "", compact_every: int = COMPACT_EVERY):
    """Write every update of a stream under its micro-batch number; a replayed batch overwrites
    its own folder. Every ``compact_every`` batches each key's latest row is folded into a
    base, so a reader opens the base and fewer than ``compact_every`` batches. With ``part`` (a
    ``column=value`` of the rows) only those rows are upserts; the others are appended."""
    column = part.split("=")[0]
    schema = T.StructType([f for f in sdf.schema if f.name != column])

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.write.mode("overwrite")
        (out.partitionBy(column) if part else out).parquet(f"{path}/batch={batch_id}")
        if batch_id % compact_every == compact_every - 1:
            _fold(batch.sparkSession, path, batch_id, keys, schema, part)

    w = sdf.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def version_folders(spark: SparkSession, path: str, part: str = "", upto: int | None = None) -> list[tuple[int, str]]:
    """(batch, folder) of the newest whole base and of the batches after it."""
    found = [n for n in run_log.names(spark, path) if "=" in n and (upto is None or _number(n) <= upto)]
    bases = [_number(n) for n in found if n.startswith("base=") and run_log.exists(spark, f"{path}/{n}/_SUCCESS")
             and (upto is None or _number(n) < upto)]
    base = max(bases, default=-1)
    out = [(base, f"{path}/base={base}")] if bases else []
    for n in sorted((n for n in found if n.startswith("batch=") and _number(n) > base), key=_number):
        folder = f"{path}/{n}/{part}" if part else f"{path}/{n}"
        if run_log.exists(spark, f"{path}/{n}/_SUCCESS") and (not part or run_log.exists(spark, folder)):
            out.append((_number(n), folder))
    return out


def latest(spark: SparkSession, path: str, keys: list[str], schema: T.StructType, part: str = "", upto: int | None = None,
           version: bool = False) -> DataFrame:
    """The last written update of every key."""
    rows = None
    for number, folder in version_folders(spark, path, part, upto):
        own = T.StructType([*schema.fields, *([T.StructField("_batch", T.LongType())] if "/base=" in folder else [])])
        read = spark.read.schema(own).parquet(folder)
        read = read if "_batch" in read.columns else read.withColumn("_batch", F.lit(number).cast("long"))
        rows = read if rows is None else rows.unionByName(read)
    if rows is None:
        return spark.createDataFrame([], T.StructType([*schema.fields, *([T.StructField("_batch", T.LongType())] if version else [])]))
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v"), F.max("_batch").alias("_batch"))
    return last.select(*keys, "v.*", *(["_batch"] if version else []))


CROSSING_KEYS = ["machine", "slice_us"]


def crossings_stream(sdf: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                     compact_every: int = COMPACT_EVERY, **options):
    """R2: run ``crossing_changes`` into a folder that ``read_crossings`` reads."""
    return upsert_stream(crossing_changes(sdf, **options), path, checkpoint, CROSSING_KEYS, trigger, "kind=slice", compact_every)


def read_crossings(spark: SparkSession, path: str, threshold: float = 0.5) -> DataFrame:
    """R2: all crossings of ``crossings_stream``'s folder, the newest readings included."""
    fields = T.StructType([f for f in CHANGES if f.name != "kind"])
    folders = [f"{path}/{n}/kind=event" for n in run_log.names(spark, path) if n.startswith("batch=")]
    folders = [f for f in folders if run_log.exists(spark, f)]
    events = spark.read.schema(fields).parquet(*folders) if folders else spark.createDataFrame([], fields)
    return stitched_crossings(events, latest(spark, path, CROSSING_KEYS, fields, "kind=slice"), threshold)


def score_stream(sdf: DataFrame, model=None, keep: tuple[str, ...] = (), offset: float = 0.0,
                 scale: float = S.SYNTHETIC_SCALE, threshold: float = 0.5, bearing_all_missing: bool = False) -> DataFrame:
    """Standardise (static-column rules) and score each reading of a stream.

    With ``model=None`` the fixed linear risk score is used."""
    from riskengine.operators.score import label_and_recommend, linear_score, score
    from riskengine.operators.standardize import standardize

    std = standardize(sdf, keep=list(keep), streaming=True, bearing_all_missing=bearing_all_missing)
    if model is None:
        return label_and_recommend(linear_score(std, offset=offset, scale=scale), threshold)
    return score(std, model, threshold)


def kpi_stream(sdf: DataFrame, ts: str = "ts", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Fleet KPIs per tumbling event-time window: in update mode the state so far of each
    window that changed (see ``upsert_stream``), in append mode the closed windows."""
    src = sdf.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return src.groupBy(F.window(ts, width).alias("w")).agg(*kpi_aggs()).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "total_assets", "high_risk_assets", "avg_risk", "monitored_stable",
    )


def sink_stream(sdf: DataFrame, root: str, checkpoint: str, name: str = "stream", trigger: dict | None = None):
    """Each micro-batch is saved as one run whose id is (name, batch id).

    A replayed batch after a failure writes the same run id: its partition is
    overwritten and the run row is not appended twice, so the sink is idempotent."""
    from riskengine.sources.store import save_batch

    def write(batch: DataFrame, batch_id: int) -> None:
        save_batch(batch, root, source_name=name, run_id=f"{name}-{batch_id}")

    w = sdf.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
