"""Fleet views over the driver's test tables.

``fleet`` turns every ``events`` row into one sensor reading of a machine
(the machine is the event's user). All views are lazy projections of the
whole table, so their work grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskengine.schema import FEATURE_COLUMNS

# Fixed parameters of the test view: score offset/scale, actual-label cut and flip rule.
FLEET_OFFSET = 5.0
FLEET_SCALE = 2.0
ACTUAL_CUT = 0.55
ACTUAL_FLIP_MOD = 13
RUN_MOD = 7
ORPHAN_RUN = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table (one file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record, ts, dataset, machine_label, user_id and the 8 features (doubles)."""
    return fleet_from_events(table(spark, sf_dir, "events"))


def events_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The ``events`` table as a file stream: the one file, or every part file of the
    folder of that name. (The bracket makes the path a pattern, which the file source
    accepts for a file as well as for a folder.)"""
    schema = table(spark, sf_dir, "events").schema
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")


def fleet_from_events(ev: DataFrame) -> DataFrame:
    """The fleet projection of an events frame (batch or stream)."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    eid = F.col("event_id")
    return ev.select(
        eid.alias("record"),
        F.col("ts"),
        F.col("event_type").alias("dataset"),
        F.format_string("MCH-%04d", F.col("user_id")).alias("machine_label"),
        F.col("user_id"),
        (F.lit(60.0) + k * F.lit(0.5)).alias("machine_temperature"),
        (F.lit(60.0) + k * F.lit(0.5) + F.lit(2) + eid % 11).alias("bearing_temperature"),
        F.least(F.lit(15.0), F.col("value") / F.lit(10.0)).alias("vibration_level"),
        (F.lit(55) + eid % 196).cast("double").alias("pressure"),
        ((eid * 13) % 10000).cast("double").alias("runtime_hours"),
        F.least(F.lit(120.0), F.lit(40.0) + F.col("value") / F.lit(2.0)).alias("load_percentage"),
        ((F.col("user_id") * 7 + eid) % 181).cast("double").alias("maintenance_delay_days"),
        F.when(F.col("event_type") == "error", (F.lit(1) + eid % 8).cast("double"))
        .otherwise(F.lit(0.0))
        .alias("error_log_count"),
    )


def fleet_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fleet + risk_score, risk_probability, predicted_risk, recommendation."""
    from riskengine.operators.score import linear_score, label_and_recommend

    return label_and_recommend(linear_score(fleet(spark, sf_dir), offset=FLEET_OFFSET, scale=FLEET_SCALE))


def fleet_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored fleet plus an 'actual' downtime_risk with deterministic label noise."""
    s = fleet_scored(spark, sf_dir)
    base = (F.col("risk_probability") > F.lit(ACTUAL_CUT)).cast("int")
    flip = (F.col("record") % ACTUAL_FLIP_MOD) == 0
    return s.withColumn("downtime_risk", F.when(flip, F.lit(1) - base).otherwise(base))


def _junk(value, rec, mods: tuple[int, int, int, int, int]):
    """Text of a number with missing/odd entries chosen by the record number."""
    m_na, m_empty, m_suffix, m_inf, m_thousand = mods
    return (
        F.when(rec % m_na == 0, F.lit("na"))
        .when(rec % m_empty == 0, F.lit(""))
        .when(rec % m_suffix == 0, F.lit("1d"))
        .when(rec % m_inf == 0, F.lit("inf"))
        .when(rec % m_thousand == 0, F.lit("1,000"))
        .otherwise(value.cast("string"))
    )


# Renamed columns of the messy view (AI4I-style and other aliases), feature order.
MESSY_NAMES = [
    "Process temperature [K]",
    "Air temperature [K]",
    "Rotational speed [rpm]",
    "Torque [Nm]",
    "Tool wear [min]",
    "utilization",
    "days since maintenance",
    "fault_count",
]
MESSY_MODS = [
    (17, 19, 23, 29, 31),
    (37, 41, 43, 47, 53),
    (59, 61, 67, 71, 73),
    (79, 83, 89, 97, 101),
    (103, 107, 109, 113, 127),
    (131, 137, 139, 149, 151),
    (157, 163, 167, 173, 179),
    (181, 191, 193, 197, 199),
]


def fleet_messy(spark: SparkSession, sf_dir: str, bearing_missing: bool = False) -> DataFrame:
    """The fleet as a text-typed file would arrive: aliases, junk values, text target."""
    a = fleet_actual(spark, sf_dir)
    rec = F.col("record")
    cols = [
        rec.alias("record"),
        rec.cast("string").alias("UDI"),
        F.when(rec % 37 == 0, F.lit("")).otherwise(F.col("machine_label")).alias("Product ID"),
    ]
    for feat, name, mods in zip(FEATURE_COLUMNS, MESSY_NAMES, MESSY_MODS):
        if bearing_missing and feat == "bearing_temperature":
            cols.append(F.lit(None).cast("string").alias(name))
        else:
            cols.append(_junk(F.col(feat), rec, mods).alias(name))
    target = (
        F.when(rec % 11 == 0, F.lit("na"))
        .when(rec % 29 == 0, F.lit("1.9"))
        .otherwise(F.col("downtime_risk").cast("string"))
    )
    cols.append(target.alias("Machine failure"))
    return a.select(*cols)


def fleet_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleet with AI4I failure-mode flags instead of a target column."""
    a = fleet_actual(spark, sf_dir)
    rec = F.col("record")
    failed = F.col("downtime_risk") == 1
    return a.select(
        "record",
        F.col("machine_label").alias("machine_id"),
        *[F.col(c) for c in FEATURE_COLUMNS],
        F.when(failed & (F.col("error_log_count") > 0), F.lit("1")).otherwise(F.lit("0")).alias("TWF"),
        F.when(failed & (rec % 3 == 0), F.lit("1")).otherwise(F.lit("0")).alias("HDF"),
        F.when(rec % 5 == 0, F.lit("na")).when(failed & (rec % 2 == 0), F.lit("1")).otherwise(F.lit("0")).alias("PWF"),
        F.lit("0").alias("OSF"),
        F.when(rec % 97 == 0, F.lit("1")).otherwise(F.lit("0")).alias("rnf"),
    )


def fleet_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(runs, predictions) tables of the run store, derived from the scored fleet.

    A machine's run is ``user_id % 7``; run 6 gets no run row (orphans).
    """
    from riskengine.sources.store import predictions_frame, run_summary

    s = fleet_scored(spark, sf_dir)
    s = s.withColumn("run_id", F.format_string("run-%d", F.col("user_id") % RUN_MOD))
    preds = predictions_frame(s, run_id=F.col("run_id"), created_at=F.col("ts"), id_col=F.col("record"))
    runs = run_summary(
        s.filter(F.col("user_id") % RUN_MOD != ORPHAN_RUN),
        by="run_id",
        source_name=F.format_string("fleet-%s", F.col("run_id")),
        created_at=F.col("created_at"),
        ts_col="ts",
    )
    return runs, preds


def lineitem_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second, differently named dataset: lineitem rows as machine readings."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.format_string("SUP-%d", F.col("l_suppkey")).alias("supplier"),
        (F.col("l_tax") * F.lit(500.0) + F.lit(60.0)).alias("temp_c"),
        (F.col("l_discount") * F.lit(100.0)).alias("vibration mm/s"),
        (F.col("l_quantity") * F.lit(2.0)).alias("load pct"),
        F.col("l_returnflag").alias("failure flag"),
        F.col("l_linenumber").alias("alarms"),
    )
