"""Fixed schema constants.

The values below are fixed values: names, defaults, alias vocabularies,
thresholds and texts that must equal the reference application's for
results to agree. They are stated as plain text, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
FEATURE_COLUMNS = [
    "machine_temperature",
    "bearing_temperature",
    "vibration_level",
    "pressure",
    "runtime_hours",
    "load_percentage",
    "maintenance_delay_days",
    "error_log_count",
]

TARGET_COLUMN = "downtime_risk"
LABEL_COLUMN = "machine_label"

FEATURE_DEFAULTS = {
    "machine_temperature": 75.0,
    "bearing_temperature": 82.0,
    "vibration_level": 4.5,
    "pressure": 140.0,
    "runtime_hours": 2400.0,
    "load_percentage": 72.0,
    "maintenance_delay_days": 15.0,
    "error_log_count": 2.0,
}

FEATURE_ALIASES = {
    "machine_temperature": [
        "machine_temperature", "machine temperature", "process temperature [k]",
        "process_temperature", "process temperature", "temperature", "temp",
    ],
    "bearing_temperature": [
        "bearing_temperature", "bearing temperature", "air temperature [k]",
        "air_temperature", "air temperature", "bearing temp",
    ],
    "vibration_level": [
        "vibration_level", "vibration", "vibration level", "rotational speed [rpm]",
        "rotational_speed", "rpm",
    ],
    "pressure": ["pressure", "torque [nm]", "torque", "hydraulic pressure"],
    "runtime_hours": [
        "runtime_hours", "runtime", "tool wear [min]", "tool_wear", "operating hours", "hours",
    ],
    "load_percentage": [
        "load_percentage", "load", "load percentage", "load_percent", "utilization",
    ],
    "maintenance_delay_days": [
        "maintenance_delay_days", "maintenance delay", "days since maintenance",
        "maintenance_delay",
    ],
    "error_log_count": ["error_log_count", "error logs", "error_count", "fault_count", "errors"],
}

TARGET_ALIASES = [
    "downtime_risk", "machine failure", "machine_failure", "failure", "target", "class", "label",
]

LABEL_ALIASES = [
    "machine_label", "machine label", "machine id", "machine_id", "machine", "product id",
    "product_id", "udi", "asset_id", "asset id", "equipment_id", "equipment id",
]

# AI4I failure-mode flags, matched case-sensitively on the raw column name.
FAILURE_FLAGS = ["TWF", "HDF", "PWF", "OSF", "RNF"]

# Linear risk score of the synthetic sensor model, terms in order:
# weight * (feature - centre) / divisor. Pressure has no term.
RISK_TERMS = [
    ("machine_temperature", 0.018, 75.0, 1.0),
    ("bearing_temperature", 0.026, 82.0, 1.0),
    ("vibration_level", 0.24, 4.0, 1.0),
    ("runtime_hours", 0.004, 3000.0, 10.0),
    ("load_percentage", 0.018, 70.0, 1.0),
    ("maintenance_delay_days", 0.035, 20.0, 1.0),
    ("error_log_count", 0.42, 0.0, 1.0),
]
SYNTHETIC_SCALE = 6.0          # sigmoid scale of the reference's generator
SYNTHETIC_QUANTILE = 0.68      # labels are the probabilities above this quantile

# Maintenance bands on the risk probability.
BAND_IMMEDIATE = 0.5
BAND_48_HOUR = 0.3
TEXT_IMMEDIATE = "Immediate maintenance inspection recommended"
TEXT_48_HOUR = "Schedule inspection within 48 hours"
TEXT_NORMAL = "Continue monitoring under normal schedule"

URGENCY_BANDS = [
    ("IMMEDIATE", "IMMEDIATE - Trigger maintenance alert and inspect now."),
    ("48-HOUR", "48-HOUR WINDOW - Schedule inspection within 48 hours."),
    ("NORMAL", "NORMAL CYCLE - Continue operation, keep monitoring."),
]

# Driver rules of the single-machine summary, evaluated in this order; first 3 kept.
DRIVER_RULES = [
    ("bearing_temperature", 95.0, "bearing temperature is critically high"),
    ("machine_temperature", 90.0, "machine temperature is elevated"),
    ("vibration_level", 7.0, "vibration is above the safe zone"),
    ("load_percentage", 85.0, "load percentage is overloaded"),
    ("maintenance_delay_days", 30.0, "maintenance has been delayed too long"),
    ("error_log_count", 4.0, "error logs are building up"),
    ("runtime_hours", 7000.0, "runtime hours are very high"),
]
DRIVER_FALLBACK = "all sensors look close to the healthy operating range"
ACTION_HIGH = (
    "Recommended action: inspect this machine immediately and plan preventive "
    "maintenance before the next production cycle."
)
ACTION_LOW = "Recommended action: continue production, but keep this machine under routine monitoring."
SUMMARY_FORMAT = (
    "AI support summary: the model predicts a downtime risk probability of %s. "
    "The strongest visible signals are that %s. %s"
)
DATASET_ADVICE_FORMAT = (
    "AI dataset advisor: `%s` currently looks like the riskiest uploaded dataset "
    "with an average risk of %.1f%% and %d high-risk records."
)
STATUS_HIGH = "HIGH RISK"
STATUS_LOW = "STABLE"
DIRECTION_UP = "Increases risk"
DIRECTION_DOWN = "Reduces risk"

# Scenario machines: name, 8 feature values in FEATURE_COLUMNS order, expected label.
SCENARIOS = [
    ("HIGH-STRESS", [95.0, 110.0, 9.0, 180.0, 7500.0, 95.0, 60.0, 8.0], 1),
    ("STABLE", [55.0, 60.0, 1.5, 130.0, 500.0, 50.0, 5.0, 0.0], 0),
    ("BOUNDARY", [80.0, 85.0, 5.0, 150.0, 3000.0, 72.0, 20.0, 3.0], None),
]

DEFAULT_LABEL_FORMAT = "MCH-%04d"
# ------------------------------------------------------------ end fixed values


def standard_schema() -> T.StructType:
    """machine_label + 8 double features + integer target."""
    fields = [T.StructField(LABEL_COLUMN, T.StringType(), True)]
    fields += [T.StructField(c, T.DoubleType(), True) for c in FEATURE_COLUMNS]
    fields.append(T.StructField(TARGET_COLUMN, T.IntegerType(), True))
    return T.StructType(fields)


RUNS_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("source_name", T.StringType(), True),
        T.StructField("total_records", T.LongType(), True),
        T.StructField("record_count", T.LongType(), True),
        T.StructField("average_risk", T.DoubleType(), True),
        T.StructField("high_risk", T.LongType(), True),
        T.StructField("high_risk_count", T.LongType(), True),
        T.StructField("created_at", T.TimestampType(), True),
        T.StructField("saved_at", T.TimestampType(), True),
    ]
)

PREDICTIONS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), True),
        T.StructField("run_id", T.StringType(), True),
        T.StructField("machine_label", T.StringType(), True),
        T.StructField("predicted_risk", T.IntegerType(), True),
        T.StructField("risk_probability", T.DoubleType(), True),
        T.StructField("recommendation", T.StringType(), True),
    ]
    + [T.StructField(c, T.DoubleType(), True) for c in FEATURE_COLUMNS]
    + [T.StructField("created_at", T.TimestampType(), True)]
)
