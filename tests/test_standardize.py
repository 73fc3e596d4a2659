"""Standardisation quirks of the reference on hand-made frames."""

import math

from pyspark.sql import functions as F

from riskengine import schema as S
from riskengine.functions.scalar import np_round, to_int_target, to_number
from riskengine.operators.standardize import find_column, guess_mapping, standardize, standardize_mapped, validate


def test_to_number_cases(spark):
    vals = ["12", " 12 ", "1.5e2", "na", "", "1,000", "1d", "2.5f", "inf", "-inf", "nan", "True", None, "+5", ".5"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(to_number("s")).collect()]
    exp = [12.0, 12.0, 150.0, None, None, None, None, None, math.inf, -math.inf, None, None, None, 5.0, 0.5]
    assert got == exp


def test_target_truncates_and_defaults(spark):
    df = spark.createDataFrame([("1.9",), ("0.2",), ("na",), ("pos",), ("inf",), ("-2.7",)], "t string")
    assert [r[0] for r in df.select(to_int_target(to_number("t"))).collect()] == [1, 0, 0, 0, 0, -2]


def test_alias_order_and_last_duplicate_wins():
    cols = ["Temp", "machine temperature", "machine_temperature"]
    # alias order decides: 'machine_temperature' comes first among the aliases; of the two columns
    # that normalise to it, the last one wins
    assert find_column(cols, S.FEATURE_ALIASES["machine_temperature"]) == "machine_temperature"
    assert find_column(["TEMP"], S.FEATURE_ALIASES["machine_temperature"]) == "TEMP"
    assert find_column(["x"], S.FEATURE_ALIASES["machine_temperature"]) is None


def test_bearing_fallback_only_when_all_missing(spark):
    df = spark.createDataFrame([("1", "70", None), ("2", "na", None)], "id string, temperature string, `bearing temp` string")
    out = standardize(df, order_by="id").orderBy("machine_label").collect()
    assert [r.bearing_temperature for r in out] == [76.0, 82.0]
    df2 = spark.createDataFrame([("1", "70", "90"), ("2", "80", None)], "id string, temperature string, `bearing temp` string")
    out2 = standardize(df2, order_by="id").orderBy("machine_label").collect()
    assert [r.bearing_temperature for r in out2] == [90.0, 82.0]


def test_labels_by_position_and_empty_label(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "c")], "pos int, vibration string")
    out = standardize(df, order_by="pos", keep=["pos"]).orderBy("pos").collect()
    assert [r.machine_label for r in out] == ["MCH-0001", "MCH-0002", "MCH-0003"]
    df2 = spark.createDataFrame([("",), ("M7",)], "`Machine ID` string")
    labels = [r.machine_label for r in standardize(df2).collect()]
    assert sorted(labels, key=lambda x: (x is None, x)) == ["M7", None]


def test_failure_flags_case_sensitive(spark):
    df = spark.createDataFrame([("A", "0", "1", "1"), ("B", "0", "0", "0"), ("C", "na", "0", "0")],
                               "machine string, TWF string, HDF string, rnf string")
    out = {r.machine_label: r.downtime_risk for r in standardize(df).collect()}
    assert out == {"A": 1, "B": 0, "C": 0}


def test_defaults_and_schema(spark):
    df = spark.createDataFrame([("M1",)], "machine string")
    r = standardize(df).first()
    for c in S.FEATURE_COLUMNS:
        assert r[c] == S.FEATURE_DEFAULTS[c]
    assert standardize(df).schema.simpleString() == S.standard_schema().simpleString()


def test_mapping_guess_and_no_target_fallback(spark):
    cols = ["Machine Temperature (C)", "vibration_level", "press", "Machine failure"]
    m = guess_mapping(cols)
    assert m["machine_temperature"] == "Machine Temperature (C)" and m["vibration_level"] == "vibration_level"
    assert m["pressure"] is None
    df = spark.createDataFrame([("80", "3", "1", "1")], [*cols]).withColumn("machine", F.lit("X"))
    r = standardize_mapped(df, m).first()
    # no target given: 0, even though a target alias column exists
    assert r.downtime_risk == 0 and r.machine_temperature == 80.0 and r.machine_label == "X"
    assert standardize_mapped(df, m, target="Machine failure").first().downtime_risk == 1


def test_empty_input_raises(spark):
    import pytest

    with pytest.raises(ValueError):
        validate(spark.createDataFrame([], "a string"))


def test_numpy_rounding(spark):
    import numpy as np

    xs = [2.675, 0.125, 2.5, -1.005, 1.015, 0.285, 12.345, -0.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for d in (0, 1, 2):
        assert [r[0] for r in df.select(np_round("x", d)).collect()] == [float(np.round(x, d)) for x in xs]
