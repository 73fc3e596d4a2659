"""Forests stated by their splits, and fitted forests compiled to SQL."""

import random

import pytest
from pyspark.sql import functions as F

from riskengine import schema as S
from riskengine.operators import forests as FR
from riskengine.operators import train as TR

FEATS = S.FEATURE_COLUMNS


def _frame(spark, n=400):
    r = random.Random(4)
    rows = []
    for i in range(n):
        x = [r.choice([None, r.uniform(0, 100)]) if j == 3 else r.uniform(0, 100) for j in range(len(FEATS))]
        rows.append((i, *x, int(x[0] + x[2] > 110 or r.random() < 0.1)))
    return spark.createDataFrame(rows, "record long, " + ", ".join(f"{c} double" for c in FEATS) + f", {S.TARGET_COLUMN} int")


def test_compiled_forest_equals_the_fitted_one(spark):
    df = _frame(spark)
    model = TR.fit_candidate("rf", df, num_trees=5, max_depth=4)
    trees = FR.trees_of(model)
    told = TR.predict(model, df).withColumn("told", F.expr(FR.probability_sql(trees, FR.prepared_by(model))))
    worst = told.select(F.max(F.abs(F.col("told") - F.col("risk_probability")))).first()[0]
    assert worst < 1e-12
    with pytest.raises(ValueError, match="nodes"):
        FR.trees_of(model, max_nodes=3)


def test_stated_forest_counts_and_scores(spark):
    df = _frame(spark)
    splits = [(FEATS[0], 50.0, None, (FEATS[2], 40.0, None, None)), (FEATS[3], 1e9, None, None)]
    trees = FR.counted(df, splits)
    rows = df.collect()
    here = [r for r in rows if r[FEATS[0]] <= 50.0]
    assert trees[0][2] == (sum(r[S.TARGET_COLUMN] == 0 for r in here), sum(r[S.TARGET_COLUMN] for r in here))
    assert trees[1][3] == (0, 0)                                    # a leaf that no row reaches
    model = FR.model_of(spark, trees)
    assert FR.trees_of(model) == trees
    share = lambda n: n[1] / (n[0] + n[1])
    for r in TR.predict(model, df).collect():
        first = trees[0][2] if r[FEATS[0]] <= 50 else trees[0][3][2 if r[FEATS[2]] <= 40 else 3]
        assert abs(r["risk_probability"] - (share(first) + share(trees[1][2])) / 2) < 1e-12
    assert FR.counted(df.where("false"), splits)[0][2] == (0, 0)
