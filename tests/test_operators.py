"""Operators against brute force on small fixtures: windows, index, quantiles,
metrics, histogram, correlation, splits, store, Shapley values."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskengine import schema as S
from riskengine.operators import analytics as G
from riskengine.operators import explain as X
from riskengine.operators import features as E
from riskengine.operators import indexing as W
from riskengine.operators import split as SP
from riskengine.operators import train as TR


def test_with_record_dense_and_ordered(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 5, 500), "v": rng.normal(size=500)})
    df = spark.createDataFrame(pdf)
    out = W.with_record(df, ["k", "v"], out="r", num_partitions=7).toPandas()
    assert sorted(out.r) == list(range(500))
    exp = pdf.sort_values(["k", "v"]).reset_index(drop=True)
    got = out.sort_values("r").reset_index(drop=True)
    assert np.allclose(got.v.values, exp.v.values)


def test_with_record_ties_not_unique(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (0, "b"), (1, "c")], "k int, s string")
    out = W.with_record(df, ["k"], out="r", unique=False, num_partitions=3).orderBy("r").collect()
    assert [r.r for r in out] == [0, 1, 2, 3]
    assert [(r.k, r.s) for r in out] == [(0, "b"), (1, "a"), (1, "a"), (1, "c")]


@pytest.mark.parametrize("bucket", [29, 64, 1000])
def test_rolling_mean_halo_equals_pandas(spark, bucket):
    rng = np.random.default_rng(2)
    vals = rng.random(700)
    vals[[5, 50, 51]] = np.nan
    pdf = pd.DataFrame({"record": np.arange(700), "p": vals})
    df = spark.createDataFrame(pdf).withColumn("p", F.when(~F.isnan("p"), F.col("p")))
    out = W.rolling_mean(df, "p", 30, bucket=bucket).orderBy("record").toPandas()
    exp = pdf.p.rolling(30, min_periods=1).mean()
    assert np.allclose(out.rolling_average.values, exp.values, equal_nan=True)


def test_rolling_mean_by_hot_key_spans_buckets(spark):
    rng = np.random.default_rng(3)
    n = 900
    key = np.where(rng.random(n) < 0.6, "HOT", rng.choice(["A", "B", "C"], n))
    pdf = pd.DataFrame({"record": np.arange(n), "ts": rng.permutation(n), "m": key, "p": rng.random(n)})
    df = spark.createDataFrame(pdf)
    out = W.rolling_mean_by(df, "m", "ts", "p", 7, bucket=50).toPandas().set_index("record").sort_index()
    exp = pdf.sort_values(["m", "ts"]).groupby("m").p.rolling(7, min_periods=1).mean().reset_index(level=0, drop=True)
    assert np.allclose(out.rolling_average.values, exp.sort_index().values)
    lag = W.lag_by(df, "m", "ts", "p", bucket=50).toPandas().set_index("record").sort_index()
    exp_lag = pdf.sort_values(["m", "ts"]).groupby("m").p.shift(1).sort_index()
    assert np.allclose(lag.previous.values, exp_lag.values, equal_nan=True)


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_exact_quantiles_match_numpy(spark, accuracy):
    rng = np.random.default_rng(4)
    a = np.round(rng.normal(size=301), 1)
    b = np.r_[np.full(10, np.nan), rng.random(91)]
    pdf = pd.DataFrame({"a": a[:101], "b": b})
    df = spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    qs = [0.01, 0.5, 0.68, 0.99]
    out = W.exact_quantiles(df, ["a", "b"], qs, accuracy=accuracy).collect()
    got = {(r.column, r.q): r.value for r in out}
    for c in ("a", "b"):
        col = pdf[c].dropna().values
        for q in qs:
            assert math.isclose(got[(c, q)], float(np.quantile(col, q)), rel_tol=1e-12, abs_tol=1e-12)


def test_metrics_reproduce_published_ratios(spark):
    m = TR.metrics_from_counts(spark, 43, 22, 25, 1910).first()
    assert m.accuracy == 0.9765
    assert m.precision == 0.6615384615384615
    assert m.recall == 0.6323529411764706
    assert abs(m.f1 - 0.6466165413533834) < 1e-15


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "downtime_risk int, predicted_risk int")
    m = TR.classification_metrics(df).first()
    assert (m.precision, m.recall, m.f1, m.accuracy) == (0.0, 0.0, 0.0, 1.0)
    conf = {(r.actual, r.predicted): r.rows for r in TR.confusion(df).collect()}
    assert conf == {(1, 1): 0, (0, 1): 0, (1, 0): 0, (0, 0): 2}


def test_threshold_sweep_brute_force(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"downtime_risk": rng.integers(0, 2, 300), "risk_probability": rng.random(300)})
    out = TR.threshold_sweep(spark.createDataFrame(pdf), [0.1, 0.5, 0.9]).collect()
    for r in out:
        pred = pdf.risk_probability >= r.threshold
        assert r.tp == int(((pdf.downtime_risk == 1) & pred).sum())
        assert r.fp == int(((pdf.downtime_risk == 0) & pred).sum())
        assert r.tp + r.fp + r.fn + r.tn == 300


def test_kpis_empty_frame(spark):
    df = spark.createDataFrame([], "risk_probability double, predicted_risk int")
    r = G.kpis(df).first()
    assert (r.total_assets, r.high_risk_assets, r.avg_risk, r.monitored_stable) == (0, 0, 0.0, 0)


def test_histogram_top_edge_and_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.51,), (None,)], "risk_probability double")
    out = {r.bin: r["count"] for r in G.histogram(df).collect()}
    assert len(out) == 20 and out[0] == 1 and out[19] == 1 and out[10] == 1 and sum(out.values()) == 3
    assert G.nice_width(0, 1, 30) == 0.05 and G.nice_width(0, 100, 10) == 10.0


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0)], "a double, b double, c double")
    out = {(r.x, r.y): r.corr for r in G.correlation(df, ["a", "b", "c"]).collect()}
    assert out[("a", "c")] is None and out[("c", "c")] is None and out[("a", "a")] == 1.0
    assert abs(out[("a", "b")] - np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1]) < 1e-12


def test_stratified_split_and_folds(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"record": np.arange(5000), "downtime_risk": (rng.random(5000) < 0.3).astype(int)})
    df = spark.createDataFrame(pdf)
    tr, te = SP.stratified_split(df)
    te_p = te.toPandas()
    assert tr.count() + len(te_p) == 5000
    for c in (0, 1):
        share = (te_p.downtime_risk == c).sum() / (pdf.downtime_risk == c).sum()
        assert abs(share - 0.2) < 0.01
    folds = SP.stratified_folds(df).groupBy("downtime_risk", "fold").count().toPandas()
    for c in (0, 1):
        sizes = folds[folds.downtime_risk == c]["count"]
        assert len(sizes) == 5 and sizes.max() - sizes.min() <= 0.02 * sizes.sum()
    w = {r.downtime_risk: r.weight for r in SP.balanced_weights(df).collect()}
    n1 = int(pdf.downtime_risk.sum())
    assert math.isclose(w[1], 5000 / (2 * n1))


def test_leaf_shapley_brute_force():
    from riskengine.operators.explain import forest_base, tree_shapley

    rng = np.random.default_rng(7)
    L, m = 40, 5
    lo = np.full((L, m), -np.inf)
    hi = np.full((L, m), np.inf)
    mask = rng.random((L, m)) < 0.5
    lo[mask] = rng.normal(size=mask.sum()) - 0.5
    hi[mask] = lo[mask] + 1.0
    cover = np.where(mask, rng.uniform(0.05, 1, (L, m)), 1.0)
    values = rng.random(L)
    x = rng.normal(size=m)
    a = ((x > lo) & (x <= hi)).astype(float)

    def v(S_):
        sel = np.isin(np.arange(m), list(S_))[None, :]
        return float(np.sum(values * np.prod(np.where(sel, a, cover), axis=1)))

    phi_bf = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for k in range(m):
            for S_ in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m)
                phi_bf[i] += w * (v(S_ + (i,)) - v(S_))
    tree = (values, lo, hi, cover)
    phi, base = tree_shapley(np.vstack([x, x]), tree, block=1, leaves=7)[1], forest_base([tree])
    assert np.allclose(phi, phi_bf, atol=1e-12)
    assert math.isclose(base, v(()), abs_tol=1e-12)
    assert math.isclose(base + phi.sum(), v(tuple(range(m))), abs_tol=1e-12)


def test_forest_contributions_local_accuracy(spark):
    from riskengine.operators import explain as X

    rng = np.random.default_rng(8)
    n = 400
    pdf = pd.DataFrame({c: rng.normal(50, 10, n) for c in S.FEATURE_COLUMNS})
    pdf["record"] = np.arange(n)
    pdf["machine_label"] = [f"M{i}" for i in range(n)]
    pdf["downtime_risk"] = ((pdf.machine_temperature + pdf.error_log_count + rng.normal(0, 5, n)) > 100).astype(int)
    df = spark.createDataFrame(pdf)
    model = TR.fit_candidate("rf", df, seed=1, num_trees=7, max_depth=4)
    c = X.forest_contributions(df, model).drop("risk_probability")
    p = TR.predict(model, df).select("record", "risk_probability")
    j = c.join(p, "record").withColumn("s", sum(F.col(f"contrib_{f}") for f in S.FEATURE_COLUMNS) + F.col("base"))
    assert j.select(F.max(F.abs(F.col("s") - F.col("risk_probability")))).first()[0] < 1e-9
    imp = X.importance(spark, model).collect()
    assert len(imp) == 8 and abs(sum(r.importance for r in imp) - 100.0) < 0.1


def test_linear_contributions_sum_to_logit(spark):
    from riskengine.operators import explain as X

    coef = {"a": 0.5, "b": -2.0}
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, -1.0, 0.5)], "record long, a double, b double")
    out = X.linear_contributions(df, coef, 0.25, mean={"a": 1.0, "b": 2.0}, std={"a": 2.0, "b": 0.5}).collect()
    for r in out:
        logit = 0.5 * (r.a - 1) / 2 - 2.0 * (r.b - 2) / 0.5 + 0.25
        assert math.isclose(r.base + r.contrib_a + r.contrib_b, logit, abs_tol=1e-12)
    tab = X.contribution_table(spark.createDataFrame(out), ["a", "b"]).collect()
    assert {t.direction for t in tab} <= {S.DIRECTION_UP, S.DIRECTION_DOWN} and len(tab) == 4


def test_model_save_load_and_single_prediction(spark, tmpdir_run):
    import os

    from riskengine.operators import score as SC
    from riskengine.sources import store as ST

    rng = np.random.default_rng(9)
    n = 300
    pdf = pd.DataFrame({c: rng.normal(50, 10, n) for c in S.FEATURE_COLUMNS})
    pdf["record"] = np.arange(n)
    pdf["machine_label"] = [f"M{i}" for i in range(n)]
    pdf["downtime_risk"] = ((pdf.machine_temperature + rng.normal(0, 5, n)) > 52).astype(int)
    df = spark.createDataFrame(pdf)
    model = TR.fit_candidate("lr", df, seed=1)
    path = os.path.join(tmpdir_run, "model")
    ST.save_model(model, path)
    back = ST.load_model(path)
    a = TR.predict(model, df).select("record", "risk_probability").toPandas().set_index("record")
    b = TR.predict(back, df).select("record", "risk_probability").toPandas().set_index("record")
    assert np.allclose(a.risk_probability.values, b.risk_probability.sort_index().values)
    vals = pdf.iloc[0][S.FEATURE_COLUMNS].to_dict()
    label, prob = SC.predict_one(spark, back, vals, threshold=0.5)
    assert math.isclose(prob, a.risk_probability.iloc[0], abs_tol=1e-12) and label == int(prob >= 0.5)
    label_hi, _ = SC.predict_one(spark, back, vals, threshold=0.0)
    assert label_hi == 1
    sc = SC.scenario_check(spark, back).collect()
    assert [r.machine for r in sc] == ["HIGH-STRESS", "STABLE", "BOUNDARY"] and sc[2].result == "Review"


def test_quantiles_with_a_hot_value_and_missing_values(spark):
    # a third of the values identical; NaN and NULL are missing; a column without values
    vals = [0.0] * 400 + list(np.linspace(1, 2, 800))
    rows = [(float(v), None) for v in vals] + [(float("nan"), None), (None, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    for accuracy in (10_000, 30):
        got = {(r.column, r.q): r.value for r in W.exact_quantiles(df, ["a", "b"], [0.0, 0.1, 0.33, 0.5, 0.9, 1.0], accuracy).collect()}
        assert len(got) == 12
        for (c, q), v in got.items():
            assert v is None if c == "b" else math.isclose(v, float(np.quantile(vals, q)), abs_tol=1e-12)
    assert W.exact_quantiles(df.where("false"), ["a"], [0.5]).collect()[0].value is None


def test_dense_index_with_repeated_rows(spark):
    dup = spark.createDataFrame([(1, "x")] * 300 + [(2, "y")] * 10, "k int, s string")
    out = W.with_record(dup, ["k"], out="r", unique=False, num_partitions=4)
    assert sorted(r.r for r in out.collect()) == list(range(310)) and "_tie" not in out.columns


def test_prep_stats_match_imputed_columns(spark):
    rng = np.random.default_rng(10)
    n = 200
    pdf = pd.DataFrame({c: rng.normal(50, 10, n) for c in S.FEATURE_COLUMNS})
    pdf.loc[rng.random(n) < 0.2, "pressure"] = np.nan
    pdf.loc[:, "error_log_count"] = np.nan
    df = spark.createDataFrame(pdf)
    for c in S.FEATURE_COLUMNS:
        df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    rows, med, mean, std = TR.prep_stats(df)
    assert rows == n
    for c in S.FEATURE_COLUMNS:
        col = pdf[c]
        m = float(col.median()) if col.notna().any() else S.FEATURE_DEFAULTS[c]
        imp = col.fillna(m)
        assert math.isclose(med[c], m, abs_tol=1e-12)
        assert math.isclose(mean[c], float(imp.mean()), rel_tol=1e-12, abs_tol=1e-12)
        sd = float(imp.std(ddof=0))
        assert math.isclose(std[c], sd if sd > 0 else 1.0, rel_tol=1e-9, abs_tol=1e-12)


def test_clean_materialised(spark):
    from riskengine.session import clean_materialised

    df = spark.createDataFrame([(i,) for i in range(20)], "k int")
    assert W.with_record(df, ["k"], out="r").count() == 20
    assert clean_materialised(spark) >= 1


def test_threshold_sweep_keeps_the_given_rows(spark):
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"downtime_risk": rng.integers(0, 2, 500), "risk_probability": np.round(rng.random(500), 2)})
    df = spark.createDataFrame(pdf).union(spark.createDataFrame([(1, float("nan")), (0, None)], "a long, b double"))
    for ts in ([0.5, 0.5, 0.1], [round(0.01 * i, 2) for i in range(1, 100)]):
        got = TR.threshold_sweep(df, ts).collect()
        assert sorted(r.threshold for r in got) == sorted(ts)
        for r in got:
            assert r.tp == int(((pdf.downtime_risk == 1) & (pdf.risk_probability >= r.threshold)).sum())
            assert r.tp + r.fn == int((pdf.downtime_risk == 1).sum()) + 1


def test_histogram_counts_values_outside(spark):
    df = spark.createDataFrame([(v,) for v in (-0.2, 0.5, 1.0, 1.7, float("nan"), None)], "risk_probability double")
    got = {r.bin: r["count"] for r in G.histogram(df, width=0.5).collect()}
    assert got == {-1: 1, 0: 0, 1: 2, 3: 1}


def test_percent_text_is_exact_half_even(spark):
    from riskengine.functions.scalar import percent_text

    rng = random.Random(3)
    values = [0.1225, 0.0625, 0.5005, 0.3125, 0.0015, 0.0025, 0.9995, 1.0, 0.0, -0.1225, -0.0004, 12.34567, 1e12]
    values += [rng.randrange(4000) / 1600 for _ in range(300)] + [rng.randrange(20000) / 20000 for _ in range(300)]
    values += [rng.random() for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", percent_text("v").alias("t")).collect()
    for r in got:
        assert r.t.lstrip("-") == f"{r.v:.1%}".lstrip("-"), r


def test_split_keeps_rows_without_a_class(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(100)], "record long, downtime_risk int")
    train, test = SP.stratified_split(df)
    assert train.count() + test.count() == 100 and test.where("downtime_risk is null").count() == 4
    folds = SP.stratified_folds(df).groupBy("downtime_risk", "fold").count().collect()
    assert len(folds) == 15 and {r["count"] for r in folds if r.downtime_risk is None} == {4}


def test_training_needs_both_classes_only(spark):
    row = tuple(1.0 for _ in S.FEATURE_COLUMNS)
    schema = "record long, downtime_risk int, " + ", ".join(f"{c} double" for c in S.FEATURE_COLUMNS)
    for labels in ([1, 2], [0, 0], [0, 1, None]):
        df = spark.createDataFrame([(i, y, *row) for i, y in enumerate(labels)], schema)
        with pytest.raises(ValueError):
            TR.train_and_select(df)


def test_scored_schema_and_positions(spark):
    from riskengine.operators import explain as X
    from riskengine.operators import score as SC

    model = TR.LinearModel(*X.fixture_linear_model(5.0, 2.0))
    df = spark.createDataFrame([(i, *[float(i)] * 8) for i in range(4)], "record long, " + ", ".join(f"{c} double" for c in S.FEATURE_COLUMNS))
    out = SC.score(df, model)
    assert set(out.columns) == {*df.columns, "machine_label", "risk_probability", "predicted_risk", "recommendation"}
    assert [r.machine_label for r in out.orderBy("record").collect()] == ["MCH-0001", "MCH-0002", "MCH-0003", "MCH-0004"]


FOREST_QUERIES = ("train_select", "scenario_check", "forest_importance", "forest_contributions", "forest_fleet_impact",
                  "forest_local_accuracy")


@pytest.mark.parametrize("name", FOREST_QUERIES)
def test_registered_forests_fit_the_references_trees(spark, monkeypatch, name):
    from riskengine.plans import model_queries as MQ
    from riskengine.plans.catalog import REGISTRY

    class Asked(Exception):
        pass

    def asked(*args, seed=None, num_trees=None, **kwargs):
        raise Asked(args[3] if len(args) > 3 else num_trees)

    monkeypatch.setattr(MQ.TR, "fit_candidate", asked)
    monkeypatch.setattr(MQ.TR, "train_and_select", asked)
    with pytest.raises(Asked) as stop:
        REGISTRY[name].run(spark, "/root/testdata/sf0.001")
    assert stop.value.args == (220,)


def test_histogram_counts_infinite_and_far_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in (0.05, 1.0, inf, inf, -inf, 1e300, -1e300, float("nan"), None)], "p double")
    rows = {r.bin: r for r in G.histogram(df, "p", width=0.1).collect() if r["count"]}
    assert sum(r["count"] for r in rows.values()) == 7
    assert (rows[G.HIGHEST_BIN]["count"], rows[G.HIGHEST_BIN].bin_start) == (2, inf)
    assert (rows[G.LOWEST_BIN]["count"], rows[G.LOWEST_BIN].bin_end) == (1, -inf)
    assert rows[G.HIGHEST_BIN - 1]["count"] == 1 and rows[G.LOWEST_BIN + 1]["count"] == 1 and rows[0]["count"] == 1


def test_correlation_with_and_without_missing_values(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(1e6, 1.0, (400, 4))
    data[:, 3] = 7.0
    frame = pd.DataFrame(data, columns=list("abcd"))
    frame["e"] = frame["a"].where(rng.random(400) > 0.4) * 2 + rng.normal(0, 1, 400)
    frame["f"] = frame["b"].where(rng.random(400) > 0.4)
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in frame.columns))
    got = {(r.x, r.y): r.corr for r in G.correlation(df, list(frame.columns)).collect()}
    expected = frame.corr()
    for (x, y), value in got.items():
        if "d" in (x, y):
            assert value is None
        else:
            assert abs(value - expected.loc[x, y]) < 1e-9, (x, y)
    assert len(got) == 36
    plan = G.correlation(df, list("abc"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "scalar-subquery" not in plan
    empty = G.correlation(df.limit(0), ["a", "b"]).collect()
    assert len(empty) == 4 and all(r.corr is None for r in empty)


def test_one_hot_keeps_null_and_its_name_apart(spark):
    values = ["a", None, "null", "\\null", "\\\\null", "nullable"]
    df = spark.createDataFrame(list(enumerate(values)), "record int, c string")
    wide = E.one_hot(df, "c", values)
    assert len(wide.columns) == 2 + len(values)
    for i, r in enumerate(wide.orderBy("record").collect()):
        assert list(r[2:]) == [int(k == i) for k in range(len(values))]
    long = {r.record: r.category for r in E.one_hot_long(df, "c").collect()}
    assert long == {i: E.category_name("c", v) for i, v in enumerate(values)} and len(set(long.values())) == len(values)


def test_contribution_table_sorts_inside_records_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, 1.0, -5.0, 2.0, None), (0, 3.0, 3.0, -3.0, 0.0)], "record int, a double, b double, c double, d double")
    for c in "abcd":
        df = df.withColumn(f"contrib_{c}", F.col(c))
    out = X.contribution_table(df, list("abcd"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    order = {}
    for r in out.collect():
        order.setdefault(r.record, []).append(r.feature)
    assert order == {1: ["b", "c", "a", "d"], 0: ["a", "b", "c", "d"]}


def test_logistic_gradient_tells_a_fit_from_altered_coefficients(spark):
    rng = np.random.default_rng(9)
    rows = [(*[float(v) for v in rng.normal(50, 10, 8)], 1.0 + float(i % 3)) for i in range(400)]
    rows = [(*r, int(r[0] + rng.normal(0, 8) > 52)) for r in rows]
    train = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in S.FEATURE_COLUMNS) + ", w double, downtime_risk int").withColumn(
        "machine_label", F.lit("M"))
    train = SP.with_weights(train.drop("w"))
    model = TR.fit_candidate("lr", train.drop("weight"), 42)
    coef, intercept, med, mean, std = TR.linear_parts(model)
    penalty = 1.0 / len(rows)

    def worst(c, b):
        scored_rows = TR.predict(TR.LinearModel(c, b, med, mean, std), train)
        return max(abs(v) for v in TR.logistic_gradient(scored_rows, (c, b, med, mean, std), penalty).first())

    assert worst(coef, intercept) < 5e-5
    for c in S.FEATURE_COLUMNS:
        assert worst({**coef, c: coef[c] + 0.05}, intercept) > 1e-3
    assert worst(coef, intercept + 0.05) > 1e-3


@pytest.mark.parametrize("ranges", [2, 5, 70])
def test_with_index_numbers_tuples_in_order(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["hot", "hot", "hot", None, "a", "é", ""]), rng.choice([None, -1.5, 0.0, float("nan"), 2.0]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v double, i int").repartition(6)
    out = W.with_index(df, ["k", "v", "i"], out="r", ranges=ranges)
    got = [x.i for x in sorted(out.collect(), key=lambda x: x.r)]
    expected = [x.i for x in df.orderBy(*[F.asc_nulls_first(c) for c in ("k", "v", "i")]).collect()]
    assert got == expected and out.agg(F.min("r"), F.max("r")).first() == (0, 899)
    assert out.columns == ["k", "v", "i", "r"]
    sizes = W.with_index(df, ["k", "v", "i"], ranges=ranges).groupBy(F.floor(F.col("record") / 100)).count()
    assert {r["count"] for r in sizes.collect()} == {100}


def test_with_index_of_few_or_no_rows_and_without_a_write(spark, tmp_path):
    df = spark.range(3).withColumn("t", F.timestamp_seconds("id"))
    assert [tuple(r) for r in W.with_index(df, ["t"], out="r").orderBy("id").select("id", "r").collect()] == [(0, 0), (1, 1), (2, 2)]
    assert W.with_index(df.limit(0), ["t"], out="r").count() == 0
    same = spark.createDataFrame([(1,)] * 40, "x int")
    assert sorted(r.r for r in W.with_index(same, ["x"], out="r", ranges=4).collect()) == list(range(40))
    from riskengine.session import checkpoint_dir
    root = checkpoint_dir(spark).removeprefix("file:")
    import os
    names = set(os.listdir(root))
    W.with_index(df, ["t"]).collect()
    W.lag_by(df.withColumn("k", F.lit("m")), "k", "t", "id", tiebreak="id").collect()
    assert set(os.listdir(root)) == names


def test_rows_of_a_class_stay_spread_over_tasks(spark):
    df = spark.range(4000).repartition(8).selectExpr("id AS record", "CAST(id % 4 = 0 AS INT) AS downtime_risk")
    kept = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}   # no help from sizes
    before = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        train, _ = SP.stratified_split(df)
        sizes = [r["count"] for r in SP.with_weights(train).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 3200 and max(sizes) < 600
