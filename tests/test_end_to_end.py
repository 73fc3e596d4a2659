"""The README workflow end to end: CSV files -> flexible read -> standardise ->
train and select -> score -> analytics and advice -> run store."""

import os

from riskengine.functions import advise
from riskengine.operators import analytics, score, train
from riskengine.sources import fixtures, ingest, store
from tests.conftest import SF_SMALL


def test_csv_to_store_workflow(spark, tmpdir_run):
    a = fixtures.fleet_actual(spark, SF_SMALL)
    store.write_csv(a, os.path.join(tmpdir_run, "plant"), ["machine_label", *fixtures.FEATURE_COLUMNS, "downtime_risk"])
    fleet = ingest.load_dataset(spark, os.path.join(tmpdir_run, "plant", "*.csv"))
    n = a.count()
    assert fleet.count() == n
    result = train.train_and_select(fleet, num_trees=15, max_depth=5, k=3)
    assert result.model_name in ("Logistic Regression", "Random Forest")
    assert 0.5 < result.metrics["accuracy"] <= 1.0 and set(result.metrics) == {"accuracy", "precision", "recall",
                                                                             "f1", "cv_f1"}
    scored = score.score(fleet, result.model)
    k = analytics.kpis(scored).first()
    assert k.total_assets == n and k.high_risk_assets + k.monitored_stable == n
    assert analytics.top_risk(scored).count() == 10
    assert analytics.correlation(scored).count() == 81
    assert scored.select(advise.driver_summary().alias("s")).first().s.startswith("AI support summary")
    root = os.path.join(tmpdir_run, "runs")
    store.save_batch(scored, root, "plant-csv")
    runs, preds = store.load(spark, root)
    assert runs.count() == 1 and preds.count() == n and store.recent(preds, runs, 25).count() == 25
