"""Property checks (hypothesis): the bucket + halo windows equal the naive windows."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskengine.operators import indexing as W


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 300), width=st.integers(1, 12), extra=st.integers(0, 40), seed=st.integers(0, 10_000))
def test_rolling_mean_equals_pandas(spark, n, width, extra, seed):
    rng = np.random.default_rng(seed)
    vals = rng.random(n)
    vals[rng.random(n) < 0.1] = np.nan
    pdf = pd.DataFrame({"record": np.arange(n), "p": vals})
    df = spark.createDataFrame(pdf).withColumn("p", F.when(~F.isnan("p"), F.col("p")))
    bucket = max(width - 1, 1) + extra
    out = W.rolling_mean(df, "p", width, bucket=bucket).orderBy("record").toPandas()
    exp = pdf.p.rolling(width, min_periods=1).mean()
    assert len(out) == n
    assert np.allclose(out.rolling_average.values, exp.values, equal_nan=True)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(2, 250), width=st.integers(1, 9), hot=st.floats(0.0, 0.9), seed=st.integers(0, 10_000))
def test_rolling_mean_by_equals_pandas(spark, n, width, hot, seed):
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < hot, "HOT", rng.choice(["a", "b", "c", "d"], n))
    pdf = pd.DataFrame({"record": np.arange(n), "ts": rng.permutation(n), "m": keys, "p": rng.random(n)})
    df = spark.createDataFrame(pdf)
    bucket = max(width - 1, 1) + 5
    out = W.rolling_mean_by(df, "m", "ts", "p", width, bucket=bucket).toPandas().set_index("record").sort_index()
    exp = (pdf.sort_values(["m", "ts"]).groupby("m").p.rolling(width, min_periods=1).mean()
           .reset_index(level=0, drop=True).sort_index())
    assert np.allclose(out.rolling_average.values, exp.values)
