"""Scoring: linear risk score, model scoring, thresholds, quantile labels, scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskengine import schema as S
from riskengine.functions.advise import recommendation
from riskengine.functions.scalar import sigmoid


def risk_score_expr(terms=None):
    """Sum of weight * (feature - centre) / divisor, in the fixed term order."""
    terms = terms or S.RISK_TERMS
    expr = None
    for feat, w, centre, div in terms:
        t = F.lit(w) * (F.col(feat) - F.lit(centre))
        if div != 1.0:
            t = t / F.lit(div)
        expr = t if expr is None else expr + t
    return expr


def linear_score(df: DataFrame, terms=None, offset: float = 0.0, scale: float = S.SYNTHETIC_SCALE) -> DataFrame:
    """risk_score and risk_probability = sigmoid((score - offset) / scale)."""
    out = df.withColumn("risk_score", risk_score_expr(terms))
    return out.withColumn("risk_probability", sigmoid(F.col("risk_score"), offset, scale))


def label_and_recommend(df: DataFrame, threshold: float = 0.5, prob: str = "risk_probability") -> DataFrame:
    """predicted_risk at ``threshold`` and the 3-band recommendation (M9 tail, A1)."""
    return df.withColumn("predicted_risk", (F.col(prob) >= F.lit(threshold)).cast("int")).withColumn(
        "recommendation", recommendation(prob)
    )


def score(df: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """M9: ``df`` with risk_probability, predicted_risk and recommendation from a fitted
    model (any transformer that adds a probability vector). Nothing else the model adds is
    kept. Machines without a label column are numbered by position (P6)."""
    from pyspark.ml.functions import vector_to_array

    if S.LABEL_COLUMN not in df.columns:
        from riskengine.operators.indexing import with_record

        order = "record" if "record" in df.columns else "_place"
        numbered = with_record(df if order == "record" else df.withColumn(order, F.monotonically_increasing_id()), [order], out="_n")
        df = numbered.withColumn(S.LABEL_COLUMN, F.format_string(S.DEFAULT_LABEL_FORMAT, F.col("_n") + 1)).drop("_n", "_place")
    scored = model.transform(df).select(*df.columns, vector_to_array("probability")[1].alias("risk_probability"))
    return label_and_recommend(scored, threshold)


def predict_one(spark: SparkSession, model, values: dict[str, float], threshold: float = 0.5) -> tuple[int, float]:
    """(label, probability) for one machine given as feature values."""
    row = [float(values[c]) for c in S.FEATURE_COLUMNS]
    df = spark.createDataFrame([tuple(["single"] + row)], ["machine_label"] + S.FEATURE_COLUMNS)
    r = score(df, model, threshold).select("predicted_risk", "risk_probability").first()
    return int(r[0]), float(r[1])


def quantile_label(df: DataFrame, col: str = "risk_probability", q: float = S.SYNTHETIC_QUANTILE,
                   out: str = "quantile_label") -> DataFrame:
    """1 where ``col`` is above its exact q-quantile (linear interpolation), else 0."""
    from riskengine.operators.indexing import exact_quantiles

    from riskengine.operators.indexing import quantile_lookup

    cut = quantile_lookup(exact_quantiles(df, [col], [q]))(col, q)
    return df.withColumn(out, (F.col(col) > cut).cast("int"))


def scenario_frame(spark: SparkSession) -> DataFrame:
    rows = [tuple([name] + vals + [exp]) for name, vals, exp in S.SCENARIOS]
    schema = "machine_label string, " + ", ".join(f"{c} double" for c in S.FEATURE_COLUMNS) + ", expected int"
    return spark.createDataFrame(rows, schema)


def scenario_check(spark: SparkSession, model, threshold: float = 0.5) -> DataFrame:
    """The three fixed machines; Pass only if HIGH-STRESS -> 1 and STABLE -> 0."""
    from riskengine.functions.advise import status_text
    from riskengine.functions.scalar import percent_text

    s = score(scenario_frame(spark), model, threshold)
    ok = ((F.col("machine_label").startswith("HIGH")) & (F.col("predicted_risk") == 1)) | (
        (F.col("machine_label").startswith("STABLE")) & (F.col("predicted_risk") == 0)
    )
    return s.select(
        F.col("machine_label").alias("machine"),
        status_text().alias("prediction"),
        percent_text("risk_probability").alias("probability"),
        F.when(ok, F.lit("Pass")).otherwise(F.lit("Review")).alias("result"),
    )
