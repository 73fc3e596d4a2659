"""Model training, selection and evaluation.

Pre-processing statistics (median imputation, population scaling) are computed
with one aggregate each and applied as column expressions; the logistic regression is
MLlib's, the forest ``growth.fit_forest``. Metrics are counted with one ``agg`` -- MLlib's evaluator "f1" is
class-weighted, not the class-1 F1 the application reports.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskengine import schema as S

PRED = "predicted_risk"


def confusion_counts(df: DataFrame, actual: str = S.TARGET_COLUMN, pred: str = PRED) -> DataFrame:
    a, p = F.col(actual).cast("int"), F.col(pred).cast("int")
    return df.agg(
        F.count_if((a == 1) & (p == 1)).alias("tp"),
        F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 1) & (p == 0)).alias("fn"),
        F.count_if((a == 0) & (p == 0)).alias("tn"),
    )


def _ratios(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(tp, tp + fp), zero)
    recall = F.coalesce(F.try_divide(tp, tp + fn), zero)
    return (
        df.withColumn("accuracy", F.coalesce(F.try_divide(tp + tn, tp + fp + fn + tn), zero))
        .withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", F.coalesce(F.try_divide(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn), zero))
    )


def classification_metrics(df: DataFrame, actual: str = S.TARGET_COLUMN, pred: str = PRED) -> DataFrame:
    """Tp, fp, fn, tn, accuracy, precision, recall, f1 of class 1 (zero division -> 0)."""
    return _ratios(confusion_counts(df, actual, pred))


def metrics_from_counts(spark, tp: int, fp: int, fn: int, tn: int) -> DataFrame:
    return _ratios(spark.createDataFrame([(tp, fp, fn, tn)], "tp long, fp long, fn long, tn long"))


def confusion(df: DataFrame, actual: str = S.TARGET_COLUMN, pred: str = PRED) -> DataFrame:
    """The 2x2 matrix as 4 rows (zero cells included)."""
    c = confusion_counts(df, actual, pred)
    return c.selectExpr("stack(4, 1, 1, tp, 0, 1, fp, 1, 0, fn, 0, 0, tn) as (actual, predicted, rows)")


def threshold_sweep(df: DataFrame, thresholds: list[float] | None = None, actual: str = S.TARGET_COLUMN,
                    prob: str = "risk_probability") -> DataFrame:
    """Metrics at each given threshold (repeats and order are the caller's) from one
    scan. Each row gets the number of thresholds at or below its score, a histogram of that
    number is built, and reverse cumulative sums over it give the counts everywhere. A
    missing score passes no threshold."""
    from pyspark.sql import Window

    given = [float(t) for t in thresholds or [round(0.05 * i, 2) for i in range(1, 20)]]
    levels = sorted(set(given))
    passed = F.size(F.filter(F.array(*[F.lit(t) for t in levels]), lambda t: t <= F.nanvl(F.col(prob), F.lit(None))))
    a = F.col(actual).cast("int")
    hist = df.groupBy(F.coalesce(passed, F.lit(0)).alias("idx")).agg(
        F.count_if(a == 1).alias("pos"), F.count_if(a == 0).alias("neg"))
    spine = df.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(levels)], "idx int, threshold double")
    at_or_above = Window.orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    full = spine.join(hist, "idx", "full_outer").fillna(0, ["pos", "neg"])   # a row per threshold, and idx 0
    every = Window.partitionBy()
    cum = full.select("threshold", F.sum("pos").over(at_or_above).alias("tp"), F.sum("neg").over(at_or_above).alias("fp"),
                      F.sum("pos").over(every).alias("_p"), F.sum("neg").over(every).alias("_n"))
    rows = df.sparkSession.createDataFrame([(t,) for t in given], "threshold double")
    out = rows.join(cum, "threshold").select("threshold", "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"),
                                             (F.col("_n") - F.col("fp")).alias("tn"))
    return _ratios(out)


def savings(df: DataFrame, downtime_cost: float, inspection_cost: float, actual: str = S.TARGET_COLUMN,
            pred: str = PRED) -> DataFrame:
    """Prevented failures x downtime cost - false alarms x inspection cost."""
    c = confusion_counts(df, actual, pred)
    return c.select(
        "tp", "fp",
        (F.col("tp") * F.lit(float(downtime_cost))).alias("prevented_cost"),
        (F.col("fp") * F.lit(float(inspection_cost))).alias("false_alarm_cost"),
        (F.col("tp") * F.lit(float(downtime_cost)) - F.col("fp") * F.lit(float(inspection_cost))).alias("savings"),
    )


# --------------------------------------------------------------------------- training
@dataclass
class TrainResult:
    model: object
    model_name: str
    metrics: dict
    cv_scores: dict = field(default_factory=dict)
    feature_columns: list = field(default_factory=lambda: list(S.FEATURE_COLUMNS))


# Memory for a forest fit's node statistics. Nodes are split in groups that fit it and the
# random feature draws follow the groups, so a fixed value keeps fits equal everywhere.
FOREST_MEMORY_MB = 512
# MLlib's largest depth; the reference's forests grow without a limit.
MAX_DEPTH = 30


def _pipeline(kind: str, n_train: int, med: dict, mean: dict, std: dict, seed: int, num_trees: int, max_depth: int,
              forest_mb: int = FOREST_MEMORY_MB):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import SQLTransformer, VectorAssembler

    exprs = ", ".join(
        f"(coalesce(`{c}`, CAST({med.get(c, S.FEATURE_DEFAULTS[c])!r} AS DOUBLE)) - CAST({mean[c]!r} AS DOUBLE))"
        f" / CAST({std[c]!r} AS DOUBLE) AS `{c}__z`"
        for c in S.FEATURE_COLUMNS
    )
    prep = SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")
    asm = VectorAssembler(inputCols=[f"{c}__z" for c in S.FEATURE_COLUMNS], outputCol="features")
    if kind == "lr":
        # sklearn C=1 on balanced weights (sum of weights = n) <=> regParam = 1 / n
        clf = LogisticRegression(featuresCol="features", labelCol=S.TARGET_COLUMN, weightCol="weight",
                                 maxIter=1000, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                 standardization=False)
    else:
        clf = RandomForestClassifier(featuresCol="features", labelCol=S.TARGET_COLUMN, weightCol="weight",
                                     numTrees=num_trees, maxDepth=max_depth, featureSubsetStrategy="sqrt",
                                     seed=seed, maxMemoryInMB=forest_mb, cacheNodeIds=True, checkpointInterval=10)
    return Pipeline(stages=[prep, asm, clf])


def prep_stats(train: DataFrame) -> tuple[int, dict, dict, dict]:
    """M3/M4: the row count and, per feature, the median of present values (imputer), then
    mean and population std of the imputed column (scaler), derived from the present
    values' count, mean and variance -- no pass over imputed data."""
    import math

    from riskengine.operators.features import medians

    cols = S.FEATURE_COLUMNS
    none = F.lit(None).cast("double")
    x = {c: F.nanvl(F.col(c).cast("double"), none) for c in cols}
    row = train.agg(F.count(F.lit(1)).alias("n"), *[e for i, c in enumerate(cols) for e in (
        F.count(x[c]).alias(f"n{i}"), F.avg(x[c]).alias(f"m{i}"), F.var_pop(x[c]).alias(f"v{i}"))]).first()
    n = row["n"]
    med = {r["feature"]: r["median"] for r in medians(train, cols).collect()}
    mean, std = {}, {}
    for i, c in enumerate(cols):
        nn, m, v = row[f"n{i}"], row[f"m{i}"], row[f"v{i}"]
        md = med.get(c)
        if md is None:
            md = med[c] = S.FEATURE_DEFAULTS[c]
        if nn == n and n:
            mu, var = m, v
        elif nn == 0:
            mu, var = md, 0.0
        else:
            mu = (nn * m + (n - nn) * md) / n
            var = (nn * (v + (m - mu) ** 2) + (n - nn) * (md - mu) ** 2) / n
        mean[c] = float(mu)
        sd = math.sqrt(max(var, 0.0))
        std[c] = sd if sd > 0 else 1.0
    return n, med, mean, std


def fit_pipeline(kind, train: DataFrame, stats, seed: int, num_trees: int, max_depth: int):
    from riskengine.operators.split import with_weights

    n, med, mean, std = stats
    plan = _pipeline(kind, n, med, mean, std, seed, num_trees, max_depth)
    if kind == "lr":
        return plan.fit(with_weights(train))
    from pyspark.ml import PipelineModel
    from riskengine.operators.growth import fit_forest

    *prepare, _ = plan.getStages()
    rows = PipelineModel(prepare).transform(with_weights(train))
    return PipelineModel([*prepare, fit_forest(rows, num_trees, max_depth, seed)])


def fit_candidate(kind: str, train: DataFrame, seed: int = 42, num_trees: int = 220, max_depth: int = MAX_DEPTH):
    """Fit one candidate ('lr' or 'rf') with its imputer/scaler on ``train``."""
    from riskengine.session import checkpoint_dir

    checkpoint_dir(train.sparkSession)
    train = train.persist()          # read by the statistics, the weights and the fit
    model = fit_pipeline(kind, train, prep_stats(train), seed, num_trees, max_depth)
    train.unpersist()
    return model


_PREP = re.compile(r"coalesce\(`(\w+)`, CAST\((\S+) AS DOUBLE\)\) - CAST\((\S+) AS DOUBLE\)\) / CAST\((\S+) AS DOUBLE\)")


def prep_parts(model) -> tuple[dict, dict, dict]:
    """(median, mean, std) by feature of a fitted or loaded pipeline, read from its first
    stage (which is saved with it)."""
    found = {c: (float(m), float(u), float(s)) for c, m, u, s in _PREP.findall(model.stages[0].getStatement())}
    return tuple({c: found[c][k] for c in S.FEATURE_COLUMNS} for k in range(3))


def linear_parts(model):
    """(coef, intercept, median, mean, std) of a logistic-regression pipeline, by feature."""
    lr = model.stages[-1]
    coef = dict(zip(S.FEATURE_COLUMNS, [float(v) for v in lr.coefficients.toArray()]))
    return coef, float(lr.intercept), *prep_parts(model)


class LinearModel:
    """A logistic model given by its numbers: the same transformer as a fitted pipeline."""

    def __init__(self, coef: dict, intercept: float, median: dict | None = None, mean: dict | None = None,
                 std: dict | None = None):
        self.coef, self.intercept = coef, intercept
        self.median = median or dict(S.FEATURE_DEFAULTS)
        self.mean = mean or {c: 0.0 for c in coef}
        self.std = std or {c: 1.0 for c in coef}

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        logit = F.lit(float(self.intercept))
        for c, w in self.coef.items():
            x = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(self.median[c])))
            logit = logit + F.lit(float(w)) * ((x - F.lit(float(self.mean[c]))) / F.lit(float(self.std[c])))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
        return df.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))


def predict(model, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df).select(*df.columns, vector_to_array("probability")[1].alias("risk_probability"))
    return out.withColumn(PRED, (F.col("risk_probability") >= F.lit(threshold)).cast("int"))


def check_binary(df: DataFrame, label: str = S.TARGET_COLUMN) -> None:
    """Training needs the classes 0 and 1, both, and nothing else."""
    y = F.col(label).cast("double")
    r = df.agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"), F.count(F.lit(1)).alias("n")).first()
    if not r["pos"] or not r["neg"] or r["pos"] + r["neg"] != r["n"]:
        raise ValueError("training needs a target column that holds both 0 and 1 and nothing else")


def cv_scores(df: DataFrame, kinds: tuple[str, ...] | str = ("lr", "rf"), k: int = 5, seed: int = 42,
              num_trees: int = 220, max_depth: int = MAX_DEPTH, parallelism: int = 4) -> DataFrame:
    """Class-1 F1 of every (candidate, fold) as (model, fold, f1).

    The folded frame is cached once; a fold's statistics are computed once for all
    candidates. Candidate x fold fits run as concurrent Spark jobs (``parallelism`` at a
    time), each distributed, over filters of the cached frame."""
    from concurrent.futures import ThreadPoolExecutor

    from riskengine.operators.split import stratified_folds
    from riskengine.session import checkpoint_dir

    kinds = (kinds,) if isinstance(kinds, str) else tuple(kinds)
    checkpoint_dir(df.sparkSession)
    folded = stratified_folds(df, k=k, seed=seed).persist()
    stats = [prep_stats(folded.filter(F.col("fold") != f)) for f in range(k)]

    def one(task):
        kind, f = task
        m = fit_pipeline(kind, folded.filter(F.col("fold") != f).drop("fold"), stats[f], seed, num_trees, max_depth)
        held = folded.filter(F.col("fold") == f).drop("fold")
        return (kind, f, float(classification_metrics(predict(m, held)).select("f1").first()[0]))

    tasks = [(kind, f) for kind in kinds for f in range(k)]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = list(pool.map(one, tasks))
    folded.unpersist()
    return df.sparkSession.createDataFrame(rows, "model string, fold int, f1 double")


def choose(scores: DataFrame, candidates: tuple[str, ...]) -> DataFrame:
    """M7's choice: (model, cv_f1) of the highest mean F1; the first candidate keeps ties."""
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("model"))
    return scores.groupBy("model").agg(F.avg("f1").alias("cv_f1")).orderBy(F.desc("cv_f1"), rank).limit(1)


def train_and_select(df: DataFrame, candidates: tuple[str, ...] = ("lr", "rf"), k: int = 5, seed: int = 42,
                     num_trees: int = 220, max_depth: int = MAX_DEPTH, key: str = "record",
                     parallelism: int = 4) -> TrainResult:
    """M7/M8: stratified 80/20 split, k-fold CV F1 per candidate (the first candidate
    wins ties), refit of the best on the training part, test metrics incl. cv_f1."""
    from riskengine.operators.split import stratified_split

    check_binary(df)
    train, test = stratified_split(df, key=key, seed=seed)
    train = train.persist()
    scores = cv_scores(train, candidates, k, seed, num_trees, max_depth, parallelism)
    means = {r["model"]: float(r["f1"]) for r in scores.groupBy("model").agg(F.avg("f1").alias("f1")).collect()}
    best = choose(scores, candidates).first()["model"]
    model = fit_pipeline(best, train, prep_stats(train), seed, num_trees, max_depth)
    m = classification_metrics(predict(model, test)).first()
    metrics = {"accuracy": m["accuracy"], "precision": m["precision"], "recall": m["recall"], "f1": m["f1"],
               "cv_f1": means[best]}
    train.unpersist()
    names = {"lr": "Logistic Regression", "rf": "Random Forest"}
    return TrainResult(model=model, model_name=names.get(best, best), metrics=metrics, cv_scores=means)


def metrics_frame(spark, metrics: dict) -> DataFrame:
    """S17 shape: (metric, value) rows; the published key ``f1_score`` reads as ``f1``."""
    rows = [("f1" if k == "f1_score" else k, float(v)) for k, v in metrics.items()]
    return spark.createDataFrame(rows, "metric string, value double")


def logistic_gradient(rows: DataFrame, parts: tuple, penalty: float, prob: str = "risk_probability",
                      weight: str = "weight") -> DataFrame:
    """M5: the gradient of the penalised, weighted log loss at a fitted model, one column for
    the intercept and one per coefficient (``g_<feature>``), in one scan: the weighted mean of
    (probability - class) times the standardised input, plus penalty times coefficient. A
    fit is optimal just where all are 0."""
    coef, _, med, mean, std = parts
    miss = F.col(weight) * (F.col(prob) - F.col(S.TARGET_COLUMN))
    z = {c: (F.coalesce(F.col(c), F.lit(float(med[c]))) - F.lit(float(mean[c]))) / F.lit(float(std[c])) for c in coef}
    total = F.sum(weight)
    return rows.agg((F.sum(miss) / total).alias("g_intercept"),
                    *[(F.sum(miss * z[c]) / total + F.lit(penalty * float(coef[c]))).alias(f"g_{c}") for c in coef])
