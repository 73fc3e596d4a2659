"""Registered queries of splits, samples, models and their explanations.

Splits and samples use an MD5 hash, so their oracle is exact. Scoring, metrics, choice and
linear explanations are checked on models given by their numbers; fits are checked by
properties with a known answer (a zero gradient, contributions that add up to the score).
A few outputs of fitted forests remain rows-only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskengine import schema as S
from riskengine.functions.scalar import np_round
from riskengine.operators import explain as X
from riskengine.operators import forests as FR
from riskengine.operators import indexing as W
from riskengine.operators import score as SC
from riskengine.operators import split as SP
from riskengine.operators import train as TR
from riskengine.plans import oracle_sql as O
from riskengine.plans.catalog import register
from riskengine.sources import fixtures as FX

FEATS = S.FEATURE_COLUMNS
# Fixed model parameters of the reference's candidates: 220 trees, seed 42.
NUM_TREES = 220
SEED = 42

HASH_SQL = f"CAST('0x' || substr(md5(CAST(record AS VARCHAR) || ':{SEED}'), 1, 13) AS BIGINT)"
RANKED = (f"ranked AS (SELECT *, row_number() OVER (PARTITION BY downtime_risk ORDER BY {HASH_SQL}, record) AS r, "
          "count(*) OVER (PARTITION BY downtime_risk) AS n FROM actual)")
SIDES = "sides AS (SELECT *, CASE WHEN r <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split FROM ranked)"
FOLD_SQL = " + ".join(f"CAST(r > ceil(CAST({i / 5!r} AS DOUBLE) * n) AS INTEGER)" for i in range(1, 5))


def _training_frame(spark, d):
    return FX.fleet_actual(spark, d).select("record", "machine_label", *FEATS, "downtime_risk")


def _fixed_model():
    """The fleet view's score as a logistic model."""
    return TR.LinearModel(*X.fixture_linear_model(FX.FLEET_OFFSET, FX.FLEET_SCALE))


@register("stratified_split", O.with_ctes(RANKED, SIDES, actual=True) + "SELECT record, downtime_risk, split FROM sides")
def q_stratified_split(spark, d):
    return SP.split_column(FX.fleet_actual(spark, d)).select("record", "downtime_risk", "split")


@register("stratified_folds", O.with_ctes(RANKED, actual=True) + f"SELECT record, downtime_risk, {FOLD_SQL} AS fold FROM ranked")
def q_stratified_folds(spark, d):
    return SP.stratified_folds(FX.fleet_actual(spark, d)).select("record", "downtime_risk", "fold")


@register("split_missing_class",
          O.with_ctes("gaps AS (SELECT * REPLACE (CASE WHEN record % 5 <> 0 THEN downtime_risk END AS downtime_risk) FROM actual)",
                      RANKED.replace("FROM actual", "FROM gaps"), SIDES, actual=True)
          + "SELECT record, downtime_risk, split FROM sides")
def q_split_missing_class(spark, d):
    """M1: rows without a class stay, as a class of their own."""
    a = FX.fleet_actual(spark, d).withColumn("downtime_risk", F.when(F.col("record") % 5 != 0, F.col("downtime_risk")))
    return SP.split_column(a).select("record", "downtime_risk", "split")


@register("seeded_sample",
          O.with_ctes() + f"SELECT record, machine_label, risk_probability FROM scored ORDER BY {HASH_SQL}, record LIMIT 200",
          doubles=("risk_probability",))
def q_seeded_sample(spark, d):
    return W.seeded_sample(FX.fleet_scored(spark, d), n=200, seed=SEED).select("record", "machine_label", "risk_probability")


@register("train_part_stats",
          O.with_ctes(RANKED, SIDES, "part AS (SELECT * FROM sides WHERE split = 'train')", actual=True)
          + " UNION ALL ".join(f"SELECT '{c}' AS feature, median({c}) AS median, avg({c}) AS mean, "
                               f"CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS std FROM part" for c in FEATS),
          doubles=("median", "mean", "std"))
def q_train_part_stats(spark, d):
    """M3, M4: the imputer's and scaler's numbers of the training part."""
    train, _ = SP.stratified_split(_training_frame(spark, d), seed=SEED)
    _, med, mean, std = TR.prep_stats(train)
    return spark.createDataFrame([(c, med[c], mean[c], std[c]) for c in FEATS],
                                 "feature string, median double, mean double, std double")


@register("test_metrics",
          O.with_ctes(RANKED, SIDES, actual=True)
          + "SELECT tp, fp, fn, tn, CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy, "
          "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision, "
          "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall, "
          "coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0.0) AS f1 FROM (SELECT "
          "count(*) FILTER (WHERE downtime_risk = 1 AND predicted_risk = 1) AS tp, "
          "count(*) FILTER (WHERE downtime_risk = 0 AND predicted_risk = 1) AS fp, "
          "count(*) FILTER (WHERE downtime_risk = 1 AND predicted_risk = 0) AS fn, "
          "count(*) FILTER (WHERE downtime_risk = 0 AND predicted_risk = 0) AS tn FROM sides WHERE split = 'test') c",
          doubles=("accuracy", "precision", "recall", "f1"))
def q_test_metrics(spark, d):
    """M8: a model's metrics on the test part."""
    _, test = SP.stratified_split(_training_frame(spark, d), seed=SEED)
    return TR.classification_metrics(TR.predict(_fixed_model(), test))


CANDIDATES = {"half": 0.5, "strict": 0.6}
_FOLD_F1 = ("scores AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS model, fold, coalesce(2.0 * count(*) FILTER (WHERE y = 1 AND p >= {t}) / nullif("
    f"count(*) FILTER (WHERE y = 1) + count(*) FILTER (WHERE p >= {t}), 0), 0.0) AS f1 FROM folds GROUP BY fold"
    for name, t in CANDIDATES.items()) + ")")


@register("model_choice",
          O.with_ctes(RANKED, f"folds AS (SELECT {FOLD_SQL} AS fold, downtime_risk AS y, risk_probability AS p FROM ranked)",
                      _FOLD_F1, actual=True)
          + "SELECT model, avg(f1) AS cv_f1 FROM scores GROUP BY model ORDER BY cv_f1 DESC, model LIMIT 1",
          doubles=("cv_f1",))
def q_model_choice(spark, d):
    """The candidate with the best mean F1 over the folds (two cuts of one score)."""
    folds = SP.stratified_folds(_training_frame(spark, d), seed=SEED)
    scored = None
    for name, t in CANDIDATES.items():
        one = TR.predict(_fixed_model(), folds, t).withColumn("model", F.lit(name))
        scored = one if scored is None else scored.unionByName(one)
    hit, said, real = F.col("downtime_risk") * F.col("predicted_risk"), F.sum("predicted_risk"), F.sum("downtime_risk")
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.sum(hit), said + real), F.lit(0.0))
    return TR.choose(scored.groupBy("model", "fold").agg(f1.alias("f1")), tuple(CANDIDATES))


@register("model_scores",
          O.with_ctes() + f"SELECT record, machine_label, {', '.join(FEATS)}, round_even(risk_probability * 1e4, 0) / 1e4 "
          "AS risk_probability, predicted_risk, recommendation FROM scored", doubles=tuple(FEATS))
def q_model_scores(spark, d):
    """M9: the standard columns, the probability (at four decimals), the label and the band,
    and nothing else."""
    scored = SC.score(FX.fleet(spark, d).select("record", "machine_label", *FEATS), _fixed_model())
    return scored.withColumn("risk_probability", np_round("risk_probability", 4))


@register("predict_single",
          O.with_ctes() + "SELECT machine_label, predicted_risk, risk_probability FROM scored WHERE machine_label = 'MCH-0007' "
          "ORDER BY record LIMIT 1", doubles=("risk_probability",))
def q_predict_single(spark, d):
    """One machine's values, scored alone."""
    first = FX.fleet(spark, d).where("machine_label = 'MCH-0007'").orderBy("record").limit(1).first()
    if first is None:
        return spark.createDataFrame([], "machine_label string, predicted_risk int, risk_probability double")
    label, p = SC.predict_one(spark, _fixed_model(), {c: first[c] for c in FEATS})
    return spark.createDataFrame([(first["machine_label"], label, p)], "machine_label string, predicted_risk int, risk_probability double")


@register("train_select")
def q_train_select(spark, d):
    r = TR.train_and_select(_training_frame(spark, d), num_trees=NUM_TREES, seed=SEED)
    rows = [(r.model_name, k, float(v)) for k, v in r.metrics.items()]
    rows += [(r.model_name, f"cv_f1_{k}", float(v)) for k, v in r.cv_scores.items()]
    return spark.createDataFrame(rows, "model string, metric string, value double")


def _fitted(spark, d, kind: str):
    train, _ = SP.stratified_split(_training_frame(spark, d), seed=SEED)
    return TR.fit_candidate(kind, train, SEED, NUM_TREES)


@register("scenario_check")
def q_scenario_check(spark, d):
    """The three fixed machines, scored by a forest trained on the fleet."""
    return SC.scenario_check(spark, _fitted(spark, d, "rf"))


@register("logistic_properties",
          O.with_ctes(RANKED, SIDES, actual=True) + "SELECT count(*) FILTER (WHERE split = 'train') AS train_rows, 0.0 AS gradient, "
          "0.0 AS contribution_error, 0.0 AS reload_error FROM sides", doubles=("gradient", "contribution_error", "reload_error"))
def q_logistic_properties(spark, d):
    """The largest component of the gradient at a fitted model (intercept and
    every coefficient, with the penalty), the largest gap between its contributions' sum
    and its log-odds, and the largest change of a contribution after saving and loading; all
    0 at four decimals."""
    import uuid

    from riskengine.session import checkpoint_dir
    from riskengine.sources import store as ST

    train, _ = SP.stratified_split(_training_frame(spark, d), seed=SEED)
    model = TR.fit_candidate("lr", train, SEED)
    path = f"{checkpoint_dir(spark).rstrip('/')}/riskengine-model-{uuid.uuid4().hex}"
    ST.save_model(model, path)

    def explained(m, prefix):
        coef, intercept, med, mean, std = TR.linear_parts(m)
        return lambda df: X.linear_contributions(df, coef, intercept, mean, std, median=med, prefix=prefix)

    rows = TR.predict(model, SP.with_weights(train))
    rows = explained(model, "contrib_")(rows).withColumnRenamed("base", "base_odds")
    rows = explained(ST.load_model(path), "loaded_")(rows)
    p = F.col("risk_probability")
    logit = F.log(p / (F.lit(1.0) - p))
    told = F.col("base_odds") + sum((F.col(f"contrib_{c}") for c in FEATS), F.lit(0.0))
    moved = F.greatest(*[F.abs(F.col(f"contrib_{c}") - F.col(f"loaded_{c}")) for c in FEATS])
    finite = p.between(1e-9, 1 - 1e-9)
    slope = TR.logistic_gradient(rows, TR.linear_parts(model), 1.0 / max(train.count(), 1)).first()
    return rows.agg(
        F.count(F.lit(1)).alias("train_rows"),
        np_round(F.lit(max(map(abs, slope))), 4).alias("gradient"),
        np_round(F.max(F.when(finite, F.abs(logit - told))), 4).alias("contribution_error"),
        np_round(F.max(moved), 4).alias("reload_error"))


@register("forest_importance")
def q_forest_importance(spark, d):
    return X.importance(spark, _fitted(spark, d, "rf"))


@register("forest_contributions")
def q_forest_contributions(spark, d):
    """Every machine of the whole fleet explained per feature."""
    return X.contribution_table(X.forest_contributions(_training_frame(spark, d), _fitted(spark, d, "rf")))


@register("forest_fleet_impact")
def q_forest_fleet_impact(spark, d):
    """Mean |contribution| per feature over the seeded sample of 200 machines."""
    sample = W.seeded_sample(_training_frame(spark, d), n=200, seed=SEED)
    return X.fleet_contributions(X.forest_contributions(sample, _fitted(spark, d, "rf")))


@register("forest_local_accuracy",
          O.with_ctes() + "SELECT count(*) AS rows, 0.0 AS worst FROM scored", doubles=("worst",))
def q_forest_local_accuracy(spark, d):
    """Over the whole fleet, contributions and base add up to the forest's
    probability (the largest gap, at six decimals)."""
    model = _fitted(spark, d, "rf")
    told = X.forest_contributions(TR.predict(model, _training_frame(spark, d)), model)
    total = F.col("base") + sum((F.col(f"contrib_{c}") for c in FEATS), F.lit(0.0))
    return told.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(total - F.col("risk_probability"))).alias("worst"))


@register("model_linear_contributions")
def q_model_linear_contributions(spark, d):
    """M12 on a fitted logistic regression: exact contributions vs the all-zero background."""
    coef, intercept, med, mean, std = TR.linear_parts(_fitted(spark, d, "lr"))
    c = X.linear_contributions(_training_frame(spark, d), coef, intercept, mean, std, median=med)
    return X.contribution_table(c)


# ----------------------------------------- a forest of stated splits, counted on the fleet
FOREST_SPLITS = [
    ("vibration_level", 6.0, ("runtime_hours", 5200.0, None, None), ("machine_temperature", 88.5, None, None)),
    ("error_log_count", 2.5, ("vibration_level", 3.25, None, None), ("runtime_hours", 4100.0, None, None)),
    ("machine_temperature", 79.0, None, ("error_log_count", 0.5, None, ("vibration_level", 6.0, None, None)))]
USED = sorted({c for c in FEATS if any(f"'{c}'" in repr(t) for t in FOREST_SPLITS)}, key=FEATS.index)


def _forest_sql() -> list[str]:
    """The forest as tables: ``nodes`` (every split with the class counts of itself and its sides) and
    ``leaves`` (share over trees, and per used feature the interval and the product of covers)."""
    counts, nodes, leaves = [], [], []

    def walk(tree, i, path, bounds, covers):
        key = f"t{i}_{len(counts)}"
        condition = " AND ".join(path) or "TRUE"
        counts.extend(f"CAST(count(*) FILTER (WHERE {condition} AND downtime_risk = {y}) AS DOUBLE) AS {key}_{y}" for y in (0, 1))
        if tree is None:
            cells = ", ".join(f"CAST({lo!r} AS DOUBLE) AS lo{j}, CAST({hi!r} AS DOUBLE) AS hi{j}" for j, (lo, hi) in enumerate(bounds))
            shares = ", ".join(f"{' * '.join(covers[j]) or 'CAST(1.0 AS DOUBLE)'} AS c{j}" for j in range(len(USED)))
            leaves.append(f"SELECT coalesce({key}_1 / nullif({key}_0 + {key}_1, 0), 0) / {len(FOREST_SPLITS)} AS value, {cells}, {shares} FROM counts")
            return key
        f, cut, left, right = tree
        j = USED.index(f)
        ends = {}
        for side, sub in (("l", left), ("r", right)):
            lo, hi = bounds[j]
            part = (lo, min(hi, cut)) if side == "l" else (max(lo, cut), hi)
            child = f"t{i}_{len(counts)}"
            cover = f"coalesce(({child}_0 + {child}_1) / nullif({key}_0 + {key}_1, 0), 0.5)"
            ends[side] = walk(sub, i, [*path, f"{FR.prepared_sql(f)} {'<=' if side == 'l' else '>'} {cut!r}"],
                              [part if k == j else b for k, b in enumerate(bounds)],
                              [[*c, cover] if k == j else c for k, c in enumerate(covers)])
        nodes.append(f"SELECT {i} AS tree, '{f}' AS feature, {key}_0 AS n0, {key}_1 AS n1, " + ", ".join(
            f"{ends[s]}_{y} AS {s}{y}" for s in "lr" for y in (0, 1)) + " FROM counts")
        return key

    for i, tree in enumerate(FOREST_SPLITS):
        walk(tree, i, [], [(-1e300, 1e300)] * len(USED), [[] for _ in USED])
    return ["counts AS (SELECT " + ", ".join(counts) + " FROM actual)", "nodes AS (" + " UNION ALL ".join(nodes) + ")",
            "leaves AS (" + " UNION ALL ".join(leaves) + ")"]


def _holds(j: int, c: str) -> str:
    return f"{FR.prepared_sql(c)} > lo{j} AND {FR.prepared_sql(c)} <= hi{j}"


_TABLES = _forest_sql()
_HIT = " AND ".join(_holds(j, c) for j, c in enumerate(USED))


def _shapley_sql() -> list[str]:
    """Every coalition's value for every machine, and from them the contributions by definition."""
    from math import factorial

    m = len(USED)
    weight = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
    factors = " * ".join(f"CASE WHEN (s >> {j}) & 1 = 1 THEN CASE WHEN {_holds(j, c)} THEN 1.0 ELSE 0.0 END ELSE c{j} END"
                         for j, c in enumerate(USED))
    with_i = "CASE bit_count(s) " + " ".join(f"WHEN {k + 1} THEN {w!r}" for k, w in enumerate(weight)) + " END"
    without = "CASE bit_count(s) " + " ".join(f"WHEN {k} THEN {-w!r}" for k, w in enumerate(weight)) + " END"
    phi = ", ".join(f"sum(v * CASE WHEN (s >> {j}) & 1 = 1 THEN {with_i} ELSE {without} END) AS p_{c}" for j, c in enumerate(USED))
    long = " UNION ALL ".join(
        f"SELECT a.record, '{c}' AS feature, a.{c} AS input_value, {f'phi.p_{c}' if c in USED else 'CAST(0.0 AS DOUBLE)'} AS contribution "
        "FROM actual a JOIN phi USING (record)" for c in FEATS)
    return [f"worth AS (SELECT record, s, sum(value * {factors}) AS v FROM actual, leaves, range({2 ** m}) AS r(s) GROUP BY record, s)",
            f"phi AS (SELECT record, {phi} FROM worth GROUP BY record)", f"told AS ({long})"]


def _stated_forest(spark, d):
    return FR.model_of(spark, FR.counted(_training_frame(spark, d), FOREST_SPLITS))


@register("stated_forest_scores",
          O.with_ctes(*_TABLES, f"p AS (SELECT a.record, sum(value) AS risk_probability FROM actual a, leaves WHERE {_HIT} GROUP BY a.record)",
                      actual=True)
          + f"SELECT record, risk_probability, CAST(risk_probability >= 0.5 AS INTEGER) AS predicted_risk, "
          f"{O.recommendation_sql()} AS recommendation FROM p", doubles=("risk_probability",))
def q_stated_forest_scores(spark, d):
    """M6, M9: a forest of stated splits, its leaves counted on the fleet, scores the whole fleet."""
    scored = SC.score(_training_frame(spark, d), _stated_forest(spark, d))
    return scored.select("record", "risk_probability", "predicted_risk", "recommendation")


@register("stated_forest_sql",
          O.with_ctes(*_TABLES, actual=True) + f"SELECT a.record, sum(value) AS probability FROM actual a, leaves WHERE {_HIT} GROUP BY a.record",
          doubles=("probability",))
def q_stated_forest_sql(spark, d):
    """M9: the same forest compiled to one SQL expression."""
    trees = FR.trees_of(_stated_forest(spark, d))
    return _training_frame(spark, d).select("record", F.expr(FR.probability_sql(trees)).alias("probability"))


_GINI = "(1.0 - pow({a} / nullif({a} + {b}, 0), 2) - pow({b} / nullif({a} + {b}, 0), 2))"
_GAIN = " - ".join(f"coalesce(({a} + {b}) * {_GINI.format(a=a, b=b)}, 0)" for a, b in (("n0", "n1"), ("l0", "l1"), ("r0", "r1")))


@register("stated_forest_importance",
          O.with_ctes(*_TABLES, f"gains AS (SELECT tree, feature, sum({_GAIN}) AS g FROM nodes GROUP BY tree, feature)",
                      "shares AS (SELECT feature, g / sum(g) OVER (PARTITION BY tree) AS s FROM gains)",
                      "names AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in FEATS) + "]) AS feature)", actual=True)
          + "SELECT feature, round_even(coalesce(sum(s), 0) / (SELECT sum(s) FROM shares) * 100.0, 2) AS importance "
          "FROM names LEFT JOIN shares USING (feature) GROUP BY feature", doubles=("importance",))
def q_stated_forest_importance(spark, d):
    """Importances of the forest, from the class counts of its nodes."""
    return X.importance(spark, _stated_forest(spark, d))


_SCENES = ("scenes AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{name}', " + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in values) + ")" for name, values, _ in S.SCENARIOS)
    + ") AS s(machine, " + ", ".join(FEATS) + "))")


@register("stated_forest_scenarios",
          O.with_ctes(*_TABLES, _SCENES, f"p AS (SELECT machine, sum(value) AS p FROM scenes, leaves WHERE {_HIT} GROUP BY machine)", actual=True)
          + f"SELECT machine, CASE WHEN p >= 0.5 THEN '{S.STATUS_HIGH}' ELSE '{S.STATUS_LOW}' END AS prediction, "
          "printf('%.1f%%', p * 100.0) AS probability, CASE WHEN (machine LIKE 'HIGH%' AND p >= 0.5) OR (machine LIKE 'STABLE%' AND p < 0.5) "
          "THEN 'Pass' ELSE 'Review' END AS result FROM p")
def q_stated_forest_scenarios(spark, d):
    """The three fixed machines, scored by the forest counted on the fleet."""
    return SC.scenario_check(spark, _stated_forest(spark, d))


@register("stated_forest_contributions",
          O.with_ctes(*_TABLES, *_shapley_sql(), actual=True) + "SELECT record, feature, input_value, contribution, "
          f"CASE WHEN contribution > 0 THEN '{S.DIRECTION_UP}' ELSE '{S.DIRECTION_DOWN}' END AS direction FROM told",
          doubles=("input_value", "contribution"))
def q_stated_forest_contributions(spark, d):
    """Contributions of the whole fleet, against Shapley values by their definition."""
    return X.contribution_table(X.forest_contributions(_training_frame(spark, d), _stated_forest(spark, d)))


@register("stated_forest_impact",
          O.with_ctes(*_TABLES, *_shapley_sql(), actual=True)
          + "SELECT feature, avg(abs(contribution)) AS mean_abs_contribution FROM told GROUP BY feature", doubles=("mean_abs_contribution",))
def q_stated_forest_impact(spark, d):
    """Mean |contribution| per feature over the whole fleet."""
    return X.fleet_contributions(X.forest_contributions(_training_frame(spark, d), _stated_forest(spark, d)))
