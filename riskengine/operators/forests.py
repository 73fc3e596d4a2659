"""Forests stated by their splits, and small forests as SQL.

* ``counted``: the class counts of every node of stated splits, from one aggregate over the rows.
* ``model_of``: a counted forest as a fitted pipeline, which scores and explains like any other.
* ``trees_of`` and ``probability_sql``: a fitted forest as nested trees and as one expression of
  CASE terms that any SQL engine runs. For small forests: the nodes come to the driver, and
  more than ``MAX_NODES`` are refused.

A tree is ``(feature, threshold, left, right)``, left for values up to the threshold, or a leaf:
``None`` where counts are wanted, ``(rows of class 0, rows of class 1)`` where they are known.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskengine import schema as S
from riskengine.operators.growth import FittedForest
from riskengine.session import checkpoint_dir

MAX_NODES = 2000


def is_leaf(tree) -> bool:
    return tree is None or len(tree) == 2


def leaf_conditions(tree, value_sql, path: tuple[str, ...] = ()) -> list[str]:
    """SQL conditions of a tree's leaves, left to right."""
    if is_leaf(tree):
        return [" AND ".join(path) or "TRUE"]
    feature, threshold, left, right = tree
    test = f"{value_sql(feature)} {{}} CAST({threshold!r} AS DOUBLE)"
    return leaf_conditions(left, value_sql, (*path, test.format("<="))) + leaf_conditions(right, value_sql, (*path, test.format(">")))


def prepared_sql(feature: str) -> str:
    """A feature with its default where it is missing."""
    return f"coalesce({feature}, CAST({S.FEATURE_DEFAULTS[feature]!r} AS DOUBLE))"


def counted(df: DataFrame, splits: list, target: str = S.TARGET_COLUMN) -> list:
    """The trees of ``splits`` with the class counts of ``df``'s rows in their leaves."""
    sums, leaves = [], [leaf_conditions(t, prepared_sql) for t in splits]
    for i, conditions in enumerate(leaves):
        for j, c in enumerate(conditions):
            sums += [F.expr(f"count_if({c} AND {target} = {y})").alias(f"n{i}_{j}_{y}") for y in (0, 1)]
    found = df.agg(*sums).first()

    def filled(tree, i, numbers):
        if is_leaf(tree):
            j = next(numbers)
            return (found[f"n{i}_{j}_0"], found[f"n{i}_{j}_1"])
        return (*tree[:2], filled(tree[2], i, numbers), filled(tree[3], i, numbers))

    return [filled(t, i, iter(range(len(leaves[i])))) for i, t in enumerate(splits)]


def class_counts(tree) -> tuple[int, int]:
    if is_leaf(tree):
        return tree
    left, right = class_counts(tree[2]), class_counts(tree[3])
    return left[0] + right[0], left[1] + right[1]


def _gini(n) -> float:
    total = n[0] + n[1]
    return 1.0 - sum((k / total) ** 2 for k in n) if total else 0.0


def _gain(tree) -> float:
    whole, parts = class_counts(tree), [class_counts(t) for t in tree[2:]]
    total = sum(whole)
    return _gini(whole) - sum(sum(p) / total * _gini(p) for p in parts) if total else 0.0


def _nodes(tree, number: int, out: list):
    """Appends the tree's nodes (preorder) as (id, tree, left id, right id); returns the next id."""
    if is_leaf(tree):
        out.append((number, tree, -1, -1))
        return number + 1
    at = len(out)
    out.append(None)
    right = _nodes(tree[2], number + 1, out)
    after = _nodes(tree[3], right, out)
    out[at] = (number, tree, number + 1, right)
    return after


def model_of(spark: SparkSession, trees: list):
    """Counted trees over the raw features (missing ones take their defaults) as a pipeline model."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import RandomForestClassificationModel
    from riskengine.operators.split import with_weights
    from riskengine.operators.train import _pipeline

    # A pipeline of the same shape gives the stages, the format and the forest's metadata.
    one = [(f"m{i}", *[float(i)] * len(S.FEATURE_COLUMNS), i % 2) for i in range(4)]
    frame = spark.createDataFrame(one, "machine_label string, " + ", ".join(f"{c} double" for c in S.FEATURE_COLUMNS)
                                  + f", {S.TARGET_COLUMN} int")
    neutral = (4, dict(S.FEATURE_DEFAULTS), {c: 0.0 for c in S.FEATURE_COLUMNS}, {c: 1.0 for c in S.FEATURE_COLUMNS})
    shape = _pipeline("rf", *neutral, seed=1, num_trees=len(trees), max_depth=1).fit(with_weights(frame))
    path = f"{checkpoint_dir(spark).rstrip('/')}/forest-stated-{uuid.uuid4().hex}"
    shape.stages[-1].write().save(path)
    schema = spark.read.parquet(f"{path}/data").schema
    rows = []
    for i, tree in enumerate(trees):
        nodes: list = []
        _nodes(tree, 0, nodes)
        for number, t, left, right in nodes:
            n = class_counts(t)
            split = (-1, [], -1) if is_leaf(t) else (S.FEATURE_COLUMNS.index(t[0]), [float(t[1])], -1)
            data = {"id": number, "prediction": float(n[1] > n[0]), "impurity": _gini(n), "impurityStats": [float(n[0]), float(n[1])],
                    "rawCount": sum(n), "gain": -1.0 if is_leaf(t) else _gain(t), "leftChild": left, "rightChild": right,
                    "split": dict(zip(("featureIndex", "leftCategoriesOrThreshold", "numCategories"), split))}
            rows.append({"treeID": i, "nodeData": data})
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/data")
    return PipelineModel([*shape.stages[:-1], RandomForestClassificationModel.load(path)])


def trees_of(model, max_nodes: int = MAX_NODES) -> list:
    """A pipeline's forest as counted trees over its prepared features."""
    forest = model.stages[-1]
    total = forest.totalNumNodes
    if total > max_nodes:
        raise ValueError(f"{total} nodes: more than {max_nodes} are not put into one expression")
    if isinstance(forest, FittedForest):
        nodes = {(r["tree"], r["id"]): r for r in forest.nodes().collect()}

        def nested(t, i):
            r = nodes[t, i]
            if r["feature"] < 0:
                return (r["w0"], r["w1"])
            return S.FEATURE_COLUMNS[r["feature"]], r["threshold"], nested(t, 2 * i), nested(t, 2 * i + 1)

        return [nested(t, 1) for t in range(forest.getNumTrees)]

    def walked(node):
        if node.numDescendants() == 0:
            return tuple(float(v) for v in node.impurityStats().stats())
        split = node.split()
        return S.FEATURE_COLUMNS[split.featureIndex()], float(split.threshold()), walked(node.leftChild()), walked(node.rightChild())

    return [walked(t._call_java("rootNode")) for t in forest.trees]


def probability_sql(trees: list, value_sql=prepared_sql) -> str:
    """The forest's probability of class 1: the mean over trees of the leaf's share."""
    def case(tree) -> str:
        if is_leaf(tree):
            total = tree[0] + tree[1]
            return f"CAST({(tree[1] / total if total else 0.0)!r} AS DOUBLE)"
        return f"CASE WHEN {value_sql(tree[0])} <= CAST({tree[1]!r} AS DOUBLE) THEN {case(tree[2])} ELSE {case(tree[3])} END"

    return "(" + " + ".join(case(t) for t in trees) + f") / {len(trees)}"


def prepared_by(model):
    """``value_sql`` of a fitted pipeline: imputed, centred and scaled as its first stage does it."""
    from riskengine.operators.train import prep_parts

    med, mean, std = prep_parts(model)
    return lambda c: (f"((coalesce({c}, CAST({med[c]!r} AS DOUBLE)) - CAST({mean[c]!r} AS DOUBLE)) / CAST({std[c]!r} AS DOUBLE))")
