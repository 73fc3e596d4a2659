"""Stratified train/test split and folds (M1, M2) and balanced class weights.

A row's side is decided by a hash of its key and the seed: the rows of a class in hash
order, the first share of them in the test part (or in fold 0, and so on). The exact cut of
a class is found without ordering the class in one task: a histogram of the hash's leading
bits gives the bin of each cut, and only that bin's rows are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskengine import schema as S
from riskengine.operators.indexing import uniform_of

HASH_BITS = 52
BIN_BITS = 16


def _cuts(hashed: DataFrame, label: str, shares: list[float]) -> DataFrame:
    """(label, cuts): for each class the last [hash, key] of every leading share of its
    rows, the share rounded up to whole rows. ``hashed`` has _u and _key."""
    binned = hashed.select(F.col(label).alias("_class"), "_u", "_key",
                           F.shiftright("_u", HASH_BITS - BIN_BITS).alias("_bin"))
    hist = binned.groupBy("_class", "_bin").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("_class")
    upto = F.sum("n").over(own.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    hist = hist.withColumn("total", F.sum("n").over(own)).withColumn("upto", upto)
    each = hist.select("_class", "_bin", "n", "upto", "total", F.posexplode(
        F.array(*[F.lit(float(s)) for s in shares])).alias("i", "share"))
    place = F.ceil(F.col("share") * F.col("total"))
    cut_bins = each.withColumn("place", place).where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place")))
    cut_bins = cut_bins.select(F.col("_class").alias("_c"), F.col("_bin").alias("_b"), "i", (F.col("place") - F.col("upto") + F.col("n")).alias("rank"))
    inside = binned.join(F.broadcast(cut_bins), F.col("_class").eqNullSafe(F.col("_c")) & (F.col("_bin") == F.col("_b")))
    order = Window.partitionBy("_c", "i").orderBy("_u", "_key")
    chosen = inside.withColumn("r", F.row_number().over(order)).where(F.col("r") == F.col("rank"))
    return chosen.groupBy("_c").agg(F.sort_array(F.collect_list(F.struct("_u", "_key"))).alias("_cuts"))


def _placed(df: DataFrame, label: str, key: str, shares: list[float], seed: int) -> DataFrame:
    """``df`` with _part: how many of the class's cuts lie before the row."""
    hashed = df.withColumn("_u", uniform_of(key, seed)).withColumn("_key", F.col(key))
    # One row per class: joined by class, the rows of a class would meet in one task.
    joined = hashed.join(F.broadcast(_cuts(hashed, label, shares)), F.col(label).eqNullSafe(F.col("_c")), "left")
    own = F.struct("_u", "_key")
    part = F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: c < own))
    return joined.withColumn("_part", part).drop("_u", "_key", "_c", "_cuts")


def split_column(df: DataFrame, label: str = S.TARGET_COLUMN, key: str = "record", test: float = 0.2,
                 seed: int = 42) -> DataFrame:
    """M1 as a column: split = 'train' | 'test'. Rows without a class are a class."""
    placed = _placed(df, label, key, [test], seed)
    return placed.withColumn("split", F.when(F.col("_part") == 0, "test").otherwise("train")).drop("_part")


def stratified_split(df: DataFrame, label: str = S.TARGET_COLUMN, key: str = "record", test: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M1: (train, test) with ``test`` share of each class in the test part."""
    placed = split_column(df, label, key, test, seed)
    return placed.where("split = 'train'").drop("split"), placed.where("split = 'test'").drop("split")


def stratified_folds(df: DataFrame, label: str = S.TARGET_COLUMN, key: str = "record", k: int = 5,
                     seed: int = 42, out: str = "fold") -> DataFrame:
    """M2: fold number 0..k-1, balanced per class (k - 1 cuts per class)."""
    placed = _placed(df, label, key, [i / k for i in range(1, k)], seed)
    return placed.withColumn(out, F.col("_part").cast("int")).drop("_part")


def balanced_weights(df: DataFrame, label: str = S.TARGET_COLUMN) -> DataFrame:
    """(label, rows, weight = n / (classes * n_c)); windows run over one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    everything = Window.partitionBy()
    return counts.withColumn(
        "weight", F.sum("rows").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("rows"))
    )


def with_weights(df: DataFrame, label: str = S.TARGET_COLUMN, out: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class (one row per class is broadcast; rows stay where they are)."""
    w = balanced_weights(df, label).select(F.col(label).alias("_class"), F.col("weight").alias(out))
    return df.join(F.broadcast(w), F.col(label).eqNullSafe(F.col("_class"))).drop("_class")
