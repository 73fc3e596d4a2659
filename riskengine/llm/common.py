"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskengine.session import checkpoint_dir

# A word of the contracts: a run of anything but space and the five ASCII controls
# that bytes.split() also splits at, so Python tasks may use either.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: later steps
    start from finished files instead of recomputing after a lost executor."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/riskengine-llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def with_result(df: DataFrame, **cols: Column) -> DataFrame:
    """Add result columns; an input column of the same name is replaced."""
    lower = {c.lower() for c in cols}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in lower]
    return df.select(*kept, *[v.alias(k) for k, v in cols.items()])


def power_of_two(n: float) -> int:
    """The smallest power of two that is at least ``n`` (1 for anything below)."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, n))))


def sample_ids(df: DataFrame, key: str, n: int) -> list:
    """At most ``n`` keys with the smallest hashes: a fixed, spread-out sample. Only
    the key column is read, and each task keeps ``n`` values at most."""
    rows = (df.select(F.col(key).alias("k")).where("k is not null").distinct()
            .orderBy(F.xxhash64("k"), "k").limit(n).collect())
    return [r["k"] for r in rows]


def sample_by(rows: DataFrame, group: str, key: str, n: int, spread: int = 64) -> list[tuple]:
    """(group, key): for each group at most ``n`` keys with the smallest hashes. Every task
    and every part of a group keeps ``n`` keys at most before a group's parts meet."""
    h = F.xxhash64("k")
    own = Window.partitionBy("g").orderBy("h", "k")
    part = Window.partitionBy("g", F.pmod("h", F.lit(spread))).orderBy("h", "k")
    keys = rows.select(F.col(group).alias("g"), F.col(key).alias("k")).where(
        F.col("g").isNotNull() & F.col("k").isNotNull()).withColumn("h", h)
    first = keys.withColumn("r", F.row_number().over(part)).where(F.col("r") <= n).select("g", "k", "h").distinct()
    found = first.withColumn("r", F.row_number().over(own)).where(F.col("r") <= n).select("g", "k").collect()
    return [(r["g"], r["k"]) for r in found]
