"""Feature engineering named in the workflow (E1-E6) and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskengine import schema as S
from riskengine.operators.indexing import exact_quantiles, quantile_lookup


def engineer(df: DataFrame) -> DataFrame:
    """E1 stress_index, E2 overload_flag, E3 age_risk (runtime / fleet max, lazy scalar)."""
    max_rt = df.select(F.max("runtime_hours")).scalar()
    return (
        df.withColumn("stress_index", (F.col("machine_temperature") / F.lit(120.0)) * (F.col("vibration_level") / F.lit(15.0)))
        .withColumn("overload_flag", (F.col("load_percentage") > F.lit(85.0)).cast("int"))
        .withColumn("age_risk", F.try_divide(F.col("runtime_hours"), max_rt))
    )


def cap_outliers(df: DataFrame, cols: list[str] | None = None, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Clip each column to its [lo, hi] quantiles (linear interpolation)."""
    cols = cols or S.FEATURE_COLUMNS
    get = quantile_lookup(exact_quantiles(df, cols, [lo, hi]))
    return df.withColumns({c: F.least(F.greatest(F.col(c), get(c, lo)), get(c, hi)) for c in cols})


def category_name(col: str, value) -> str:
    """E5: the column of a category. NULL is ``<col>_null``; a text that reads ``null`` behind any
    number of backslashes gets one more, so no two categories share a name."""
    text = "null" if value is None else str(value)
    escaped = value is not None and text.lstrip("\\") == "null"
    return f"{col}_" + "\\" * escaped + text


def one_hot(df: DataFrame, col: str, values: list) -> DataFrame:
    """E5: one 0/1 column per given category (NULL is a category like any other)."""
    return df.withColumns({category_name(col, v): F.col(col).eqNullSafe(F.lit(v)).cast("int") for v in values})


def one_hot_long(df: DataFrame, col: str, key: str = "record") -> DataFrame:
    """E5 for any number of categories: (key, category, 1), the entries that are not 0; names as
    ``category_name`` gives them."""
    text = F.col(col).cast("string")
    name = F.when(text.isNull(), "null").when(text.rlike(r"^\\*null\z"), F.concat(F.lit("\\"), text)).otherwise(text)
    return df.select(key, F.concat(F.lit(f"{col}_"), name).alias("category"), F.lit(1).alias("value"))


def impute_median(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NULL -> the column's median over the non-NULL values."""
    cols = cols or S.FEATURE_COLUMNS
    get = quantile_lookup(exact_quantiles(df, cols, [0.5]))
    return df.withColumns({c: F.coalesce(F.col(c), get(c, 0.5)) for c in cols})


def medians(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(feature, median)."""
    cols = cols or S.FEATURE_COLUMNS
    return exact_quantiles(df, cols, [0.5]).select(F.col("column").alias("feature"),
                                                                   F.col("value").alias("median"))


def scaling_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(feature, mean, std) with the population std; zero std -> 1 (one scan)."""
    cols = cols or S.FEATURE_COLUMNS
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
    wide = df.agg(*aggs)
    entries = ", ".join(f"'{c}', m{i}, CASE WHEN s{i} = 0 THEN 1.0D ELSE s{i} END" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {entries}) as (feature, mean, std)")


def dedup(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop duplicate rows (map-side partial aggregation before the shuffle)."""
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()
