"""Fleet analytics over a scored frame (G1-G7, G12, G17-G20, J3, T1, T2, R4 batch).

Every aggregate is one ``agg`` (partial aggregation before the shuffle); grouped
outputs are bounded by the number of groups. 1-row statistics are lazy scalar
subqueries, never driver round trips or cross joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskengine import schema as S
from riskengine.functions.scalar import fixed1, parse_percent

PROB = "risk_probability"
PRED = "predicted_risk"


def kpi_aggs(prob: str = PROB, pred: str = PRED) -> list[Column]:
    total = F.count(F.lit(1))
    high = F.coalesce(F.sum(F.when(F.col(pred) == 1, 1).otherwise(0)), F.lit(0)).cast("long")
    return [
        total.alias("total_assets"),
        high.alias("high_risk_assets"),
        F.coalesce(F.avg(F.nanvl(F.col(prob).cast("double"), F.lit(None).cast("double"))) * F.lit(100.0),
                   F.lit(0.0)).alias("avg_risk"),
        (total - high).alias("monitored_stable"),
    ]


def kpis(df: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """G1 (no keys: one row, also for an empty frame) / G2 (per key)."""
    if by:
        return df.groupBy(*by).agg(*kpi_aggs())
    return df.agg(*kpi_aggs())


def dataset_comparison(df: DataFrame, by: str = "dataset") -> DataFrame:
    """Rows, high risk, average risk text ('12.3%') and stable per dataset."""
    k = kpis(df, [by])
    return k.select(
        F.col(by).alias("dataset"),
        F.col("total_assets").alias("rows"),
        F.col("high_risk_assets").alias("high_risk"),
        F.concat(fixed1(F.col("avg_risk")), F.lit("%")).alias("average_risk"),
        F.col("monitored_stable").alias("stable"),
    )


def riskiest_dataset(comparison: DataFrame) -> DataFrame:
    """The dataset with the highest 1-decimal average risk (ties: name), with advice."""
    c = comparison.withColumn("average_risk_numeric", parse_percent("average_risk"))
    top = c.orderBy(F.desc("average_risk_numeric"), F.asc("dataset")).limit(1)
    return top.select(
        "dataset",
        "average_risk_numeric",
        "high_risk",
        F.format_string(S.DATASET_ADVICE_FORMAT, F.col("dataset"), F.col("average_risk_numeric"),
                        F.col("high_risk")).alias("advice"),
    )


def accuracy(df: DataFrame, by: list[str] | tuple = (), actual: str = S.TARGET_COLUMN, pred: str = PRED) -> DataFrame:
    """Share of rows whose actual target equals the prediction."""
    a = F.avg((F.col(actual).cast("int") == F.col(pred).cast("int")).cast("double")).alias("accuracy")
    n = F.count(F.lit(1)).alias("rows")
    return df.groupBy(*by).agg(n, a) if by else df.agg(n, a)


def nice_width(lo: float, hi: float, nbins: int) -> float:
    """Smallest width of the form {1, 2, 2.5, 5} x 10^k giving at most ``nbins`` bins."""
    raw = (hi - lo) / nbins
    if raw <= 0:
        return 1.0
    exp = math.floor(math.log10(raw))
    for m in (1.0, 2.0, 2.5, 5.0, 10.0):
        w = m * 10 ** exp
        if w >= raw * (1 - 1e-12):
            return float(f"{w:.12g}")
    return float(10 ** (exp + 1))


LOWEST_BIN, HIGHEST_BIN = -(1 << 31), (1 << 31) - 1


def histogram(df: DataFrame, col: str = PROB, nbins: int = 30, lo: float = 0.0, hi: float = 1.0,
              width: float | None = None) -> DataFrame:
    """Equal-width bins; every non-missing value is counted. Empty bins between ``lo``
    and ``hi`` are kept, ``hi`` itself goes in the last of them, and values outside get
    bins of their own (negative below ``lo``). The outermost four numbers of an int are the bins
    of -infinity, of all values too far below or above for a number, and of infinity."""
    w = width or nice_width(lo, hi, nbins)
    k = int(math.ceil(round((hi - lo) / w, 9)))
    x = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    inf = F.lit(float("inf"))
    far = F.least(F.greatest((x - F.lit(lo)) / F.lit(w), F.lit(float(LOWEST_BIN + 1))), F.lit(float(HIGHEST_BIN - 1)))
    b = (F.when(x == F.lit(float(hi)), F.lit(k - 1)).when(x == inf, F.lit(HIGHEST_BIN)).when(x == -inf, F.lit(LOWEST_BIN))
         .otherwise(F.floor(far).cast("int")))
    counts = df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = df.sparkSession.range(0, k).select(F.col("id").cast("int").alias("bin"))
    bound = lambda at: (F.when(F.col("bin") == HIGHEST_BIN, inf).when(F.col("bin") == LOWEST_BIN, -inf)
                        .otherwise(F.lit(lo) + at * F.lit(w)))
    return spine.join(counts, "bin", "full_outer").select(
        "bin",
        bound(F.col("bin").cast("double")).alias("bin_start"),
        bound(F.col("bin").cast("double") + 1).alias("bin_end"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
    )


def correlation(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Full Pearson matrix as (x, y, corr) rows on pairwise-complete values.

    Two one-row aggregates over the input: first the columns' means and counts (a few
    numbers, put into the second as literals), then sums of the values less those means
    (the shift keeps the sums from cancelling) and of their products. Columns without missing
    values share their sums; only pairs with a column that has some need sums over the
    rows where both are present. Only partial sums are shuffled. A constant column gives NULL.
    """
    cols = cols or S.FEATURE_COLUMNS + [PROB]
    k = range(len(cols))
    none = F.lit(None).cast("double")
    rows = df.select(*[F.nanvl(F.col(c).cast("double"), none).alias(f"c{i}") for i, c in enumerate(cols)])
    first = rows.agg(F.count(F.lit(1)).alias("n"), *[e for i in k for e in (
        F.avg(f"c{i}").alias(f"m{i}"), F.count(f"c{i}").alias(f"n{i}"))]).first()
    rows = rows.select(*[(F.col(f"c{i}") - F.lit(first[f"m{i}"] or 0.0)).alias(f"c{i}") for i in k])
    full = [first[f"n{i}"] == first["n"] for i in k]
    c = [F.col(f"c{i}") for i in k]
    sums = [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c[i]).alias(f"s{i}") for i in k]]
    parts = []
    for i in k:
        for j in range(i, len(cols)):
            sums.append(F.sum(c[i] * c[j]).alias(f"p{i}_{j}"))
            named = {"n": "n", "sx": f"s{i}", "sy": f"s{j}", "xx": f"p{i}_{i}", "yy": f"p{j}_{j}"}
            if not (full[i] and full[j]):
                both = c[i].isNotNull() & c[j].isNotNull()
                for name, value in zip(named, (F.lit(1.0), c[i], c[j], c[i] * c[i], c[j] * c[j])):
                    named[name] = f"{name}{i}_{j}"
                    sums.append(F.sum(F.when(both, value)).alias(named[name]))
            parts.append(F.struct(F.lit(cols[i]).alias("x"), F.lit(cols[j]).alias("y"), F.col(f"p{i}_{j}").alias("xy"),
                                  *[F.col(v).alias(name) for name, v in named.items()]))
    long = rows.agg(*sums).select(F.inline(F.array(*parts)))
    n = F.col("n")
    vx, vy = F.col("xx") - F.col("sx") * F.col("sx") / n, F.col("yy") - F.col("sy") * F.col("sy") / n
    # A variance within rounding of the squares it comes from is a constant column.
    varied = (vx > F.col("xx") * F.lit(1e-14)) & (vy > F.col("yy") * F.lit(1e-14))
    r = F.when(F.col("x") == F.col("y"), F.lit(1.0)).otherwise(
        (F.col("xy") - F.col("sx") * F.col("sy") / n) / (F.sqrt(vx) * F.sqrt(vy)))
    value = F.when(varied, r).alias("corr")
    one, other = F.struct("x", "y", value), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), value)
    return long.select(F.inline(F.when(F.col("x") == F.col("y"), F.array(one)).otherwise(F.array(one, other))))


def machines(df: DataFrame, label: str = S.LABEL_COLUMN, order: str = "record") -> DataFrame:
    """Distinct machines (NULL shown as 'Unknown') with their first record."""
    lab = F.coalesce(F.col(label), F.lit("Unknown"))
    return df.groupBy(lab.alias("machine_label")).agg(F.min(order).alias("first_record"))


def top_risk(df: DataFrame, n: int = 10, prob: str = PROB, order: str = "record") -> DataFrame:
    """The n riskiest rows; earliest record wins ties, missing probabilities (NULL or
    NaN) last."""
    present = F.nanvl(F.col(prob).cast("double"), F.lit(None).cast("double"))
    return df.orderBy(present.desc_nulls_last(), F.col(order).asc()).limit(n)


def preview(df: DataFrame, n: int = 25, order: str = "record") -> DataFrame:
    """The first n rows in record order."""
    return df.orderBy(order).limit(n)


def machine_vs_fleet(df: DataFrame, machine: str, threshold: float = 0.5, prob: str = PROB,
                     label: str = S.LABEL_COLUMN, order: str = "record") -> DataFrame:
    """Selected machine's first reading vs fleet average vs alert threshold (3 rows)."""
    lab = F.coalesce(F.col(label), F.lit("Unknown"))
    # one scan: the smallest record's probability among the machine's rows, and the average
    one = df.agg(F.min_by(prob, F.when(lab == F.lit(machine), F.col(order))).alias("_first"), F.avg(prob).alias("_mean"))
    selected = F.coalesce("_first", F.lit(0.0))
    fleet = F.coalesce("_mean", F.lit(0.0))
    return one.select(
        F.inline(
            F.array(
                F.struct(F.lit(f"Selected: {machine}").alias("metric"), selected.alias("risk_probability")),
                F.struct(F.lit("Fleet average").alias("metric"), fleet.alias("risk_probability")),
                F.struct(F.lit("Alert threshold").alias("metric"), F.lit(float(threshold)).alias("risk_probability")),
            )
        )
    )


def failure_rate(df: DataFrame, key: str = S.LABEL_COLUMN, target: str = S.TARGET_COLUMN,
                 hours: str = "runtime_hours", per: float = 1000.0) -> DataFrame:
    """Failures per ``per`` operating hours, per machine (NULL if no hours)."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("readings"),
        F.sum(F.col(target)).cast("long").alias("failures"),
        F.sum(hours).alias("operating_hours"),
        (F.try_divide(F.sum(F.col(target)).cast("double"), F.sum(hours)) * F.lit(per)).alias("failure_rate"),
    )


def class_balance(df: DataFrame, target: str = S.TARGET_COLUMN) -> DataFrame:
    """Rows and share of each class (the window runs over one row per class)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))


def failures_by_window(df: DataFrame, ts: str = "ts", width: str = "1 day", target: str = S.TARGET_COLUMN) -> DataFrame:
    """Readings, failures and failure share per tumbling time window."""
    return df.groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("readings"),
        F.sum(F.col(target)).cast("long").alias("failures"),
        F.avg(F.col(target).cast("double")).alias("failure_share"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
             "readings", "failures", "failure_share")


def failures_by_shift(df: DataFrame, ts: str = "ts", hours_per_shift: int = 8, target: str = S.TARGET_COLUMN) -> DataFrame:
    """G20 (shift form): failures per shift of the day."""
    shift = F.floor(F.hour(ts) / F.lit(hours_per_shift)).cast("int")
    return df.groupBy(shift.alias("shift")).agg(
        F.count(F.lit(1)).alias("readings"), F.sum(F.col(target)).cast("long").alias("failures")
    )


def window_kpis(df: DataFrame, ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """R4 (batch form): fleet KPIs per tumbling event-time window."""
    return df.groupBy(F.window(ts, width).alias("w")).agg(*kpi_aggs()).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "total_assets", "high_risk_assets", "avg_risk", "monitored_stable",
    )
