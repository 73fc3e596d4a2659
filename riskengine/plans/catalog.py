"""Registered queries: a Spark DataFrame query and its DuckDB oracle per operator.

Every query reads whole test tables (``events`` through the fleet views, plus
``lineitem`` for the second dataset). Float columns listed in ``doubles`` are
rounded to 6 decimals on both sides (sum order and ``exp`` differ in the last bits).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine import schema as S
from riskengine.functions import advise as A
from riskengine.functions.scalar import clip, np_round, parse_percent, percent_text
from riskengine.operators import analytics as G
from riskengine.operators import explain as X
from riskengine.operators import features as E
from riskengine.operators import indexing as W
from riskengine.operators import score as SC
from riskengine.operators import split as SP
from riskengine.operators import standardize as P
from riskengine.operators import train as TR
from riskengine.plans import oracle_sql as O
from riskengine.sources import fixtures as FX
from riskengine.sources import store as ST

FEATS = S.FEATURE_COLUMNS


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: tuple[str, ...] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.fn(spark, sf_dir)
        for c in self.doubles:
            # round half to even on the binary value: the same IEEE steps as the oracle
            df = df.withColumn(c, F.rint(F.col(c) * F.lit(1e6)) / F.lit(1e6))
        return df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.doubles:
            return self.sql
        repl = ", ".join(f"round_even(\"{c}\" * 1e6, 0) / 1e6 AS \"{c}\"" for c in self.doubles)
        return f"SELECT * REPLACE ({repl}) FROM (\n{self.sql}\n) q"


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, doubles: tuple[str, ...] = ()):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, tuple(doubles))
        return fn
    return deco


KPI_SQL = (
    "count(*) AS total_assets, "
    "CAST(coalesce(sum(CASE WHEN predicted_risk = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS high_risk_assets, "
    "coalesce(avg(risk_probability) * 100.0, 0.0) AS avg_risk, "
    "count(*) - CAST(coalesce(sum(CASE WHEN predicted_risk = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS monitored_stable"
)
FEAT_LIST = ", ".join(FEATS)


# ----------------------------------------------------------------- KPIs and datasets
@register("machine_kpis", O.with_ctes() + f"SELECT machine_label, {KPI_SQL} FROM scored GROUP BY machine_label",
          doubles=("avg_risk",))
def q_machine_kpis(spark, d):
    return G.kpis(FX.fleet_scored(spark, d), ["machine_label"])


@register("fleet_kpis", O.with_ctes() + f"SELECT {KPI_SQL} FROM scored", doubles=("avg_risk",))
def q_fleet_kpis(spark, d):
    return G.kpis(FX.fleet_scored(spark, d))


COMPARISON_SQL = (
    "SELECT dataset, count(*) AS rows, "
    "CAST(coalesce(sum(CASE WHEN predicted_risk = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS high_risk, "
    "printf('%.1f%%', coalesce(avg(risk_probability) * 100.0, 0.0)) AS average_risk, "
    "count(*) - CAST(coalesce(sum(CASE WHEN predicted_risk = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS stable "
    "FROM scored GROUP BY dataset"
)


@register("dataset_comparison", O.with_ctes() + COMPARISON_SQL)
def q_dataset_comparison(spark, d):
    return G.dataset_comparison(FX.fleet_scored(spark, d))


_ADVICE = S.DATASET_ADVICE_FORMAT.replace("'", "''")


@register(
    "riskiest_dataset",
    O.with_ctes(f"comp AS ({COMPARISON_SQL})")
    + "SELECT dataset, TRY_CAST(rtrim(average_risk, '%') AS DOUBLE) AS average_risk_numeric, high_risk, "
    f"printf('{_ADVICE}', dataset, TRY_CAST(rtrim(average_risk, '%') AS DOUBLE), high_risk) AS advice "
    "FROM comp ORDER BY average_risk_numeric DESC, dataset LIMIT 1",
    doubles=("average_risk_numeric",),
)
def q_riskiest_dataset(spark, d):
    return G.riskiest_dataset(G.dataset_comparison(FX.fleet_scored(spark, d)))


@register(
    "target_accuracy",
    O.with_ctes(actual=True) + "SELECT dataset, count(*) AS rows, "
    "avg(CAST(CAST(downtime_risk AS INTEGER) = CAST(predicted_risk AS INTEGER) AS DOUBLE)) AS accuracy "
    "FROM actual GROUP BY dataset",
    doubles=("accuracy",),
)
def q_target_accuracy(spark, d):
    return G.accuracy(FX.fleet_actual(spark, d), ["dataset"])


@register(
    "risk_histogram",
    O.with_ctes(
        "bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(0, 20))",
        "cnt AS (SELECT CAST(least(floor((risk_probability - 0.0) / CAST(0.05 AS DOUBLE)), 19) AS INTEGER) AS bin, "
        "count(*) AS c FROM scored WHERE risk_probability IS NOT NULL GROUP BY 1)",
    )
    + "SELECT bins.bin, 0.0 + bins.bin * CAST(0.05 AS DOUBLE) AS bin_start, "
    "0.0 + (bins.bin + 1) * CAST(0.05 AS DOUBLE) AS bin_end, CAST(coalesce(c, 0) AS BIGINT) AS count "
    "FROM bins LEFT JOIN cnt ON bins.bin = cnt.bin",
    doubles=("bin_start", "bin_end"),
)
def q_risk_histogram(spark, d):
    return G.histogram(FX.fleet_scored(spark, d), nbins=30)


@register(
    "score_histogram",
    O.with_ctes("cnt AS (SELECT CAST(floor(risk_score / 2.0) AS INTEGER) AS bin, count(*) AS c FROM scored GROUP BY 1)")
    + "SELECT coalesce(b.range, cnt.bin) AS bin, coalesce(b.range, cnt.bin) * 2.0 AS bin_start, "
    "(coalesce(b.range, cnt.bin) + 1) * 2.0 AS bin_end, CAST(coalesce(c, 0) AS BIGINT) AS count "
    "FROM range(0, 5) b FULL JOIN cnt ON b.range = cnt.bin",
    doubles=("bin_start", "bin_end"),
)
def q_score_histogram(spark, d):
    """G5 where most values lie outside [lo, hi]: all of them are counted."""
    return G.histogram(FX.fleet_scored(spark, d), "risk_score", lo=0.0, hi=10.0, width=2.0)


def _corr_sql() -> str:
    cols = FEATS + ["risk_probability"]
    aggs, names = [], {}
    for i, a in enumerate(cols):
        for b in cols[i:]:
            n = f"c{len(aggs)}"
            if a == b:
                aggs.append(f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END AS {n}")
            else:
                aggs.append(
                    f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END AS {n}"
                )
            names[(a, b)] = names[(b, a)] = n
    body = O.with_ctes(f"w AS (SELECT {', '.join(aggs)} FROM scored)")
    sel = " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, CAST({names[(a, b)]} AS DOUBLE) AS corr FROM w" for a in cols for b in cols
    )
    return body + sel


@register("sensor_correlation", _corr_sql(), doubles=("corr",))
def q_sensor_correlation(spark, d):
    return G.correlation(FX.fleet_scored(spark, d))


@register(
    "distinct_machines",
    O.with_ctes() + "SELECT coalesce(machine_label, 'Unknown') AS machine_label, min(record) AS first_record "
    "FROM scored GROUP BY 1",
)
def q_distinct_machines(spark, d):
    return G.machines(FX.fleet_scored(spark, d))


# ----------------------------------------------------------------- statistics
def _union_feats(tmpl: str) -> str:
    return " UNION ALL ".join(tmpl.format(c=c) for c in FEATS)


@register(
    "feature_medians",
    O.with_ctes() + _union_feats("SELECT '{c}' AS feature, median({c}) AS median FROM fleet"),
    doubles=("median",),
)
def q_feature_medians(spark, d):
    return E.medians(FX.fleet(spark, d))


@register(
    "feature_scaling",
    O.with_ctes() + _union_feats(
        "SELECT '{c}' AS feature, avg({c}) AS mean, "
        "CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS std FROM fleet"
    ),
    doubles=("mean", "std"),
)
def q_feature_scaling(spark, d):
    return E.scaling_stats(FX.fleet(spark, d))


@register(
    "class_weights",
    O.with_ctes(actual=True) + "SELECT downtime_risk, rows, "
    "CAST(sum(rows) OVER () AS DOUBLE) / (count(*) OVER () * rows) AS weight "
    "FROM (SELECT downtime_risk, count(*) AS rows FROM actual GROUP BY downtime_risk) c",
    doubles=("weight",),
)
def q_class_weights(spark, d):
    return SP.balanced_weights(FX.fleet_actual(spark, d))


def _ratio_sql(src: str) -> str:
    return (
        "SELECT *, "
        "coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0.0) AS accuracy, "
        "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision, "
        "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall, "
        "coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0.0) AS f1 "
        f"FROM ({src}) r"
    )


COUNTS_SQL = (
    "SELECT count(*) FILTER (WHERE downtime_risk = 1 AND predicted_risk = 1) AS tp, "
    "count(*) FILTER (WHERE downtime_risk = 0 AND predicted_risk = 1) AS fp, "
    "count(*) FILTER (WHERE downtime_risk = 1 AND predicted_risk = 0) AS fn, "
    "count(*) FILTER (WHERE downtime_risk = 0 AND predicted_risk = 0) AS tn FROM actual"
)


@register("classification_metrics", O.with_ctes(actual=True) + _ratio_sql(COUNTS_SQL),
          doubles=("accuracy", "precision", "recall", "f1"))
def q_classification_metrics(spark, d):
    return TR.classification_metrics(FX.fleet_actual(spark, d))


@register(
    "confusion_matrix",
    O.with_ctes(actual=True) + "SELECT a.actual, a.predicted, "
    "count(x.record) AS rows FROM (VALUES (1, 1), (0, 1), (1, 0), (0, 0)) a(actual, predicted) "
    "LEFT JOIN actual x ON x.downtime_risk = a.actual AND x.predicted_risk = a.predicted GROUP BY 1, 2",
)
def q_confusion_matrix(spark, d):
    return TR.confusion(FX.fleet_actual(spark, d))


SWEEP = [round(0.05 * i, 2) for i in range(1, 20)]


@register(
    "threshold_sweep",
    O.with_ctes(
        "t AS (SELECT CAST(unnest([" + ", ".join(repr(t) for t in SWEEP) + "]) AS DOUBLE) AS threshold)",
        actual=True,
    )
    + _ratio_sql(
        "SELECT t.threshold, "
        "count(*) FILTER (WHERE a.downtime_risk = 1 AND a.risk_probability >= t.threshold) AS tp, "
        "count(*) FILTER (WHERE a.downtime_risk = 0 AND a.risk_probability >= t.threshold) AS fp, "
        "count(*) FILTER (WHERE a.downtime_risk = 1 AND a.risk_probability < t.threshold) AS fn, "
        "count(*) FILTER (WHERE a.downtime_risk = 0 AND a.risk_probability < t.threshold) AS tn "
        "FROM t, actual a GROUP BY t.threshold"
    ),
    doubles=("threshold", "accuracy", "precision", "recall", "f1"),
)
def q_threshold_sweep(spark, d):
    return TR.threshold_sweep(FX.fleet_actual(spark, d), SWEEP)


@register(
    "quantile_label",
    O.with_ctes() + "SELECT record, CAST(risk_probability > "
    f"(SELECT quantile_cont(risk_probability, {S.SYNTHETIC_QUANTILE!r}) FROM scored) AS INTEGER) AS quantile_label "
    "FROM scored",
)
def q_quantile_label(spark, d):
    return SC.quantile_label(FX.fleet_scored(spark, d)).select("record", "quantile_label")


@register(
    "failure_rate",
    O.with_ctes(actual=True) + "SELECT machine_label, count(*) AS readings, "
    "CAST(sum(downtime_risk) AS BIGINT) AS failures, sum(runtime_hours) AS operating_hours, "
    "CAST(sum(downtime_risk) AS DOUBLE) / nullif(sum(runtime_hours), 0) * 1000.0 AS failure_rate "
    "FROM actual GROUP BY machine_label",
    doubles=("operating_hours", "failure_rate"),
)
def q_failure_rate(spark, d):
    return G.failure_rate(FX.fleet_actual(spark, d))


@register(
    "class_balance",
    O.with_ctes(actual=True) + "SELECT downtime_risk, rows, CAST(rows AS DOUBLE) / sum(rows) OVER () AS share "
    "FROM (SELECT downtime_risk, count(*) AS rows FROM actual GROUP BY downtime_risk) c",
    doubles=("share",),
)
def q_class_balance(spark, d):
    return G.class_balance(FX.fleet_actual(spark, d))


DOWNTIME_COST = 5000.0
INSPECTION_COST = 400.0


@register(
    "savings",
    O.with_ctes(actual=True) + f"SELECT tp, fp, tp * {DOWNTIME_COST!r} AS prevented_cost, "
    f"fp * {INSPECTION_COST!r} AS false_alarm_cost, "
    f"tp * {DOWNTIME_COST!r} - fp * {INSPECTION_COST!r} AS savings FROM ({COUNTS_SQL}) c",
    doubles=("prevented_cost", "false_alarm_cost", "savings"),
)
def q_savings(spark, d):
    return TR.savings(FX.fleet_actual(spark, d), DOWNTIME_COST, INSPECTION_COST)


@register(
    "failures_by_window",
    O.with_ctes(actual=True) + "SELECT date_trunc('day', ts) AS window_start, "
    "date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS readings, "
    "CAST(sum(downtime_risk) AS BIGINT) AS failures, avg(CAST(downtime_risk AS DOUBLE)) AS failure_share "
    "FROM actual GROUP BY 1, 2",
    doubles=("failure_share",),
)
def q_failures_by_window(spark, d):
    return G.failures_by_window(FX.fleet_actual(spark, d), width="1 day")


@register(
    "failures_by_shift",
    O.with_ctes(actual=True) + "SELECT CAST(floor(hour(ts) / 8) AS INTEGER) AS shift, count(*) AS readings, "
    "CAST(sum(downtime_risk) AS BIGINT) AS failures FROM actual GROUP BY 1",
)
def q_failures_by_shift(spark, d):
    return G.failures_by_shift(FX.fleet_actual(spark, d))


@register(
    "hourly_kpis",
    O.with_ctes() + "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR "
    f"AS window_end, {KPI_SQL} FROM scored GROUP BY 1, 2",
    doubles=("avg_risk",),
)
def q_hourly_kpis(spark, d):
    return G.window_kpis(FX.fleet_scored(spark, d), width="1 hour")


# ----------------------------------------------------------------- windows and order
@register(
    "row_index",
    O.with_ctes() + "SELECT record, row_number() OVER (ORDER BY machine_label, ts, record) - 1 AS row_index FROM fleet",
)
def q_row_index(spark, d):
    f = FX.fleet(spark, d)
    return W.with_index(f, ["machine_label", "ts", "record"], out="row_index").select("record", "row_index")


@register(
    "rolling_risk",
    O.with_ctes() + "SELECT record, avg(risk_probability) OVER (ORDER BY record ROWS BETWEEN 29 PRECEDING "
    "AND CURRENT ROW) AS rolling_average FROM scored",
    doubles=("rolling_average",),
)
def q_rolling_risk(spark, d):
    # record (= event_id) is dense from 0: the halo buckets apply directly
    s = FX.fleet_scored(spark, d).select("record", "risk_probability")
    return W.rolling_mean(s, "risk_probability", 30, bucket=2048).select("record", "rolling_average")


@register(
    "machine_rolling_risk",
    O.with_ctes() + "SELECT record, machine_label, avg(risk_probability) OVER (PARTITION BY machine_label "
    "ORDER BY ts, record ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS rolling_average FROM scored",
    doubles=("rolling_average",),
)
def q_machine_rolling_risk(spark, d):
    s = FX.fleet_scored(spark, d).select("record", "ts", "machine_label", "risk_probability")
    return W.rolling_mean_by(s, "machine_label", "ts", "risk_probability", 30, bucket=2048).select(
        "record", "machine_label", "rolling_average")


@register(
    "threshold_crossings",
    O.with_ctes(
        "l AS (SELECT record, machine_label, ts, risk_probability, lag(risk_probability) OVER "
        "(PARTITION BY machine_label ORDER BY ts, record) AS prev FROM scored)"
    )
    + "SELECT record, machine_label, ts, risk_probability, CASE WHEN risk_probability >= 0.5 THEN 'rising' "
    "ELSE 'falling' END AS crossing FROM l WHERE (risk_probability >= 0.5) <> (coalesce(prev, -1.0) >= 0.5)",
    doubles=("risk_probability",),
)
def q_threshold_crossings(spark, d):
    from riskengine.streaming.stream import crossings

    s = FX.fleet_scored(spark, d).select("record", "machine_label", "ts", "risk_probability")
    return crossings(s, 0.5, bucket=2048)


@register(
    "top_risk",
    O.with_ctes() + "SELECT record, machine_label, risk_probability FROM scored "
    "ORDER BY risk_probability DESC NULLS LAST, record LIMIT 10",
    doubles=("risk_probability",),
)
def q_top_risk(spark, d):
    return G.top_risk(FX.fleet_scored(spark, d)).select("record", "machine_label", "risk_probability")


PREVIEW_COLS = ["record", "machine_label", *FEATS, "risk_probability", "predicted_risk", "recommendation"]


@register(
    "preview",
    O.with_ctes() + f"SELECT {', '.join(PREVIEW_COLS)} FROM scored ORDER BY record LIMIT 25",
    doubles=("risk_probability",),
)
def q_preview(spark, d):
    return G.preview(FX.fleet_scored(spark, d)).select(*PREVIEW_COLS)


@register(
    "machine_vs_fleet",
    O.with_ctes()
    + "SELECT 'Selected: MCH-0007' AS metric, coalesce((SELECT risk_probability FROM scored WHERE "
    "coalesce(machine_label, 'Unknown') = 'MCH-0007' ORDER BY record LIMIT 1), 0.0) AS risk_probability "
    "UNION ALL SELECT 'Fleet average', coalesce((SELECT avg(risk_probability) FROM scored), 0.0) "
    "UNION ALL SELECT 'Alert threshold', 0.5",
    doubles=("risk_probability",),
)
def q_machine_vs_fleet(spark, d):
    return G.machine_vs_fleet(FX.fleet_scored(spark, d), "MCH-0007", 0.5)


@register(
    "rolling_with_gaps",
    O.with_ctes("kept AS (SELECT record, CASE WHEN record % 5 <> 0 THEN risk_probability END AS p FROM scored WHERE record % 3 <> 0)")
    + "SELECT record, avg(p) OVER (ORDER BY record ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS rolling_average FROM kept",
    doubles=("rolling_average",),
)
def q_rolling_with_gaps(spark, d):
    """W2 over an index with gaps and NaN scores."""
    s = FX.fleet_scored(spark, d).where("record % 3 <> 0").select(
        "record", F.when(F.col("record") % 5 != 0, F.col("risk_probability")).otherwise(F.lit(float("nan"))).alias("p"))
    return W.rolling_mean(s, "p", 30, bucket=2048).select("record", "rolling_average")


@register(
    "top_risk_missing",
    O.with_ctes() + "SELECT record, machine_label FROM scored WHERE record % 4 <> 0 "
    "ORDER BY risk_probability DESC, record LIMIT 10",
)
def q_top_risk_missing(spark, d):
    """T1 with NaN scores, which rank last."""
    s = FX.fleet_scored(spark, d)
    p = F.when(F.col("record") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("risk_probability"))
    return G.top_risk(s.withColumn("risk_probability", p)).select("record", "machine_label")


# ----------------------------------------------------------------- scalar functions
@register(
    "percent_ties",
    O.with_ctes() + "SELECT record, printf('%.1f%%', CAST(record AS DOUBLE) / 1600.0 * 100.0) AS sixteenths, "
    "printf('%.1f%%', CAST(record % 2000 AS DOUBLE) / 2000.0 * 100.0) AS halves FROM fleet",
)
def q_percent_ties(spark, d):
    """X10 on exact binary halves and on decimal halves that are none in binary."""
    rec = F.col("record").cast("double")
    return FX.fleet(spark, d).select("record", percent_text(rec / F.lit(1600.0)).alias("sixteenths"),
                                     percent_text((F.col("record") % 2000).cast("double") / F.lit(2000.0)).alias("halves"))


@register(
    "scalar_functions",
    O.with_ctes()
    + "SELECT record, greatest(least(vibration_level, 10.0), 1.0) AS clipped_vibration, "
    "round_even(load_percentage * 10.0, 0) / 10.0 AS rounded_load, "
    "abs(machine_temperature - 75.0) AS abs_temp_delta, "
    f"greatest({FEAT_LIST}) AS row_max, "
    "coalesce(nullif(CASE WHEN error_log_count > 0 THEN dataset ELSE '' END, ''), 'none') AS error_source, "
    "lower(replace(trim(machine_label), '-', '_')) AS label_key, "
    "regexp_extract(machine_label, '^([A-Z]+)', 1) AS label_stem, "
    "contains(dataset, 'err') AS is_error_event, "
    "printf('MCH-%04d', record % 10000) AS padded_label, "
    "printf('%.1f%%', risk_probability * 100.0) AS risk_text, "
    "TRY_CAST(rtrim(printf('%.1f%%', risk_probability * 100.0), '%') AS DOUBLE) AS risk_text_value "
    "FROM scored",
    doubles=("clipped_vibration", "rounded_load", "abs_temp_delta", "row_max", "risk_text_value"),
)
def q_scalar_functions(spark, d):
    s = FX.fleet_scored(spark, d)
    return s.select(
        "record",
        clip("vibration_level", 1.0, 10.0).alias("clipped_vibration"),
        np_round("load_percentage", 1).alias("rounded_load"),
        F.abs(F.col("machine_temperature") - F.lit(75.0)).alias("abs_temp_delta"),
        F.greatest(*[F.col(c) for c in FEATS]).alias("row_max"),
        F.coalesce(F.nullif(F.when(F.col("error_log_count") > 0, F.col("dataset")).otherwise(F.lit("")), F.lit("")),
                   F.lit("none")).alias("error_source"),
        F.lower(F.replace(F.trim("machine_label"), F.lit("-"), F.lit("_"))).alias("label_key"),
        F.regexp_extract("machine_label", r"^([A-Z]+)", 1).alias("label_stem"),
        F.col("dataset").contains("err").alias("is_error_event"),
        F.format_string("MCH-%04d", F.col("record") % 10000).alias("padded_label"),
        percent_text("risk_probability").alias("risk_text"),
        parse_percent(percent_text("risk_probability")).alias("risk_text_value"),
    )


@register(
    "linear_score",
    O.with_ctes() + "SELECT record, risk_score, risk_probability FROM scored",
    doubles=("risk_score", "risk_probability"),
)
def q_linear_score(spark, d):
    return FX.fleet_scored(spark, d).select("record", "risk_score", "risk_probability")


# ----------------------------------------------------------------- advice
@register(
    "risk_bands",
    O.with_ctes()
    + "SELECT record, recommendation, "
    "CASE WHEN risk_probability >= 0.5 THEN 'IMMEDIATE' WHEN risk_probability >= 0.3 THEN '48-HOUR' "
    "ELSE 'NORMAL' END AS urgency, "
    f"CASE WHEN risk_probability >= 0.5 THEN '{S.URGENCY_BANDS[0][1]}' "
    f"WHEN risk_probability >= 0.3 THEN '{S.URGENCY_BANDS[1][1]}' ELSE '{S.URGENCY_BANDS[2][1]}' END AS action, "
    f"CASE WHEN predicted_risk = 1 THEN '{S.TEXT_IMMEDIATE}' ELSE '{S.TEXT_NORMAL}' END AS recommendation_binary "
    "FROM scored",
)
def q_risk_bands(spark, d):
    s = FX.fleet_scored(spark, d)
    band, action = A.urgency()
    return s.select("record", "recommendation", band.alias("urgency"), action.alias("action"),
                    A.recommendation_binary().alias("recommendation_binary"))


def _drivers_sql() -> str:
    arr = ", ".join(f"CASE WHEN {c} >= {t!r} THEN '{txt}' END" for c, t, txt in S.DRIVER_RULES)
    kept = f"list_filter([{arr}], lambda x: x IS NOT NULL)[1:3]"
    return f"CASE WHEN len({kept}) = 0 THEN '{S.DRIVER_FALLBACK}' ELSE array_to_string({kept}, '; ') END"


@register(
    "driver_summary",
    O.with_ctes()
    + f"SELECT record, CASE WHEN predicted_risk = 1 THEN '{S.STATUS_HIGH}' ELSE '{S.STATUS_LOW}' END AS status, "
    f"printf('{S.SUMMARY_FORMAT}', printf('%.1f%%', risk_probability * 100.0), {_drivers_sql()}, "
    f"CASE WHEN predicted_risk = 1 THEN '{S.ACTION_HIGH}' ELSE '{S.ACTION_LOW}' END) AS summary FROM scored",
)
def q_driver_summary(spark, d):
    s = FX.fleet_scored(spark, d)
    return s.select("record", A.status_text().alias("status"), A.driver_summary().alias("summary"))


# ----------------------------------------------------------------- standardisation
def _std_sql(src: str, label: str, sources: dict, target: str | None, flags: list[str] | None = None,
             bearing_from: str | None = None, bearing_all_missing_sql: str | None = None) -> str:
    cols = ["record", f"nullif(CAST(\"{label}\" AS VARCHAR), '') AS machine_label"]
    for f in FEATS:
        s = sources.get(f)
        parsed = O.to_number_sql(f'"{s}"') if s else "CAST(NULL AS DOUBLE)"
        if f == "bearing_temperature" and bearing_from:
            derived = f"({O.to_number_sql(chr(34) + bearing_from + chr(34))} + 6.0)"
            if s is None:
                parsed = derived
            else:
                parsed = f"(CASE WHEN {bearing_all_missing_sql} THEN {derived} ELSE {parsed} END)"
        cols.append(f"CAST(coalesce({parsed}, CAST({S.FEATURE_DEFAULTS[f]!r} AS DOUBLE)) AS DOUBLE) AS {f}")
    if target:
        cols.append(f"{O.to_int_target_sql(chr(34) + target + chr(34))} AS downtime_risk")
    elif flags:
        parts = [f"coalesce({O.to_number_sql(chr(34) + c + chr(34))}, 0.0)" for c in flags]
        cols.append(f"CAST(trunc(greatest({', '.join(parts)})) AS INTEGER) AS downtime_risk")
    else:
        cols.append("0 AS downtime_risk")
    return "SELECT " + ",\n  ".join(cols) + f" FROM {src}"


MESSY_SOURCES = dict(zip(FEATS, FX.MESSY_NAMES))
_BEARING_NAME = MESSY_SOURCES["bearing_temperature"]
_MACHINE_NAME = MESSY_SOURCES["machine_temperature"]
STD_DOUBLES = tuple(FEATS)


@register(
    "standardize",
    O.with_ctes(O.messy_cte(), actual=True)
    + _std_sql("messy", "Product ID", MESSY_SOURCES, "Machine failure", bearing_from=_MACHINE_NAME,
               bearing_all_missing_sql=f"(SELECT count({O.to_number_sql(chr(34) + _BEARING_NAME + chr(34))}) FROM messy) = 0"),
    doubles=STD_DOUBLES,
)
def q_standardize(spark, d):
    return P.standardize(FX.fleet_messy(spark, d), keep=["record"])


@register(
    "bearing_fallback",
    O.with_ctes(O.messy_cte(bearing_missing=True).replace("messy AS", "messy_nb AS"), actual=True)
    + "SELECT record, bearing_temperature, machine_temperature FROM ("
    + _std_sql("messy_nb", "Product ID", MESSY_SOURCES, "Machine failure", bearing_from=_MACHINE_NAME,
               bearing_all_missing_sql=f"(SELECT count({O.to_number_sql(chr(34) + _BEARING_NAME + chr(34))}) FROM messy_nb) = 0")
    + ") s",
    doubles=("bearing_temperature", "machine_temperature"),
)
def q_bearing_fallback(spark, d):
    return P.standardize(FX.fleet_messy(spark, d, bearing_missing=True), keep=["record"]).select(
        "record", "bearing_temperature", "machine_temperature")


MAPPING = {
    "machine_temperature": "Process temperature [K]",
    "bearing_temperature": None,
    "vibration_level": "Rotational speed [rpm]",
    "pressure": None,
    "runtime_hours": "Tool wear [min]",
    "load_percentage": "utilization",
    "maintenance_delay_days": None,
    "error_log_count": "fault_count",
}


@register(
    "standardize_mapped",
    O.with_ctes(O.messy_cte(), actual=True)
    + _std_sql("messy", "UDI", MAPPING, "Machine failure", bearing_from=_MACHINE_NAME),
    doubles=STD_DOUBLES,
)
def q_standardize_mapped(spark, d):
    return P.standardize_mapped(FX.fleet_messy(spark, d), MAPPING, target="Machine failure", label="UDI",
                                keep=["record"])


FLAG_SQL = (
    "flags AS (SELECT record, machine_label AS machine_id, "
    + FEAT_LIST
    + ", CASE WHEN downtime_risk = 1 AND error_log_count > 0 THEN '1' ELSE '0' END AS \"TWF\", "
    "CASE WHEN downtime_risk = 1 AND record % 3 = 0 THEN '1' ELSE '0' END AS \"HDF\", "
    "CASE WHEN record % 5 = 0 THEN 'na' WHEN downtime_risk = 1 AND record % 2 = 0 THEN '1' ELSE '0' END AS \"PWF\", "
    "'0' AS \"OSF\", CASE WHEN record % 97 = 0 THEN '1' ELSE '0' END AS rnf FROM actual)"
)


@register(
    "failure_flags",
    O.with_ctes(FLAG_SQL, actual=True)
    + "SELECT record, machine_label, downtime_risk FROM ("
    + _std_sql("flags", "machine_id", {f: f for f in FEATS}, None, flags=["TWF", "HDF", "PWF", "OSF"])
    + ") s",
)
def q_failure_flags(spark, d):
    return P.standardize(FX.fleet_flags(spark, d), keep=["record"]).select("record", "machine_label", "downtime_risk")


@register(
    "boolean_targets",
    O.with_ctes(actual=True) + "SELECT record, downtime_risk AS typed, downtime_risk AS words, "
    "CAST(downtime_risk = 1 AND record % 2 = 0 AS INTEGER) AS flags FROM actual",
)
def q_boolean_targets(spark, d):
    """A boolean target, the words True and False, and boolean failure flags."""
    a = FX.fleet_actual(spark, d).withColumn("failed", F.col("downtime_risk") == 1).drop("downtime_risk")
    typed = P.standardize(a.withColumnRenamed("failed", "machine failure"), keep=["record"])
    words = P.standardize(a.withColumn("target", F.initcap(F.col("failed").cast("string"))).drop("failed"), keep=["record"])
    flags = P.standardize(a.withColumn("HDF", F.col("failed") & (F.col("record") % 2 == 0)).drop("failed"), keep=["record"])
    out = typed.select("record", F.col("downtime_risk").alias("typed"))
    out = out.join(words.select("record", F.col("downtime_risk").alias("words")), "record")
    return out.join(flags.select("record", F.col("downtime_risk").alias("flags")), "record")


@register("guessed_mapping", O.with_ctes() + f"SELECT record, machine_label, {FEAT_LIST}, 0 AS downtime_risk FROM fleet",
          doubles=STD_DOUBLES)
def q_guessed_mapping(spark, d):
    """Columns that contain a feature's name, mapped by guess, on a checked input."""
    f = FX.fleet(spark, d)
    named = P.validate(f.select("record", F.col("machine_label").alias("Machine"),
                                *[F.col(c).alias(f"avg {c.replace('_', ' ')} (24h)") for c in FEATS]))
    return P.standardize_mapped(named, P.guess_mapping(named.columns), label="Machine", keep=["record"])


@register("positional_labels",
          O.with_ctes() + "SELECT record, printf('MCH-%04d', record + 1) AS machine_label FROM fleet")
def q_positional_labels(spark, d):
    """Machines without a label column are numbered by position."""
    f = FX.fleet(spark, d).select("record", *FEATS)
    return P.standardize(f, order_by="record", keep=["record"]).select("record", "machine_label")


@register(
    "dedup",
    O.with_ctes(actual=True)
    + f"SELECT DISTINCT machine_label, {FEAT_LIST}, downtime_risk FROM "
    f"(SELECT machine_label, {FEAT_LIST}, downtime_risk FROM actual UNION ALL "
    f"SELECT machine_label, {FEAT_LIST}, downtime_risk FROM actual) u",
    doubles=STD_DOUBLES,
)
def q_dedup(spark, d):
    a = FX.fleet_actual(spark, d).select("machine_label", *FEATS, "downtime_risk")
    return E.dedup(a.unionByName(a))


LINEITEM_MAPPING = {
    "machine_temperature": "temp_c",
    "vibration_level": "vibration mm/s",
    "load_percentage": "load pct",
    "error_log_count": "alarms",
}


def _lineitem_sql() -> str:
    li = (
        "li AS (SELECT printf('SUP-%d', l_suppkey) AS supplier, l_tax * 500.0 + 60.0 AS temp_c, "
        "l_discount * 100.0 AS vib, l_quantity * 2.0 AS load_pct, l_linenumber AS alarms FROM lineitem)"
    )
    std = (
        "li_std AS (SELECT 'lineitem' AS dataset, supplier AS machine_label, "
        f"coalesce(temp_c, {S.FEATURE_DEFAULTS['machine_temperature']!r}) AS machine_temperature, "
        f"{S.FEATURE_DEFAULTS['bearing_temperature']!r} AS bearing_temperature, "
        f"coalesce(vib, {S.FEATURE_DEFAULTS['vibration_level']!r}) AS vibration_level, "
        f"{S.FEATURE_DEFAULTS['pressure']!r} AS pressure, {S.FEATURE_DEFAULTS['runtime_hours']!r} AS runtime_hours, "
        f"coalesce(load_pct, {S.FEATURE_DEFAULTS['load_percentage']!r}) AS load_percentage, "
        f"{S.FEATURE_DEFAULTS['maintenance_delay_days']!r} AS maintenance_delay_days, "
        f"coalesce(CAST(alarms AS DOUBLE), {S.FEATURE_DEFAULTS['error_log_count']!r}) AS error_log_count FROM li)"
    )
    return li + ",\n" + std


@register(
    "union_datasets",
    O.with_ctes(
        _lineitem_sql(),
        f"u0 AS (SELECT 'events' AS dataset, machine_label, {FEAT_LIST} FROM fleet UNION ALL "
        f"SELECT dataset, machine_label, {FEAT_LIST} FROM li_std)",
        f"u1 AS (SELECT *, {O.risk_score_sql()} AS risk_score FROM u0)",
        f"u2 AS (SELECT *, 1.0 / (1.0 + exp(-(risk_score - {FX.FLEET_OFFSET!r}) / {FX.FLEET_SCALE!r})) AS risk_probability FROM u1)",
        "u AS (SELECT *, CAST(risk_probability >= 0.5 AS INTEGER) AS predicted_risk FROM u2)",
    )
    + f"SELECT dataset, {KPI_SQL} FROM u GROUP BY dataset",
    doubles=("avg_risk",),
)
def q_union_datasets(spark, d):
    ev = P.standardize(FX.fleet(spark, d)).withColumn("dataset", F.lit("events"))
    li = P.standardize_mapped(FX.lineitem_fleet(spark, d), LINEITEM_MAPPING, label="supplier").withColumn(
        "dataset", F.lit("lineitem"))
    u = ev.unionByName(li)
    scored = SC.label_and_recommend(SC.linear_score(u, offset=FX.FLEET_OFFSET, scale=FX.FLEET_SCALE))
    return G.kpis(scored, ["dataset"])


# ----------------------------------------------------------------- feature engineering
@register(
    "engineered_features",
    O.with_ctes()
    + "SELECT record, (machine_temperature / 120.0) * (vibration_level / 15.0) AS stress_index, "
    "CAST(load_percentage > 85.0 AS INTEGER) AS overload_flag, "
    "runtime_hours / nullif((SELECT max(runtime_hours) FROM fleet), 0) AS age_risk FROM fleet",
    doubles=("stress_index", "age_risk"),
)
def q_engineered_features(spark, d):
    return E.engineer(FX.fleet(spark, d)).select("record", "stress_index", "overload_flag", "age_risk")


@register(
    "outlier_cap",
    O.with_ctes(
        "q AS (SELECT " + ", ".join(
            f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in FEATS
        ) + " FROM fleet)"
    )
    + "SELECT record, " + ", ".join(f"least(greatest({c}, lo_{c}), hi_{c}) AS {c}" for c in FEATS)
    + " FROM fleet, q",
    doubles=STD_DOUBLES,
)
def q_outlier_cap(spark, d):
    return E.cap_outliers(FX.fleet(spark, d)).select("record", *FEATS)


ONE_HOT_VALUES = ["click", "error", "purchase", "signup", "view"]


@register(
    "one_hot",
    O.with_ctes() + "SELECT record, " + ", ".join(
        f"CASE WHEN dataset = '{v}' THEN 1 ELSE 0 END AS dataset_{v}" for v in ONE_HOT_VALUES
    ) + " FROM fleet",
)
def q_one_hot(spark, d):
    f = FX.fleet(spark, d)
    return E.one_hot(f, "dataset", ONE_HOT_VALUES).select("record", *[f"dataset_{v}" for v in ONE_HOT_VALUES])


@register("one_hot_long", O.with_ctes() + "SELECT record, 'machine_label_' || machine_label AS category, 1 AS value FROM fleet")
def q_one_hot_long(spark, d):
    """E5 in long form: one entry per row, whatever the number of categories."""
    return E.one_hot_long(FX.fleet(spark, d), "machine_label")


def _messy_parsed_sql() -> str:
    return "parsed AS (SELECT record, " + ", ".join(
        f"{O.to_number_sql(chr(34) + n + chr(34))} AS {f}" for f, n in zip(FEATS, FX.MESSY_NAMES)
    ) + " FROM messy)"


@register(
    "impute_median",
    O.with_ctes(O.messy_cte(), _messy_parsed_sql(),
                "m AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in FEATS) + " FROM parsed)",
                actual=True)
    + "SELECT record, " + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in FEATS) + " FROM parsed, m",
    doubles=STD_DOUBLES,
)
def q_impute_median(spark, d):
    from riskengine.functions.scalar import to_number

    m = FX.fleet_messy(spark, d)
    parsed = m.select("record", *[to_number(F.col(f"`{n}`")).alias(f) for f, n in zip(FEATS, FX.MESSY_NAMES)])
    return E.impute_median(parsed)


# ----------------------------------------------------------------- explanations (linear)
_COEF, _INTERCEPT = X.fixture_linear_model(FX.FLEET_OFFSET, FX.FLEET_SCALE)


def _contrib_long_sql() -> str:
    parts = []
    for c in FEATS:
        w = _COEF[c]
        contrib = f"CAST({w!r} AS DOUBLE) * (({c} - 0.0) / 1.0 - 0.0)"
        parts.append(
            f"SELECT record, '{c}' AS feature, CAST({c} AS DOUBLE) AS input_value, {contrib} AS contribution, "
            f"CASE WHEN {contrib} > 0 THEN '{S.DIRECTION_UP}' ELSE '{S.DIRECTION_DOWN}' END AS direction FROM fleet"
        )
    return " UNION ALL ".join(parts)


@register(
    "linear_contributions",
    O.with_ctes() + _contrib_long_sql(),
    doubles=("input_value", "contribution"),
)
def q_linear_contributions(spark, d):
    c = X.linear_contributions(FX.fleet(spark, d), _COEF, _INTERCEPT)
    return X.contribution_table(c)


@register(
    "fleet_contributions",
    O.with_ctes(f"lc AS ({_contrib_long_sql()})")
    + "SELECT feature, round_even(avg(abs(contribution)) * 1e4, 0) / 1e4 AS mean_abs_contribution FROM lc GROUP BY feature",
)
def q_fleet_contributions(spark, d):
    # sums of doubles differ in their last bits with the order of rows: four decimals
    means = X.fleet_contributions(X.linear_contributions(FX.fleet(spark, d), _COEF, _INTERCEPT))
    return means.withColumn("mean_abs_contribution", np_round("mean_abs_contribution", 4))


# ----------------------------------------------------------------- run store
_RUNS = (
    "preds AS (SELECT s.record AS id, printf('run-%d', s.user_id % 7) AS run_id, s.machine_label, "
    "s.predicted_risk, s.risk_probability, s.recommendation, " + ", ".join(f"s.{c}" for c in FEATS)
    + ", CAST(s.ts AS TIMESTAMP) AS created_at FROM scored s)",
    "runs AS (SELECT run_id, 'fleet-' || run_id AS source_name, count(*) AS record_count, "
    "coalesce(avg(risk_probability), 0.0) AS average_risk FROM preds WHERE run_id <> 'run-6' GROUP BY run_id)",
)


@register(
    "recent_predictions",
    O.with_ctes(*_RUNS)
    + "SELECT " + ", ".join(ST.RECENT_COLUMNS) + " FROM preds WHERE run_id IN (SELECT run_id FROM runs) "
    "ORDER BY created_at DESC, id DESC LIMIT 25",
    doubles=("risk_probability",),
)
def q_recent_predictions(spark, d):
    runs, preds = FX.fleet_runs(spark, d)
    # created_at as a zone-free timestamp so the result does not depend on the session zone
    return ST.recent(preds, runs, 25).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@register(
    "runs_join",
    O.with_ctes(*_RUNS)
    + "SELECT p.id, p.run_id, r.source_name, p.risk_probability, r.average_risk AS run_average_risk, "
    "r.record_count AS run_records FROM preds p JOIN runs r ON p.run_id = r.run_id",
    doubles=("risk_probability", "run_average_risk"),
)
def q_runs_join(spark, d):
    runs, preds = FX.fleet_runs(spark, d)
    return ST.runs_join(preds, runs).select("id", "run_id", "source_name", "risk_probability",
                                            "run_average_risk", "run_records")


@register(
    "orphan_predictions",
    O.with_ctes(*_RUNS)
    + "SELECT id, run_id FROM preds p WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.run_id = p.run_id)",
)
def q_orphan_predictions(spark, d):
    runs, preds = FX.fleet_runs(spark, d)
    return ST.orphans(preds, runs).select("id", "run_id")


@register(
    "machine_membership",
    O.with_ctes(actual=True)
    + "SELECT record, machine_label FROM actual WHERE downtime_risk = 1 AND machine_label IN "
    "(SELECT machine_label FROM scored WHERE predicted_risk = 1 AND dataset = 'error')",
)
def q_machine_membership(spark, d):
    a = FX.fleet_actual(spark, d)
    flagged = P.high_risk(FX.fleet_scored(spark, d)).filter(F.col("dataset") == "error")
    return P.in_fleet(a.filter(F.col("downtime_risk") == 1), flagged).select("record", "machine_label")


@register(
    "machine_first_reading",
    O.with_ctes()
    + "SELECT coalesce(machine_label, 'Unknown') AS machine, record, risk_probability, predicted_risk, "
    "CASE WHEN predicted_risk = 1 THEN 'HIGH RISK' ELSE 'STABLE' END AS status FROM scored "
    "WHERE coalesce(machine_label, 'Unknown') = 'MCH-0042' ORDER BY record LIMIT 1",
    doubles=("risk_probability",),
)
def q_machine_first_reading(spark, d):
    first = P.filter_machine(FX.fleet_scored(spark, d), "MCH-0042")
    return first.select(P.display_label().alias("machine"), "record", "risk_probability", "predicted_risk",
                        A.status_text().alias("status"))


@register(
    "csv_roundtrip",
    O.with_ctes() + f"SELECT record, machine_label, {FEAT_LIST}, 0 AS downtime_risk FROM fleet",
    doubles=STD_DOUBLES,
)
def q_csv_roundtrip(spark, d):
    """S15 -> S1 -> S4: the fleet written as CSV to the shared folder, read back by
    the flexible reader (sniffed separator and header) and standardised."""
    import uuid

    from riskengine.session import checkpoint_dir
    from riskengine.sources.ingest import read_flexible_csv

    path = f"{checkpoint_dir(spark).rstrip('/')}/riskengine-csv-{uuid.uuid4().hex}"
    ST.write_csv(FX.fleet(spark, d), path, ["record", "machine_label", *FEATS])
    raw = read_flexible_csv(spark, path)
    std = P.standardize(raw.withColumn("record", F.col("record").cast("long")), keep=["record"])
    return std



def _messy_lines(f):
    """The fleet as text lines: ';' between fields, a comment with separators and quotes,
    every seventh line cut short and, after the lines the header is sniffed from, every
    eleventh with fields too many."""
    comment = F.concat(F.lit('"hot; loud, ""'), F.col("dataset"), F.lit('"" no '), F.col("record").cast("string"), F.lit('"'))
    fields = [F.col("record").cast("string"), F.col("machine_label"), comment,
              *[F.col(c).cast("string") for c in FEATS[:3]]]
    line = F.concat_ws(";", *fields)
    short = F.concat_ws(";", *fields[:4])
    return f.select("record", F.when(
        (F.col("record") % 11 == 0) & (F.col("record") >= 600), F.concat(line, F.lit(";9;9"))).when(
        F.col("record") % 7 == 0, short).otherwise(line).alias("line"))


@register(
    "csv_messy",
    O.with_ctes() + "SELECT record, machine_label, 'hot; loud, \"' || dataset || '\" no ' || record AS comment, "
    f"machine_temperature, CASE WHEN record % 7 <> 0 THEN vibration_level ELSE {S.FEATURE_DEFAULTS['vibration_level']!r} END "
    "AS vibration_level "
    "FROM fleet WHERE record % 11 <> 0 OR record < 600 UNION ALL "
    f"SELECT NULL, 'exported by plant;A', NULL, {S.FEATURE_DEFAULTS['machine_temperature']!r}, {S.FEATURE_DEFAULTS['vibration_level']!r}",
    doubles=("machine_temperature", "vibration_level"),
)
def q_csv_messy(spark, d):
    """A preamble, ';', quoted separators and quotes, short and long rows, a data row
    equal to a preamble line, in several files that each have their own preamble."""
    import uuid

    from riskengine.session import checkpoint_dir
    from riskengine.sources.ingest import read_flexible_csv

    path = f"{checkpoint_dir(spark).rstrip('/')}/riskengine-csv-{uuid.uuid4().hex}"
    head = ["exported by plant", "site notes", "record;machine id;comment;machine temperature;bearing temperature;vibration"]
    rows = _messy_lines(FX.fleet(spark, d)).withColumn("part", F.col("record") % 3)
    lines = spark.createDataFrame([(p, -9 + i, h) for p in range(3) for i, h in enumerate(head)] + [
        (1, 10 ** 15, "exported by plant")], "part long, record long, line string")
    ordered = rows.select("part", "record", "line").unionByName(lines)
    ordered.repartition(3, "part").sortWithinPartitions("part", "record").select("line", "part").write.partitionBy("part").text(path)
    raw = read_flexible_csv(spark, path)
    std = P.standardize(raw, keep=["record", "comment"])
    extra = F.when(F.col("record") == "exported by plant", F.lit("exported by plant;A"))
    return std.select(F.col("record").try_cast("long").alias("record"), F.coalesce(extra, "machine_label").alias("machine_label"),
                      "comment", "machine_temperature", "vibration_level")


@register(
    "csv_multiline",
    O.with_ctes() + "SELECT row_number() OVER (ORDER BY record) - 1 AS record, machine_label, "
    "'hot' || chr(10) || chr(10) || '\"' || dataset || '\",' || chr(10) || record AS comment, machine_temperature, vibration_level "
    "FROM fleet WHERE record % 11 <> 0 OR record < 600",
    doubles=("machine_temperature", "vibration_level"),
)
def q_csv_multiline(spark, d):
    """Records whose quoted field holds line breaks, an empty line, separators and quotes,
    records with fields too many among them, in several files, numbered by position."""
    import uuid

    from riskengine.session import checkpoint_dir
    from riskengine.sources.ingest import read_flexible_csv

    path = f"{checkpoint_dir(spark).rstrip('/')}/riskengine-csv-{uuid.uuid4().hex}"
    fleet, kept = FX.fleet(spark, d), ["machine_temperature", "vibration_level"]
    comment = F.concat(F.lit('"hot\n\n""'), F.col("dataset"), F.lit('"",\n'), F.col("record").cast("string"), F.lit('"'))
    line = F.concat_ws(",", F.col("machine_label"), comment, *[F.col(c).cast("string") for c in kept])
    long = (F.col("record") % 11 == 0) & (F.col("record") >= 600)
    part = F.format_string("%08d", F.floor(F.col("record") / 4000))
    rows = fleet.select(part.alias("part"), "record", F.when(long, F.concat(line, F.lit(",9,9"))).otherwise(line).alias("line"))
    head = F.lit(",".join(["machine id", "comment", *kept]))
    heads = rows.select("part").distinct().select("part", F.lit(-1).cast("long").alias("record"), head.alias("line"))
    (rows.unionByName(heads).repartition("part").sortWithinPartitions("part", "record")
     .select("line", "part").write.partitionBy("part").text(path))
    raw = read_flexible_csv(spark, path, multiline=True)
    numbered = W.with_index(raw, ["_pos"], out="record")
    return P.standardize(numbered, order_by="record", keep=["record", "comment"]).select(
        "record", "machine_label", "comment", "machine_temperature", "vibration_level")


@register(
    "csv_many",
    O.with_ctes() + f"SELECT 'first' AS dataset, record, printf('MCH-%04d', record + 1) AS machine_label, {FEAT_LIST}, "
    f"0 AS downtime_risk FROM fleet UNION ALL SELECT 'second', record, printf('MCH-%04d', record + 1), {FEAT_LIST}, 0 FROM fleet",
    doubles=STD_DOUBLES,
)
def q_csv_many(spark, d):
    """Two sources of several files each read through ``read_many``, machines numbered by position."""
    import uuid

    from riskengine.session import checkpoint_dir
    from riskengine.sources.ingest import read_many

    base = f"{checkpoint_dir(spark).rstrip('/')}/riskengine-csv-{uuid.uuid4().hex}"
    for name in ("first", "second"):
        ST.write_csv(FX.fleet(spark, d).repartitionByRange("record").sortWithinPartitions("record"), f"{base}/{name}", list(FEATS))
    return read_many(spark, {n: f"{base}/{n}" for n in ("first", "second")})


# ----------------------------------------------------------------- streams
def _run_stream(spark, sdf) -> DataFrame:
    """Run a streaming query over everything available into a Parquet file sink in
    the shared folder and return what it wrote (no memory sink: nothing is gathered
    on the driver)."""
    import uuid

    from riskengine.session import checkpoint_dir

    base = f"{checkpoint_dir(spark).rstrip('/')}/riskengine-stream-{uuid.uuid4().hex}"
    q = (sdf.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/checkpoint").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(sdf.schema).parquet(f"{base}/out")


def _run_updates(spark, sdf, keys: list[str]) -> DataFrame:
    """Run an aggregated stream over everything available and return each key's last state."""
    import uuid

    from riskengine.session import checkpoint_dir
    from riskengine.streaming.stream import latest, upsert_stream

    base = f"{checkpoint_dir(spark).rstrip('/')}/riskengine-stream-{uuid.uuid4().hex}"
    q = upsert_stream(sdf, f"{base}/out", f"{base}/checkpoint", keys)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return latest(spark, f"{base}/out", keys, sdf.schema)


@register(
    "stream_scores",
    O.with_ctes() + "SELECT record, machine_label, risk_probability, predicted_risk, recommendation FROM scored",
    doubles=("risk_probability",),
)
def q_stream_scores(spark, d):
    """The events file read as a stream, standardised and scored per micro-batch."""
    from riskengine.streaming.stream import score_stream

    sdf = FX.fleet_from_events(FX.events_stream(spark, d))
    scored = score_stream(sdf, keep=("record",), offset=FX.FLEET_OFFSET, scale=FX.FLEET_SCALE)
    return _run_stream(spark, scored.select("record", "machine_label", "risk_probability", "predicted_risk",
                                            "recommendation"))


@register("stream_crossings", REGISTRY["threshold_crossings"].sql, doubles=("risk_probability",))
def q_stream_crossings(spark, d):
    """R2 (stream): settled crossings and open slices of every machine; equals the batch form."""
    import uuid

    from riskengine.operators.score import label_and_recommend, linear_score
    from riskengine.session import checkpoint_dir
    from riskengine.streaming.stream import crossings_stream, read_crossings

    base = f"{checkpoint_dir(spark).rstrip('/')}/riskengine-stream-{uuid.uuid4().hex}"
    sdf = FX.fleet_from_events(FX.events_stream(spark, d))
    scored = label_and_recommend(linear_score(sdf, offset=FX.FLEET_OFFSET, scale=FX.FLEET_SCALE))
    q = crossings_stream(scored, f"{base}/out", f"{base}/checkpoint", threshold=0.5, width="10 days", delay="1 day")
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_crossings(spark, f"{base}/out", 0.5).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("stream_hourly_kpis", REGISTRY["hourly_kpis"].sql, doubles=("avg_risk",))
def q_stream_hourly_kpis(spark, d):
    """Fleet KPIs per event-time hour from the stream, the newest hour included."""
    from riskengine.operators.score import label_and_recommend, linear_score
    from riskengine.streaming.stream import kpi_stream

    sdf = FX.fleet_from_events(FX.events_stream(spark, d))
    scored = label_and_recommend(linear_score(sdf, offset=FX.FLEET_OFFSET, scale=FX.FLEET_SCALE))
    out = _run_updates(spark, kpi_stream(scored, width="1 hour"), ["window_start", "window_end"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@register(
    "stream_run_log",
    O.with_ctes() + "SELECT 'fleet-stream-0' AS run_id, 'fleet-stream' AS source_name, "
    "count(*) AS record_count, coalesce(avg(risk_probability), 0.0) AS average_risk, "
    "CAST(coalesce(sum(predicted_risk), 0) AS BIGINT) AS high_risk_count, "
    "CAST(count(*) AS BIGINT) AS stored_predictions FROM scored",
    doubles=("average_risk",),
)
def q_stream_run_log(spark, d):
    """The scored stream saved by the run-store sink (one run per micro-batch,
    run id = name + batch id); returns the committed run log with stored rows per run."""
    import uuid

    from riskengine.session import checkpoint_dir
    from riskengine.streaming.stream import score_stream, sink_stream

    base = f"{checkpoint_dir(spark).rstrip('/')}/riskengine-sink-{uuid.uuid4().hex}"
    sdf = FX.fleet_from_events(FX.events_stream(spark, d))
    scored = score_stream(sdf, offset=FX.FLEET_OFFSET, scale=FX.FLEET_SCALE)
    q = sink_stream(scored, f"{base}/store", f"{base}/checkpoint", name="fleet-stream")
    q.awaitTermination()
    runs, preds = ST.load(spark, f"{base}/store")
    stored = ST.committed(preds, runs).groupBy("run_id").agg(F.count(F.lit(1)).alias("stored_predictions"))
    return runs.select("run_id", "source_name", "record_count", "average_risk", "high_risk_count").join(
        stored, "run_id", "left")


# ----------------------------------------------------------------- run store round trips
def _new_store(spark) -> str:
    import uuid

    from riskengine.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/riskengine-store-{uuid.uuid4().hex}"


@register(
    "store_roundtrip",
    O.with_ctes("halves AS (SELECT *, CASE WHEN record % 2 = 0 THEN '1' ELSE '2' END AS run_id FROM scored)")
    + "SELECT run_id, 'half' AS source_name, count(*) AS record_count, avg(risk_probability) AS average_risk, "
    "CAST(sum(predicted_risk) AS BIGINT) AS high_risk_count, count(*) AS stored, count(*) AS distinct_ids, 1 AS times "
    "FROM halves GROUP BY run_id", doubles=("average_risk",),
)
def q_store_roundtrip(spark, d):
    """Two runs with integer ids, the first saved twice: one row per run, one
    timestamp, ids unique over the store."""
    root, s = _new_store(spark), FX.fleet_scored(spark, d)
    first = ST.save_batch(s.where("record % 2 = 0"), root, "half", mode="integer")
    ST.save_batch(s.where("record % 2 = 1"), root, "half", mode="integer")
    ST.save_batch(s.where("record % 2 = 0"), root, "half", run_id=first)
    runs, preds = ST.load(spark, root)
    unique = preds.groupBy("id").agg(F.max("run_id").alias("run_id"), F.count(F.lit(1)).alias("n"))
    kept = unique.where("n = 1").groupBy("run_id").agg(F.count(F.lit(1)).alias("distinct_ids"))
    stored = preds.groupBy("run_id").agg(F.count(F.lit(1)).alias("stored"), F.count_distinct("created_at").cast("int").alias("times"))
    return runs.select("run_id", "source_name", "record_count", "average_risk", "high_risk_count").join(
        stored, "run_id").join(kept, "run_id")


@register(
    "store_delete",
    O.with_ctes() + "SELECT 'kept' AS run_id, count(*) AS record_count, count(*) AS stored FROM scored WHERE record % 3 <> 0",
)
def q_store_delete(spark, d):
    """Deleting a run removes its row and its predictions and leaves the other run."""
    root, s = _new_store(spark), FX.fleet_scored(spark, d)
    ST.save_batch(s.where("record % 3 = 0"), root, "a", run_id="gone")
    ST.save_batch(s.where("record % 3 <> 0"), root, "b", run_id="kept")
    ST.delete_run(spark, root, "gone")
    runs, preds = ST.load(spark, root)
    stored = preds.groupBy("run_id").agg(F.count(F.lit(1)).alias("stored"))
    return runs.select("run_id", "record_count").join(stored, "run_id", "full_outer")


@register(
    "store_schema_drift",
    O.with_ctes() + "SELECT machine_label, record % 2 AS old, CAST(NULL AS INTEGER) AS pressure FROM scored",
)
def q_store_schema_drift(spark, d):
    """A store that lacks a column is appended to in the columns it has, which its
    manifests state, and read in all."""
    root, s = _new_store(spark), FX.fleet_scored(spark, d)
    ST.create_store(spark, root, T.StructType([f for f in S.PREDICTIONS_SCHEMA if f.name != "pressure"]))
    ST.save_batch(s.where("record % 2 = 1"), root, "old", run_id="old")
    ST.save_batch(s.where("record % 2 = 0"), root, "new", run_id="new")
    _, preds = ST.load(spark, root)
    return preds.select("machine_label", (F.col("run_id") == "old").cast("long").alias("old"), F.col("pressure").cast("int"))


@register(
    "store_single",
    O.with_ctes("one AS (SELECT * FROM scored WHERE machine_label = 'MCH-0007' ORDER BY record LIMIT 1)")
    + "SELECT 'single_machine_demo' AS source_name, machine_label, predicted_risk, risk_probability, recommendation FROM one",
    doubles=("risk_probability",),
)
def q_store_single(spark, d):
    """One machine's prediction saved as a batch of its own."""
    root = _new_store(spark)
    one = FX.fleet_scored(spark, d).where("machine_label = 'MCH-0007'").orderBy("record").limit(1).collect()
    for r in one:
        ST.save_single(spark, root, r.asDict(), r["predicted_risk"], r["risk_probability"], r["recommendation"], r["machine_label"])
    runs, preds = ST.load(spark, root)
    return preds.join(runs.select("run_id", "source_name"), "run_id").select(
        "source_name", "machine_label", "predicted_risk", "risk_probability", "recommendation")


@register(
    "metrics_roundtrip",
    O.with_ctes(actual=True) + "SELECT unnest(['accuracy', 'f1']) AS metric, unnest([accuracy, f1]) AS value FROM ("
    + _ratio_sql(COUNTS_SQL) + ") m", doubles=("value",),
)
def q_metrics_roundtrip(spark, d):
    """Metrics saved as JSON under the published key and read back as rows."""
    m = TR.classification_metrics(FX.fleet_actual(spark, d)).first()
    path = _new_store(spark) + "/metrics"
    ST.save_metrics(spark, {"accuracy": m["accuracy"], "f1_score": m["f1"]}, path)
    return TR.metrics_frame(spark, ST.load_metrics(spark, path))


@register(
    "store_empty_batch",
    O.with_ctes() + "SELECT 'full' AS run_id, count(*) AS record_count, avg(risk_probability) AS average_risk, "
    "CAST(sum(predicted_risk) AS BIGINT) AS high_risk_count, count(*) AS stored, min(1) AS first_id, count(*) AS last_id FROM scored "
    "UNION ALL SELECT 'none', 0, 0.0, 0, 0, NULL, NULL", doubles=("average_risk",),
)
def q_store_empty_batch(spark, d):
    """An empty batch opens the store: it is logged as a run of 0 records, and the
    store goes on; a run saved, replaced by nothing and saved again has dense ids."""
    root, s = _new_store(spark), FX.fleet_scored(spark, d)
    ST.save_batch(s.where("record < 0"), root, "nothing", run_id="none")
    ST.save_batch(s, root, "all", run_id="full")
    runs, preds = ST.load(spark, root)
    stored = preds.groupBy("run_id").agg(F.count(F.lit(1)).alias("stored"), F.min("id").cast("int").alias("first_id"),
                                         F.max("id").alias("last_id"))
    joined = runs.select("run_id", "record_count", "average_risk", "high_risk_count").join(stored, "run_id", "left")
    return joined.fillna(0, ["stored"])


@register(
    "store_recent",
    O.with_ctes() + "SELECT record + 1 AS place, machine_label, predicted_risk, risk_probability, recommendation FROM scored "
    "WHERE record % 3 = 2 QUALIFY row_number() OVER (ORDER BY record DESC) <= 25",
    doubles=("risk_probability",),
)
def q_store_recent(spark, d):
    """The newest predictions of a store of three runs, of which one is replaced and one
    deleted; only the newest run's folder is read."""
    root, s = _new_store(spark), FX.fleet_scored(spark, d).withColumn("pressure", (F.col("record") + 1).cast("double"))
    for k in (0, 1, 2, 0):
        ST.save_batch(s.where(F.col("record") % 3 == k).orderBy("record"), root, f"third-{k}", run_id=f"run-{k}")
    ST.delete_run(spark, root, "run-0")
    found = ST.load_recent(spark, root, 25)
    return found.select(F.col("pressure").cast("long").alias("place"), "machine_label", "predicted_risk",
                        "risk_probability", "recommendation")
