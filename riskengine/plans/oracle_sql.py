"""DuckDB SQL twins of the fleet views (used by ``oracle_sql()``).

Each query's oracle starts with ``WITH <ctes>``; the CTE texts are built from the
same fixed constants as the Spark views so both sides compute the same numbers.
"""

from __future__ import annotations

from riskengine import schema as S
from riskengine.sources import fixtures as FX

FEATS = S.FEATURE_COLUMNS


def risk_score_sql() -> str:
    terms = []
    for feat, w, centre, div in S.RISK_TERMS:
        t = f"CAST({w!r} AS DOUBLE) * ({feat} - CAST({centre!r} AS DOUBLE))"
        if div != 1.0:
            t = f"{t} / CAST({div!r} AS DOUBLE)"
        terms.append(t)
    # left-assoc sum, same order as the Spark expression
    return " + ".join(terms)


def recommendation_sql(p: str = "risk_probability") -> str:
    return (
        f"CASE WHEN {p} >= 0.5 THEN '{S.TEXT_IMMEDIATE}' WHEN {p} >= 0.3 THEN '{S.TEXT_48_HOUR}' "
        f"ELSE '{S.TEXT_NORMAL}' END"
    )


FLEET = f"""fleet AS (
  SELECT event_id AS record, ts, event_type AS dataset,
         printf('MCH-%04d', user_id) AS machine_label, user_id,
         CAST(60.0 AS DOUBLE) + k * CAST(0.5 AS DOUBLE) AS machine_temperature,
         CAST(60.0 AS DOUBLE) + k * CAST(0.5 AS DOUBLE) + 2 + (event_id % 11) AS bearing_temperature,
         least(CAST(15.0 AS DOUBLE), value / CAST(10.0 AS DOUBLE)) AS vibration_level,
         CAST(55 + event_id % 196 AS DOUBLE) AS pressure,
         CAST((event_id * 13) % 10000 AS DOUBLE) AS runtime_hours,
         least(CAST(120.0 AS DOUBLE), CAST(40.0 AS DOUBLE) + value / CAST(2.0 AS DOUBLE)) AS load_percentage,
         CAST((user_id * 7 + event_id) % 181 AS DOUBLE) AS maintenance_delay_days,
         CASE WHEN event_type = 'error' THEN CAST(1 + event_id % 8 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS error_log_count
  FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
)"""

SCORED = f"""scored0 AS (
  SELECT *, {risk_score_sql()} AS risk_score FROM fleet
), scored1 AS (
  SELECT *, 1.0 / (1.0 + exp(-(risk_score - {FX.FLEET_OFFSET!r}) / {FX.FLEET_SCALE!r})) AS risk_probability FROM scored0
), scored AS (
  SELECT *, CAST(risk_probability >= 0.5 AS INTEGER) AS predicted_risk,
         {recommendation_sql()} AS recommendation
  FROM scored1
)"""

ACTUAL = f"""actual AS (
  SELECT *, CASE WHEN record % {FX.ACTUAL_FLIP_MOD} = 0
                 THEN 1 - CAST(risk_probability > {FX.ACTUAL_CUT!r} AS INTEGER)
                 ELSE CAST(risk_probability > {FX.ACTUAL_CUT!r} AS INTEGER) END AS downtime_risk
  FROM scored
)"""


def with_ctes(*extra: str, actual: bool = False) -> str:
    parts = [FLEET, SCORED]
    if actual:
        parts.append(ACTUAL)
    parts += list(extra)
    return "WITH " + ",\n".join(parts) + "\n"


def to_number_sql(s: str) -> str:
    """The oracle of ``functions.scalar.to_number``."""
    t = f"trim(CAST({s} AS VARCHAR))"
    d = f"(CASE WHEN NOT regexp_matches({t}, '[0-9.]\\s*[dDfF]\\s*$') THEN TRY_CAST({t} AS DOUBLE) END)"
    return f"(CASE WHEN NOT isnan({d}) THEN {d} END)"


def to_int_target_sql(s: str) -> str:
    d = to_number_sql(s)
    return f"coalesce(CASE WHEN isfinite({d}) AND abs({d}) < 2147483648 THEN CAST(trunc({d}) AS INTEGER) END, 0)"


def junk_sql(value: str, mods: tuple[int, int, int, int, int]) -> str:
    m_na, m_empty, m_suffix, m_inf, m_thousand = mods
    return (
        f"CASE WHEN record % {m_na} = 0 THEN 'na' WHEN record % {m_empty} = 0 THEN '' "
        f"WHEN record % {m_suffix} = 0 THEN '1d' WHEN record % {m_inf} = 0 THEN 'inf' "
        f"WHEN record % {m_thousand} = 0 THEN '1,000' ELSE CAST({value} AS VARCHAR) END"
    )


def messy_cte(bearing_missing: bool = False) -> str:
    cols = ["record", "CAST(record AS VARCHAR) AS \"UDI\"",
            "CASE WHEN record % 37 = 0 THEN '' ELSE machine_label END AS \"Product ID\""]
    for feat, name, mods in zip(FEATS, FX.MESSY_NAMES, FX.MESSY_MODS):
        if bearing_missing and feat == "bearing_temperature":
            cols.append(f"CAST(NULL AS VARCHAR) AS \"{name}\"")
        else:
            cols.append(f"{junk_sql(feat, mods)} AS \"{name}\"")
    cols.append(
        "CASE WHEN record % 11 = 0 THEN 'na' WHEN record % 29 = 0 THEN '1.9' "
        "ELSE CAST(downtime_risk AS VARCHAR) END AS \"Machine failure\""
    )
    return "messy AS (\n  SELECT " + ",\n         ".join(cols) + "\n  FROM actual\n)"


def r6(expr: str) -> str:
    return f"round({expr}, 6)"
