"""Maintenance advice as column expressions (A1-A5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskengine import schema as S
from riskengine.functions.scalar import percent_text


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def recommendation(prob: Column | str = "risk_probability") -> Column:
    """A1: three bands on the probability (>=0.5, >=0.3, else)."""
    p = _c(prob)
    return (
        F.when(p >= F.lit(S.BAND_IMMEDIATE), F.lit(S.TEXT_IMMEDIATE))
        .when(p >= F.lit(S.BAND_48_HOUR), F.lit(S.TEXT_48_HOUR))
        .otherwise(F.lit(S.TEXT_NORMAL))
    )


def recommendation_binary(pred: Column | str = "predicted_risk") -> Column:
    """A2: two levels by the predicted label."""
    return F.when(_c(pred) == 1, F.lit(S.TEXT_IMMEDIATE)).otherwise(F.lit(S.TEXT_NORMAL))


def urgency(prob: Column | str = "risk_probability") -> tuple[Column, Column]:
    """A3: (band, action text)."""
    p = _c(prob)
    (b1, t1), (b2, t2), (b3, t3) = S.URGENCY_BANDS
    hi = p >= F.lit(S.BAND_IMMEDIATE)
    mid = p >= F.lit(S.BAND_48_HOUR)
    band = F.when(hi, F.lit(b1)).when(mid, F.lit(b2)).otherwise(F.lit(b3))
    action = F.when(hi, F.lit(t1)).when(mid, F.lit(t2)).otherwise(F.lit(t3))
    return band, action


def drivers(max_items: int = 3) -> Column:
    """The first ``max_items`` rule texts that fire, joined by '; ' (fallback if none)."""
    fired = F.array(*[F.when(F.col(c) >= F.lit(t), F.lit(txt)) for c, t, txt in S.DRIVER_RULES])
    kept = F.slice(F.filter(fired, lambda x: x.isNotNull()), 1, max_items)
    return F.when(F.size(kept) == 0, F.lit(S.DRIVER_FALLBACK)).otherwise(F.array_join(kept, "; "))


def driver_summary(prob: Column | str = "risk_probability", pred: Column | str = "predicted_risk") -> Column:
    """A4: the single-machine support summary, for every row at once."""
    action = F.when(_c(pred) == 1, F.lit(S.ACTION_HIGH)).otherwise(F.lit(S.ACTION_LOW))
    return F.format_string(S.SUMMARY_FORMAT, percent_text(prob), drivers(), action)


def status_text(pred: Column | str = "predicted_risk") -> Column:
    """A5: HIGH RISK / STABLE."""
    return F.when(_c(pred) == 1, F.lit(S.STATUS_HIGH)).otherwise(F.lit(S.STATUS_LOW))
