"""Column expressions used across the engine (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A trailing Java type suffix ("1d", "2.5f") is accepted by Spark's cast but
# not by the reference's number parser, so such strings are treated as missing.
_TYPE_SUFFIX = r"[0-9.]\s*[dDfF]\s*$"


def _to_number(c: Column) -> Column:
    s = F.trim(c.cast("string"))
    parsed = F.when(~s.rlike(_TYPE_SUFFIX), s.try_cast("double"))
    return F.when(~F.isnan(parsed), parsed)


def to_number(col: Column | str) -> Column:
    """Text or number -> double; unparseable, NaN and empty become NULL.

    Matches pandas ``to_numeric(errors="coerce")`` on the cases that matter:
    ``na``/empty/``1,000``/``True`` -> NULL, ``inf`` -> inf, ``nan`` -> NULL.
    """
    return _to_number(F.col(col) if isinstance(col, str) else col)


def to_int_target(number: Column) -> Column:
    """Target of a parsed number: missing -> 0, truncated to int; +-inf -> 0."""
    return F.coalesce(number.try_cast("int"), F.lit(0))


def np_round(col: Column | str, digits: int = 0) -> Column:
    """NumPy-style rounding: scale, round half to even on the binary value, unscale."""
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def clip(col: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    if lo is not None:
        c = F.greatest(c, F.lit(float(lo)))
    if hi is not None:
        c = F.least(c, F.lit(float(hi)))
    return c


def sigmoid(col: Column, offset: float = 0.0, scale: float = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(col - F.lit(float(offset))) / F.lit(float(scale))))


def fixed1(value: Column) -> Column:
    """Python's ``{:.1f}``: the exact binary value rounded half to even.

    Java's formatter rounds the shortest decimal text, half up. Here the fraction's
    tenths are 8f + 2f, two exact products whose sum's rounding error is kept (two-sum),
    so the side of the half is always known."""
    size = F.abs(value)
    whole = F.floor(size).cast("double")
    frac = size - whole
    a, b = frac * F.lit(8.0), frac * F.lit(2.0)
    total = a + b
    part = total - a
    error = (a - (total - part)) + (b - part)
    tenth = F.floor(total).cast("double")
    past_half = (total - tenth - F.lit(0.5)) + error
    up = (past_half > 0) | ((past_half == 0) & (tenth % 2 == 1))
    tenths = F.when(up, tenth + F.lit(1.0)).otherwise(tenth).cast("long")
    units = F.floor(size).cast("long") + F.floor(tenths / 10).cast("long")
    text = F.concat(F.when(value < 0, "-").otherwise(""), units.cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(size < F.lit(9e15), text).otherwise(F.format_string("%.1f", value))


def percent_text(col: Column | str) -> Column:
    """Python's ``{:.1%}``: value times 100 with one decimal and a % sign."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(fixed1(c * F.lit(100.0)), F.lit("%"))


def parse_percent(col: Column | str) -> Column:
    """Percent text back to a number ("12.3%" -> 12.3)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.rtrim(c, F.lit("%")).try_cast("double")
