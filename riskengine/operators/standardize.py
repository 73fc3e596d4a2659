"""Bring any sensor table to the fixed standard schema.

Column detection runs on ``df.columns`` (metadata) in Python; the data work is a
single lazy ``select``. The one data-dependent rule -- derive the bearing
temperature only when that column is missing everywhere -- is a scalar
subquery (count of parsed values), so the transform stays lazy and distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskengine import schema as S
from riskengine.functions.scalar import to_int_target, to_number

BEARING_OFFSET = 6.0


def normalise_name(name: str) -> str:
    """Strip, lower-case, '_' -> ' '."""
    return str(name).strip().lower().replace("_", " ")


def find_column(columns: list[str], aliases: list[str]) -> str | None:
    """First alias (in alias order) that matches a column; the last column wins
    among columns with the same normalised name."""
    lookup = {normalise_name(c): c for c in columns}
    for alias in aliases:
        hit = lookup.get(normalise_name(alias))
        if hit is not None:
            return hit
    return None


def _label_expr(df: DataFrame, label_col: str | None, order_by: str | None) -> tuple[DataFrame, Column]:
    if label_col is not None:
        return df, F.nullif(F.col(f"`{label_col}`").cast("string"), F.lit(""))
    if order_by is None:
        raise ValueError("no machine-label column: pass order_by to number machines by position")
    from riskengine.operators.indexing import with_index

    if order_by not in df.columns:
        raise ValueError(f"order column {order_by!r} not found")
    indexed = with_index(df, [order_by], out="_pos")
    return indexed, F.format_string(S.DEFAULT_LABEL_FORMAT, F.col("_pos") + F.lit(1))


def parse_column(df: DataFrame, name: str, booleans: bool = False) -> Column:
    """P3 by source type: numbers cast directly (NaN -> NULL), booleans via 0/1,
    text through the pandas-compatible parser. With ``booleans`` (targets and flags), the
    words true and false in a text column count as 1 and 0 too."""
    from pyspark.sql import types as T

    dtype = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dtype, T.NumericType):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if booleans:
        word = F.lower(F.trim(c.cast("string")))
        return F.when(word == "true", 1.0).when(word == "false", 0.0).otherwise(to_number(c))
    return to_number(c)


def _features(df: DataFrame, sources: dict[str, str | None], machine_alias: str | None,
              streaming: bool, bearing_all_missing: bool | None) -> list[Column]:
    out = []
    for feat in S.FEATURE_COLUMNS:
        src = sources.get(feat)
        parsed = parse_column(df, src) if src is not None else F.lit(None).cast("double")
        if feat == "bearing_temperature" and machine_alias is not None:
            derived = parse_column(df, machine_alias) + F.lit(BEARING_OFFSET)
            if src is None:
                parsed = derived
            elif streaming or bearing_all_missing is not None:
                if bearing_all_missing:
                    parsed = derived
            else:
                # one present value decides: every task stops at its first
                some = df.where(parse_column(df, src).isNotNull()).select(F.lit(1).alias("x")).limit(1)
                parsed = F.when(some.select(F.count("x")).scalar() == F.lit(0), derived).otherwise(parsed)
        out.append(F.coalesce(parsed, F.lit(S.FEATURE_DEFAULTS[feat])).cast("double").alias(feat))
    return out


def standardize(df: DataFrame, order_by: str | None = None, keep: list[str] | tuple = (),
                streaming: bool = False, bearing_all_missing: bool | None = None) -> DataFrame:
    """P10: detect label/feature/target columns by alias and emit the standard schema.

    ``keep`` columns are carried through in front (e.g. a record key). On a stream
    the all-missing bearing test is undefined, so ``bearing_all_missing`` decides.
    """
    cols = df.columns
    label_col = find_column(cols, S.LABEL_ALIASES)
    base, label = _label_expr(df, label_col, order_by)
    sources = {f: find_column(cols, S.FEATURE_ALIASES[f]) for f in S.FEATURE_COLUMNS}
    machine_alias = sources["machine_temperature"]
    feats = _features(df, sources, machine_alias, streaming, bearing_all_missing)
    target_col = find_column(cols, S.TARGET_ALIASES)
    if target_col is not None:
        target = to_int_target(parse_column(df, target_col, booleans=True))
    else:
        flags = [c for c in S.FAILURE_FLAGS if c in cols]
        if flags:
            parts = [F.coalesce(parse_column(df, c, booleans=True), F.lit(0.0)) for c in flags]
            m = parts[0] if len(parts) == 1 else F.greatest(*parts)
            target = m.try_cast("int")
        else:
            target = F.lit(0)
    return base.select(*[F.col(k) for k in keep], label.alias(S.LABEL_COLUMN), *feats,
                       target.cast("int").alias(S.TARGET_COLUMN))


def standardize_mapped(df: DataFrame, mapping: dict[str, str | None], target: str | None = None,
                       label: str | None = None, order_by: str | None = None, keep: list[str] | tuple = (),
                       streaming: bool = False, bearing_all_missing: bool | None = None) -> DataFrame:
    """Explicit feature columns; label falls back to alias detection; the target
    has no alias or flag fallback (0 when not given)."""
    cols = df.columns
    label_col = label if (label and label in cols) else find_column(cols, S.LABEL_ALIASES)
    base, lab = _label_expr(df, label_col, order_by)
    sources = {f: (mapping.get(f) if mapping.get(f) in cols else None) for f in S.FEATURE_COLUMNS}
    # The bearing derivation reads the alias-detected machine column, not the mapped one.
    machine_alias = find_column(cols, S.FEATURE_ALIASES["machine_temperature"])
    feats = _features(df, sources, machine_alias, streaming, bearing_all_missing)
    tgt = to_int_target(parse_column(df, target, booleans=True)) if (target and target in cols) else F.lit(0)
    return base.select(*[F.col(k) for k in keep], lab.alias(S.LABEL_COLUMN), *feats,
                       tgt.cast("int").alias(S.TARGET_COLUMN))


def guess_mapping(columns: list[str]) -> dict[str, str | None]:
    """First column equal to, or containing, the feature name (lower, '_' -> ' ')."""
    out: dict[str, str | None] = {}
    for feat in S.FEATURE_COLUMNS:
        simple = feat.replace("_", " ").lower()
        out[feat] = None
        for c in columns:
            sc = str(c).replace("_", " ").lower()
            if sc == simple or simple in sc:
                out[feat] = c
                break
    return out


def validate(df: DataFrame) -> DataFrame:
    """Raise on an empty input (an eager check, kept out of the lazy transform)."""
    if df.isEmpty():
        raise ValueError(f"no rows to standardise in a frame of columns {df.columns}")
    return df


def display_label(col: str = S.LABEL_COLUMN) -> Column:
    """NULL label shown as 'Unknown'."""
    return F.coalesce(F.col(col), F.lit("Unknown"))


def filter_machine(df: DataFrame, machine: str, order: str = "record") -> DataFrame:
    """The first reading of one machine."""
    return df.filter(display_label() == F.lit(machine)).orderBy(order).limit(1)


def high_risk(df: DataFrame, pred: str = "predicted_risk") -> DataFrame:
    """P17."""
    return df.filter(F.col(pred) == 1)


def in_fleet(df: DataFrame, fleet: DataFrame, label: str = S.LABEL_COLUMN) -> DataFrame:
    """Rows whose machine appears in ``fleet`` (semi join, no duplicates)."""
    return df.join(fleet.select(label), label, "left_semi")
