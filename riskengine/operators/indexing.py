"""Row order on an unordered engine: dense index, rolling windows, quantiles, samples.

None of these puts the whole table in one task:

* ``with_index`` (W1) numbers rows by keys of their own columns, without a write: the split
  points of the ranges are a fixed function of the keys, so every evaluation cuts the same
  ranges, and a row's number is the rows of the ranges before plus its place in its own.
* ``with_record`` (W1) numbers rows by keys that a second evaluation may change (places in
  the input): it range-partitions, numbers rows inside each partition and writes that once to
  the checkpoint folder. In both, only counts (one row per range) are combined in one place.
* ``rolling_mean`` (W2) and ``rolling_mean_by`` (W3) split the index into
  buckets and copy the last ``n - 1`` rows of each bucket into the next one
  ("halo"), so a row-frame window per bucket is exact and a hot machine is
  spread over many buckets.
* ``exact_quantiles`` brackets every quantile by a sketch and counts exactly inside
  the bracket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.session import checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id = partition index << 33 | row in partition


def with_record(df: DataFrame, order_by: list[str | Column], out: str = "record",
                num_partitions: int | None = None, unique: bool = True) -> DataFrame:
    """Dense 0-based row index in ``order_by`` order.

    ``order_by`` must identify rows; with ``unique=False`` every column is added
    as a tie-breaker so that recomputation after a lost executor gives the same
    numbers. Nulls sort first.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in order_by]
    if not unique:
        names = {k for k in order_by if isinstance(k, str)}
        keys += [F.col(c) for c in df.columns if c not in names]
        # last tie-breaker: the row's position in its (deterministic) input split, so
        # that even many identical rows are spread over several range partitions
        df = df.withColumn("_tie", F.monotonically_increasing_id())
        keys.append(F.col("_tie"))
    order = [k.asc_nulls_first() for k in keys]
    # Without an explicit count AQE may merge adjacent (small) ranges, which keeps the order.
    by_range = df.repartitionByRange(int(num_partitions), *order) if num_partitions else df.repartitionByRange(*order)
    ranged = (
        by_range
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    # Range bounds come from a sample seeded by the RDD id, so two evaluations of
    # the same plan may cut the ranges differently. Materialise the numbered rows
    # once, as a Parquet table in the shared checkpoint folder, so that the count
    # pass and the numbering pass see the same (partition, position) pairs, also
    # after a lost executor. ``_mid`` carries both, so the read-back split does not matter.
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/riskengine-index-{uuid.uuid4().hex}"
    ranged.write.parquet(path)
    ranged = spark.read.parquet(path).withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # One row per partition: the broadcast is bounded by ``n``.
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    result = (
        ranged.join(F.broadcast(offsets), "_pid")
        .withColumn(out, F.col("_off") + local)
        .drop("_mid", "_pid", "_off")
    )
    return result.drop("_tie") if "_tie" in result.columns else result


SAMPLE_PER_RANGE = 64
SPLIT_BLOCK = 16


def _split_points(df: DataFrame, names: list[str], ranges: int) -> list[Column]:
    """The ranges' split points, in order: at most ``ranges - 1`` values, collected.

    The points are quantiles of the rows whose key hashes fall under a bound set by the number
    of rows: about ``SAMPLE_PER_RANGE`` a range at any size, and the same rows on every evaluation."""
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(names)]
    n = df.select(F.count(F.lit(1))).scalar()
    bound = F.lit(float(SAMPLE_PER_RANGE * ranges)) * F.lit(float(1 << 30)) / n
    sample = df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < bound)
    held = sample.agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("a")).where(F.size("a") > 0)
    places = [F.floor(F.size("a") * F.lit(i) / F.lit(ranges)).cast("int") for i in range(1, ranges)]
    points = held.select(F.explode(F.array_distinct(F.array(*[F.get("a", i) for i in places]))).alias("p")).select("p.*")
    # Values travel as texts that read back as the same value.
    types = [df.schema[c].dataType for c in names]
    micros = [isinstance(t, T.TimestampType) for t in types]
    told = points.select(*[(F.unix_micros(c) if m else F.col(c)).cast("string").alias(c) for c, m in zip(points.columns, micros)])
    back = lambda v, t, m: F.timestamp_micros(F.lit(v).cast("long")) if m else F.lit(v).cast(t)
    return [F.struct(*[back(v, t, m).alias(f"k{i}") for i, (v, t, m) in enumerate(zip(r, types, micros))]) for r in told.collect()]


def with_index(df: DataFrame, order_by: list[str], out: str = "record", ranges: int | None = None) -> DataFrame:
    """Dense 0-based row index in the order of columns that identify rows (nulls first),
    by scans of the key columns (split points now, rows per range with the result) and one
    shuffle of the rows by range. ``df`` must give the same rows again when it is evaluated again."""
    spark = df.sparkSession
    ranges = max(2, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(order_by)]
    points, key = _split_points(df, order_by, ranges), F.struct(*keys)
    # Two steps: the block of points, then the place in it.
    blocks = [points[i:i + SPLIT_BLOCK] for i in range(0, len(points), SPLIT_BLOCK)]
    upto = lambda found: F.size(F.filter(F.array(*found), lambda p: p <= key))
    block = upto([b[0] for b in blocks]) if blocks else F.lit(0)
    inside = F.coalesce(*[F.when(F.col("_block") == i + 1, i * SPLIT_BLOCK + upto(b)) for i, b in enumerate(blocks)], F.lit(0))
    tagged = df.withColumn("_block", block).withColumn("_range", inside).drop("_block")
    counts = tagged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*[F.asc_nulls_first(c) for c in order_by]))
    # One row per range: the broadcast is bounded by ``ranges``.
    numbered = tagged.withColumn("_place", place).join(F.broadcast(offsets), "_range")
    return numbered.withColumn(out, F.col("_off") + F.col("_place") - 1).drop("_range", "_place", "_off")


def _halo(df: DataFrame, idx: str, width: int, bucket: int) -> DataFrame:
    """Rows tagged with bucket ``_b``; the last ``width`` rows of each bucket also
    appear in the next bucket with ``_halo`` set. One pass: each row is exploded
    into itself and, in the halo zone, one copy (no second scan of the input)."""
    if bucket < width:
        raise ValueError("bucket must be at least the window width")
    b = F.floor(F.col(idx) / F.lit(bucket)).cast("long")
    if width == 0:
        return df.withColumn("_b", b).withColumn("_halo", F.lit(False))
    in_zone = F.col(idx) % F.lit(bucket) >= F.lit(bucket - width)
    targets = F.when(in_zone, F.array(b, b + F.lit(1))).otherwise(F.array(b))
    return (
        df.withColumn("_own", b)
        .withColumn("_b", F.explode(targets))
        .withColumn("_halo", F.col("_b") != F.col("_own"))
        .drop("_own")
    )


def _present(col: str) -> Column:
    """The value as a double, NaN as NULL."""
    return F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))


def rolling_mean(df: DataFrame, col: str, n: int = 30, order: str = "record", out: str = "rolling_average",
                 bucket: int = 100_000) -> DataFrame:
    """Mean of the last ``n`` rows (min_periods 1; NULL and NaN skipped) in the order of a
    unique integer column. If that column has gaps, rows are numbered first (W1)."""
    span = df.agg(F.count(order).alias("n"), F.min(order).alias("a"), F.max(order).alias("b")).first()
    idx = order
    if span["n"] and span["b"] - span["a"] + 1 != span["n"]:
        idx = "_dense"
        df = with_index(df, [order], out=idx)
    u = _halo(df, idx, n - 1, bucket)
    w = Window.partitionBy("_b").orderBy(idx).rowsBetween(-(n - 1), 0)
    out_df = u.withColumn(out, F.avg(_present(col)).over(w)).filter(~F.col("_halo")).drop("_b", "_halo")
    return out_df.drop(idx) if idx != order else out_df


def rolling_mean_by(df: DataFrame, key: str, ts: str, col: str, n: int = 30, tiebreak: str = "record",
                    out: str = "rolling_average", bucket: int = 100_000, skew_safe: bool = True) -> DataFrame:
    """Per-``key`` mean of the last ``n`` readings in ``ts`` order.

    ``skew_safe`` numbers rows globally in (key, ts, tiebreak) order and windows per
    (bucket, key) with a halo, so one machine with a third of all rows is still
    split over many tasks. Without it, a plain ``partitionBy(key)`` window is used.
    """
    if not skew_safe:
        w = Window.partitionBy(key).orderBy(ts, tiebreak).rowsBetween(-(n - 1), 0)
        return df.withColumn(out, F.avg(_present(col)).over(w))
    idx = with_index(df, [key, ts, tiebreak], out="_gidx")
    u = _halo(idx, "_gidx", n - 1, bucket)
    w = Window.partitionBy("_b", key).orderBy("_gidx").rowsBetween(-(n - 1), 0)
    return u.withColumn(out, F.avg(_present(col)).over(w)).filter(~F.col("_halo")).drop("_b", "_halo", "_gidx")


def lag_by(df: DataFrame, key: str, ts: str, col: str, tiebreak: str = "record", out: str = "previous",
           bucket: int = 100_000, skew_safe: bool = True) -> DataFrame:
    """Previous ``col`` of the same ``key`` in (ts, tiebreak) order (NULL for the first)."""
    if not skew_safe:
        return df.withColumn(out, F.lag(col).over(Window.partitionBy(key).orderBy(ts, tiebreak)))
    idx = with_index(df, [key, ts, tiebreak], out="_gidx")
    u = _halo(idx, "_gidx", 1, bucket)
    w = Window.partitionBy("_b", key).orderBy("_gidx")
    return u.withColumn(out, F.lag(col).over(w)).filter(~F.col("_halo")).drop("_b", "_halo", "_gidx")


BRACKET_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float], accuracy: int = BRACKET_ACCURACY) -> DataFrame:
    """(column, q, value): linear-interpolated quantiles of the present values (NULL and
    NaN are missing). One plan for all sizes, in two scans:

    1. per column the number of values, and for every quantile a bracket that certainly
       holds its two neighbours: the sketch's values at ``q`` less and plus twice its
       guaranteed rank error (a few numbers, collected);
    2. per bracket the number of values below it, and (value, count) of those inside: about
       4 / ``accuracy`` of the rows, and a value that many rows share is one group.
    """
    none = F.lit(None).cast("double")
    rows = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), none).alias(f"c{i}") for i, c in enumerate(cols)])
    reach = 2.0 / accuracy
    edges = [min(1.0, max(0.0, q + side)) for q in qs for side in (-reach, reach)]
    first = rows.agg(*[e for i in range(len(cols)) for e in (
        F.count(f"c{i}").alias(f"n{i}"), F.percentile_approx(f"c{i}", edges, accuracy).alias(f"e{i}"))]).first()
    brackets = []   # (column, q, values, position, low, high)
    for i, c in enumerate(cols):
        for j, q in enumerate(qs):
            n = first[f"n{i}"]
            if n:
                low, high = first[f"e{i}"][2 * j], first[f"e{i}"][2 * j + 1]
                low = float("-inf") if q - reach <= 0 else low
                high = float("inf") if q + reach >= 1 else high
                brackets.append((i, c, float(q), q * (n - 1), low, high))
    spark = df.sparkSession
    kinds = "id int, column string, q double, position double"
    wanted = spark.createDataFrame([(k, b[1], b[2], b[3]) for k, b in enumerate(brackets)], kinds)
    if not brackets:
        return spark.createDataFrame([(c, float(q), None) for c in cols for q in qs], "column string, q double, value double")
    # Per bracket and row: NULL outside, the value inside, -infinity (a marker) below.
    inside = F.array(*[F.struct(
        F.lit(k).alias("id"), (F.col(f"c{i}") < F.lit(low)).alias("below"),
        F.when(F.col(f"c{i}") >= F.lit(low), F.col(f"c{i}")).alias("value")) for k, (i, _, _, _, low, high) in enumerate(brackets)])
    highs = F.array(*[F.lit(b[5]) for b in brackets])
    long = rows.select(F.explode(F.filter(inside, lambda x: (~x["below"]) & (
        x["value"] <= F.element_at(highs, x["id"] + 1)))).alias("x")).select("x.id", "x.value")
    counted = long.groupBy("id", "value").agg(F.count(F.lit(1)).alias("n"))
    # Of few values the sketch's bracket can miss a neighbour by one rank: the values next to it.
    around = rows.agg(F.array(*[F.struct(
        F.count_if(F.col(f"c{i}") < F.lit(low)).alias("below"), F.max(F.when(F.col(f"c{i}") < F.lit(low), F.col(f"c{i}"))).alias("prev"),
        F.min(F.when(F.col(f"c{i}") > F.lit(high), F.col(f"c{i}"))).alias("next"))
        for i, _, _, _, low, high in brackets]).alias("a")).select(F.posexplode("a").alias("id", "a")).select("id", "a.*")
    upto = Window.partitionBy("id").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("n").over(upto)).join(around, "id").join(wanted, "id")
    last = F.col("below") + F.col("upto") - 1            # ranks first..last (from 0) hold this value
    start = last - F.col("n") + 1
    low, high = F.floor("position"), F.ceil("position")
    agg = ranked.groupBy("column", "q", "position", "below", "prev", "next").agg(
        F.max(F.when(low.between(start, last), F.col("value"))).alias("lo"),
        F.max(F.when(high.between(start, last), F.col("value"))).alias("hi"))
    agg = agg.withColumn("lo", F.coalesce("lo", F.when(low < F.col("below"), F.col("prev")).otherwise(F.col("next"))))
    agg = agg.withColumn("hi", F.coalesce("hi", F.when(high < F.col("below"), F.col("prev")).otherwise(F.col("next"))))
    found = agg.select("column", "q", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(
        F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("position") - F.floor("position"))).alias("value"))
    empty = [(c, float(q), None) for i, c in enumerate(cols) for q in qs if not first[f"n{i}"]]
    return found.union(spark.createDataFrame(empty, "column string, q double, value double")) if empty else found


def quantile_lookup(qs_df: DataFrame):
    """``get(column, q) -> Column`` over the result of ``exact_quantiles``.

    The quantile table has (#columns x #quantiles) rows -- statistics, not data --
    so it is collected once and the values are inlined as literals. (A scalar
    subquery per lookup would be planned and run once per use.)"""
    values = {(r["column"], float(r["q"])): r["value"] for r in qs_df.collect()}

    def get(column: str, q: float) -> Column:
        return F.lit(values.get((column, float(q)))).cast("double")

    return get


def uniform_of(key: str, seed: int) -> Column:
    """52 hash bits of a key and a seed (MD5) as a non-negative long: the same number in any
    engine that has MD5."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def seeded_sample(df: DataFrame, n: int = 200, seed: int = 42, key: str = "record", min_rows: int = 10) -> DataFrame:
    """T5: a deterministic sample of ``n`` rows (hash of key and seed), only if the
    frame has at least ``min_rows`` rows. A top-k, so no full sort."""
    total = df.select(F.count(F.lit(1))).scalar()
    return (
        df.withColumn("_h", uniform_of(key, seed))
        .orderBy("_h", key)
        .limit(n)
        .filter(total >= F.lit(min_rows))
        .drop("_h")
    )
