"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree,
in DataFrame and SQL functions only.

1. *Targets.* A document's size is its number of words. Sources, in code point order
   (null last), get the weights in turn and share the total size; a target stops at
   ``max_epochs`` times its source's size and the excess is shared again by weight. In
   closed form: sources are taken by cap / weight, and capped while their cap is within
   their share of what is left.
2. *Blocks.* A source of n words is cut by document hash into about sqrt(n) blocks, so a
   hot source has many small blocks rather than one large group, and the number of
   blocks grows slowly. Every block is taken floor(target / size) times; the remainder
   is filled with blocks in hash order, in passes: each pass takes the first blocks that
   still fit, until no block fits. So a source misses its target by less than the
   smallest block it has left.
3. *Tree.* Each taken copy of a block is a unit; each source's units are its quota. The
   root holds all quotas; a node splits its output shards in halves, drawing how many
   units of each source go left from the multivariate hypergeometric distribution, one
   conditional draw per source. Leaves hold exact quotas per shard. Nodes of a level are
   rows, and the depth is the logarithm of the number of shards.
4. *Draw.* A source's units in hash order are dealt to shards by the leaves' quotas:
   disjoint ranges of a permutation. Rows get their block's shards by equality join.
5. *Shuffle.* ``shuffled`` puts one row per copy in its shard, in hash order.

Everything random is a hash of the seed and the id, so reruns agree. One row per source
(and in the tree per source and shard) is held together; documents never are.

Defined results: a null, empty or wordless text has size 0 and is taken with its block;
null is a source of its own; repeated rows fall into the same block and are taken alike;
an empty table gives an empty result; clashing input columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskengine.llm.common import WORD, fresh, power_of_two, staged, with_result

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SHARD_WORDS = 1 << 22
FILL_STEP = 4          # passes of the fill between two looks at what is left
SEED = 17


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(doc_id: Column, seed: int) -> Column:
    """60 hash bits of an id, as a non-negative long."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, idx, source_size, target, n_blocks) from (source, size) rows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    idx = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    per = per.withColumn("idx", idx).withColumn("w", F.element_at(cycle, (F.col("idx") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * max_epochs)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    w_left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    per = per.withColumn("capped", F.col("cap") * w_left <= F.col("w") * left)
    per = per.withColumn("rest", F.sum("source_size").over(every) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every))
    per = per.withColumn("w_rest", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        (F.col("w") * F.col("rest")).cast("double") / F.col("w_rest").cast("double"))
    blocks = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("source_size").cast("double")))).cast("long")
    return per.select("source", "idx", "source_size", target.alias("target"), blocks.alias("n_blocks"))


def in_block(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` (source, place, ...) with their source's columns and their block."""
    s = sources.withColumnRenamed("source", "source_key")
    joined = rows.join(s, F.col("source").eqNullSafe(F.col("source_key"))).drop("source_key")
    return joined.withColumn("block", F.pmod("place", "n_blocks"))


def block_copies(blocked: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(idx, block, copies): how often the mix takes each block."""
    per = blocked.groupBy("idx", "block", "source_size", "target").agg(F.sum("size").alias("words"))
    base = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(
        F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    per = per.withColumn("base", base)
    per = per.withColumn("missing", F.col("target") - (F.col("base") * F.col("source_size")).cast("double"))
    per = per.withColumn("extra", F.lit(0))
    own = Window.partitionBy("idx")
    order = own.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    free = (F.col("extra") == 0) & (F.col("base") < max_epochs) & (F.col("words") <= F.col("missing"))
    while True:
        # Every pass takes a block of each source that has one that fits: the end is certain, and
        # what is missing shrinks to a part of itself with each pass.
        for _ in range(FILL_STEP):
            per = per.withColumn("free", free)
            upto = F.sum(F.when(F.col("free"), F.col("words")).otherwise(0)).over(order)
            per = per.withColumn("now", F.col("free") & (upto <= F.col("missing")))
            took = F.sum(F.when(F.col("now"), F.col("words")).otherwise(0)).over(own)
            per = per.withColumn("took", took).withColumn("missing", F.col("missing") - F.col("took").cast("double"))
            per = per.withColumn("extra", F.when(F.col("now"), 1).otherwise(F.col("extra")))
        per = staged(per.drop("free", "now", "took"), "mix-fill")
        if per.where(free).isEmpty():
            break
    return per.select("idx", "block", (F.col("base") + F.col("extra")).alias("copies"))


# A hypergeometric draw by inversion: how many of h.good marked items are among h.draws
# drawn without replacement from h.pop. Weights relative to the mode's are summed upwards
# and downwards from it until they vanish in double precision; the uniform h.u then picks.
_RISE = "(cast(h.good - k as double) * (h.draws - k) / ((k + 1D) * (h.pop - h.good - h.draws + k + 1D)))"
_FALL = "((k + 1D) * (h.pop - h.good - h.draws + k + 1D) / (cast(h.good - k as double) * (h.draws - k)))"
_SHARE = "(cast(h.good as double) / greatest(h.pop, 1L))"
_RANGE = f"""array(named_struct(
  'low', greatest(0L, h.draws - (h.pop - h.good)), 'high', least(h.draws, h.good),
  'mode', cast(floor((h.draws + 1D) * (h.good + 1D) / (h.pop + 2D)) as bigint),
  'reach', cast(12 * sqrt(h.draws * {_SHARE} * (1 - {_SHARE})) as bigint) + 20L))"""
_WALKS = f"""transform(transform({_RANGE},
  s -> named_struct('mode', greatest(s.low, least(s.high, s.mode)), 'low', s.low, 'high', s.high, 'reach', s.reach)),
  s -> named_struct('top', least(s.high, s.mode + s.reach), 'up', sequence(s.mode, least(s.high, s.mode + s.reach)),
    'down', if(s.mode > greatest(s.low, s.mode - s.reach),
               sequence(s.mode - 1, greatest(s.low, s.mode - s.reach)), cast(array() as array<bigint>))))"""
_ZERO = "named_struct('w', 1D, 't', 0D)"
_SUMS = f"""transform({_WALKS}, s -> named_struct('up', s.up, 'down', s.down, 'top', s.top,
    'above', aggregate(s.up, {_ZERO}, (x, k) -> named_struct('w', x.w * {_RISE}, 't', x.t + x.w)).t,
    'below', aggregate(s.down, {_ZERO}, (x, k) -> named_struct('w', x.w * {_FALL}, 't', x.t + x.w * {_FALL})).t))"""
_PICK = "named_struct('w', 1D, 't', 0D, 'pick', -1L)"
_DRAW = f"""element_at(transform({_SUMS}, s -> if(h.u * (s.above + s.below) < s.above or size(s.down) = 0,
    aggregate(s.up, {_PICK}, (x, k) -> named_struct('w', x.w * {_RISE}, 't', x.t + x.w, 'pick',
      if(x.pick < 0 and (x.t + x.w > h.u * (s.above + s.below) or k = s.top), k, x.pick))).pick,
    aggregate(s.down, {_PICK}, (x, k) -> named_struct('w', x.w * {_FALL}, 't', x.t + x.w * {_FALL}, 'pick',
      if(x.pick < 0 and (x.t + x.w * {_FALL} > h.u * (s.above + s.below) - s.above
                         or k = element_at(s.down, -1)), k, x.pick))).pick)), 1)"""


def hypergeometric(total: str, successes: str, draws: str, uniform: str) -> str:
    """SQL text of one draw; the arguments are SQL expressions."""
    return (f"element_at(transform(array(named_struct('pop', {total}, 'good', {successes}, 'draws', {draws}, "
            f"'u', {uniform})), h -> {_DRAW}), 1)")


def splitting_tree(sources: DataFrame, units: DataFrame, n_shards: int, seed: int = SEED) -> DataFrame:
    """(idx, shard, quota): exact quotas of every source in every shard."""
    per = sources.select("idx").join(units.groupBy("idx").agg(F.sum("copies").alias("q")), "idx", "left")
    pairs = F.sort_array(F.collect_list(F.struct("idx", F.coalesce("q", F.lit(0)).cast("long").alias("q"))))
    node = per.agg(F.transform(pairs, lambda p: p["q"]).alias("quotas")).select(
        F.lit(0).cast("long").alias("first"), F.lit(n_shards).cast("long").alias("span"), "quotas",
        F.expr("aggregate(quotas, 0L, (a, q) -> a + q)").alias("units"))
    uniform = (f"cast(xxhash64({seed}, first, span, i) & 9007199254740991L as double) / 9007199254740992D")
    draw = hypergeometric("acc.left", "quotas[i]", "acc.draws", uniform)
    share = "cast(floor(cast(units as decimal(38,0)) * {} / " + str(n_shards) + ") as bigint)"
    fold = f"""aggregate(sequence(0, size(quotas) - 1),
        named_struct('left', aggregate(quotas, 0L, (a, q) -> a + q), 'draws', draws, 'out', cast(array() as array<bigint>)),
        (acc, i) -> element_at(transform(array({draw}), x -> named_struct(
            'left', acc.left - quotas[i], 'draws', acc.draws - x, 'out', concat(acc.out, array(x)))), 1)).out"""
    for _ in range(n_shards.bit_length() - 1):
        node = node.withColumn("draws", F.expr(f"{share.format('(first + span div 2)')} - {share.format('first')}"))
        node = node.withColumn("gone", F.expr(f"if(size(quotas) = 0, quotas, {fold})"))
        node = node.select("units", F.explode(F.expr(
            "array(named_struct('first', first, 'span', span div 2, 'quotas', gone), "
            "named_struct('first', first + span div 2, 'span', span div 2, "
            "'quotas', zip_with(quotas, gone, (q, g) -> q - g)))")).alias("n"))
        node = node.select("n.first", "n.span", "n.quotas", "units")
    return node.select(F.col("first").alias("shard"), F.posexplode("quotas").alias("idx", "quota"))


def dealt(units: DataFrame, leaves: DataFrame, seed: int = SEED) -> DataFrame:
    """(idx, block, shards): every taken block with the shard of each of its copies."""
    order = Window.partitionBy("idx").orderBy(F.xxhash64(F.lit(seed), "idx", "block", "copy"), "block", "copy")
    one = units.where("copies > 0").select("idx", "block", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    one = one.withColumn("unit", F.row_number().over(order).cast("long"))
    upto = F.sum("quota").over(Window.partitionBy("idx").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    slots = leaves.withColumn("upto", upto).where("quota > 0").select(
        "idx", "shard", F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))).alias("unit"))
    return one.join(slots, ["idx", "unit"]).groupBy("idx", "block").agg(
        F.sort_array(F.collect_list("shard")).alias("shards"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, shard_words: int = SHARD_WORDS,
        seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, taken (size times copies) and shards (the
    output shard of every copy; empty if the mix leaves the row out)."""
    sizes = staged(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "mix-sizes")
    sources = staged(targets(sizes, weights, max_epochs), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("t")).first()["t"]
    n_shards = power_of_two(total / shard_words)
    blocked = in_block(sizes.withColumn("place", place_of(F.col("doc_id"), seed)), sources)
    units = staged(block_copies(blocked, max_epochs), "mix-units")
    shards = dealt(units, splitting_tree(sources, units, n_shards, seed), seed)
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(carried, F.col("source"), size_of(F.col("text")).alias("size"),
                       place_of(F.col("doc_id"), seed).alias("place"))
    placed = in_block(rows, sources).join(shards, ["idx", "block"], "left")
    kept = placed.select("row.*", F.struct("size", "source_size", "target", "shards").alias(fresh(docs, "mixed")))
    m = F.col(kept.columns[-1])
    shards_of = F.coalesce(m["shards"], F.array().cast("array<bigint>"))
    return with_result(kept, size=m["size"], source_size=m["source_size"], target=m["target"],
                       taken=m["size"] * F.size(shards_of), shards=shards_of).drop(kept.columns[-1])


def shuffled(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per copy in the mix: the row's columns with shard and position (from 0, a
    hash order inside the shard). Copies of a document in one shard are separate rows."""
    copies = mixed.select(*[F.col(f"`{c}`") for c in mixed.columns if c not in ("shards", "shard", "copy", "position")],
                          F.posexplode("shards").alias("copy", "shard"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "doc_id", "copy", "text"), "doc_id", "copy")
    return copies.withColumn("position", F.row_number().over(order) - 1)


def digest(mixed: DataFrame) -> DataFrame:
    """The contract's columns from ``mix``'s rows."""
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
