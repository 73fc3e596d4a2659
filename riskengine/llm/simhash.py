"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into ``distance // 2 + 1`` segments. Two fingerprints within
``distance`` bits have a segment with at most one differing bit, so the index holds, for
every bit, the segment with that bit wildcarded: equal variants meet in an equality
shuffle and their distance is verified. Texts with equal fingerprints are one node, so
copies are never compared. Within a variant's group a pair is verified only where the
wildcarded bit differs, or once, at the segment's first bit, if the segments are equal.

A group never becomes a list of pairs. It streams through its task in blocks of
``block`` fingerprints, and a breadth-first search emits only a spanning forest of its
links (same components, no link lost between components). A group larger than a block is
dealt out again as pairs of its blocks, so no task holds more than two blocks of a group.
Components come from alternating large-star and small-star steps over the links, each
written to the shared folder.

Defined results: null, empty and wordless texts have fingerprint zero and link like any
other; a row without a doc_id has no component and links nothing; repeated rows share a
fingerprint; an empty table gives an empty result; clashing input columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.llm.common import fresh, staged, with_result

SHINGLE = 4
DISTANCE = 4
SEED = 42
BLOCK = 4096
SMALL = 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, as a signed 64-bit int."""
    words = data.lower().split() if data else []  # bytes.lower changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = (end - size)[:1 - shingle].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start, end[shingle - 1:].tolist())),
                             np.uint64, len(start))
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", text_hash: bool = False) -> DataFrame:
    """(doc_id, fp) of every row; with ``text_hash`` also h, a hash of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(b, shingle) for b in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]],
                                             names=["doc_id", "fp", *batch.schema.names[2:]])

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())]
    given = docs.select("doc_id", text)
    if text_hash:
        given, fields = docs.select("doc_id", text, F.xxhash64(text).alias("h")), [*fields, T.StructField("h", T.LongType())]
    return given.mapInArrow(run, T.StructType(fields))


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; the last ones take the odd bits."""
    m = distance // 2 + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(fps: DataFrame, distance: int) -> DataFrame:
    """(bit, part, fp): for every bit, its segment's value with that bit cleared."""
    rows = []
    for first, width in segments(distance):
        mask = (1 << width) - 1
        for p in range(width):
            rows.append(F.struct(
                F.lit(first + p).alias("bit"),
                F.shiftrightunsigned("fp", first).bitwiseAND(F.lit(mask & ~(1 << p)).cast("long")).alias("part")))
    return fps.select("fp", F.explode(F.array(*rows)).alias("v")).select("v.bit", "v.part", "fp")


def _forest(fps: np.ndarray, bit: int, first: bool, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a group's fingerprints that this bit verifies."""
    left = fps
    links: list[tuple[int, int]] = []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            diff = left ^ x
            near = np.bitwise_count(diff) <= distance
            if not first:
                near &= (diff >> np.uint64(bit)) & np.uint64(1) == 1
            if near.any():
                found = left[near]
                links.extend((int(x), int(y)) for y in found)
                front.extend(found)
                left = left[~near]
    return links


def _small_links(fps, bits, starts, ends, chosen, firsts, distance: int) -> list[tuple[int, int]]:
    """The links inside the chosen groups, each of ``SMALL`` rows at most, all at once."""
    rows = np.flatnonzero(np.repeat(chosen, ends - starts))
    end = np.repeat(ends, ends - starts)[rows]
    whole = np.isin(np.arange(64), list(firsts))
    out: list[tuple[int, int]] = []
    step = 1
    while len(rows):
        inside = rows + step < end
        rows, end = rows[inside], end[inside]
        diff = fps[rows] ^ fps[rows + step]
        at = bits[rows]
        near = (np.bitwise_count(diff) <= distance) & (whole[at] | ((diff >> at.astype(np.uint64)) & np.uint64(1) == 1))
        out.extend(zip(fps[rows[near]].tolist(), fps[rows[near] + step].tolist()))
        step += 1
    return out


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


_FOUND = "a long, b long, bit int, part long, block int, members binary"


def _group_links(distance: int, block: int):
    firsts = {first for first, _ in segments(distance)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by (bit, part). Small groups give links, large ones blocks."""
        group, held, blocks = None, np.empty(0, np.uint64), 0
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bit", pa.int32()), ("part", pa.int64()),
                            ("block", pa.int32()), ("members", pa.binary())])

        def table(links, cut):
            ab = _signed(links).reshape(-1, 2)
            n, m = len(ab), len(cut)
            return pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(ab[:, 0]), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.array(ab[:, 1]), pa.nulls(m, pa.int64())]),
                pa.array([None] * n + [c[0] for c in cut], pa.int32()),
                pa.array([None] * n + [c[1] for c in cut], pa.int64()),
                pa.array([None] * n + [c[2] for c in cut], pa.int32()),
                pa.array([None] * n + [c[3] for c in cut], pa.binary())], schema=schema)

        def close(links, cut):
            if group is None:
                return
            if blocks:
                if len(held):
                    cut.append((*group, blocks, held.tobytes()))
            elif len(held) > 1:
                links.extend(_forest(held, group[0], group[0] in firsts, distance))

        for batch in batches:
            links: list[tuple[int, int]] = []
            cut: list[tuple] = []
            bits = batch.column(0).to_numpy()
            parts = batch.column(1).to_numpy()
            fps = batch.column(2).to_numpy().view(np.uint64)
            if not len(fps):
                continue
            starts = np.flatnonzero(np.r_[True, (bits[1:] != bits[:-1]) | (parts[1:] != parts[:-1])])
            ends = np.r_[starts[1:], len(fps)]
            # A group of one row cannot link; the first and last may go on in another batch.
            size = ends - starts
            inner = np.ones(len(starts), bool)
            inner[[0, -1]] = False
            links.extend(_small_links(fps, bits, starts, ends, inner & (size > 1) & (size <= SMALL), firsts, distance))
            for i in sorted({0, len(starts) - 1, *np.flatnonzero(size > SMALL).tolist()}):
                a, b = starts[i], ends[i]
                key = (int(bits[a]), int(parts[a]))
                if key != group:
                    close(links, cut)
                    group, held, blocks = key, np.empty(0, np.uint64), 0
                held = np.concatenate([held, fps[a:b]])
                while len(held) > block:
                    cut.append((*group, blocks, held[:block].tobytes()))
                    held, blocks = held[block:], blocks + 1
            yield table(links, cut)
        links, cut = [], []
        close(links, cut)
        yield table(links, cut)
    return run


def _block_links(distance: int):
    firsts = {first for first, _ in segments(distance)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fps = np.frombuffer(row["m1"] + row["m2"] if row["b1"] != row["b2"] else row["m1"], np.uint64)
                ab = _signed(_forest(fps, row["bit"], row["bit"] in firsts, distance)).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])
    return run


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b) links that connect all fingerprints within ``distance`` bits of each other.
    ``fps``: distinct values in a column fp."""
    found = staged(
        variants(fps, distance).repartition("bit", "part").sortWithinPartitions("bit", "part")
        .mapInArrow(_group_links(distance, block), _FOUND), "simhash-found")
    cut = found.where("members is not null")
    x = cut.select("bit", "part", F.col("block").alias("b1"), F.col("members").alias("m1"))
    y = cut.select("bit", "part", F.col("block").alias("b2"), F.col("members").alias("m2"))
    pairs = x.join(y, ["bit", "part"]).where("b1 <= b2")
    pairs = pairs.repartition(F.xxhash64("bit", "part", "b1", "b2"))
    more = pairs.mapInArrow(_block_links(distance), "a long, b long")
    return found.where("members is null").select("a", "b").union(more).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node u of a component above its smallest node v. ``edges``: u > v."""
    def star(pairs: DataFrame) -> DataFrame:
        """Each node's neighbours are linked to the smallest of the node and its neighbours."""
        least = pairs.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        return pairs.join(least, "u")

    def size(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = staged(edges, "simhash-edges")
    before = size(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v"))
        large = large.where("u > v").distinct()
        small = star(large)
        small = small.select(F.col("v").alias("u"), F.col("w").alias("v")).union(
            small.select("u", F.col("w").alias("v"))).where("u > v").distinct()
        edges = staged(small, "simhash-edges")
        after = size(edges)
        if after == before:
            break
        before = after
    return edges


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, text: str = "text",
                    block: int = BLOCK, text_hash: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``: the smallest doc_id reachable."""
    marked = staged(fingerprints(docs, shingle, text, text_hash), "simhash-fp")
    fps = staged(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id")),
                 "simhash-distinct")
    tree = components(links(fps.select("fp"), distance, block))
    member = tree.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(
        tree.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    member = member.join(fps, "fp")
    root = member.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = member.join(root, "root").select("fp", "least_id")
    whole = fps.join(linked, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    out = marked.join(whole, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
                      *(["h"] if text_hash else []))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``near_duplicates``' output."""
    return with_result(found, fingerprint=F.lower(F.lpad(F.hex("fp"), 16, "0"))).select(
        "doc_id", "fingerprint", "component_id")


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of every component, that of the smallest (doc_id, fingerprint, hash of the
    text); of rows that repeat an id and a text, the one whose columns' hash is smallest. Rows that
    share an id but are no near copies are judged apart. Rows without a doc_id cannot be told
    apart and all stay."""
    rows = near_duplicates(docs, shingle, distance, text_hash=True).where("doc_id is not null")
    least = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "fp", "h")).alias("m"))
    h, columns = fresh(docs, "text_hash"), [F.col(f"`{c}`") for c in docs.columns]
    keep = least.select("m.doc_id", F.col("m.h").alias(h))
    named = docs.withColumn(h, F.xxhash64("text")).join(keep, ["doc_id", h], "left_semi")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    one = named.groupBy(F.col("doc_id").alias("i"), F.col(h).alias("t")).agg(
        F.min_by(F.struct(*columns), F.xxhash64(*hashed)).alias("row")).select("row.*")
    return one.unionByName(docs.where("doc_id is null"))
