"""Phrase collocations by weighted acyclic automata over words.

A ``Transducer`` maps a phrase to its count: states with a weight, arcs labelled with words,
equal states kept once. The steps, all on Spark's partitions:

1. Every task turns its texts into runs of ``run_words`` words. The n-grams of a run come sorted,
   level by level, and states are registered from the last words up, so that equal ends of
   phrases share their states. A run is cut by prefix range: words are ordered by
   hash, and a cell is a range of that order at each word of the phrase, so a word or a
   pair that starts a large part of all phrases still spreads over many cells.
2. Transducers of one (language, cell) are united and their weights summed; what stays under
   ``min_count`` goes. Parts of a frequent phrase are frequent, so nothing that is asked later is lost.
3. Each cell's candidates ask for their parts' counts: a transducer of wanted phrases per
   (asking cell, answering cell), which is composed with the counts of the answering cell.
4. Candidates are scored with Python's exact integers, those inside a longer candidate of
   enough weight are dropped, and each language's best are ranked.

The number of cells grows with the bytes of text; no count, word or phrase is ever dropped
before the totals are known. A cell's transducers meet in one task.

Defined results: null texts count as empty; a null language is ``und``; repeated rows count again;
texts of any length are read whole, in runs that end between pieces; an empty
table gives no row; input columns other than the two read are not used.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskengine.llm.common import staged

MAX_WORDS = 3
MIN_COUNT = 10
CONTAINED_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
RUN_WORDS = 2_000_000
CELL_BYTES = 16 << 20
# Fixed values of the contract: lower case for A-Z, and the bytes that end a piece.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)
_LOW = (1 << 32) - 1

Level = tuple[np.ndarray, np.ndarray, np.ndarray]        # row of the level above, word, weight


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def in_order(words) -> list[bytes]:
    """The order of symbols: by hash, so that equal ranges hold equal shares of the words."""
    return sorted(words, key=lambda w: (word_hash(w), w))


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, their summed weights, the place of every key among them)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    sums = np.add.reduceat(weights[order], starts) if len(keys) else weights[:0]
    return ordered[starts], sums, place


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of ``starts[i] .. starts[i] + sizes[i] - 1``, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Transducer:
    """Counts of phrases. ``arcs[first[s]:first[s + 1]]`` leave state ``s``, in word order; an
    arc is ``word << 32 | state``. The last state is the root."""

    def __init__(self, words: list[bytes], weight: np.ndarray, first: np.ndarray, arcs: np.ndarray):
        self.words, self.weight, self.first, self.arcs = words, weight, first, arcs

    @classmethod
    def build(cls, words: list[bytes], levels: list[Level]) -> Transducer:
        """From sorted phrases, one level per length, each level sorted by (row above, word).
        States are registered from the longest phrases up: one with the same weight and arcs
        as an earlier state is that state."""
        used = np.unique(np.concatenate([w for _, w, _ in levels])) if levels else np.zeros(0, np.int64)
        weights, sizes, arcs, n = [], [], [], 0
        below = np.zeros(0, np.int64)                    # the arcs into the level below
        root = (np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))
        for k in range(len(levels), -1, -1):
            weight = levels[k - 1][2] if k else root[2]
            degree = np.bincount(levels[k][0], minlength=len(weight)) if k < len(levels) else np.zeros(len(weight), np.int64)
            start = np.cumsum(degree) - degree
            kind, member = cls._register(weight, degree, start, below)
            weights.append(weight[member])
            sizes.append(degree[member])
            arcs.append(below[ragged(start[member], degree[member])])
            if k:
                below = np.searchsorted(used, levels[k - 1][1]) << 32 | (n + kind)
            n += len(member)
        first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return cls([words[i] for i in used.tolist()], np.concatenate(weights), first, np.concatenate(arcs))

    @staticmethod
    def _register(weight, degree, start, arcs) -> tuple[np.ndarray, np.ndarray]:
        """(number of each row's state, one row for each state)."""
        kind, members, n = np.empty(len(weight), np.int64), [], 0
        few = np.flatnonzero(degree < 2)
        if len(few):                                     # at most one arc: compared as numbers
            single = np.full(len(few), -1, np.int64)
            has = degree[few] == 1
            single[has] = arcs[start[few[has]]]
            order = np.lexsort((single, weight[few]))
            w, a = weight[few][order], single[order]
            new = np.ones(len(few), bool)
            new[1:] = (w[1:] != w[:-1]) | (a[1:] != a[:-1])
            kind[few[order]] = np.cumsum(new) - 1
            members.append(few[order[new]])
            n = len(members[0])
        register: dict[tuple, int] = {}
        many, own = np.flatnonzero(degree >= 2), []
        raw = arcs.tobytes()
        for i, w, s, d in zip(many.tolist(), weight[many].tolist(), (8 * start[many]).tolist(), (8 * degree[many]).tolist()):
            state = register.setdefault((w, raw[s:s + d]), n + len(register))
            if state == n + len(own):
                own.append(i)
            kind[i] = state
        return kind, np.concatenate([*members, np.array(own, np.int64)])

    def walk(self) -> list[Level]:
        """All phrases, level by level, in order."""
        levels, at = [], np.array([len(self.weight) - 1])
        while True:
            sizes = self.first[at + 1] - self.first[at]
            if not sizes.any():
                return levels
            arcs = self.arcs[ragged(self.first[at], sizes)]
            parent = np.repeat(np.arange(len(at)), sizes)
            at = arcs & _LOW
            levels.append((parent, arcs >> 32, self.weight[at]))

    def follow(self, paths: list[np.ndarray]) -> np.ndarray:
        """Counts of phrases given by columns of own word numbers (-1: unknown); 0 if absent."""
        state_of = np.repeat(np.arange(len(self.weight)), np.diff(self.first))
        keys = state_of << 32 | self.arcs >> 32          # sorted: by state, then by word
        at = np.full(len(paths[0]), len(self.weight) - 1)
        alive = np.ones(len(at), bool)
        for word in paths:
            want = at << 32 | np.maximum(word, 0)
            place = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
            alive &= (word >= 0) & (keys[place] == want if len(keys) else False)
            at = np.where(alive, self.arcs[place] & _LOW if len(keys) else 0, 0)
        return np.where(alive, self.weight[at], 0)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Own numbers of other words; -1 for those it does not have."""
        own = {w: i for i, w in enumerate(self.words)}
        return np.array([own.get(w, -1) for w in words], np.int64)

    def dumps(self) -> bytes:
        import zstandard

        head = np.array([len(self.weight), len(self.arcs)], "<i8").tobytes()
        body = [self.weight.astype("<i8").tobytes(), np.diff(self.first).astype("<i4").tobytes(),
                (self.arcs >> 32).astype("<i4").tobytes(), (self.arcs & _LOW).astype("<i4").tobytes(), b" ".join(self.words)]
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(body))

    @classmethod
    def loads(cls, data: bytes) -> Transducer:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(data)
        n, m = np.frombuffer(raw, "<i8", 2).tolist()
        at = 16 + 8 * n
        column = lambda k, size: np.frombuffer(raw, "<i4", size, k).astype(np.int64)
        sizes, word, to = column(at, n), column(at + 4 * n, m), column(at + 4 * n + 4 * m, m)
        words = raw[at + 4 * n + 8 * m:]
        return cls(words.split(b" ") if words else [], np.frombuffer(raw, "<i8", n, 16).astype(np.int64),
                   np.concatenate([[0], np.cumsum(sizes)]), word << 32 | to)


def united(parts: list[Transducer]) -> tuple[list[bytes], list[Level]]:
    """The union of transducers, weights summed: all are walked together, level by level."""
    words = in_order({w for t in parts for w in t.words})
    place = {w: i for i, w in enumerate(words)}
    names = [np.array([place[w] for w in t.words], np.int64) for t in parts]
    walks, above, levels = [t.walk() for t in parts], [np.zeros(1, np.int64)] * len(parts), []
    for k in range(max(map(len, walks), default=0)):
        rows = [i for i, w in enumerate(walks) if k < len(w)]
        keys = np.concatenate([above[i][walks[i][k][0]] << 32 | names[i][walks[i][k][1]] for i in rows])
        found, weight, at = summed(keys, np.concatenate([walks[i][k][2] for i in rows]))
        levels.append((found >> 32, found & _LOW, weight))
        ends = np.cumsum([len(walks[i][k][0]) for i in rows])[:-1]
        for i, own in zip(rows, np.split(at, ends)):
            above[i] = own
    return words, levels


def pruned(levels: list[Level], least: int) -> list[Level]:
    """Phrases of at least ``least``, and what leads to them (with weight 0 if it has less)."""
    out, keep_below = [], None
    for k in range(len(levels) - 1, -1, -1):
        parent, word, weight = levels[k]
        keep = weight >= least
        if keep_below is not None:
            keep[levels[k + 1][0][keep_below]] = True
            moved = np.cumsum(keep) - 1
            out[0] = (moved[out[0][0]], *out[0][1:])
        out.insert(0, (parent[keep], word[keep], np.where(weight >= least, weight, 0)[keep]))
        keep_below = keep
    while out and not len(out[-1][0]):
        out.pop()
    return out


def paths_of(levels: list[Level]) -> list[list[np.ndarray]]:
    """For every level its phrases as columns of word numbers."""
    out: list[list[np.ndarray]] = []
    for parent, word, _ in levels:
        out.append([*(c[parent] for c in out[-1]), word] if out else [word])
    return out


# -- prefix ranges

def level_bits(bits: int, max_words: int) -> list[int]:
    """The bits of a cell that each word of a phrase gives: half of what is left."""
    out = []
    for k in range(max_words):
        out.append(bits - sum(out) if k == max_words - 1 else (bits - sum(out) + 1) // 2)
    return out


def cells(columns: list[np.ndarray], hashes: np.ndarray, bits: list[int]) -> np.ndarray:
    """The cell of phrases: for each word, its range in the order of hashes."""
    cell = np.zeros(len(columns[0]), np.int64)
    for k, b in enumerate(bits):
        part = (hashes[columns[k]] >> np.uint64(64 - b)).astype(np.int64) if k < len(columns) and b else 0
        cell = cell << b | part
    return cell


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.array([word_hash(w) for w in words], np.uint64)


def cut(words: list[bytes], levels: list[Level], bits: list[int]) -> Iterator[tuple[int, Transducer]]:
    """The transducer of every cell: its phrases, and with weight 0 what leads to them."""
    hashes = hashes_of(words)
    own = [cells(p, hashes, bits) for p in paths_of(levels)]
    pairs, extra = [None] * len(levels), np.zeros(0, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        pairs[k] = np.unique(np.concatenate([own[k] << 32 | np.arange(len(own[k])), extra]))
        extra = pairs[k] >> 32 << 32 | levels[k][0][pairs[k] & _LOW]
    for cell in np.unique(pairs[0] >> 32).tolist() if levels else []:
        part, above = [], None
        for k, (parent, word, weight) in enumerate(levels):
            a, b = np.searchsorted(pairs[k], [cell << 32, (cell + 1) << 32])
            if a == b:
                break
            rows = pairs[k][a:b] & _LOW
            up = np.searchsorted(above, parent[rows]) if k else np.zeros(len(rows), np.int64)
            part.append((up, word[rows], np.where(own[k][rows] == cell, weight[rows], 0)))
            above = rows
        yield cell, Transducer.build(words, part)


# -- counting

class Run:
    """The words of one language in a task's current run; 0 stands between pieces."""

    def __init__(self):
        self.ids, self.vocabulary = array("i"), {}

    def add(self, piece: list[bytes]) -> None:
        known = self.vocabulary
        for w in piece:
            if w not in known:
                known[w] = len(known) + 1
        self.ids.extend(map(known.__getitem__, piece))
        self.ids.append(0)

    def counted(self, max_words: int) -> tuple[list[bytes], list[Level]]:
        words = in_order(self.vocabulary)
        number = np.zeros(len(words) + 1, np.int64)
        number[[self.vocabulary[w] for w in words]] = np.arange(1, len(words) + 1)
        ids = number[np.frombuffer(self.ids, np.int32)]
        at, row, levels = np.flatnonzero(ids), np.zeros(np.count_nonzero(ids), np.int64), []
        for k in range(max_words):
            if k:                                        # the last id is 0, so no phrase leaves the run
                on = ids[at + k] > 0
                at, row = at[on], row[on]
            if not len(at):
                break
            found, weight, row = summed(row << 32 | (ids[at + k] - 1), np.ones(len(at), np.int64))
            levels.append((found >> 32, found & _LOW, weight))
        return words, levels


_PART = "lang string, cell long, blob binary"
_PART_ARROW = pa.schema([("lang", pa.string()), ("cell", pa.int64()), ("blob", pa.binary())])


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PART_ARROW.types)], schema=_PART_ARROW)


def shard_transducers(docs: DataFrame, bits: list[int], text: str, lang: str, run_words: int) -> DataFrame:
    """Step 1: (lang, cell, transducer) of every run."""
    slim = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                       F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, Run] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, r in runs.items():
                rows = [(name, cell, t.dumps()) for cell, t in cut(*r.counted(len(bits)), bits)]
                if rows:
                    yield _parts(rows)
            runs.clear()

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece in (data.as_py() or b"").translate(_FOLD).split(b"\n"):
                    words = piece.split()
                    if words:
                        runs.setdefault(name, Run()).add(words)
                        size += len(words)
                        if size >= run_words:
                            yield from flush()
                            size = 0
        yield from flush()

    return slim.mapInArrow(run, _PART)


def united_cells(parts: DataFrame, min_count: int) -> DataFrame:
    """Step 2: one transducer per (lang, cell) with the frequent phrases, and the words counted."""
    def unite(key: tuple, table: pa.Table) -> pa.Table:
        words, levels = united([Transducer.loads(x.as_py()) for x in table.column("blob")])
        n = int(levels[0][2].sum())
        blob = Transducer.build(words, pruned(levels, min_count)).dumps()
        return pa.table({"lang": [key[0].as_py()], "cell": pa.array([key[1].as_py()], pa.int64()),
                         "blob": pa.array([blob], pa.binary()), "words": pa.array([n], pa.int64())})

    return parts.groupBy("lang", "cell").applyInArrow(unite, f"{_PART}, words long")


# -- parts of candidates

def wanted(n: int) -> list[tuple[int, int]]:
    """The parts of a phrase of ``n`` words that its score and its containment need, as ranges."""
    ends = {(0, k) for k in range(1, n)} | {(k, n) for k in range(1, n)}
    return sorted(ends | {(i, j) for i in range(n) for j in range(i + 2, n + 1) if j - i < n})


def _candidates(t: Transducer) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(words, columns, counts) of the phrases of two words or more."""
    levels = t.walk()
    for k, columns in enumerate(paths_of(levels)):
        rows = levels[k][2] > 0
        if k and rows.any():
            yield k + 1, [c[rows] for c in columns], levels[k][2][rows]


def requests(found: DataFrame, bits: list[int]) -> DataFrame:
    """Step 3, asking: for every cell and every cell that holds parts of its candidates, a
    transducer of those parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, origin, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                t = Transducer.loads(blob)
                hashes, asked = hashes_of(t.words), []
                for n, columns, _ in _candidates(t):
                    for i, j in wanted(n):
                        part = columns[i:j]
                        asked.append((cells(part, hashes, bits), part))
                rows = []
                for target in np.unique(np.concatenate([c for c, _ in asked])).tolist() if asked else []:
                    own = [[x[c == target] for x in part] for c, part in asked]
                    rows.append((lang, target, origin, Transducer.build(t.words, _phrases(own)).dumps()))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.binary()))],
                        names=["lang", "cell", "origin", "asked"])

    return found.select("lang", "cell", "blob").mapInArrow(run, "lang string, cell long, origin long, asked binary")


def _phrases(sets: list[list[np.ndarray]]) -> list[Level]:
    """Levels of a set of phrases, each of weight 1."""
    sets = [s for s in sets if len(s[0])]
    rows, levels = [np.zeros(len(s[0]), np.int64) for s in sets], []
    for k in range(max(map(len, sets), default=0)):
        live = [i for i, s in enumerate(sets) if len(s) > k]
        keys = np.concatenate([rows[i] << 32 | sets[i][k] for i in live])
        found, weight, at = summed(keys, np.concatenate([np.full(len(rows[i]), int(len(sets[i]) == k + 1)) for i in live]))
        levels.append((found >> 32, found & _LOW, np.minimum(weight, 1)))
        for i, own in zip(live, np.split(at, np.cumsum([len(rows[i]) for i in live])[:-1])):
            rows[i] = own
    return levels


def composed(asked: Transducer, counts: Transducer) -> Transducer:
    """The asked phrases with their counts."""
    names, levels = counts.numbers(asked.words), []
    for (parent, word, weight), columns in zip(walk := asked.walk(), paths_of(walk)):
        levels.append((parent, word, np.where(weight > 0, counts.follow([names[c] for c in columns]), 0)))
    return Transducer.build(asked.words, levels)


def answers(found: DataFrame, asked: DataFrame) -> DataFrame:
    """Step 3, answering: (lang, cell that asked, transducer of counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, origin, composed(Transducer.loads(a), Transducer.loads(b)).dumps())
                    for lang, origin, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)))]
            if rows:
                yield _parts(rows)

    return asked.join(found.select("lang", "cell", "blob"), ["lang", "cell"]).select(
        "lang", "origin", "asked", "blob").mapInArrow(run, _PART)


# -- scores

def scored(found: DataFrame, answered: DataFrame, percent: int, scale: int) -> DataFrame:
    """Step 4: candidates with a, l, r and score, and a row for each phrase that a longer
    candidate drops (dropped = true)."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()),
                        ("r", pa.int64()), ("score", pa.int64()), ("dropped", pa.bool_())])

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        dropped: set[bytes] = set()
        counts = None
        if right.num_rows:
            counts = Transducer.build(*united([Transducer.loads(x.as_py()) for x in right.column("blob")]))
        for x in left.column("blob"):
            t = Transducer.loads(x.as_py())
            for n, columns, weight in _candidates(t):
                names = counts.numbers(t.words)
                of = {part: counts.follow([names[c] for c in columns[part[0]:part[1]]]).tolist() for part in wanted(n)}
                texts = list(zip(*([t.words[i] for i in c.tolist()] for c in columns)))
                for row, (a, words) in enumerate(zip(weight.tolist(), texts)):
                    least = min((scale * a * a // (of[0, k][row] * of[k, n][row]), k) for k in range(1, n))
                    k = least[1]
                    out.append((b" ".join(words), a, of[0, k][row], of[k, n][row], least[0], False))
                    dropped.update(b" ".join(words[i:j]) for i, j in wanted(n)
                                   if j - i > 1 and 100 * a >= percent * of[i, j][row])
        out.extend((w, None, None, None, None, True) for w in dropped)
        columns = list(zip(*out)) if out else [()] * 6
        lang = pa.array([key[0].as_py()] * len(out), pa.string())
        return pa.Table.from_arrays([lang, pa.array([w.decode() for w in columns[0]], pa.string()),
                                     *[pa.array(c, f) for c, f in zip(columns[1:], schema.types[2:])]], schema=schema)

    return found.select("lang", "cell", "blob").groupBy("lang", "cell").cogroup(answered.groupBy("lang", "cell")).applyInArrow(
        score, "lang string, phrase string, a long, l long, r long, score long, dropped boolean")


def cell_bits(docs: DataFrame, text: str, cell_bytes: int) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    return max(3, math.ceil(math.log2(max(1.0, size / cell_bytes))))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
         percent: int = CONTAINED_PERCENT, top: int = TOP, scale: int = SCALE, run_words: int = RUN_WORDS,
         cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    bits = level_bits(cell_bits(docs, text, cell_bytes), max_words)
    found = staged(united_cells(shard_transducers(docs, bits, text, lang, run_words), min_count), "phrase-cells")
    asked = staged(requests(found, bits), "phrase-requests")
    rows = staged(scored(found, answers(found, asked), percent, scale), "phrase-scores")
    kept = rows.where("not dropped").join(rows.where("dropped").select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    words = found.groupBy("lang").agg(F.sum("words").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
