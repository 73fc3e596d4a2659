"""Token-id output: documents' ids in ascending key order, packed into 64-bit words.

The file format is a table of shards. A shard is one Parquet file; its rows are blocks, in
order. A block holds whole documents, at least one, and closes at ``BLOCK_IDS`` ids:

  shard, first     number of the shard; ids of the shard in front of the block
  docs             per document its key and where its ids end inside the block
  n_ids            ids of the block
  marks            output position of every ``MARK_EVERY``-th word, so that a reader can
                   start decoding there
  words            little-endian 64-bit words, Simple-8b

A word's top four bits are its selector, the other 60 hold ``COUNTS[selector]`` ids of
``BITS[selector]`` bits, the first one lowest. The packer takes the selector with the most ids
that still fits. Selector 0 is the escape: the word after it is one value of up to 64 bits.
Places behind a block's last id are zero and not ids. Spark's own writer makes the files, so
a task that is lost or runs twice leaves whole files, on any store that Spark reaches.

Encoding is map-side behind one shuffle by key range: a text is cut into pieces at
single spaces and line ends between other characters, where no pre-token of a byte-level model
goes across, and each piece is encoded by the library once and kept in the worker's
bounded cache. ``check_cuts`` refuses a tokenizer whose ids change by cutting.

Defined results: a null text counts as empty and so has the end id alone; null keys come
first; rows of equal keys stand in the order of their texts' hashes; repeated rows are all
written; texts of any length are encoded in slices of ``SLICE_CHARS`` where a cut allows;
an empty table gives no row; other columns are not written.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.session import checkpoint_dir

# Fixed values of the code: ids to a word and bits to an id, by selector (0: escape).
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
ESCAPE, WIDEST = 0, 14
PAYLOAD = np.uint64((1 << 60) - 1)
_LIMITS = np.array([1 << int(b) for b in BITS[1:15]], np.uint64)
_NARROWEST = (np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right") + 1).astype(np.uint8)

END_ID = 2
BLOCK_IDS = 1 << 16
MARK_EVERY = 64
SHARD_BYTES = 32 << 20
MIN_SHARDS = 8
SLICE_CHARS = 1 << 20
CACHE_PIECES = 400_000
BROADCAST_SHARDS = 1 << 20
KEPT_CHARS = 64
ENDS = tuple(".,;:!?")

DOC = T.StructType([T.StructField("key", T.LongType()), T.StructField("end", T.LongType())])
BLOCK = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("docs", T.ArrayType(DOC)), T.StructField("marks", T.ArrayType(T.IntegerType())),
    T.StructField("words", T.BinaryType())])
_ARROW = pa.schema([
    ("shard", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()),
    ("docs", pa.list_(pa.struct([("key", pa.int64()), ("end", pa.int64())]))), ("marks", pa.list_(pa.int32())),
    ("words", pa.binary())])


# -- the code

def _chain(follows: np.ndarray, doublings: int = 5) -> np.ndarray:
    """0, follows[0], follows[follows[0]] ... below its length: one walk in strides of
    ``2 ** doublings`` steps, then the steps of all strides at once."""
    n = len(follows)
    one = np.append(np.minimum(follows, n), n)
    far = one
    for _ in range(doublings):
        far = far[far]
    at, walk = 0, []
    while at < n:
        walk.append(at)
        at = int(far[at])
    steps = [np.array(walk)]
    for _ in range((1 << doublings) - 1):
        steps.append(one[steps[-1]])
    chain = np.stack(steps, axis=1).ravel()
    return chain[chain < n]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, marks) of ids below 2^64."""
    values, n = np.ascontiguousarray(ids, np.uint64), len(ids)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, np.int32)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    need = _NARROWEST[np.minimum(padded, 0xFFFF)]        # the narrowest selector of each id
    large = np.flatnonzero(padded > 0xFFFF)
    need[large] = np.searchsorted(_LIMITS, padded[large], side="right") + 1
    every = min(int(need.max()), WIDEST + 1)             # from this selector on, all ids fit
    choice = np.full(n, every if every <= WIDEST else ESCAPE, np.int8)
    wide = np.zeros(n + 61, np.int32)
    fits = np.arange(n)
    for s in range(every - 1, 0, -1):                    # from few wide ids to many narrow ones
        if len(fits) * COUNTS[s] < n:
            fits = fits[(need[fits[:, None] + np.arange(COUNTS[s])] <= s).all(axis=1)]
        else:
            np.cumsum(need > s, out=wide[1:])
            fits = fits[wide[fits + COUNTS[s]] == wide[fits]]
        if not len(fits):
            break
        choice[fits] = s
    starts = _chain(np.arange(n) + np.maximum(COUNTS[choice], 1))
    chosen = choice[starts]
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(chosen == ESCAPE)[:-1]])
    words = np.zeros(int(place[-1]) + 1 + int(chosen[-1] == ESCAPE), np.uint64)
    for s in np.unique(chosen):
        own = chosen == s
        if s == ESCAPE:
            words[place[own] + 1] = values[starts[own]]
            continue
        first = starts[own]
        word = padded[first] | np.uint64(int(s) << 60)
        for i in range(1, COUNTS[s]):
            word |= padded[first + i] << np.uint64(i * int(BITS[s]))
        words[place[own]] = word
    return words.astype("<u8"), starts[::MARK_EVERY].astype(np.int32)


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of ``pack``'s words, all words of a selector at once."""
    words = words.astype(np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    literal = np.zeros(len(words), bool)                 # raw values look like any word:
    for i in np.flatnonzero(selector == ESCAPE):         # they stand behind an escape
        if not literal[i]:
            literal[i + 1] = True
    counts = np.where(literal, 1, COUNTS[selector])
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    out[ends[literal] - 1] = words[literal]
    for s in np.unique(selector[~literal]):
        if s == ESCAPE:
            continue
        own = (selector == s) & ~literal
        width, mask = np.uint64(BITS[s]), np.uint64((1 << int(BITS[s])) - 1)
        rest, first = words[own] & PAYLOAD, ends[own] - COUNTS[s]
        for i in range(COUNTS[s]):
            out[first + i] = rest & mask
            rest >>= width
    return out[:n]


# -- the tokenizer

def load_tokenizer(data: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"       # Spark's tasks are the parallel part
    import tokenizers

    return tokenizers.Tokenizer.from_str(data)


def check_cuts(data: str) -> None:
    """Only a byte-level model that cuts by its own pattern and adds nothing may be cut."""
    spec = json.loads(data)
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    if (spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
            or spec["model"].get("dropout") or any(a["lstrip"] or a["rstrip"] or re.search(r"^\w|\s", a["content"]) for a in added)):
        raise ValueError("this tokenizer's ids can depend on text across a cut")


_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
_SPACE_CUT = re.compile(r"(?<=\S)(?= \S)")
FIRST = " "                                              # no piece of a split holds a space
# A word that starts with one pre-token of letters, and what may follow that at once:
# neither a letter nor a mark of one.
_WORD = re.compile(r"([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]{1,64})([!-@\[-`{-~][!-~]{0,63})?").fullmatch


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """The text in slices of about ``size`` characters, each but the first starting at a
    single space in front of a word."""
    start = 0
    while len(text) - start > size:
        found = _SPACE_CUT.search(text, start + size)
        if not found:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:] if start else text


class Encoder(dict):
    """Ids of texts as little-endian 32-bit bytes, word by word; the library encodes a
    pre-token once while the worker's caches hold it. The entry of a word is what it adds behind
    a space, that of a line end and a word what both add behind a word; None for one that
    single spaces and line ends do not cut off.

    A cache has two generations: one that has grown to ``limit`` entries becomes the older
    one, whose entries stay only if they are asked for again."""

    def __init__(self, data: str, limit: int = CACHE_PIECES):
        super().__init__()
        self.model, self.limit = load_tokenizer(data), limit
        cut = self.model.pre_tokenizer.pre_tokenize_str
        self.bytes = {ord(c): cut(c)[0][0] for c in map(chr, range(0x41, 0x100)) if _WORD(c)}
        self.space = cut(" a")[0][0][:-1]
        self.letters, self.pieces = {}, {}
        self.line_end = self.alone("\n")
        self.older, self.older_letters = {}, {}

    def age(self) -> None:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        if len(self.letters) > self.limit:
            self.letters, self.older_letters = {}, self.letters
        if len(self.pieces) > self.limit // 4:
            self.pieces = {}

    def alone(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of what lies between two cuts."""
        found = self.pieces.get(text)
        if found is None:
            found = self.alone(text)
            if len(text) <= KEPT_CHARS:
                self.pieces[text] = found
        return found

    def careful(self, text: str) -> bytes:
        """Ids of a text with any white space, cut wherever that is safe."""
        return b"".join([self.piece(x) for x in _CUT.split(text)])

    def token(self, letters: str, lead: str = "") -> bytes:
        """One pre-token, letters behind a space or nothing, goes to the library's model at once."""
        form = letters if letters.isascii() else letters.translate(self.bytes)
        return array("I", [t.id for t in self.model.model.tokenize(lead + form)]).tobytes()

    def behind_space(self, letters: str) -> bytes:
        found = self.letters.get(letters) or self.older_letters.get(letters)
        if found is None:
            found = self.token(letters, self.space)
        self.letters[letters] = found
        return found

    def behind_line_end(self, word: str) -> bytes:
        m = _WORD(word)
        if not m:
            return self.line_end + self.careful(word)
        letters, rest = m.groups()
        return self.line_end + self.token(letters) + (self.piece(rest) if rest else b"")

    def __missing__(self, word: str) -> bytes | None:
        found = self.older.get(word)
        if found is None:
            if word.isascii() and len(word) <= KEPT_CHARS:   # the usual forms of _WORD, without it
                if word.isalpha():
                    self[word] = found = self.behind_space(word)
                    return found
                if word[-1:] in ENDS and word[:-1].isalpha():
                    self[word] = found = self.behind_space(word[:-1]) + self.piece(word[-1])
                    return found
            m = _WORD(word)
            if m:
                letters, rest = m.groups()
                # A word of letters alone is one object in both caches.
                found = self.behind_space(letters) + self.piece(rest) if rest else self.behind_space(word)
            elif word == FIRST:
                found = b""
            elif word and not word[-1].isspace():
                if not word[0].isspace():
                    found = self.careful(" " + word)
                elif word[0] == "\n" and not word[1].isspace():
                    found = self.behind_line_end(word[1:])
                if len(word) > KEPT_CHARS:
                    return found
        self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        out, known = [], self.__getitem__
        for part in slices(text) if len(text) > SLICE_CHARS else (text,):
            self.age()
            # A line's first word is a word of its own. An empty one stands where a line end
            # follows a space, a bare line end where one precedes: such texts are cut with care.
            words = part.replace("\n", " \n").split(" ")
            first, words[0] = words[0], FIRST            # nothing stands in front of it
            try:
                found = b"".join(map(known, words))
            except TypeError:                            # other white space than single spaces
                out.append(self.careful(part))
                continue
            if first and first[-1].isspace():
                out.append(self.careful(part))
            else:
                out.extend([self.careful(first), found] if first else [found])
        return b"".join(out)


_ENCODERS: dict[int, Encoder] = {}


def encoder(data: str, limit: int) -> Encoder:
    """One encoder to a worker process, kept from task to task."""
    key = hash((data, limit))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(data, limit)
    return _ENCODERS[key]


# -- the jobs

def shard_count(docs: DataFrame, text: str, shard_bytes: int, least: int) -> int:
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, math.ceil(size / shard_bytes))


def packed(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
           shard_bytes: int = SHARD_BYTES, min_shards: int = MIN_SHARDS, block_ids: int = BLOCK_IDS,
           cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """The blocks of the file format, one shard to a task, in ascending key order."""
    with open(tokenizer_path, encoding="utf-8") as f:
        data = f.read()
    check_cuts(data)
    sent = docs.sparkSession.sparkContext.broadcast(data)     # a tokenizer file: a few MB
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    order = [F.asc_nulls_first("key"), F.xxhash64("text"), F.asc("spread")]
    # Equal rows are dealt out by their place in the input: their order changes nothing.
    ranged = rows.withColumn("spread", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(shard_count(docs, text, shard_bytes, min_shards), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shard = encoder(sent.value, cache_pieces), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        first, size, parts, docs_of = 0, 0, [], []

        def block() -> pa.RecordBatch:
            words, marks = pack(np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_pylist([{"shard": shard, "first": first, "n_ids": size, "docs": docs_of,
                                                "marks": marks.tolist(), "words": words.tobytes()}], schema=_ARROW)

        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for k, ids in zip(batch.column(0).to_pylist(), map(model.ids, texts)):
                own = ids + end
                if docs_of and size + len(own) // 4 > block_ids:
                    yield block()
                    first, size, parts, docs_of = first + size, 0, [], []
                parts.append(own)
                size += len(own) // 4
                docs_of.append({"key": k, "end": size})
        if docs_of:
            yield block()

    return ranged.mapInArrow(run, BLOCK)


def write(docs: DataFrame, tokenizer_path: str, path: str, **options) -> None:
    """Write the ids of ``docs`` as shards under ``path``."""
    packed(docs, tokenizer_path, **options).write.option("compression", "none").parquet(path)


def shard_starts(blocks: DataFrame, group: int = 1024) -> DataFrame:
    """(shard, start): ids of all shards before. Prefix sums in groups of shards, so that one
    task sums ``1 / group`` of the shards."""
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("g", F.floor(F.col("shard") / group))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = shards.select("shard", "g", before(Window.partitionBy("g").orderBy("shard")).alias("inner_start"))
    groups = shards.groupBy("g").agg(F.sum("n").alias("n")).select("g", before(Window.orderBy("g")).alias("outer_start"))
    return inside.join(groups, "g").select("shard", (F.col("inner_start") + F.col("outer_start")).alias("start"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, decoded from the files: key, start, n_tokens, ids (raw
    little-endian 32-bit)."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    result = T.StructType([T.StructField("shard", T.LongType()), T.StructField("key", T.LongType()),
                           T.StructField("place", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    arrow = pa.schema([("shard", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, n, docs = (batch.column(c)[i].as_py() for c in range(4))
                ids = unpack(np.frombuffer(batch.column(4)[i].as_buffer(), "<u8"), n).astype("<u4").tobytes()
                ends = [0, *(d["end"] for d in docs)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(docs), pa.int64()), pa.array([d["key"] for d in docs], pa.int64()),
                    pa.array([first + e for e in ends[:-1]], pa.int64()),
                    pa.array([b - a for a, b in zip(ends, ends[1:])], pa.int64()),
                    pa.array([ids[4 * a:4 * b] for a, b in zip(ends, ends[1:])], pa.binary())], schema=arrow)

    docs = blocks.select("shard", "first", "n_ids", "docs", "words").mapInArrow(run, result)
    starts = shard_starts(blocks.select("shard", "n_ids"))
    if len(blocks.inputFiles()) <= BROADCAST_SHARDS:     # one row of two numbers per file
        starts = F.broadcast(starts)
    return docs.join(starts, "shard").select("key", (F.col("start") + F.col("place")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the ids to the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/riskengine-llm-token-ids-{uuid.uuid4().hex}"
    write(docs, tokenizer_path, path, **options)
    return read_back(spark, path)


def digest(decoded: DataFrame) -> DataFrame:
    """The contract's columns."""
    return decoded.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
