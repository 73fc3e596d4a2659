"""Substring dedup: every fixed-length token window is hashed (Rabin-Karp, modulo 2^64),
the hashes are counted in Spark, and the words covered by repeated windows are removed;
repeated windows that overlap or touch merge into maximal removal intervals.

Layout. Documents are dealt by hash into chunks of about ``chunk_bytes`` of text. A
chunk's task hashes its windows, keeps each distinct hash once with a flag "repeats in
here", and sends them as sorted 8-byte arrays to hash-range buckets, so the shuffle
carries 8 bytes a window instead of a row. A bucket's task marks the hashes that came
from two chunks or repeat in one, and answers each chunk with one bit per hash it sent.
The chunk's task, over the same text shuffle, hashes again and applies the answers.
Chunks and buckets are counted from the corpus size, so their size stays the same as the
corpus grows; a window that a third of all documents share reaches its bucket once per
chunk.

A window is judged on the input alone. Equal windows always have equal hashes; two
different ones share one of 2^64 values with a chance of about n^2 / 2^65 for n windows.

Defined results: null, empty and short texts have no windows and lose nothing; identical
rows are separate documents, so their windows repeat; an empty table gives an empty
result; clashing input columns are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.llm.common import power_of_two

WINDOW = 35
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
BYTES_A_WORD = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


class WordHashes(dict):
    """64-bit hashes of words, each computed once per chunk."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(hashes: np.ndarray, window: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of every window of word hashes: prefix sums of h_i / B^i, times
    B^start, are sum(h_(start+j) / B^j); a finaliser then spreads the bits."""
    n = len(hashes) - window + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * down[:len(hashes)], out=total[1:])
    h = (total[window:] - total[:-window]) * up[:n]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Chunk:
    """The documents of one chunk in a fixed order, with their words and window hashes."""

    def __init__(self, table: pa.Table, window: int):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] is None, texts[i] or b""))
        self.ids = [ids[i] for i in order]
        self.words = [texts[i].split() if texts[i] else [] for i in order]
        known = WordHashes()
        longest = max(map(len, self.words), default=0)
        up, down = powers(_BASE, longest), powers(_BASE_INVERSE, longest)
        each = [window_hashes(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)), window, up, down)
                if len(w) >= window else np.empty(0, np.uint64) for w in self.words]
        self.counts = [len(h) for h in each]
        every = np.concatenate(each) if each else np.empty(0, np.uint64)
        self.values, self.place, times = np.unique(every, return_inverse=True, return_counts=True)
        self.repeats = times > 1

    def bucket_starts(self, log_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets present, and where each begins in the sorted values."""
        if not log_buckets:
            return np.zeros(min(1, len(self.values)), np.int64), np.zeros(min(1, len(self.values)), np.int64)
        bucket = (self.values >> np.uint64(64 - log_buckets)).astype(np.int64)
        return np.unique(bucket, return_index=True)


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Words covered by the windows that start at the marked positions."""
    step = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return np.cumsum(step[:-1]) > 0


def intervals(gone: np.ndarray) -> list[int]:
    """Flat [start, end, ...] of the maximal runs of covered words."""
    return np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).tolist()


def _send(window: int, log_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        buckets, starts = chunk.bucket_starts(log_buckets)
        ends = np.r_[starts[1:], len(chunk.values)]
        number = table.column("chunk")[0].as_py()
        return pa.table({
            "chunk": pa.array([number] * len(buckets), pa.int64()), "bucket": pa.array(buckets, pa.int64()),
            "hashes": pa.array([chunk.values[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            "repeats": pa.array([np.packbits(chunk.repeats[a:b]).tobytes() for a, b in zip(starts, ends)], pa.binary())})
    return run


def _answer(table: pa.Table) -> pa.Table:
    """One bit per hash sent: it repeats in its chunk or came from another chunk too."""
    sent = [np.frombuffer(b, np.uint64) for b in table.column("hashes").to_pylist()]
    sizes = [len(s) for s in sent]
    values = np.concatenate(sent)
    twice = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
                            for b, n in zip(table.column("repeats").to_pylist(), sizes)])
    order = np.argsort(values)
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    marks = np.zeros(len(values), bool)
    marks[order[1:]] |= same
    marks[order[:-1]] |= same
    marks |= twice
    parts = np.split(marks, np.cumsum(sizes)[:-1])
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"),
                     "marks": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})


def _apply(window: int, log_buckets: int, keep_text: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(docs, window)
        buckets, starts = chunk.bucket_starts(log_buckets)
        ends = np.r_[starts[1:], len(chunk.values)]
        marked = np.zeros(len(chunk.values), bool)
        told = dict(zip(answers.column("bucket").to_pylist(), answers.column("marks").to_pylist()))
        for bucket, a, b in zip(buckets.tolist(), starts, ends):
            marked[a:b] = np.unpackbits(np.frombuffer(told[bucket], np.uint8), count=b - a)
        repeated = marked[chunk.place]
        n_words, n_removed, digests, gaps, kept = [], [], [], [], []
        at = 0
        for words, count in zip(chunk.words, chunk.counts):
            gone = covered(repeated[at:at + count], len(words), window)
            at += count
            left = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if gone.any() else b" ".join(words)
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            digests.append(hashlib.sha256(left).hexdigest())
            gaps.append(intervals(gone))
            kept.append(left.decode() if keep_text else None)
        return pa.table({
            "doc_id": pa.array(chunk.ids, docs.schema.field("doc_id").type), "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
            "intervals": pa.array(gaps, pa.list_(pa.int64())), "kept_text": pa.array(kept, pa.string())})
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES,
                   bucket_bytes: int = BUCKET_BYTES, text: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, intervals (flat
    word positions [start, end, ...] removed) and, with ``keep_text``, the kept words."""
    base = docs.select("doc_id", F.col(text).alias("text"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n_chunks = max(1, -(-size // chunk_bytes))
    log_buckets = power_of_two(size / BYTES_A_WORD * 8 / bucket_bytes).bit_length() - 1
    dealt = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks).cast("long")))
    sent = dealt.groupBy("chunk").applyInArrow(
        _send(window, log_buckets), "chunk long, bucket long, hashes binary, repeats binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket long, marks binary")
    schema = T.StructType([
        T.StructField("doc_id", base.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()),
        T.StructField("intervals", T.ArrayType(T.LongType())), T.StructField("kept_text", T.StringType())])
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _apply(window, log_buckets, keep_text), schema)
