"""Benchmark decontamination: a broadcast hash set of the normalised test n-grams is
scanned over every document's word windows; hits are verified word by word.

The benchmark is the small, stated query set. Its text is measured first: up to
``part_bytes`` one broadcast index is built; beyond that the items are dealt by hash
into parts and the documents are scanned once per part, with the hit words carried
along, so no broadcast grows with the data and no item is left out.

Defined results: a null or wordless text has no words and no hits; a null or wordless
benchmark item has no windows; an item without an id marks words but is not listed;
repeated documents are judged row by row; an empty benchmark hits nothing; an input
column named like a result column is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.llm.common import fresh, with_result

N_GRAM = 10
PART_BYTES = 32 << 20
_MULT = 0x9E3779B97F4A7C15


def _fold_table() -> bytes:
    """A-Z to a-z; word bytes stay (0-9, a-z, every byte of a non-ASCII character); the
    rest becomes a space. One byte for one byte, so offsets are kept."""
    out = []
    for c in range(256):
        if 0x41 <= c <= 0x5A:
            c += 0x20
        word = 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80
        out.append(c if word else 0x20)
    return bytes(out)


FOLD = _fold_table()


def folded_words(data: bytes | None) -> list[bytes]:
    return data.translate(FOLD).split() if data else []


class GramIndex:
    """Windows of the benchmark items: word codes, a hash filter and the exact windows."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int = N_GRAM, filter_bits: int = 20):
        self.codes: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, list[str]]] = {}
        for item_id, data in items:
            words = folded_words(data)
            if not words:
                continue
            row = np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in words], np.int64)
            size = min(n, len(words))
            table = self.windows.setdefault(size, {})
            for i in range(len(words) - size + 1):
                ids = table.setdefault(row[i:i + size].tobytes(), [])
                if item_id is not None and item_id not in ids:
                    ids.append(item_id)
        self.mask = np.uint64((1 << filter_bits) - 1)
        self.filters = {}
        for size, table in self.windows.items():
            keys = np.frombuffer(b"".join(table), np.int64).reshape(-1, size)
            seen = np.zeros(1 << filter_bits, bool)
            seen[self._hash(keys.T, len(keys), size, rows=True)] = True
            self.filters[size] = seen

    def _hash(self, codes: np.ndarray, count: int, size: int, rows: bool = False) -> np.ndarray:
        """Polynomial window hashes, folded to the filter's bits."""
        h = np.zeros(count, np.uint64)
        for j in range(size):
            part = codes[j] if rows else codes[j:j + count]
            h = h * np.uint64(_MULT) + part.astype(np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return ((h >> np.uint64(40)) & self.mask).astype(np.int64)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items hit."""
        n = len(words)
        hit = np.zeros(n, bool)
        items: set[str] = set()
        if not n:
            return hit, items
        get = self.codes.get
        codes = np.fromiter((get(w, 0) for w in words), np.int64, n)
        for size, table in self.windows.items():
            count = n - size + 1
            if count < 1:
                continue
            for i in np.flatnonzero(self.filters[size][self._hash(codes, count, size)]):
                found = table.get(codes[i:i + size].tobytes())
                if found is not None:
                    hit[i:i + size] = True
                    items.update(found)
        return hit, items


def cut_hits(data: bytes, hit: np.ndarray) -> str:
    """The text without its hit words; the separators next to a removed run collapse to
    the one before it."""
    spans = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(FOLD))]
    out, pos = [], 0
    i = 0
    while i < len(spans):
        if not hit[i]:
            i += 1
            continue
        j = i
        while j + 1 < len(spans) and hit[j + 1]:
            j += 1
        out.append(data[pos:spans[i][0]])
        pos = spans[j + 1][0] if j + 1 < len(spans) else spans[j][1]
        i = j + 1
    out.append(data[pos:])
    return b"".join(out).decode("utf-8")


def _scanner(index, names: list[str], text_at: int, first: bool, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = index.value
        for batch in batches:
            cols = list(batch.columns) if first else list(batch.columns[:-5])
            before = None if first else [batch.column(c).to_pylist() for c in (len(cols) + 2, len(cols) + 3)]
            n_words, n_hit, marks, items, texts = [], [], [], [], []
            for k, data in enumerate(batch.column(text_at).cast(pa.binary()).to_pylist()):
                words = folded_words(data)
                hit, found = grams.scan(words)
                if before is not None:
                    if before[0][k]:
                        hit |= np.unpackbits(np.frombuffer(before[0][k], np.uint8), count=len(words)).astype(bool)
                    found |= set(before[1][k])
                n_words.append(len(words))
                n_hit.append(int(hit.sum()))
                marks.append(np.packbits(hit).tobytes() if n_hit[-1] else b"")
                items.append(sorted(found))
                texts.append(cut_hits(data, hit) if cut and n_hit[-1] else None)
            arrays = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(marks, pa.binary()),
                      pa.array(items, pa.list_(pa.string())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *arrays], names=names)
    return run


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N_GRAM, part_bytes: int = PART_BYTES,
         text: str = "text", cut: bool = False) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_bits (bit i of the packed bytes: word i is hit;
    empty if none), items (ids of the items hit, as sorted strings) and cut_text (with
    ``cut``, the text without hit words where any is hit, else null)."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, math.ceil(total / part_bytes))
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    results = ("n_words", "n_hit", "hit_bits", "items", "cut_text")
    internal = [fresh(docs, f"scan_{x}") for x in results]
    kinds = (T.LongType(), T.LongType(), T.BinaryType(), T.ArrayType(T.StringType()), T.StringType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(internal, kinds))])
    at = [c.lower() for c in docs.columns].index(text.lower())
    out = docs
    for k in range(parts):
        rows = [(r["item_id"], r["text"].encode() if r["text"] else None)
                for r in bench.where(dealt == k).collect()]
        index = spark.sparkContext.broadcast(GramIndex(rows, n))
        out = out.mapInArrow(_scanner(index, schema.names, at, k == 0, cut), schema)
    return with_result(out, **{r: F.col(f"`{c}`") for r, c in zip(results, internal)}).drop(*internal)


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``'s output."""
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with their own columns."""
    out = scan(docs, benchmark)
    return out.where(F.col("n_hit") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
