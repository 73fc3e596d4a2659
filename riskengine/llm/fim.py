"""Fill-in-the-middle by piece tables: a document becomes descriptors over two buffers that
never change, its text and the sentinels; no piece of text is copied until it is written.

A descriptor is (buffer, start, length) in bytes. Cutting splits a descriptor in two,
an arrangement is a permutation of descriptors with sentinel descriptors between them, and
``written`` copies the buffers' bytes once, in descriptor order. ``restored`` goes the other
way from output and form alone: the sentinels cut the output into descriptors, and the
inverse permutation puts them back. Hashes are fed one descriptor after the other.

Cuts lie behind whole units (lines with their line end). Every choice is a hash of the
seed and the key, so reruns and lost executors give the same rows.

Defined results: a null text counts as empty; an empty text, a text that holds a sentinel and
a text that the rate leaves out are 'plain' (one descriptor, null character counts); a null key
hashes like an empty one; repeated rows get equal results; texts of any length are cut whole,
holding one copy of the text and its line ends; clashing input columns are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.llm.common import fresh, with_result

SEED = 7
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = "".join((PREFIX, SUFFIX, MIDDLE)).encode()   # the sentinel buffer
TEXT, MARK = 0, 1                                        # buffer numbers
P, S, M = ((MARK, i, 3) for i in (0, 3, 6))
# An arrangement: sentinel descriptors, and the places of (prefix, middle, suffix).
ARRANGED = {"plain": (0,), "psm": (P, 0, S, 2, M, 1), "spm": (S, 2, P, 0, M, 1)}
FIM_PERCENT, SPM_PERCENT = 100, 50

PIECE = T.StructType([T.StructField("buffer", T.IntegerType()), T.StructField("start", T.LongType()),
                      T.StructField("length", T.LongType())])


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit draws of a row, from the digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def units(text: bytes) -> np.ndarray:
    """The end of every unit: behind each newline, and the end of a last line without one."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if not text or text.endswith(b"\n") else np.append(ends, len(text))


def code_points(text: memoryview) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def split(piece: tuple, at: int) -> tuple[tuple, tuple]:
    """One descriptor cut in two at ``at`` bytes from its start."""
    buffer, start, length = piece
    return (buffer, start, at), (buffer, start + at, length - at)


def cut(text: bytes, first: int, second: int, ends: np.ndarray) -> list[tuple]:
    """(prefix, middle, suffix) of a text cut behind ``first`` and ``second`` units."""
    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((first, second)))
    prefix, rest = split((TEXT, 0, len(text)), a)
    return [prefix, *split(rest, b - a)]


def arrange(pieces: list[tuple], form: str) -> list[tuple]:
    return [pieces[x] if isinstance(x, int) else x for x in ARRANGED[form]]


def inverse(output: bytes, form: str) -> list[tuple]:
    """Descriptors over ``output`` that give the text back."""
    if form == "plain":
        return [(TEXT, 0, len(output))]
    found, start = {}, 0
    order = ARRANGED[form]
    for mark, place in zip(order[::2], order[1::2]):
        begin = output.index(SENTINELS[mark[1]:mark[1] + mark[2]], start) + mark[2]
        if found:                                   # the piece before ends at this sentinel
            last = next(reversed(found))
            found[last] = (TEXT, found[last][1], begin - mark[2] - found[last][1])
        found[place] = (TEXT, begin, len(output) - begin)
        start = begin
    return [found[i] for i in range(3)]


def streamed(pieces: list[tuple], text: bytes) -> Iterator[memoryview]:
    buffers = (memoryview(text), memoryview(SENTINELS))
    for buffer, start, length in pieces:
        yield buffers[buffer][start:start + length]


def hashed(pieces: list[tuple], text: bytes) -> str:
    digest = hashlib.sha256()
    for part in streamed(pieces, text):
        digest.update(part)
    return digest.hexdigest()


def _described(text: bytes, h: list[int], fim_percent: int, spm_percent: int) -> tuple:
    ends = units(text)
    n = len(ends)
    pieces = cut(text, h[0] % (n + 1), h[1] % (n + 1), ends)
    marked = any(SENTINELS[i:i + 3] in text for i in (0, 3, 6))
    if not text or marked or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, [(TEXT, 0, len(text))]
    form = "spm" if h[3] % 100 < spm_percent else "psm"
    chars = [code_points(x) for x in streamed(pieces[:2], text)]
    return n, form, *chars, arrange(pieces, form)


def describe(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED,
             fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars and pieces, the descriptors
    of the output in its order."""
    h = [fresh(docs, f"draw{i}") for i in range(4)]
    given = docs.select("*", *[c.alias(x) for x, c in zip(h, draws(F.col(f"`{key}`"), seed))])
    t = fresh(given, "described")
    at, hs = [c.lower() for c in docs.columns].index(text.lower()), [given.columns.index(x) for x in h]
    result = T.StructType([
        T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
        T.StructField("pieces", T.ArrayType(PIECE))])
    arrow = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                       ("pieces", pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])))])
    names = [f.name for f in result.fields]
    parts = [f.name for f in PIECE.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = zip(*(batch.column(i).to_pylist() for i in hs))
            rows = []
            for x, d in zip(batch.column(at).cast(pa.binary()), drawn):
                *first, pieces = _described(x.as_py() or b"", d, fim_percent, spm_percent)
                rows.append(dict(zip(names, [*first, [dict(zip(parts, p)) for p in pieces]])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, arrow)], names=[*batch.schema.names, t])

    out = given.mapInArrow(run, T.StructType([*given.schema.fields, T.StructField(t, result)]))
    return with_result(out, **{x: F.col(t)[x] for x in names}).drop(t, *h)


def written(described: DataFrame, text: str = "text", out: str = "output") -> DataFrame:
    """The output text: the descriptors' bytes, copied once, in order (JVM only)."""
    buffers = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), F.lit(SENTINELS.decode()).cast("binary")
    piece = lambda p: F.when(p["buffer"] == TEXT, F.substring(
        buffers[0], (p["start"] + 1).cast("int"), p["length"].cast("int"))).otherwise(F.substring(
            buffers[1], (p["start"] + 1).cast("int"), p["length"].cast("int"))).cast("string")
    return with_result(described, **{out: F.array_join(F.transform("pieces", piece), "")})


def restored(outputs: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``outputs`` with output_sha256, and restored_sha256 of the text rebuilt from output and form."""
    names = [c.lower() for c in outputs.columns]
    at, kind = names.index(output.lower()), names.index(form.lower())
    a, b = fresh(outputs, "hash_output"), fresh(outputs, "hash_restored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, back = [], []
            for x, f in zip(batch.column(at).cast(pa.binary()), batch.column(kind).to_pylist()):
                data = x.as_py() or b""
                made.append(hashed([(TEXT, 0, len(data))], data))
                back.append(hashed(inverse(data, f), data))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string()), pa.array(back, pa.string())],
                                             names=[*batch.schema.names, a, b])

    out = outputs.mapInArrow(run, T.StructType([*outputs.schema.fields, T.StructField(a, T.StringType()),
                                                T.StructField(b, T.StringType())]))
    return with_result(out, output_sha256=F.col(a), restored_sha256=F.col(b)).drop(a, b)


def transform(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with their descriptors and the output text."""
    return written(describe(docs, **options), options.get("text", "text"))


def digest(outputs: DataFrame) -> DataFrame:
    """The contract's columns, from the outputs read back."""
    slim = outputs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    return restored(slim).drop("output")
