"""Quality rules: a linear-chain conditional random field labels every line of a text as
content or boilerplate (Viterbi decoding); the share of words in content lines decides
whether the document stays, after a few fixed base rules.

The field is trained on a bounded sample: for each quality label the ``sample_docs``
documents with the smallest id hashes. A line of a good document counts as content unless
it holds a phrase of ``BOILERPLATE``; every line of a bad one counts as boilerplate. A document's lines form one chain, cut into pieces of
``TRAIN_LINES`` lines for training only.

Line features are binned counts: words, symbol, capital and digit shares, ending, repeats,
distinct words, word length, words that end in a symbol, stock phrases, place in the text.

Defined results: a null, empty or wordless text has no words and fails the base rules;
without any labelled document every line counts as content; repeated rows get equal
answers; an empty table gives an empty result; clashing input columns are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.llm.common import fresh, sample_by, with_result
from riskengine.llm.crf import MAIN, OTHER, LinearChain, viterbi

SAMPLE_DOCS = 500
TRAIN_LINES = 32
TRAIN_DECAY = 1e-3
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
MIN_CONTENT = 0.5

# The contract's symbols, and phrases of stock lines.
SYMBOLS = b"#*$%&|<>"
BOILERPLATE = re.compile(rb"licen[sc]ed? |copyright|all rights reserved|cookie|subscribe|click here|privacy policy|"
                         rb"terms of (?:use|service)|sign (?:in|up)|javascript")
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_CONTINUATION = bytes(range(0x80, 0xC0))

# Bin edges of each line feature; a value's bin is the number of edges at or below it.
EDGES = {
    "words": (1, 2, 4, 8, 16, 32), "marks": (0.001, 0.02, 0.05, 0.1, 0.15, 0.25), "upper": (0.001, 0.06, 0.15, 0.3, 0.6),
    "digits": (0.001, 0.05, 0.2), "ending": (1, 2, 3), "repeat": (1,), "distinct": (0.3, 0.5, 0.7, 0.9),
    "length": (2, 3.5, 5, 7, 9, 12), "suffix": (0.001, 0.15, 0.3, 0.6, 0.9), "stock": (1,), "place": (1, 2)}
_STARTS = dict(zip(EDGES, np.cumsum([0] + [len(e) + 1 for e in EDGES.values()]).tolist()))
N_FEATURES = sum(len(e) + 1 for e in EDGES.values())


def share_of(line: bytes, kind: bytes) -> float:
    return (len(line) - len(line.translate(None, kind))) / max(1, len(line))


def line_features(line: bytes, repeat: bool, place: int) -> list[int]:
    """Feature ids of a line: one bin of each kind."""
    words = line.split()
    n = len(words)
    body = b"".join(words)
    end = line.rstrip()[-1:]
    values = (n, share_of(body, _MARKS), share_of(body, _UPPER), share_of(body, _DIGITS),
              1 if end in b".?" else 2 if end and end in _MARKS else 3 if end else 0, int(repeat),
              len(set(words)) / max(1, n), len(body) / max(1, n),
              sum(w[-1] in _MARKS for w in words) / max(1, n),
              int(BOILERPLATE.search(line.lower()) is not None), place)
    return [start + bisect_right(EDGES[k], v) for (k, start), v in zip(_STARTS.items(), values)]


def split_lines(data: bytes) -> tuple[list[bytes], list[bool]]:
    """The lines that hold a word, and whether each equals an earlier one."""
    seen: set[bytes] = set()
    lines, repeats = [], []
    for line in data.split(b"\n"):
        if line.strip():
            lines.append(line)
            repeats.append(line in seen)
            seen.add(line)
    return lines, repeats


def chain(lines: list[bytes], repeats: list[bool]) -> list[list[int]]:
    last = len(lines) - 1
    return [line_features(x, r, 0 if i == 0 else 2 if i == last else 1) for i, (x, r) in enumerate(zip(lines, repeats))]


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words in windows of a power-of-two length whose sequence occurs twice or more. Equal
    sequences get equal numbers, doubling the length each time, so the answer is exact."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    number = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    size = 1
    while size < window:
        both = number[:-size] * (int(number.max()) + 1) + number[size:]
        values, number = np.unique(both, return_inverse=True)
        if len(values) == len(both):
            return 0
        size *= 2
    twice = np.bincount(number)[number] > 1
    step = np.zeros(len(words) + 1, np.int64)
    step[:n] += twice
    step[window:window + n] -= twice
    return int((np.cumsum(step[:-1]) > 0).sum())


def training(rows: list[tuple[bytes, int]]) -> LinearChain:
    """A field trained on (text, quality) rows."""
    sequences, labels = [], []
    for data, good in rows:
        lines, repeats = split_lines(data)
        found = chain(lines, repeats)
        marks = [MAIN if good and not BOILERPLATE.search(x.lower()) else OTHER for x in lines]
        for a in range(0, len(lines), TRAIN_LINES):
            sequences.append(found[a:a + TRAIN_LINES])
            labels.append(marks[a:a + TRAIN_LINES])
    return LinearChain(N_FEATURES).fit(sequences, labels, decay=TRAIN_DECAY)


def sample(docs: DataFrame, labels: DataFrame, n: int) -> list[tuple[bytes, int]]:
    """For each quality at most ``n`` labelled texts with the smallest id hashes."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") > 0).cast("int")).alias("good"))
    quality = {i: good for good, i in sample_by(marked, "good", "doc_id", n)}
    # Of rows that repeat an id, the smallest text.
    first = {r["doc_id"]: r["text"] for r in docs.where(F.col("doc_id").isin(sorted(quality)) & F.col("text").isNotNull())
             .groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    return [(first[i].encode(), quality[i]) for i in sorted(first)]


def judge(data: bytes | None, model: LinearChain, min_content: float) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, share, kept."""
    data = data or b""
    words = data.split()
    n = len(words)
    lines, repeats = split_lines(data)
    n_repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n
    share = 0.0
    if lines:
        path = viterbi(model.features[np.array(chain(lines, repeats))].sum(axis=1), model.pairs, model.first)
        share = sum(len(x.split()) for x, y in zip(lines, path) if y == MAIN) / n
    return (n, len(b"".join(words).translate(None, _CONTINUATION)), len(data) - len(data.translate(None, SYMBOLS)),
            sum(repeats), n_repeat, failed, share, not failed and share >= min_content)


RESULTS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
           "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "content_share": pa.float64(), "kept": pa.bool_()}


def rules(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, min_content: float = MIN_CONTENT) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the columns of ``RESULTS``."""
    shared = docs.sparkSession.sparkContext.broadcast(training(sample(docs, labels, sample_docs)))
    at = [c.lower() for c in docs.columns].index("text")
    names = [fresh(docs, f"rule_{c}") for c in RESULTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = [judge(b, model, min_content) for b in batch.column(at).cast(pa.binary()).to_pylist()]
            columns = zip(*rows) if rows else [[] for _ in RESULTS]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(list(c), k) for c, k in zip(columns, RESULTS.values()))],
                names=[*batch.schema.names, *names])

    kinds = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.float64(): T.DoubleType()}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, kinds[k]) for n, k in zip(names, RESULTS.values()))])
    return with_result(docs.mapInArrow(run, schema), **{c: F.col(n) for c, n in zip(RESULTS, names)}).drop(*names)


def digest(judged: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")
