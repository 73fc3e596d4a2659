"""Token counts by a map-side two-tier lookup: a compact broadcast table holds the token
lengths of frequent pre-tokens; a miss is encoded once and kept in the worker's cache.
No pre-token is ever shuffled.

A text is cut into pre-tokens in front of every run of spaces (the model's own mark for a
space counts as one) and around every newline.
That is exact for a piece vocabulary in which no piece holds a space after another
character and none holds a newline: merges then never cross a cut, so a text's length is
the sum of its pre-tokens' lengths. ``check_vocabulary`` verifies this of the given
model; a model without that property is refused rather than counted wrongly.

The table is filled from the ``sample_docs`` documents with the smallest key hashes and
holds ``table_entries`` entries at most; the cache is emptied at ``cache_entries``. Both
bound memory only: what they hold never changes a count.

Defined results: null counts as empty (0 bytes, 0 tokens); texts of any length are
encoded whole; repeated documents are counted row by row; clashing input columns are
replaced by the result columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.llm.common import fresh, sample_ids, with_result

SAMPLE_DOCS = 1000
TABLE_ENTRIES = 50_000
CACHE_ENTRIES = 200_000
KEPT_CHARS = 64
TOKEN_LIMIT = 4096
PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")
_SPACE = "▁"


def load_model(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def check_vocabulary(model) -> None:
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if _SPACE in piece.lstrip(_SPACE) or (not model.is_control(i) and "\n" in piece):
            raise ValueError(f"piece {i} crosses a pre-token boundary")
    if len(model.encode("a  b \n")) != len(model.encode("a")) + len(model.encode(" b")) + len(model.encode("")) + 2:
        raise ValueError("the model changes white space, so pre-token lengths do not add up")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens; the model puts one space in front of a non-empty text."""
    return PRE_TOKEN.findall(" " + text.replace(_SPACE, " ")) if text else []


class Lengths(dict):
    """Token lengths of pre-tokens: the broadcast table, then a bounded cache of encoded ones."""

    def __init__(self, model, table: dict[str, int], cache_entries: int = CACHE_ENTRIES):
        super().__init__(table)
        self.model, self.table, self.limit = model, table, len(table) + cache_entries
        # A newline in front keeps the model's own leading space away from a pre-token.
        self.lead = len(model.encode("\n"))

    def __missing__(self, part: str) -> int:
        n = len(self.model.encode("\n" + part)) - self.lead
        if len(part) <= KEPT_CHARS:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.table)
            self[part] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return sum(map(self.__getitem__, pre_tokens(text)))


def frequent_lengths(docs: DataFrame, model, key: str, text: str, sample_docs: int, entries: int) -> dict[str, int]:
    """Token lengths of the most frequent pre-tokens of a bounded sample of documents."""
    ids = sample_ids(docs.where(F.col(text).isNotNull()), key, sample_docs)
    counts: Counter = Counter()
    for row in docs.where(F.col(key).isin(ids)).select(text).limit(sample_docs).toLocalIterator():
        counts.update(p for p in pre_tokens(row[0] or "") if len(p) <= KEPT_CHARS)
    lengths = Lengths(model, {}, entries)
    return {part: lengths[part] for part, _ in counts.most_common(entries)}


def count_tokens(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text",
                 sample_docs: int = SAMPLE_DOCS, table_entries: int = TABLE_ENTRIES,
                 limit: int = TOKEN_LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    with open(model_path, "rb") as f:
        proto = f.read()
    model = load_model(proto)
    check_vocabulary(model)
    table = docs.sparkSession.sparkContext.broadcast(
        (proto, frequent_lengths(docs, model, key, text, sample_docs, table_entries)))
    at = [c.lower() for c in docs.columns].index(text.lower())
    b, t = fresh(docs, "count_bytes"), fresh(docs, "count_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, known = table.value
        lengths = Lengths(load_model(data), known)
        for batch in batches:
            texts = batch.column(at)
            sizes = [len(x) if x else 0 for x in texts.cast(pa.binary()).to_pylist()]
            counts = [lengths.count(x) if x else 0 for x in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=[*batch.schema.names, b, t])

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(b, T.LongType()),
                                             T.StructField(t, T.LongType())]))
    return with_result(out, n_bytes=F.col(b), n_tokens=F.col(t), over_limit=F.col(t) > limit).drop(b, t)
