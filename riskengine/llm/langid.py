"""Language identification by compression: a text is encoded with zstandard against a
raw-content dictionary of each language, and the language that needs the fewest bytes
wins; a narrow margin between the best two is a rejection.

The dictionaries are learned from a bounded sample: the ``sample_docs`` labelled rows of
a language with the smallest key hashes, ``n_dicts`` dictionaries of ``dict_bytes`` each
per language, dealt from those rows in turn. Labels can be wrong, and one foreign row in a
dictionary attracts its language, so the sample is cleaned first: it is dealt into two
halves, each row is classified by the dictionaries of the other half, and rows whose
label that contradicts are left out. A few bytes often cost the same in every language; of
languages that tie, the one whose dictionaries hold the text's words most often wins, and
the margin is then the difference of those counts over their sum.

Texts are folded before learning and encoding alike: lower case, and every run of
characters that are not letters becomes one space. The whole text is encoded, in pieces of
``PIECE_BYTES`` that are compressed each on its own and whose sizes are summed: a dictionary
saves a bounded number of bytes per frame, so in one frame the margin of a long text would
shrink with its length.

Defined results: a null text or one without a letter is ``und``, score 0, rejected; a
corpus without labelled rows teaches nothing, so every text is ``und``; with a single
language learned nothing can compete and the margin counts as 1; repeated rows get equal
answers; clashing input columns are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.llm.common import fresh, sample_by, with_result

SAMPLE_DOCS = 400
DICT_BYTES = 96 << 10
N_DICTS = 2
LEVEL = 6
MARGIN = 0.005
PIECE_BYTES = 4 << 10
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def folded(text: str) -> bytes:
    """Lower case letters with single spaces around every run of them."""
    letters = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {letters} ".encode() if any(map(str.isalpha, letters)) else b""


def learn(rows: list[tuple[str, str]], n_dicts: int = N_DICTS, dict_bytes: int = DICT_BYTES) -> dict[str, list[bytes]]:
    """Dictionary contents per language from (lang, text) rows, in their order."""
    out: dict[str, list[bytearray]] = {}
    turn: dict[str, int] = {}
    for lang, text in rows:
        data = folded(text)
        if not data:
            continue
        dicts = out.setdefault(lang, [bytearray() for _ in range(n_dicts)])
        k = turn[lang] = turn.get(lang, -1) + 1
        target = dicts[k % n_dicts]
        if len(target) < dict_bytes:
            target += data[:dict_bytes - len(target)]
    return {lang: [bytes(d) for d in dicts if d] for lang, dicts in sorted(out.items())}


class Classifier:
    """One compressor per language and dictionary."""

    def __init__(self, learned: dict[str, list[bytes]], level: int = LEVEL):
        self.coders = []
        self.contents = learned
        for lang, contents in learned.items():
            own = []
            for content in contents:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                own.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False,
                                                    write_checksum=False, write_dict_id=False))
            self.coders.append((lang, own))

    def held(self, data: bytes, lang: str) -> float:
        """How often the language's dictionaries hold the text's words (+1 each), on average."""
        words = set(data.split())
        contents = self.contents[lang]
        return sum(c.count(b" " + w + b" ") for c in contents for w in words) / len(contents)

    def classify(self, text: str | None) -> tuple[str, float]:
        """(language, margin): the share by which the runner-up is longer; of ties, see above."""
        data = folded(text) if text else b""
        if not data or not self.coders:
            return UNKNOWN, 0.0
        pieces = [data[i:i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        # A language with fewer dictionaries than another is compared by its mean size.
        sizes = sorted((sum(len(c.compress(p)) for c in own for p in pieces) / len(own), lang) for lang, own in self.coders)
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        best = sizes[0][0]
        if sizes[1][0] > best:
            return sizes[0][1], (sizes[1][0] - best) / sizes[1][0]
        held = sorted(((-self.held(data, lang), lang) for size, lang in sizes if size == best))
        first, second = -held[0][0], -held[1][0]
        return held[0][1], (first - second) / (first + second + 1)


def cleaned(rows: list[tuple[str, str]], n_dicts: int, dict_bytes: int) -> list[tuple[str, str]]:
    """The rows whose label agrees with the dictionaries learned from the other half."""
    turn: dict[str, int] = {}
    half = []
    for lang, _ in rows:
        turn[lang] = turn.get(lang, -1) + 1
        half.append(turn[lang] % 2)
    judges = [Classifier(learn([r for r, h in zip(rows, half) if h == side], n_dicts, dict_bytes)) for side in (0, 1)]

    def agrees(lang: str, text: str, side: int) -> bool:
        judge = judges[1 - side]
        return lang not in judge.contents or judge.classify(text)[0] in (lang, UNKNOWN)

    return [(lang, text) for (lang, text), h in zip(rows, half) if agrees(lang, text, h)]


def sample(docs: DataFrame, key: str, lang: str, text: str, n: int) -> list[tuple[str, str]]:
    """For each language at most ``n`` labelled texts with the smallest key hashes."""
    chosen = set(sample_by(docs.where(F.col(text).isNotNull()), lang, key, n))
    # Of rows that repeat a language and key, the smallest text.
    found = (docs.where(F.col(key).isin(sorted({k for _, k in chosen})) & F.col(lang).isNotNull() & F.col(text).isNotNull())
             .groupBy(F.col(lang), F.xxhash64(key), F.col(key)).agg(F.min(text)).collect())
    rows = sorted((r[0], r[1], r[2], r[3]) for r in found if (r[0], r[2]) in chosen)
    return [(r[0], r[3]) for r in rows]


def identify(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text",
             sample_docs: int = SAMPLE_DOCS, n_dicts: int = N_DICTS, dict_bytes: int = DICT_BYTES,
             margin: float = MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score (the margin, 0 to 1) and accepted. Only the sample of
    ``labelled`` is learned from; a prediction reads the text alone."""
    spark = docs.sparkSession
    rows = cleaned(sample(labelled, key, lang, text, sample_docs), n_dicts, dict_bytes)
    learned = learn(rows, n_dicts, dict_bytes)
    shared = spark.sparkContext.broadcast(learned)
    at = [c.lower() for c in docs.columns].index(text.lower())
    pred, score = fresh(docs, "said_lang"), fresh(docs, "said_margin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in batches:
            said = [model.classify(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())],
                names=[*batch.schema.names, pred, score])

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()),
                                             T.StructField(score, T.DoubleType())]))
    score_01 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    return with_result(out, lang_pred=F.col(pred), score=score_01,
                       accepted=(F.col(pred) != UNKNOWN) & (F.col(score) >= margin)).drop(pred, score)


def held_out(key: str = "doc_id"):
    """The contract's fold: crc32 of the id as text, modulo 5, is 0 (never learned from)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def digest(docs: DataFrame, **options) -> DataFrame:
    """The contract's columns."""
    rows = docs.select("doc_id", "text", "lang")
    out = identify(rows, rows.where(~held_out()), **options)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
