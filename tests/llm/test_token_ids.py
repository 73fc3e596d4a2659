"""Token-id files: the code's round trip, and ids against the library."""

import json
import random
import zlib

import numpy as np
import pytest

from riskengine.llm import queries, token_ids as K
from tests.conftest import SF_SMALL
from tests.llm.helpers import AWKWARD, documents

PATH = queries.tokenizer_path(queries.IDS_TOKENIZER)
PARTS = ["a", "B", "é", "ß", "÷", " ", "  ", "\n", "\n\n", "\t", "\x85", "\xa0", "\x00", "'s", "'t", "1", "²", "٣", "漢", "ñ", "́",
         "<|endoftext|>", ".", "!?", "\r\n", "\x1c", "_", "😀", "ª", "word", "don't", " ", "　"]


@pytest.fixture(scope="module")
def model():
    with open(PATH, encoding="utf-8") as f:
        return K.load_tokenizer(f.read())


def plain(model, rows):
    """(doc_id, start, n_tokens, crc) of rows with distinct ids."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = model.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_pack_round_trip():
    r = random.Random(1)
    for bits in (0, 1, 5, 16, 33, 60, 64):
        for n in (0, 1, 2, 59, 60, 61, 1000, 20_000):
            values = [r.randrange(1 << r.randrange(bits + 1)) for _ in range(n)]
            words, marks = K.pack(np.array(values, np.uint64))
            assert K.unpack(words, n).tolist() == values
            for i, at in enumerate(marks.tolist()[:3]):          # a reader may start at a mark
                if bits <= 60:
                    assert K.unpack(words[K.MARK_EVERY * i:], n - at).tolist() == values[at:]
    assert len(K.pack(np.ones(600, np.uint64))[0]) == 10


def test_cut_texts_encode_like_whole_ones(model, monkeypatch):
    r = random.Random(2)
    with open(PATH, encoding="utf-8") as f:
        encoder = K.Encoder(f.read(), 200)                       # small caches: entries come and go
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(14))) for _ in range(4000)]
    whole = [np.array(model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [encoder.ids(t) for t in texts] == whole
    monkeypatch.setattr(K, "SLICE_CHARS", 5)
    assert [encoder.ids(t) for t in texts] == whole
    assert len(encoder.letters) <= 210 and len(encoder) <= 210


def test_line_ends_cost_no_split_text(model, monkeypatch):
    """Words at single line ends come from the caches: the library sees a line's first word once."""
    with open(PATH, encoding="utf-8") as f:
        encoder = K.Encoder(f.read(), 1000)
    text = "One more.\nÉté it's\n2nd line\ndon't,\nÉté\n(x)\nlast"
    whole = np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.ids(text) == whole
    asked = []
    monkeypatch.setattr(K.Encoder, "careful", lambda self, t: asked.append(t) or b"".join(self.piece(x) for x in K._CUT.split(t)))
    monkeypatch.setattr(K.Encoder, "alone", lambda self, t: pytest.fail(t))
    assert encoder.ids(text) == whole and encoder.ids(text) == whole
    assert asked == ["One"] * 2                          # a text's first word
    odd = "a\n\nb c\n d e \nf g\n"                      # other white space than single line ends
    monkeypatch.undo()
    assert encoder.ids(odd) == np.array(model.encode(odd, add_special_tokens=False).ids, "<u4").tobytes()


def test_chain_is_the_plain_walk():
    r = random.Random(3)
    for n in (1, 2, 31, 32, 33, 5000):
        step = [r.choice([1, 2, 3, 60]) for _ in range(n)]
        at, walk = 0, []
        while at < n:
            walk.append(at)
            at += step[at]
        assert K._chain(np.arange(n) + np.array(step)).tolist() == walk


def test_files_equal_the_library(spark, model):
    r = random.Random(4)
    rows = [(i, "".join(r.choice(PARTS) for _ in range(r.randrange(60))), "en", "s") for i in range(-50, 400)]
    rows += [(None, "no id", "en", "s"), (900, None, "en", "s"), (901, "", "en", "s"), (902, "word " * 60_000, "en", "s"),
             (1 << 40, "far", "en", "s")]
    r.shuffle(rows)
    for options in ({}, {"block_ids": 50, "min_shards": 3}):
        out = K.digest(K.round_trip(documents(spark, rows).repartition(5), PATH, **options)).collect()
        assert sorted(map(tuple, out), key=lambda x: x[1]) == plain(model, [x[:2] for x in rows])


def test_equal_keys_and_empty_table(spark, model):
    rows = AWKWARD + [(4, "another text of that id", "en", "s")] + [(70, "copy", "en", "s")] * 30
    out = K.digest(K.round_trip(documents(spark, rows), PATH)).collect()
    assert len(out) == len(rows)
    ordered = sorted(out, key=lambda x: x.start)
    assert [x.start for x in ordered] == [0, *np.cumsum([x.n_tokens for x in ordered])[:-1].tolist()]
    ids = [-1 if x.doc_id is None else x.doc_id for x in ordered]
    assert ids == sorted(ids)
    assert K.round_trip(documents(spark, []), PATH).count() == 0


def test_files_hold_blocks_in_order(spark, tmpdir_run):
    K.write(documents(spark, [(i, f"text {i} " * 50, "en", "s") for i in range(200)]), PATH, f"{tmpdir_run}/ids", block_ids=500)
    for shard, rows in __import__("itertools").groupby(spark.read.parquet(f"{tmpdir_run}/ids").orderBy("shard", "first").collect(), lambda b: b.shard):
        at, last = 0, None
        for b in rows:
            assert b.first == at and b.docs[-1].end == b.n_ids and [d.key for d in b.docs] == sorted(d.key for d in b.docs)
            assert last is None or last < b.docs[0].key
            at, last = at + b.n_ids, b.docs[-1].key


def test_prefix_sums_over_groups(spark):
    blocks = spark.range(50).selectExpr("id div 2 AS shard", "id AS n_ids")
    got = {r.shard: r.start for r in K.shard_starts(blocks, group=4).collect()}
    assert got == {s: sum(range(2 * s)) for s in range(25)}


def test_other_tokenizers_are_refused():
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    K.check_cuts(json.dumps(spec))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        with pytest.raises(ValueError):
            K.check_cuts(json.dumps({**spec, **change}))


def test_query_equals_the_library(spark, model):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.op13_token_ids(spark, SF_SMALL).collect()), key=lambda x: x[1])
    assert got == plain(model, [tuple(d) for d in docs])
