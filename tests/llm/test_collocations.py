"""Phrase mining against a plain version and SQL, and the automata against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import pytest

from riskengine.llm import collocations as C
from riskengine.llm import queries
from tests.conftest import SF_SMALL
from tests.llm.helpers import AWKWARD, documents
from tests.oracle_check import check, duck


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, max_words=3, least=10, percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, max_words + 1):
                f[lang or "und"].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        phrases = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in phrases.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and 100 * a >= percent * counts[p[i:j]]}
        rated = []
        for p, a in phrases.items():
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if p not in gone:
                rated.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(rated)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def text_of(r, words, size):
    return "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ". ", "\n", "  "]) for _ in range(size))


def some_rows(n=120, seed=3):
    r = random.Random(seed)
    words = ["The", "the", "of", "new", "york", "city", "ÉTÉ", "été", "a\x1cb", "x|y", "漢字", "end"] + [f"w{i}" for i in range(30)]
    rows = [(i, text_of(r, words, r.randrange(60)) + "of the new york city " * r.randrange(3), r.choice(["en", "fr", None]), "s")
            for i in range(n)]
    return rows + [(1000 + i, "hot pair " * 200 + text_of(r, words, 20), "en", "s") for i in range(n // 2)]


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"max_words": 4, "min_count": 4, "top": 7}, {"run_words": 50, "cell_bytes": 200},
                                     {"max_words": 2, "percent": 90}])
def test_equals_plain_version(spark, options):
    rows = some_rows() + AWKWARD
    names = {"min_count": "least"}
    expected = plain(rows, **{names.get(k, k): v for k, v in options.items() if k not in ("run_words", "cell_bytes")})
    assert collected(C.mine(documents(spark, rows).repartition(4), **options)) == expected
    assert expected


def test_awkward_and_empty(spark):
    assert collected(C.mine(documents(spark, AWKWARD))) == plain(AWKWARD)
    assert C.mine(documents(spark, [])).count() == 0
    assert C.mine(documents(spark, [(1, None, None, None)])).count() == 0


def as_dict(t):
    levels = t.walk()
    return {tuple(t.words[c[i]] for c in columns): w for (_, _, weight), columns in zip(levels, C.paths_of(levels))
            for i, w in enumerate(weight.tolist()) if w}


def counted(texts, max_words=3):
    run, expected = C.Run(), Counter()
    for ws in texts:
        run.add(ws)
        for k in range(1, max_words + 1):
            expected.update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    return C.Transducer.build(*run.counted(max_words)), expected


def test_automata_equal_dictionaries():
    r = random.Random(8)
    parts = [counted([[b"w%d" % r.randrange(20) for _ in range(r.randrange(1, 30))] for _ in range(20)]) for _ in range(5)]
    for t, expected in parts:
        assert as_dict(t) == expected and as_dict(C.Transducer.loads(t.dumps())) == expected
        assert len(t.weight) < len(expected)                     # equal ends share states
    words, levels = C.united([t for t, _ in parts])
    total = sum((e for _, e in parts), Counter())
    whole = C.Transducer.build(words, levels)
    assert as_dict(whole) == total
    assert as_dict(C.Transducer.build(words, C.pruned(levels, 9))) == {p: c for p, c in total.items() if c >= 9}
    asked = C.Transducer.build(*C.united([parts[0][0]]))
    assert as_dict(C.composed(asked, whole)) == {p: total[p] for p in parts[0][1]}
    for bits in ([0, 0, 0], [2, 1, 1], [3, 0, 2]):
        cut = dict(C.cut(words, levels, bits))
        merged = Counter()
        for cell, t in cut.items():
            own = as_dict(t)
            assert not merged.keys() & own.keys()                # a phrase has one cell
            merged.update(own)
        assert merged == total


def test_a_hot_first_word_spreads_over_cells():
    t, expected = counted([[b"hot", b"pair", b"w%d" % i] for i in range(500)] + [[b"hot", b"w%d" % i] for i in range(500)])
    sizes = [len(as_dict(x)) for _, x in C.cut(*C.united([t]), [2, 2, 2])]
    assert max(sizes) < 0.5 * len(expected)


def test_counts_beyond_64_bits_are_exact(spark):
    n = C.np.array
    a, left, right = 3_000_000_019, 3_000_400_023, 5_000_000_029
    t = C.Transducer.build([b"x", b"y"], [(n([0, 0]), n([0, 1]), n([left, right])), (n([0]), n([1]), n([a]))])
    assert as_dict(C.Transducer.loads(t.dumps())) == {(b"x",): left, (b"y",): right, (b"x", b"y"): a}
    found = spark.createDataFrame([("en", 0, t.dumps(), left + right)], "lang string, cell long, blob binary, words long")
    rows = C.scored(found, C.answers(found, C.requests(found, [0, 0])), 50, C.SCALE).where("not dropped").collect()
    assert [(r.phrase, r.a, r.l, r.r, r.score) for r in rows] == [("x y", a, left, right, 1_000_000 * a * a // (left * right))]
    assert C.SCALE * a * a > 1 << 63


def test_query_equals_sql(spark):
    found = check(spark, "op12_phrases", queries.op12_phrases, queries.ORACLES["op12_phrases"], duck(SF_SMALL), SF_SMALL)
    assert found["status"] == "ok" and found["rows"] > 0, found
