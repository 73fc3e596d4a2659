"""Language ID, token counts, decontamination, quality rules and HTML extraction."""

import hashlib
import html
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskengine.llm import crf, decontaminate, html_extract, langid, quality, queries, token_counts
from tests.llm.helpers import AWKWARD, documents, words
from tests.oracle_check import check, duck

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# ------------------------------------------------------------------ language ID
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    rows = queries.op5_langid(spark, MID).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert sum(r["accepted"] for r in rows) / len(rows) > 0.99


def test_langid_awkward_rows(spark):
    teach = [(i, t, lang, "s") for i in range(40, 80) for t, lang in
             (("the cat and the dog with that house", "en"), ("der Hund und die Katze mit dem Haus", "de"))]
    docs = documents(spark, AWKWARD + [(30, "the dog", "de", None)])
    got = langid.identify(docs, documents(spark, teach)).collect()
    by = {(r["doc_id"], r["text"][:9] if r["text"] else r["text"]): r for r in got}
    assert len(got) == len(AWKWARD) + 1
    for key in ((1, None), (2, ""), (3, " \n\t "), (9, "1234 5678")):
        assert by[key]["lang_pred"] == "und" and by[key]["score"] == 0 and not by[key]["accepted"]
    assert by[(30, "the dog")]["lang_pred"] == "en"   # its own label is no input
    nothing = langid.identify(docs, docs.where("false")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    alone = langid.identify(docs, documents(spark, teach[::2])).collect()
    assert {r["lang_pred"] for r in alone} == {"und", "en"}


def test_long_clean_documents_are_accepted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    labelled = docs.where(~langid.held_out())
    learned = {t for _, t in langid.sample(labelled, "doc_id", "lang", "text", langid.SAMPLE_DOCS)}
    long = {}
    for r in docs.where("lang IS NOT NULL AND text IS NOT NULL").orderBy("doc_id").collect():
        if r["text"] not in learned and len(long.get(r["lang"], "")) < 3_000_000:
            long[r["lang"]] = long.get(r["lang"], "") + "\n" + r["text"]
    assert len(long) == 4 and all(len(t) > 1_000_000 for t in long.values())
    rows = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(sorted(long.items()))], "doc_id long, text string, lang string")
    for r in langid.identify(rows, labelled).collect():
        assert r["lang_pred"] == r["lang"] and r["accepted"] and r["score"] > 0.05


# ----------------------------------------------------------------- token counts
def test_token_counts_equal_the_library(spark):
    model = token_counts.load_model(open(queries.tokenizer_path(), "rb").read())
    extra = [(40, "  two  leading\n\n newline \n", "en", "s"), (41, "<s>[INST] x </s> <unk> ▁ ▁a a▁b", "en", "s"),
             (42, "tab\there\r\nnbsp x 　 ​ é \U0001F469‍\U0001F4BB", "en", "s"), (43, " ", "en", "s"), (44, "\n", "en", "s")]
    rows = AWKWARD + extra
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(
        documents(spark, rows), queries.tokenizer_path(), sample_docs=3, table_entries=5).collect())
    want = Counter((r[0], len((r[1] or "").encode()), len(model.encode(r[1] or "")), len(model.encode(r[1] or "")) > 4096) for r in rows)
    assert got == want


def test_token_query_over_a_whole_table(spark):
    model = token_counts.load_model(open(queries.tokenizer_path(), "rb").read())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op9_tokens(spark, SMALL).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in texts.items()}


def test_a_cache_that_overflows_changes_nothing():
    model = token_counts.load_model(open(queries.tokenizer_path(), "rb").read())
    lengths = token_counts.Lengths(model, {}, cache_entries=2)
    text = "one two three one two three four five one"
    assert lengths.count(text) == len(model.encode(text)) and len(lengths) <= 2


# -------------------------------------------------------------- decontamination
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return FOLDED.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(rows, items, n=10):
    grams = {}
    for item, text in items:
        ws = folded(text)
        size = min(n, len(ws))
        for i in range(len(ws) - size + 1 if ws else 0):
            grams.setdefault(tuple(ws[i:i + size]), set()).add(item)
    out = []
    for r in rows:
        ws, hit, found = folded(r[1]), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(ws) - size + 1):
                if tuple(ws[i:i + size]) in grams:
                    hit.update(range(i, i + size))
                    found |= {x for x in grams[tuple(ws[i:i + size])] if x is not None}
        names = sorted(str(x) for x in found)
        out.append((r[0], len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return Counter(out)


BENCH = [(1, "One two three, four five six seven eight nine ten eleven twelve"), (2, None), (3, "..."), (4, "short item"),
         (10, "ONE TWO three four five six seven eight nine ten"), (None, "an item that has no id at all but ten words here"),
         (5, "ñandú Ähre 漢字 x1")]


def bench_rows():
    line = "one two three four five six seven eight nine ten eleven twelve"
    return AWKWARD + [(50, f"x {line} y", "en", "s"), (51, line.replace(" ", "-- "), "en", "s"), (52, "a short ITEM, or short items", "en", "s"),
                      (53, "an item that has no id at all but ten words here", "en", "s"), (54, "pre ñandú Ähre 漢字 X1 ñandú Ähre 漢字 x1", "en", "s"),
                      (55, line[:-8] + " end", "en", "s"), (50, f"x {line} y", "en", "s")]


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_decontamination_matches_brute_force(spark, part_bytes):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    out = decontaminate.digest(decontaminate.scan(documents(spark, bench_rows()), bench, part_bytes=part_bytes))
    got = Counter(tuple(r) for r in out.collect())
    assert got == plain_hits(bench_rows(), BENCH)


def test_cut_and_drop(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = documents(spark, bench_rows())
    cut = {r["doc_id"]: r["cut_text"] for r in decontaminate.scan(docs, bench, cut=True).collect()}
    assert cut[50] == "x y" and cut[52] == "a or short items" and cut[54] == "pre " and cut[4] is None
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in AWKWARD)
    assert decontaminate.drop_contaminated(docs, bench.where("false")).count() == docs.count()


def test_decontamination_oracle(spark):
    r = check(spark, "op10", queries.op10_decontaminate, queries.ORACLES["op10_decontaminate"], duck(SMALL), SMALL)
    assert r["status"] == "ok", r


# ---------------------------------------------------------------- quality rules
def plain_base(text):
    text = text or ""
    ws = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(words(line)) and line in seen
        seen.add(line)
    grams = Counter(tuple(ws[i:i + 8]) for i in range(len(ws) - 7))
    rep = {j for i in range(len(ws) - 7) if grams[tuple(ws[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep),
            len(ws) < 20 or 100 * len(rep) > 30 * len(ws))


def test_base_rules_and_verdicts(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    labels = spark.read.parquet(f"{MID}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = queries.op3_quality(spark, MID).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:7] == plain_base(rows[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    judged = [(good[r["doc_id"]], r["kept"]) for r in got if r["doc_id"] in good and not r["base_failed"]]
    assert sum(k == bool(q) for q, k in judged) / len(judged) > 0.97


def test_quality_awkward_rows_and_no_labels(spark):
    docs = documents(spark, AWKWARD)
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.where("false")):
        out = quality.rules(docs, table).collect()
        assert len(out) == len(AWKWARD)
        for r in out:
            assert tuple(r[c] for c in list(quality.RESULTS)[:6]) == plain_base(r["text"])
            assert r["fp"] == "clash"


def test_viterbi_and_gradient_against_enumeration():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        score, pairs, first = rng.normal(size=(n, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)

        def value(path):
            return first[path[0]] + sum(score[i, y] for i, y in enumerate(path)) + sum(pairs[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(crf.viterbi(score, pairs, first)) == best
    # Chains whose label is their feature.
    r = random.Random(3)
    seqs, tags = [], []
    for _ in range(60):
        feats = [r.randrange(2) for _ in range(r.randrange(1, 9))]
        seqs.append([[f] for f in feats])
        tags.append([f for f in feats])
    model = crf.LinearChain(2).fit(seqs, tags)
    assert all(model.decode(s) == t for s, t in zip(seqs, tags))
    assert crf.LinearChain(2).fit([], []).decode([]) == []


# --------------------------------------------------------------- HTML extraction
def test_pages_give_their_article(spark):
    pages = spark.read.parquet(f"{MID}/pages.parquet")
    rows = {r["page_id"]: r for r in queries.op6_html(spark, MID).collect()}
    right = 0
    for p in pages.collect():
        inner = p["html"][p["html"].index("<article>"):p["html"].index("</article>")]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1)>|<br>", " ", inner))).split())
        got = rows[p["page_id"]]
        assert got["n_chars"] == len(got["text"]) and got["url"] == p["url"]
        right += got["text"] == want
    assert right / len(rows) > 0.99


def test_held_out_layouts():
    model = html_extract.Extractor(html_extract.labelled_pages(300))
    same = total = 0
    for page, main in html_extract.labelled_pages(150, seed=77):
        blocks = html_extract.blocks_of(page)
        path = model.model.decode([model.known(f) for f in html_extract.features_of(blocks)])
        same += sum((b.text in main) == bool(y) for b, y in zip(blocks, path))
        total += len(blocks)
    assert same / total > 0.97


def test_blocks_of_awkward_markup():
    def texts(page):
        return [b.text for b in html_extract.blocks_of(page)]

    assert texts("") == [] and texts("plain &amp; simple") == ["plain & simple"]
    assert texts("<p>one<p>two <b>three</b><br>four</p>five") == ["one", "two three four", "five"]
    assert texts('<script>var t="</p><p>no";</script><p>yes</p><!-- <p>no</p> --><style>p{}</style>') == ["yes"]
    assert texts("<ul><li>a<li>b</ul></div></nav>c") == ["a", "b", "c"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert texts("a < b <p class='x>y'>c</p> <p title=\"open>d") == ["a < b", "c", "d"]
    assert texts("<p>x<!-- never closed") == ["x"] and texts("<script>never closed") == []
    assert texts("<p>" * 3000 + "deep") == ["deep"] and texts("<div>" * 3000 + "deep") == ["deep"]
    assert texts("w&nbsp;&#x41;&#233;\t\n z") == ["w Aé z"]


def test_html_awkward_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<nav><a href='/'>x</a></nav>"), (3, "u", "<article><p>Kept text here.</p></article>" * 2),
            (3, "u", "<article><p>Kept text here.</p></article>" * 2)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.digest(html_extract.extract(pages, train_pages=200)).collect()
    assert sorted(((r["page_id"], r["text"], r["n_chars"]) for r in got), key=str) == sorted(
        [(1, "", 0), (2, "", 0), (None, "", 0), (3, "Kept text here. Kept text here.", 31)] + [(3, "Kept text here. Kept text here.", 31)], key=str)


def test_broken_pages_take_linear_time():
    import time

    n = 100_000
    names = "".join(f"<div class=c{i}a>x" for i in range(n // 4))
    for page, blocks in (("<div>x " * n, n), ("<td>x<p>" * n, n), ("<div>" * n + "</i></section>x" * n, n), (names, n // 4),
                         ("<b>" * n + "<div>x" * n + "</b>" * n, n), ("<" * n, 1), ("<!--" * n, 0)):
        began = time.time()
        assert len(html_extract.blocks_of(page, {"in=div", "name=c"})) == blocks
        assert time.time() - began < 10


def test_inline_names_end_with_their_element():
    blocks = html_extract.blocks_of("<div class=x><b class=y>one<p>two</b>three</p>four</div>")
    assert [(b.text, b.own, sorted(b.within)) for b in blocks] == [
        ("one", "div", ["in=div", "name=x", "name=y"]), ("twothree", "p", ["in=div", "in=p", "name=x"]), ("four", "div", ["in=div", "name=x"])]


def test_samples_take_one_row_of_repeated_ids(spark):
    rows = [(i % 3, "en", f"some text number {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 1.0), (2, 0.0)], "doc_id long, quality double")
    least = [min(t for d, _, t in rows if d == i) for i in range(3)]
    for parts in (1, 7):
        some = docs.repartition(parts)
        assert quality.sample(some, labels, 5) == [(t.encode(), y) for t, y in zip(least, (1, 0, 1))]
        assert sorted(t for _, t in langid.sample(some, "doc_id", "lang", "text", 5)) == sorted(least)
