"""SimHash and substring dedup against plain versions."""

import hashlib
import random
from collections import Counter

import xxhash

from riskengine.llm import queries, simhash, substring
from tests.llm.helpers import AWKWARD, documents, words
from tests.oracle_check import check, duck


def plain_fingerprint(text, shingle=4):
    ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    grams = [" ".join(ws[i:i + shingle]) for i in range(max(1, len(ws) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows, distance):
    """{row number: smallest id reachable}; rows without an id are left out."""
    fps = [(i, r[0], plain_fingerprint(r[1])) for i, r in enumerate(rows) if r[0] is not None]
    root = {i: i for i, _, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, _, x) in enumerate(fps):
        for j, _, y in fps[a + 1:]:
            if bin(x ^ y).count("1") <= distance:
                root[find(j)] = find(i)
    least = {}
    for i, doc, _ in fps:
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {i: least[find(i)] for i, _, _ in fps}


def near_rows(n=60, seed=1):
    """Long texts in families whose members differ in a few words, and one large family."""
    r = random.Random(seed)
    rows, doc = [], 100
    for size in [3] * n + [80]:
        base = [f"w{r.randrange(5000)}" for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for _ in range(r.randrange(4)):
                own[r.randrange(len(own))] = f"w{r.randrange(5000)}"
            rows.append((doc, " ".join(own), "en", "s"))
            doc += 1
    r.shuffle(rows)
    return rows


def compare(spark, rows, **options):
    found = simhash.near_duplicates(documents(spark, rows), **options)
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found.collect())
    whole = plain_components(rows, options.get("distance", 4))
    want = Counter((r[0], plain_fingerprint(r[1]), whole.get(i)) for i, r in enumerate(rows))
    assert got == want


def test_components_match_brute_force(spark):
    compare(spark, near_rows() + AWKWARD)


def test_blocks_of_large_groups_lose_no_link(spark):
    compare(spark, near_rows(n=5), block=7)


def test_other_distances(spark):
    compare(spark, near_rows(n=25, seed=3), distance=7)


def test_segments_and_forest():
    for d in (0, 1, 4, 7, 10):
        parts = simhash.segments(d)
        assert len(parts) == d // 2 + 1 and sum(w for _, w in parts) == 64


def test_simhash_query_over_a_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash(spark, d).collect()}
    whole = plain_components(docs, 4)
    assert got == {doc: (f"{plain_fingerprint(t):016x}", whole[i]) for i, (doc, t) in enumerate(docs)}


def test_one_row_stays_of_every_group(spark):
    rows = AWKWARD + [(20, "alpha beta gamma delta epsilon", "en", "s"), (21, "alpha beta gamma delta epsilon", "en", "s")]
    kept = simhash.one_per_group(documents(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 4, 6, 7, 8, 9, 20]
    assert sum(r["doc_id"] is None for r in kept) == 1
    assert kept[0]["spans"] == "clash"


def test_unlike_documents_of_one_id_are_judged_apart(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "a"), (1, "completely other words stand in this one", "en", "a"),
            (2, "alpha beta gamma delta epsilon zeta", "en", "a"), (3, "a third text of yet other words here", "en", "x"),
            (3, "a third text of yet other words here", "en", "y"), (0, "completely other words stand in this one", "en", "b")]
    for parts in (1, 5):
        kept = simhash.one_per_group(documents(spark, rows).repartition(parts)).collect()
        found = sorted((r["doc_id"], r["text"][:5]) for r in kept)
        assert found == [(0, "compl"), (1, "alpha"), (3, "a thi")]
        third = {r["source"] for r in kept if r["doc_id"] == 3}
        assert len(third) == 1 and third == {r["source"] for r in simhash.one_per_group(documents(spark, rows)).collect() if r["doc_id"] == 3}


def plain_removal(rows, window):
    seen = Counter(tuple(words(r[1])[i:i + window]) for r in rows for i in range(len(words(r[1])) - window + 1))
    out = []
    for r in rows:
        ws, gone = words(r[1]), set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i:i + window])] > 1:
                gone.update(range(i, i + window))
        left = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((r[0], len(ws), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return Counter(out)


def test_substring_matches_brute_force(spark):
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = AWKWARD + [(i, " ".join(f"w{r.randrange(300)}" for _ in range(r.randrange(90))) + (" " + passage if i % 3 == 0 else ""),
                       "en", "s") for i in range(100, 160)]
    rows += [(200, "a b c d e f g a b c d e f g a b c d e f g", "en", "s"), (201, "x y x y x y x y x y", "en", "s")]
    for window, chunk, bucket in ((35, 4 << 20, 16 << 20), (5, 300, 600), (1, 2000, 64)):
        found = substring.remove_repeats(documents(spark, rows), window, chunk, bucket)
        got = Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in found.collect())
        assert got == plain_removal(rows, window)


def test_intervals_are_maximal(spark):
    rows = [(1, "k0 " + " ".join(f"p{i}" for i in range(12)) + " k1", "en", "s"), (2, " ".join(f"p{i}" for i in range(12)), "en", "s")]
    found = {r["doc_id"]: r for r in substring.remove_repeats(documents(spark, rows), 5, keep_text=True).collect()}
    assert found[1]["intervals"] == [1, 13] and found[1]["kept_text"] == "k0 k1"
    assert found[2]["intervals"] == [0, 12] and found[2]["kept_text"] == ""


def test_substring_oracle(spark):
    d = "/root/testdata/sf0.001"
    r = check(spark, "op8", queries.op8_substring, queries.ORACLES["op8_substring"], duck(d), d)
    assert r["status"] == "ok", r
