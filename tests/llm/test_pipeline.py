"""The pipeline against plain versions of its stages, and every query on awkward input."""

import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from riskengine.llm import langid, queries
from riskengine.llm.common import read
from tests.llm.helpers import AWKWARD, documents, words
from tests.llm.test_dedup import plain_components
from tests.llm.test_native import plain_base
from tests.llm.test_text import plain_hits
from tests.oracle_check import duck

SMALL = "/root/testdata/sf0.001"


def test_stages_match_plain_versions(spark):
    docs = read(spark, SMALL, "documents")
    rows = [tuple(r) for r in docs.collect()]

    out = P.language_id(spark, docs, SMALL)
    said = {r["doc_id"]: r["accepted"] for r in langid.digest(docs).collect()}
    rows = [r for r in rows if said[r[0]]]
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(rows)

    out = P.simhash_dedup(spark, out, SMALL)
    group = plain_components(rows, 4)
    rows = [r for i, r in enumerate(rows) if group[i] == r[0]]
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(rows)

    out = P.decontamination(spark, out, SMALL)
    bench = [tuple(r) for r in read(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    hit = {h[0] for h in plain_hits(rows, bench) if h[-1]}
    rows = [r for r in rows if r[0] not in hit]
    assert hit and out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(rows)

    out = P.secret_scan(spark, out, SMALL)
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == {r[0] for r in rows}
    for r in rows:
        text, at, clean = r[1], 0, ""
        for start, _, end, _ in plain_base(text):
            if start >= at:
                clean += text[at:start] + "[SECRET]"
            at = max(at, end)
        assert got[r[0]]["text"] == clean + text[at:] and got[r[0]]["n_chars"] == len(got[r[0]]["text"])

    out = P.mixing_stage(spark, out, SMALL)
    con = duck(SMALL)
    con.execute("CREATE OR REPLACE TEMP TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in got.values()])
    taken = {r[0]: r[4] for r in con.execute(queries.OP1_SQL).fetchall()}
    copies = {}
    for r in out.collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + len(words(r["text"]))
    assert copies == {i: n for i, n in taken.items() if n}


def test_run_writes_every_stage(spark):
    out = P.run(spark, SMALL)
    assert out.count() > 0 and {"doc_id", "text", "shard", "position"} <= set(out.columns)
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_dedup", "decontamination", "secret_scan", "mixing"]


@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_stages_on_awkward_tables(spark, rows):
    docs = documents(spark, rows)
    for name, stage in P.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() <= 4 * max(1, len(rows)), name
        if name != "mixing":
            assert out.columns == docs.columns, name


def test_registration():
    names = list(E.queries())
    assert "pipeline" in names
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len(queries.QUERIES) == 13 and set(queries.ORACLES) <= set(queries.QUERIES)
    assert set(queries.ORACLES) <= set(E.oracle_sql())
