"""Fill-in-the-middle against a plain version and SQL."""

import hashlib
import random
import re
from collections import Counter

from riskengine.llm import fim, queries
from tests.conftest import SF_SMALL
from tests.llm.helpers import AWKWARD, documents
from tests.oracle_check import check, duck

MARKED = [(40, "a <P> inside\nb\nc", "en", "s"), (41, "<M>", "en", "s"), (42, "one\ntwo\nthree", "en", "s"),
          (43, "\n\n\n", "en", "s"), (44, "ends <\n<S\n>P>\n", "en", "s"), (45, "é\nß\r\n漢字\n😀", "de", "s")]


def plain(doc, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out


def compare(spark, rows, **rates):
    found = fim.transform(documents(spark, rows).withColumn("form", fim.F.lit("clash")).withColumn("Pieces", fim.F.lit(1)),
                          **{f"{k}_percent": v for k, v in rates.items()})
    got = Counter(tuple(r) for r in found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect())
    rate, spm = rates.get("fim", 100), rates.get("spm", 50)
    assert got == Counter((r[0], *plain(r[0], r[1], rate, spm)) for r in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    back = fim.digest(found).collect()
    assert Counter((r.doc_id, r.output_sha256, r.restored_sha256) for r in back) == Counter(
        (r[0], sha(plain(r[0], r[1], rate, spm)[-1]), sha(r[1] or "")) for r in rows)


def test_awkward_rows_and_rates(spark):
    r = random.Random(5)
    rows = AWKWARD + MARKED + [(i, "".join(r.choice(["a", "é", "\n", "<", "P>", " ", "x\n"]) for _ in range(r.randrange(40))), "en", "s")
                               for i in range(100, 300)]
    compare(spark, rows)
    compare(spark, rows, fim=40, spm=90)
    compare(spark, rows, fim=0)


def test_long_text_and_empty_table(spark):
    compare(spark, [(1, "line of text\n" * 300_000, "en", "s"), (2, "no line end " * 300_000, "en", "s")])
    empty = fim.digest(fim.transform(documents(spark, [])))
    assert empty.count() == 0 and "restored_sha256" in empty.columns


def test_pieces_cover_the_text_once(spark):
    """Cuts only split descriptors: the text's bytes are each in one descriptor."""
    for row in fim.describe(documents(spark, AWKWARD + MARKED)).collect():
        own = sorted((p.start, p.length) for p in row.pieces if p.buffer == fim.TEXT)
        assert sum(n for _, n in own) == len((row.text or "").encode())
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_query_equals_sql(spark):
    found = check(spark, "op11_fim", queries.op11_fim, queries.ORACLES["op11_fim"], duck(SF_SMALL), SF_SMALL)
    assert found["status"] == "ok", found
