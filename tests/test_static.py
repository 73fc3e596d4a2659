"""Static guards on the package source: rules every operator keeps."""

import pathlib
import re

import __spark_entry__ as E

PKG = pathlib.Path(__file__).resolve().parent.parent / "riskengine"
SOURCES = {p: p.read_text() for p in PKG.rglob("*.py")}


def test_no_local_checkpoint_or_cross_join():
    for p, src in SOURCES.items():
        assert "localCheckpoint" not in src, p
        assert ".crossJoin(" not in src and "how=\"cross\"" not in src, p


def test_no_row_at_a_time_python_udfs():
    for p, src in SOURCES.items():
        assert not re.search(r"@F\.udf|F\.udf\(|@udf\b|\budf\(", src), p


def test_library_does_not_import_the_llm_subpackage():
    for p, src in SOURCES.items():
        if "llm" not in p.parts:
            assert "llm" not in src, p
