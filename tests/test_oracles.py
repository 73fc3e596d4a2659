"""Every registered query with an oracle agrees with DuckDB (sf0.001, whole tables)."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import check, duck
from tests.conftest import SF_SMALL

# The library's own queries; those of the llm subpackage are tested in tests/llm.
SQLS = {name: q.oracle() for name, q in E.REGISTRY.items() if q.sql is not None}
QUERIES = {name: q.run for name, q in E.REGISTRY.items()}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_oracle(spark, con, name):
    r = check(spark, name, QUERIES[name], SQLS[name], con, SF_SMALL)
    assert r["status"] == "ok", r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["machine_label", "total_assets", "high_risk_assets", "avg_risk", "monitored_stable"]
    assert df.count() > 0


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(SQLS)
    assert rows_only <= {"train_select", "scenario_check", "forest_importance", "forest_contributions",
                         "forest_fleet_impact", "model_linear_contributions"}
