"""Every registered query against its DuckDB oracle at sf0.01 (the driver's check)."""
import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck
from conftest import SF_ORACLE

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, QUERIES[name], ORACLES.get(name), SF_ORACLE, con)
    if ORACLES.get(name) is None:
        assert r["rows"] > 0
    else:
        assert r["ok"], r
        assert r["type_diffs"] == {}, r["type_diffs"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and len(df.columns) == 42
    assert all(0.0 <= r.aggregate_lexical_risk_score <= 1.0 for r in rows)
