"""Every training-data query with SQL against DuckDB over the whole tables."""
import pytest

from lurescope.llm.queries import oracle_sql, queries
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, name):
    got = compare(spark, name, queries()[name], oracle_sql()[name], SF_SMALL, duck(SF_SMALL))
    assert got["ok"], got
    assert not got["type_diffs"], got
