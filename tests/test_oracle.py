"""Every registered query against its DuckDB counterpart on the smallest tables."""

import pytest
from compare import compare, duck

from corpuslens.plans import catalog

SF = "/root/testdata/sf0.001"

#: Queries without SQL, and where their results are held against a loop or a rule instead.
NO_SQL = {
    "chunk_braces": "tests/test_text.py",
    "split_to_limit": "tests/test_text.py",
    "repo_context": "its sections by SQL (dependency_cycles, tested_by, public_api, build_time_files)",
}


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, SF)
    assert ok or (ok is None and name in NO_SQL), message


def test_most_queries_have_sql():
    assert len(catalog.oracle_sql()) >= 0.9 * len(catalog.QUERIES)
