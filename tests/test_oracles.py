"""Every registered query of the library against DuckDB on the smallest given tables, in one session."""

from pathlib import Path

import pytest

from catalogue.registry import ORACLES, QUERIES
from oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return duck(SF)


@pytest.mark.skipif(not Path(SF).exists(), reason="given tables absent")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, database, name):
    assert compare(name, spark, database, SF, QUERIES, ORACLES) is None


def test_only_the_large_similarity_query_has_no_oracle():
    assert set(QUERIES) - set(ORACLES) == {"line_assignment_large"}
