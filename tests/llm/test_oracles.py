"""The numbered queries that have SQL give the rows of their SQL, on the smallest tables."""

import pytest

from tests.oracles import TABLES, disagreement
from vellum.llm.queries import ORACLES, QUERIES


@pytest.mark.skipif(not TABLES.is_dir(), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_those_of_the_sql(spark, name):
    assert disagreement(spark, QUERIES[name], ORACLES[name]) is None
