"""Every query that has SQL gives the rows of its SQL, on the smallest tables."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tests.oracles import TABLES, disagreement
from vellum.plans.catalog import ORACLES, QUERIES

NAMES = sorted(set(QUERIES) & set(ORACLES))


@pytest.fixture(scope="module")
def compared(spark):
    """All comparisons, some at a time: most of the work is planning, which one query does alone."""
    with ThreadPoolExecutor(8) as pool:
        yield {name: pool.submit(disagreement, spark, QUERIES[name], ORACLES[name]) for name in NAMES}


@pytest.mark.skipif(not TABLES.is_dir(), reason="the test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_those_of_the_sql(compared, name):
    assert compared[name].result() is None
