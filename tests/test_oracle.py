"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, differences

from quillspan.registry.oracle import ORACLE
from quillspan.registry.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_query(spark, duck, name):
    assert differences(duck, spark, QUERIES[name], ORACLE[name], SF) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
