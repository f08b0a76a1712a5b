import pytest
from compare import difference, duck

from lexloom.plans.oracle import ORACLE
from lexloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    if name not in ORACLE:
        assert QUERIES[name](spark, SF).count() > 0
    else:
        assert difference(spark, con, QUERIES[name], ORACLE[name], SF) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
