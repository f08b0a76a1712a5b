"""Queries of the llm subpackage that SQL can state."""

import pytest
from compare import difference, duck

pytest.importorskip("lexloom.llm")

SF = "/root/testdata/sf0.01"


def test_queries_equal_their_sql(spark):
    from lexloom.llm.queries import ORACLE, QUERIES

    con = duck(SF)
    for name, sql in ORACLE.items():
        assert difference(spark, con, QUERIES[name], sql, SF) == "", name
