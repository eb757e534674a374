"""The queries that SQL can express agree with it on whole tables."""

import pytest

from quernstone.llm import queries
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])
