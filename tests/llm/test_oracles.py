"""Every operator's query that has SQL gives the rows of its SQL."""

import pytest
from oracle import assert_same

from lodestack.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], SF)
