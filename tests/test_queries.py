"""Every registered query of the engine that has SQL gives the rows of its SQL."""

import numpy as np
import pytest
from oracle import assert_same

import lodestack.store_queries  # noqa: F401 - adds its queries
from lodestack.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], SF)


def test_knn_join_asks_with_the_whole_query_set(spark):
    """Every id divisible by 100 is asked with, wherever it stands in the table, and all rows are searched: brute force."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = {}
    for q, v in zip(ids, x, strict=True):
        if q % 100 == 0:
            want[int(q)] = ids[np.lexsort((ids, ((x - v) ** 2).sum(1)))[:5]].tolist()
    got = {}
    for r in sorted(QUERIES["knn_join_hundredths"](spark, SF).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(want) == (ids % 100 == 0).sum() and max(want) >= 100
    assert got == want
