"""Top-k by brute force where scores exceed 64 bits, and at the edges of what is exact."""

import math

import numpy as np
import pytest

from lodestack.llm import topk


def brute(rows, k):
    scaled = {i: [math.floor(1024 * c) for c in v] for i, v in rows}
    out = []
    for q in sorted(i for i in scaled if i % 3 == 0):
        far = sorted((-sum(a * b for a, b in zip(scaled[q], v, strict=True)), i) for i, v in scaled.items() if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(far[:k])]
    return out


@pytest.mark.parametrize("size", [10.0, 65_536.0, 70_000.0, 1e9, 8e12])
def test_large_components(spark, size, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 16)
    draw = np.random.default_rng(int(size))
    rows = [(i, (size * draw.uniform(-1, 1, 6)).tolist()) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df, df.vec_id % 3 == 0, k=4, wide=True).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, int(r.score)) for r in found) == sorted(brute(rows, 4))


def test_what_doubles_cannot_tell_apart_is_an_error(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2\\^53"):
        topk.top_k(df, df.vec_id == 0).collect()
