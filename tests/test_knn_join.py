"""Block products against plain distances: both ways of joining, ties, odd vectors, more neighbours than rows."""

import math

import numpy as np
import pytest

from lodestack.operators import knn


def plain(rows, asked, k, metric):
    out = []
    for q, v in asked:
        far = []
        for i, x in rows:
            if v is None or x is None or len(x) != len(v) or any(c is None for c in [*x, *v]):
                continue
            if metric == "l2":
                d = math.sqrt(sum((a - b) ** 2 for a, b in zip(x, v, strict=True)))
            else:
                norm = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in v))
                d = 1 - sum(a * b for a, b in zip(x, v, strict=True)) / norm if norm else math.nan
            if not math.isnan(d):
                far.append((round(d, 9), i))
        out += [(q, i, n + 1, d) for n, (d, i) in enumerate(sorted(far)[:k])]
    return sorted(out)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_join(spark, monkeypatch, metric, limit):
    monkeypatch.setattr(knn, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(knn, "BLOCK_BYTES", 512)
    draw = np.random.default_rng(3)
    rows = [(i, draw.integers(-3, 4, 4).astype(float).tolist()) for i in range(120)]  # many ties, some zero
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [1.0, 2.0]), (203, [0.0] * 4), (204, []), (205, [2.0, 1.0])]
    asked = [(f"q{i}", v) for i, v in rows[:10]] + [("n", None), ("z", [0.0] * 4), ("two", [1.0, 1.5]), ("none", [1.0] * 7)]
    for k in (1, 5, 500):
        found = knn.knn_join(
            spark.createDataFrame(rows, "vec_id long, embedding array<float>"), spark.createDataFrame(asked, "query_id string, query array<float>"), k, metric
        )
        assert found.columns == ["query_id", "vec_id", "distance", "rank"]
        got = sorted((r.query_id, r.vec_id, r.rank, round(r.distance, 9) + 0.0) for r in found.collect())
        if metric == "cosine":  # parallel vectors tie but for rounding: distances by rank are what counts
            assert sorted((q, n, abs(d)) for q, _, n, d in got) == sorted((q, n, abs(d)) for q, _, n, d in plain(rows, asked, k, metric))
        else:
            assert got == plain(rows, asked, k, metric)
