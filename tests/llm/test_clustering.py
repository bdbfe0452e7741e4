"""Clustering against plain Lloyd's rounds in Python's whole numbers; the query's SQL is held against it with the others."""

import hashlib
import math

import numpy as np
import pytest

from lodestack.llm import clustering
from lodestack.llm.clustering import Tree, assigned, clustered, first_centroids, moved, nearest, squared


def lloyd(rows, dims, clusters=8, rounds=10):
    """Straight from the definition: (id, cluster, distance, cluster inertia, inertia, hash) of each kept vector."""
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows]
    z = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in z] for _, v in kept]
        return [(min(range(len(z)), key=lambda k: (d[k], k)), min(d)) for d in far]

    for _ in range(rounds):
        at = [k for k, _ in assign()]
        for k in set(at):
            own = [v for (_, v), c in zip(kept, at, strict=True) if c == k]
            z[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = assign()
    each = [sum(d for k, d in last if k == c) for c in range(len(z))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z]
    return [(i, k, d, each[k], sum(each), names[k]) for (i, _), (k, d) in zip(kept, last, strict=True)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 9, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string")


def found(df):
    return sorted(((r.vec_id, r.cluster, int(r.distance), int(r.cluster_inertia), int(r.inertia), r.centroid_sha256) for r in df.collect()), key=str)


def clumps(n, dims, seed, spread=0.01):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(12, dims))
    return [(i, (middles[draw.integers(12)] + spread * draw.normal(size=dims)).tolist()) for i in range(n)]


def test_every_row_is_assigned_once_and_to_the_nearest():
    draw = np.random.default_rng(0)
    for x in (draw.integers(-50, 50, (700, 3)), np.repeat(draw.integers(-9, 9, (3, 3)), 200, axis=0), draw.integers(0, 2, (500, 2))):
        z = draw.integers(-50, 50, (8, x.shape[1]))
        z[5] = z[2]  # a tie of centroids
        tree = Tree(x, 16)
        y, cluster, times = x[tree.order], np.full(len(x), -1), np.zeros(len(x), int)
        for at, k, balls in assigned(tree, y, z):
            for a, c in zip(at, k, strict=True):
                rows = slice(tree.begin[a], tree.end[a]) if balls else a
                cluster[rows], times[rows] = c, times[rows] + 1
        assert (times == 1).all() and (cluster == nearest(y, z)[0]).all()
        assert all((tree.sums[k] == y[b:e].sum(0)).all() for k, (b, e) in enumerate(zip(tree.begin, tree.end, strict=True)))


def test_distances_are_exact_at_any_size():
    for most in (100, 1 << 27, 1 << 40, 1 << 50):
        x = np.random.default_rng(1).integers(-most, most, (5, 4))
        z = np.random.default_rng(2).integers(-most, most, (3, 4))
        truth = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in z] for v in x]
        assert squared(x, z).tolist() == truth


def test_whole_balls_are_used_where_clusters_are_apart(spark):
    rows = vectors(spark, clumps(3000, 8, 5)).selectExpr("vec_id as id", "embedding as v")
    blocks = rows.mapInArrow(clustering.planting(8, 1024, 32), clustering.TREES)
    _, whole = moved(blocks, first_centroids(rows, 8, 3, 1024))
    assert whole > 0


@pytest.mark.parametrize(("n", "dims", "spread"), [(300, 4, 0.01), (250, 64, 1.0), (5, 3, 1.0), (120, 1, 0.5)])
def test_rounds(spark, n, dims, spread, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 64)
    rows = clumps(n, dims, n, spread)
    assert found(clustered(vectors(spark, rows), dims=dims)) == sorted(lloyd(rows, dims), key=str)


def test_rows_that_are_odd(spark):
    draw = np.random.default_rng(8)
    good = [(i % 30, draw.normal(size=4).tolist()) for i in range(60)] + [(None, [1.0, 2.0, 3.0, 4.0]), (77, [0.5] * 4), (78, [0.5] * 4)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [float("nan")] * 4), (103, [float("inf")] * 4), (104, []), (105, [1.0] * 5)]
    assert found(clustered(vectors(spark, good + bad), dims=4)) == sorted(lloyd(good, 4), key=str)
    assert clustered(vectors(spark, bad), dims=4).count() == 0
    equal = [(i, [0.25, -0.25]) for i in range(20)]
    assert found(clustered(vectors(spark, equal), dims=2)) == sorted(lloyd(equal, 2), key=str)  # seven clusters stay empty


def test_large_components(spark):
    rows = [(i, [70000.0 * i, -1e9 * i, float(i)]) for i in range(30)]
    assert found(clustered(vectors(spark, rows), dims=3)) == sorted(lloyd(rows, 3), key=str)
    with pytest.raises(Exception, match="2\\^50"):
        clustered(vectors(spark, [(1, [1e30, 0.0])]), dims=2).collect()
