"""Whitening against exact integers and a library's eigenvectors."""

from fractions import Fraction

import numpy as np
import pytest

from lodestack.llm import whitening
from lodestack.llm.queries import QUERIES
from lodestack.llm.whitening import Moments, squares, symmetric_qr, whitened

SF = "/root/testdata/sf0.001"


def exact_covariance(x):
    """Of integers, centred before multiplying, by fractions of whole numbers."""
    n, wide = len(x), x.astype(object)
    centred = n * wide - wide.sum(0)
    return np.array([[float(Fraction(int(a @ b), n**3)) for b in centred.T] for a in centred.T])


def test_streams_and_merges_give_the_moments_of_all_rows():
    draw = np.random.default_rng(0)
    x = draw.integers(-600, 600, (1000, 7)) + 100_000
    cuts = [0, 1, 2, 300, 300, 999, 1000]
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        m = Moments(7)
        for row in range(a, b, 37):
            m.add(x[row : min(row + 37, b)])
        parts.append(m)
    whole = Moments(7)
    for m in parts:
        whole.merge(m)
    assert whole.n == 1000 and whole.sums.tolist() == x.sum(0).tolist()
    assert np.allclose(whole.covariance(), exact_covariance(x), rtol=1e-12, atol=1e-8)


def test_large_numbers_keep_their_sums():
    x = np.array([[2**53 - 1, -(2**53)], [2**53 - 3, 5], [7, -9]] * 1000)
    m = Moments(2)
    m.add(x)
    assert m.sums.tolist() == x.astype(object).sum(0).tolist()
    c = np.array([[2**61 + 1, -(2**60) - 7], [2**31, 3], [-(2**42) - 5, 2**21]])
    assert [int(v) for v in squares(c).to_pylist()] == [sum(int(v) ** 2 for v in row) for row in c]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 64])
def test_symmetric_qr(n):
    draw = np.random.default_rng(n)
    kinds = [np.zeros((n, n)), np.eye(n), draw.normal(size=(n, n)), np.ones((n, n)), np.diag(np.arange(n, dtype=float)), 1e9 * draw.normal(size=(n, n))]
    for a in kinds:
        a = a + a.T
        values, vectors = symmetric_qr(a)
        size = np.abs(a).max(initial=0)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1] if n else [], atol=1e-12 * size + 1e-300)
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-11 * size + 1e-300)


def truth(rows, most=8):
    """(id, component) to n, deviation, whitened up to sign, explained."""
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows])
    n, s = len(x), x.sum(0)
    v = exact_covariance(x)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = ((x - s / n) @ vectors) / np.sqrt(values)
    deviation = [sum(int(c) ** 2 for c in n * row - s) for row in x]
    return n, deviation, white[:, :most], values[:most] / np.trace(v)


def check(found, rows):
    n, deviation, white, explained = truth(rows)
    k = white.shape[1]
    assert len(found) == len(rows) * k
    by = {(r.vec_id, r.component): r for r in found}
    signs = [np.sign(by[rows[0][0], c + 1].whitened) * np.sign(white[0, c]) for c in range(k)]
    for i, (id_, _) in enumerate(rows):
        for c in range(k):
            r = by[id_, c + 1]
            assert (r.n, int(r.deviation)) == (n, deviation[i])
            assert r.whitened == pytest.approx(signs[c] * white[i, c], abs=1e-8)
            assert r.explained == pytest.approx(explained[c], rel=1e-9)
            assert r.identity_error < 1e-9


def test_query_over_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = QUERIES["op12_embedding_whitening"](spark, SF)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(found.dtypes)["deviation"] == "bigint"
    check(found.collect(), rows)


def vectors(spark, rows, more="n int, dims string"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<float>, {more}")


def test_rows_that_are_odd(spark):
    draw = np.random.default_rng(3)
    good = [(i, draw.normal(size=3).astype(np.float32).tolist()) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [0.0, float("inf"), 0.0]), (104, [])]
    check(whitened(vectors(spark, good + bad)).collect(), good)
    assert whitened(vectors(spark, bad)).count() == 0
    assert whitened(vectors(spark, good[:1])).count() == 0  # no variance
    assert whitened(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0


def test_a_flat_dimension_repeats_and_lengths(spark, monkeypatch):
    draw = np.random.default_rng(4)
    rows = [(i % 20, [*draw.normal(size=2).tolist(), 0.5]) for i in range(60)] + [(None, [1.0, 2.0, 0.5])]
    found = whitened(vectors(spark, rows)).collect()
    assert len(found) == 61 * 2 and {r.component for r in found} == {1, 2} and {r.n for r in found} == {61}
    assert max(r.identity_error for r in found) < 1e-9
    mixed = [(i, draw.normal(size=2 + i % 3).tolist()) for i in range(90)]
    for limit in (16 << 20, 0):  # models broadcast, and joined
        monkeypatch.setattr(whitening, "BROADCAST_BYTES", limit)
        found = whitened(vectors(spark, mixed)).collect()
        for d in (2, 3, 4):
            own = [(i, np.float32(v).tolist()) for i, v in mixed if len(v) == d]
            check([r for r in found if r.vec_id % 3 == d - 2], own)


def test_entries_beyond_the_doubles_are_an_error(spark):
    rows = [(1, [1.0, 2.0]), (2, [3e38, 1.0])]
    with pytest.raises(Exception, match="2\\^53"):
        whitened(vectors(spark, rows)).collect()
    check(whitened(vectors(spark, [(1, [70000.0, 2.0]), (2, [-65536.0, 1.0]), (3, [1.0, 5.0])])).collect(), [(1, [70000.0, 2.0]), (2, [-65536.0, 1.0]), (3, [1.0, 5.0])])
