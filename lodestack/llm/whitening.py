"""Whitening of embeddings: streaming moments, merged in parallel, then the principal axes by symmetric QR.

1. Each task runs Welford's update over its rows: with the mean so far m and a row x, the n-th, the moments gain
   (n - 1) / n * (x - m)(x - m)^T and the mean (x - m) / n. Sums are whole numbers and exact, so a batch's running
   means are known at once, and its rank-one updates are one product of matrices.
2. Tasks' moments are merged by the parallel formula, in slots first and then in one row a vector length.
3. The covariance is brought to tridiagonal form by reflections and to diagonal form by QR steps with shifts.
4. A second scan projects the centred rows; the moments of what it wrote give the error of the identity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Task, freeing, in_small_batches, lookup, stored

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
#: Whole numbers from here on aren't told apart by doubles, nor are their sums sure to fit.
LARGEST = 1 << 53
#: Components whose variance is below this share of the largest have none but by rounding.
LEAST_SHARE = 1e-12
#: Tasks' moments are merged in so many slots, then in one.
SLOTS = 64
#: Moments that a task holds before it hands them on; a task meets more than one length only in mixed tables.
HELD_BYTES = 64 << 20
#: Bytes of models that may be broadcast; beyond that they are joined.
BROADCAST_BYTES = 16 << 20


def usable(vector: Column) -> Column:
    """vector as doubles; null if it is null or has a null or non-finite entry."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), wide)


def whole_numbers(values: np.ndarray, scale: int, offset: int) -> np.ndarray:
    """floor(scale * c) + offset as 64-bit integers."""
    x = np.floor(scale * values)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise OverflowError(f"an entry times the scale reaches 2^53: {values[np.abs(x).argmax()]}")
    return x.astype(np.int64) + offset


def matrices(batch: pa.RecordBatch, key: str, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each key of a batch, whose lists are of one length: the key, the rows that have it, their entries as a matrix."""
    lists, keys = batch.column(column), batch.column(key).to_numpy()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values, lengths = lists.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for k in np.unique(keys):
        rows = np.flatnonzero(keys == k)
        yield int(k), rows, values[offsets[rows][:, None] + np.arange(lengths[rows[0]])]


# ---------------------------------------------------------------- moments


class Moments:
    """Count, exact sums and centred second moments of rows of whole numbers or doubles."""

    def __init__(self, dims: int, n: int = 0, sums: np.ndarray | None = None, m2: np.ndarray | None = None) -> None:
        self.n = n
        self.sums = np.zeros(dims, object) if sums is None else sums
        self.m2 = np.zeros((dims, dims)) if m2 is None else m2

    def add(self, x: np.ndarray) -> None:
        """Welford's updates by the rows of x, one after the other."""
        if not len(x):
            return
        # About a point near the mean, so that differences are small.
        near = (round(s / self.n) if x.dtype.kind == "i" else s / self.n for s in self.sums)
        origin = np.fromiter(near, x.dtype, x.shape[1]) if self.n else x[0]
        local = x - origin
        if local.dtype.kind == "i" and float(np.abs(local).max(initial=0)) * len(x) >= 2**62:
            local = local.astype(float)
        held = np.array([float(s - self.n * o) for s, o in zip(self.sums, origin.tolist(), strict=True)])  # sums about the origin
        counts = self.n + np.arange(len(x), dtype=float)[:, None]
        before = held + np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(local, 0)[:-1]])
        delta = local - before / np.maximum(counts, 1)
        self.m2 += delta.T @ (delta * (counts / (counts + 1)))
        self.sums = self.sums + np.array([sum_(c) for c in x.T], object)
        self.n += len(x)

    def merge(self, other: Moments) -> None:
        """The parallel formula: the moments of both sets of rows together."""
        if not self.n or not other.n:
            if other.n:
                self.n, self.sums, self.m2 = other.n, other.sums, other.m2
            return
        # Of exact sums, the difference of the means loses nothing: (S1 n2 - S2 n1) / (n1 n2).
        apart = (other.sums * self.n - self.sums * other.n) / (self.n * other.n)
        apart = apart.astype(float)
        self.m2 = self.m2 + other.m2 + np.outer(apart, apart) * (self.n / (self.n + other.n) * other.n)
        self.sums, self.n = self.sums + other.sums, self.n + other.n

    def covariance(self) -> np.ndarray:
        return (self.m2 + self.m2.T) / (2 * max(self.n, 1))


def sum_(column: np.ndarray) -> int | float:
    """Exact for whole numbers: halves are summed apart where 64 bits may not do."""
    if column.dtype.kind != "i":
        return float(column.sum())
    return (int((column >> 26).sum()) << 26) + int((column & ((1 << 26) - 1)).sum())


MOMENTS = "key int, slot int, n long, whole boolean, sums array<string>, m2 binary"


def as_row(key: int, slot: int, m: Moments, whole: bool) -> pa.RecordBatch:
    sums = [str(s) if whole else float(s).hex() for s in m.sums]
    columns = [pa.array([key], pa.int32()), pa.array([slot], pa.int32()), pa.array([m.n]), pa.array([whole])]
    columns += [pa.array([sums], pa.list_(pa.string())), pa.array([m.m2.astype("<f8").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["key", "slot", "n", "whole", "sums", "m2"])


def from_row(table: pa.Table | pa.RecordBatch, i: int) -> Moments:
    read = int if table.column("whole")[i].as_py() else float.fromhex
    sums = np.array([read(s) for s in table.column("sums")[i].as_py()] + [None], object)[:-1]
    d = len(sums)
    return Moments(d, table.column("n")[i].as_py(), sums, np.frombuffer(table.column("m2")[i].as_py(), "<f8").reshape(d, d))


def measured(key: str, column: str, whole: bool, scale: int, offset: int) -> Task:
    """Batches with a list column of doubles to rows of moments, one a key and task (more in tables of many keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = TaskContext.get().partitionId() % SLOTS, {}
        for batch in batches:
            for k, _, values in matrices(batch, key, column):
                if k not in held and sum(m.m2.nbytes for m in held.values()) + 8 * values.shape[1] ** 2 > HELD_BYTES:
                    yield from (as_row(other, slot, m, whole) for other, m in held.items())
                    held = {}
                held.setdefault(k, Moments(values.shape[1])).add(whole_numbers(values, scale, offset) if whole else values)
        yield from (as_row(k, slot, m, whole) for k, m in held.items())

    return run


def merging(keys: list[str]) -> Task:
    """Rows of moments, sorted by keys, to one row a group of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of, whole = None, None, True
        for batch in batches:
            for i in range(batch.num_rows):
                group, read = [batch.column(k)[i].as_py() for k in keys], from_row(batch, i)
                if now is not None and group == of:
                    now.merge(read)
                    continue
                if now is not None:
                    yield as_row(of[0], 0, now, whole)
                now, of, whole = read, group, batch.column("whole")[i].as_py()
        if now is not None:
            yield as_row(of[0], 0, now, whole)

    return run


def moments(rows: DataFrame, key: str, column: str, whole: bool, scale: int = 1, offset: int = 0) -> DataFrame:
    """rows with a list column of doubles, of one length for each key, to one row of moments a key."""
    made = in_small_batches(rows.select(key, column)).mapInArrow(freeing(measured(key, column, whole, scale, offset)), MOMENTS)
    for keys in (["key", "slot"], ["key"]):
        made = made.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(freeing(merging(keys)), MOMENTS)
    return made


# ---------------------------------------------------------------- eigenvectors


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and Q, with Q T Q^T = a: by Householder's reflections."""
    a, n = a.astype(float).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix: QR steps with Wilkinson's shifts.

    Each vector's entry of the largest size is positive. Equal eigenvalues leave their vectors free within their space.
    """
    n = len(a)
    d, e, q = tridiagonal(a)
    q = np.ascontiguousarray(q.T)  # rows turn faster than columns
    tiny = np.finfo(float).eps
    hi, steps = n - 1, 0
    while hi > 0:
        small = np.abs(e[:hi]) <= tiny * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0
        if e[hi - 1] == 0:
            hi, steps = hi - 1, 0
            continue
        steps += 1
        if steps > 100:
            raise ArithmeticError("the QR steps don't converge")
        zeros = np.flatnonzero(e[:hi] == 0)
        lo = zeros[-1] + 1 if len(zeros) else 0
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half or 1.0))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, o, w = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * p + 2 * c * s * w + s * s * o, s * s * p - 2 * c * s * w + c * c * o
            e[k] = (c * c - s * s) * w + c * s * (o - p)
            if k + 1 < hi:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k : k + 2] = np.array([[c, s], [-s, c]]) @ q[k : k + 2]
    order = np.argsort(-d, kind="stable")
    vectors = q[order].T
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(n)]) if n else np.ones(0)
    return d[order], vectors * signs


# ---------------------------------------------------------------- whitening


MODEL = "dims int, n long, sums array<string>, axes binary, explained array<double>"


def solving(most: int) -> Task:
    """Rows of moments to models: axes are the leading eigenvectors over the roots of their eigenvalues."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m, d = from_row(batch, i), batch.column("key")[i].as_py()
                v = m.covariance()
                values, vectors = symmetric_qr(v)
                kept = [k for k in range(min(most, d)) if values[k] > LEAST_SHARE * max(values[0], 0)]
                axes = vectors[:, kept] / np.sqrt(values[kept])
                explained = (values[kept] / np.trace(v)).tolist()
                columns = [pa.array([d], pa.int32()), pa.array([m.n]), batch.column("sums").slice(i, 1)]
                columns += [pa.array([np.ascontiguousarray(axes).tobytes()], pa.binary()), pa.array([explained], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["dims", "n", "sums", "axes", "explained"])

    return run


def squares(c: np.ndarray) -> pa.Array:
    """Exact sums of the squares of the rows of c (64-bit integers, or Python's), as decimals."""
    if c.dtype == object or (c.size and float(np.abs(c).max()) ** 2 * c.shape[1] >= 2**62):
        # Three limbs of 21 bits keep every product and sum within 64 bits.
        if c.dtype == object or np.abs(c).max() >= 1 << 62:
            total = [sum(int(v) ** 2 for v in row) for row in c]
        else:
            size = np.abs(c)
            low, mid, high = size & 0x1FFFFF, (size >> 21) & 0x1FFFFF, size >> 42
            parts = [(low, low, 0, 1), (low, mid, 21, 2), (mid, mid, 42, 1), (low, high, 42, 2), (mid, high, 63, 2), (high, high, 84, 1)]
            sums = [(np.einsum("ij,ij->i", a, b).tolist(), shift, times) for a, b, shift, times in parts]
            total = [sum(times * s[i] << shift for s, shift, times in sums) for i in range(len(c))]
        return pa.array(map(str, total), pa.string()).cast(pa.decimal128(38, 0))
    return pa.array(np.einsum("ij,ij->i", c, c)).cast(pa.decimal128(38, 0))


WHITENED = "id long, dims int, deviation decimal(38,0), whitened array<double>"


def projecting() -> Task:
    """Rows (ids, dims, data, n, sums, axes), each a block of vectors and its model, to whitened rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda c: batch.column(c)[i].as_py()  # noqa: E731, B023
                d, n = cell("dims"), cell("n")
                x = np.frombuffer(cell("data"), "<i8").reshape(-1, d)
                sums = [int(s) for s in cell("sums")]
                axes = np.frombuffer(cell("axes"), "<f8").reshape(d, -1)
                largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
                if largest < 1 << 62:
                    c = n * x - np.array(sums, np.int64)
                else:
                    c = n * x.astype(object) - np.array([*sums, None], object)[:-1]
                white = (c / n).astype(float) @ axes
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1])
                columns = [pa.array(cell("ids")), pa.array(np.full(len(x), d, np.int32)), squares(c)]
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(white.ravel())))
                yield pa.RecordBatch.from_arrays(columns, ["id", "dims", "deviation", "whitened"])

    return run


def packing(scale: int, offset: int) -> Task:
    """Rows (id, dims, v) to blocks of one length, as they come: dims, ids, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, values in matrices(batch, "dims", "v"):
                x = whole_numbers(values, scale, offset).astype("<i8")
                ids = batch.column("id").take(pa.array(rows))
                columns = [pa.array([d], pa.int32()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["dims", "ids", "data"])

    return run


def whitened(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """For each vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries c become x = floor(scale * c) + offset. n counts the vectors, S are their sums, V their covariance with
    divisor n. Components are V's unit eigenvectors by falling eigenvalue e. deviation is the exact sum over dimensions
    of (n x - S)^2 (a decimal), whitened the projection of x - S / n over sqrt(e), explained is e / trace(V), and
    identity_error the largest absolute entry of the whitened rows' own covariance minus the identity.

    Vectors that are null or hold null or non-finite entries are left out; so are empty vectors, which have no
    component. A component without variance can't be whitened and has no rows: there are none at all of a single
    vector or of equal vectors. Vectors of different lengths are whitened apart, each length by its own n, S and V.
    Rows that repeat an id, and rows without one, each count and each come back. An entry of 2^53 / scale or more is an
    error. Other columns of vectors are not looked at.
    """
    v = usable(F.col(vector_col))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("size(v) > 0").withColumn("dims", F.size("v"))
    models = moments(rows, "dims", "v", True, scale, offset).mapInArrow(freeing(solving(components)), MODEL)
    models = stored(models, "whitening_models")
    blocks = in_small_batches(rows).mapInArrow(freeing(packing(scale, offset)), "dims int, ids array<bigint>, data binary")
    used = with_model(blocks, models.select("dims", "n", "sums", "axes")).select("ids", "dims", "data", "n", "sums", "axes")
    made = stored(in_small_batches(used).mapInArrow(freeing(projecting()), WHITENED), "whitened")
    errors = moments(made, "dims", "whitened", False).mapInArrow(freeing(off_identity), "dims int, identity_error double")
    facts = stored(models.select("dims", "n", "explained").join(errors, "dims"), "whitening_facts")
    pair = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "pair")
    found = with_model(made, facts).select("id", pair, "n", "deviation", "identity_error")
    return found.select(
        F.col("id").alias(id_col),
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        F.col("pair.whitened").alias("whitened"),
        F.col("pair.explained").alias("explained"),
        "identity_error",
    )


def with_model(left: DataFrame, models: DataFrame) -> DataFrame:
    """left joined with the stored row of its length; these are broadcast where their size allows it."""
    widths = {"axes": 8 * COMPONENTS, "sums": 32}
    size = models.agg(F.sum(F.col("dims") * sum(widths.get(c, 0) for c in models.columns) + 200)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return left.join(F.broadcast(models), "dims")
    left = stored(left, "by_length")
    counts = left.groupBy("dims").agg(F.count("*").alias("weight"))
    return lookup(left, stored(models.join(counts, "dims"), "weighed_models"), "dims", "weight")


def off_identity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            m = from_row(batch, i)
            off = float(np.abs(m.covariance() - np.eye(len(m.m2))).max(initial=0))
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, 1), pa.array([off])], ["dims", "identity_error"])
