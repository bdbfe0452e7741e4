"""Centroid clustering (Lloyd's rounds) on whole numbers, filtered by partition-local ball trees.

1. Each task packs its rows into blocks and builds a tree over each: a ball holds the rows of a range, with its centre,
   its radius, their count and their exact sum. The blocks are stored once and serve all rounds.
2. In a round a task takes each tree from its root. By the triangle inequality a centroid that is farther from a ball's
   centre than the nearest one by more than twice the radius wins none of its rows; where one is left, the whole ball
   goes to it by count and sum. Other balls are left for their halves, and leaves compare exact distances.
3. Tasks hand on a count and a sum a cluster; those, cluster by component, are all that the driver ever sees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Task, freeing, in_small_batches, ragged, stored
from .whitening import usable

SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
#: Bytes of vectors in a block, about, its most rows, and rows of a leaf.
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 4096
LEAF = 32
#: Components times the scale stay below this, so that a block's sums fit in 64 bits.
LARGEST = 1 << 50
#: Share of a distance by which bounds are widened, so that rounding never decides.
SLACK = 1e-9


# ---------------------------------------------------------------- trees


class Tree:
    """A ball tree over rows x of whole numbers; nodes are ranges of rows in level order, node 0 is the root.

    order: the rows' order; begin, end: each node's range in it; child: its first child (the second follows), 0 for a
    leaf; centre: the mean of the range as doubles; radius: at least the largest distance to it; sums: exact.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        order, ranges, child, at = np.arange(len(x)), [(0, len(x))], [], 0
        while at < len(ranges):
            lo, hi = ranges[at]
            at += 1
            child.append(0)
            rows = x[order[lo:hi]]
            if hi - lo > leaf:
                spread = rows.max(0) - rows.min(0)
                widest = int(np.argmax(spread))
                if spread[widest] > 0:  # equal rows stay together: their ball has no radius
                    mid = (hi - lo) // 2
                    order[lo:hi] = order[lo:hi][np.argpartition(rows[:, widest], mid)]
                    child[-1] = len(ranges)
                    ranges += [(lo, lo + mid), (lo + mid, hi)]
        self.order, self.child = order, np.array(child, np.int32)
        self.begin, self.end = (np.array(r, np.int32) for r in zip(*ranges, strict=True))
        y = x[order]
        wide = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(y, 0)])
        self.sums = wide[self.end] - wide[self.begin]
        self.centre = self.sums / (self.end - self.begin)[:, None]
        self.radius = np.zeros(len(child))
        for k, (lo, hi) in enumerate(ranges):
            self.radius[k] = np.sqrt(np.square(y[lo:hi] - self.centre[k]).sum(1).max())

    @classmethod
    def of(cls, parts: dict) -> Tree:
        tree = cls.__new__(cls)
        tree.__dict__.update(parts)
        return tree


def squared(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each row of z; Python's numbers where 64 bits may not do."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(z).max(initial=0)))
    if 4 * largest**2 * max(1, x.shape[1]) < 1 << 53:  # every sum below is a whole number that doubles hold
        xf, zf = x.astype(float), z.astype(float)
        return (np.square(xf).sum(1)[:, None] - 2 * (xf @ zf.T) + np.square(zf).sum(1)).astype(np.int64)
    if 4 * largest**2 * max(1, x.shape[1]) < 1 << 63:
        return np.stack([np.square(x - one).sum(1) for one in z], 1)
    wide, out = x.astype(object), np.empty((len(x), len(z)), object)
    for k, one in enumerate(z):
        out[:, k] = [sum(v * v for v in row) for row in (wide - one.astype(object)).tolist()]
    return out


def nearest(x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the nearest row of z, ties to the first, and the squared distance."""
    d = squared(x, z)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def assigned(tree: Tree, y: np.ndarray, z: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(nodes, clusters, True) of balls that go to one cluster whole, and (rows, clusters, False) of leaves' rows.

    y are the rows in the tree's order; each row comes once, in its ball or by itself.
    """
    zf = z.astype(float)
    nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(z)), bool)
    while len(nodes):
        centre, radius = tree.centre[nodes], tree.radius[nodes]
        gap = np.sqrt(np.square(centre[:, None, :] - zf[None, :, :]).sum(2))
        gap[~open_] = np.inf
        best = gap.min(1)
        # A row of the ball is at most best + radius from the nearest centroid, at least gap - radius from another.
        open_ = gap - radius[:, None] <= (best + radius)[:, None] + SLACK * (best + radius + np.abs(zf).max(initial=0))[:, None]
        one = open_.sum(1) == 1
        if one.any():
            yield nodes[one], open_[one].argmax(1), True
        leaf = ~one & (tree.child[nodes] == 0)
        if leaf.any():
            begin, size = tree.begin[nodes[leaf]].astype(np.int64), (tree.end - tree.begin)[nodes[leaf]].astype(np.int64)
            rows = ragged(begin, size)
            yield rows, nearest(y[rows], z)[0], False
        inner = ~one & ~leaf
        first = tree.child[nodes[inner]].astype(np.int64)
        nodes, open_ = np.repeat(first, 2), np.repeat(open_[inner], 2, axis=0)
        nodes[1::2] += 1


# ---------------------------------------------------------------- blocks


TREES = "dims int, ids array<bigint>, data binary, child binary, begin binary, end binary, sums binary, centre binary, radius binary"
KINDS = {"data": "<i8", "child": "<i4", "begin": "<i4", "end": "<i4", "sums": "<i8", "centre": "<f8", "radius": "<f8"}


def planting(dims: int, scale: int, leaf: int) -> Task:
    """Batches of (id, v) to blocks with their trees; a block's rows are of one task."""
    most = min(BLOCK_ROWS, max(leaf, BLOCK_BYTES // (8 * dims)))

    def block(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        tree = Tree(x, leaf)
        parts = {"data": x[tree.order]} | {k: getattr(tree, k) for k in list(KINDS)[1:]}
        columns = [pa.array([dims], pa.int32()), pa.array([ids.take(pa.array(tree.order)).to_pylist()], pa.list_(pa.int64()))]
        columns += [pa.array([np.ascontiguousarray(v.astype(KINDS[k])).tobytes()], pa.binary()) for k, v in parts.items()]
        return pa.RecordBatch.from_arrays(columns, ["dims", "ids", *parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, rows = [], [], 0
        for batch in batches:
            flat = np.floor(scale * batch.column("v").flatten().to_numpy(zero_copy_only=False))
            if np.abs(flat).max(initial=0) >= LARGEST:
                raise OverflowError("a component times the scale reaches 2^50")
            ids.append(batch.column("id"))
            held.append(flat.astype(np.int64).reshape(-1, dims))
            rows += batch.num_rows
            while rows >= most:
                all_ids, x = pa.concat_arrays(ids), np.concatenate(held)
                yield block(all_ids.slice(0, most), x[:most])
                ids, held, rows = [all_ids.slice(most)], [x[most:]], rows - most
        if rows:
            yield block(pa.concat_arrays(ids), np.concatenate(held))

    return run


def trees_of(batch: pa.RecordBatch) -> Iterator[tuple[list[int], np.ndarray, Tree]]:
    for i in range(batch.num_rows):
        dims = batch.column("dims")[i].as_py()
        parts = {k: np.frombuffer(batch.column(k)[i].as_py(), kind) for k, kind in KINDS.items()}
        for k in ("data", "sums", "centre"):
            parts[k] = parts[k].reshape(-1, dims)
        y = parts.pop("data")
        yield batch.column("ids")[i].as_py(), y, Tree.of(parts)


def summing(z: np.ndarray) -> Task:
    """Blocks to the exact sum and count of each cluster's rows in this task: cluster, count, sums (as text, of any size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * len(z), np.zeros(z.shape, object)
        whole = 0
        for batch in batches:
            for _, y, tree in trees_of(batch):
                for at, cluster, balls in assigned(tree, y, z):
                    size = (tree.end - tree.begin)[at] if balls else np.ones(len(at), np.int64)
                    whole += int(size.sum()) if balls else 0
                    for k in np.unique(cluster):
                        mine = cluster == k
                        counts[k] += int(size[mine].sum())
                        sums[k] += (tree.sums if balls else y)[at[mine]].sum(0).astype(object)
        kept = [k for k, n in enumerate(counts) if n]
        columns = [pa.array(kept, pa.int32()), pa.array([counts[k] for k in kept], pa.int64())]
        columns += [pa.array([list(map(str, sums[k])) for k in kept], pa.list_(pa.string())), pa.array([whole] * len(kept), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "count", "sums", "in_balls"])

    return run


def naming(z: np.ndarray) -> Task:
    """Blocks to rows id, cluster, distance; of a whole ball only the distances to its centroid are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, y, tree in trees_of(batch):
                cluster, distance = np.empty(len(y), np.int32), np.empty(len(y), object)
                for at, found, balls in assigned(tree, y, z):
                    size = (tree.end - tree.begin)[at].astype(np.int64) if balls else None
                    rows = ragged(tree.begin[at].astype(np.int64), size) if balls else at
                    cluster[rows] = np.repeat(found, size) if balls else found
                for k in np.unique(cluster):
                    mine = np.flatnonzero(cluster == k)
                    distance[mine] = squared(y[mine], z[k : k + 1])[:, 0].tolist()
                columns = [pa.array(ids, pa.int64()), pa.array(cluster)]
                columns.append(pa.array(map(str, distance), pa.string()).cast(pa.decimal128(38, 0)))
                yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    return run


# ---------------------------------------------------------------- rounds


def first_centroids(rows: DataFrame, clusters: int, seed: int, scale: int) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id, as whole numbers; a few rows, brought to the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()
    return np.floor(scale * np.array([r.v for r in first], float)).astype(np.int64)


def moved(blocks: DataFrame, z: np.ndarray) -> tuple[np.ndarray, int]:
    """The centroids after a round: floor of each component's mean; empty clusters stay. And how many rows went in whole balls."""
    sums = in_small_batches(blocks).mapInArrow(freeing(summing(z)), "cluster int, count long, sums array<string>, in_balls long")
    each = sums.select("cluster", "count", "in_balls", F.posexplode("sums").alias("place", "s"))
    each = each.groupBy("cluster", "place").agg(
        F.sum("count").alias("count"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("in_balls").alias("in_balls")
    )
    z, whole = z.copy(), 0
    for row in each.collect():  # clusters times components, whatever the number of rows
        z[row["cluster"], row["place"]] = int(row["s"]) // row["count"]
        whole = max(whole, row["in_balls"])
    return z, whole


def clustered(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = 64,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = 3,
    scale: int = SCALE,
    leaf: int = LEAF,
) -> DataFrame:
    """One row per vector kept: id, cluster, distance, cluster_inertia, inertia (decimals), centroid_sha256.

    Vectors of exactly dims components, none null or non-finite, are kept; components become floor(scale * x).
    Centroids start as the vectors with the smallest lower-case hex SHA-256 of `seed:id` (rows that share an id: the
    smaller vector; no id counts as empty text), in that order; with fewer vectors than clusters each starts one. Each
    round assigns every vector to the nearest centroid (squared distance, ties to the smaller number) and moves every
    centroid that has vectors to the floor of their means. After the last round vectors are assigned once more.
    centroid_sha256 is that of the final centroid's components as decimal integers joined by `,`. Every row kept comes
    back, also rows that repeat an id or a vector. A table without such vectors gives no rows. A component of
    2^50 / scale or more is an error. Other columns of vectors are not looked at.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), usable(F.col(vector_col)).alias("v")).where(F.size("v") == dims)
    blocks = stored(in_small_batches(rows).mapInArrow(freeing(planting(dims, scale, leaf)), TREES), "ball_trees")
    z = first_centroids(rows, clusters, seed, scale).reshape(-1, dims)
    for _ in range(rounds if len(z) else 0):
        z, _ = moved(blocks, z)
    found = in_small_batches(blocks).mapInArrow(freeing(naming(z)), "id long, cluster int, distance decimal(38,0)")
    found = stored(found, "clustered")
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = stored(inertia.join(centroids(vectors.sparkSession, z), "cluster"), "inertia")
    total = inertia.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = inertia.select("cluster", "cluster_inertia", total.scalar().alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def centroids(spark: SparkSession, z: np.ndarray) -> DataFrame:
    named = spark.createDataFrame([(k, ",".join(map(str, row))) for k, row in enumerate(z.tolist())], "cluster int, line string")
    return named.select("cluster", F.sha2("line", 256).alias("centroid_sha256"))
