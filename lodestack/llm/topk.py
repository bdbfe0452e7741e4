"""Exact top-k by inner product, pruned by segment means and deviations from coarse to fine.

Vectors are packed in blocks, queries too; a task compares a block of queries with a block of vectors. For a cut of
the dimensions in segments of lengths n, q.x = sum over segments of n * mean(q) * mean(x) + the product of what
remains, and that product is at most n * sd(q) * sd(x). So sum(n * (mean mean + sd sd)) bounds the score from above,
as the same numbers bound the distance |q - x|^2 = |q|^2 + |x|^2 - 2 q.x from below. Finer cuts bound closer.

A first pass over one block of vectors gives each query a floor, the k-th of its exact scores there; against all
blocks only what may reach the floor is looked at any closer, and only what reaches it leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import freeing, lookup, stored, whole_groups

SCALE = 1024
K = 10
VECTOR_BLOCK = 4096
QUERY_BLOCK = 512
#: Blocks of queries that a task holds at once, beside one block of vectors.
QUERY_GROUP = 16
#: Scores are products of whole blocks where more than this share of a block's pairs is left, and below 2^53.
DENSE = 0.05
#: Numbers of segments, coarse to fine; those that a dimension is too small for are left out.
LEVELS = (4, 16)
#: Whole numbers from here on aren't told apart by doubles; below it every score fits in a decimal of 38 digits.
LARGEST = 1 << 53


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if the vector is null or has a null or non-finite component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), whole)


# ---------------------------------------------------------------- bounds


def segments(dims: int, parts: int) -> np.ndarray:
    """Begin of each segment, and the end of the last."""
    return np.linspace(0, dims, min(parts, max(1, dims)) + 1).astype(int)


def statistics(x: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of each row's segments, each times the root of the segment's length."""
    n = np.diff(cuts).astype(float)
    mean = np.add.reduceat(x, cuts[:-1], 1) / n
    square = np.add.reduceat(np.square(x - np.repeat(mean, np.diff(cuts), 1)), cuts[:-1], 1) / n
    return mean * np.sqrt(n), np.sqrt(square) * np.sqrt(n)


def largest_product(queries: np.ndarray, x: np.ndarray) -> int:
    return x.shape[-1] * max(1, int(np.abs(x).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0)))


def products(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact: as 64-bit integers, or as Python's where these may not do."""
    if largest_product(queries, x) < 1 << 62:
        return np.einsum("...d,...d->...", queries, x)
    return (queries.astype(object) * x.astype(object)).sum(-1)


def best(
    queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """The k highest exact scores of each query among the rows of x but its own, ties to smaller ids, and pairs scored.

    Scores below the query's floor are left out. Returns places of queries, places of rows, scores.
    """
    least = np.full(len(queries), np.iinfo(np.int64).min) if floors is None else floors.astype(np.int64)
    if x.shape[1] == 0:
        q, r = np.nonzero((query_ids[:, None] != ids[None, :]) & (least <= 0)[:, None])
        return *first_k(q, r, np.zeros(len(q), np.int64), ids, k), len(q)
    xf, qf = x.astype(float), queries.astype(float)
    slack = 1e-9 * (np.linalg.norm(qf, axis=1)[:, None] * np.linalg.norm(xf, axis=1)[None, :]) + 1e-6
    own = query_ids[:, None] == ids[None, :]
    levels = [(statistics(qf, c), statistics(xf, c)) for c in (segments(x.shape[1], p) for p in LEVELS if p <= x.shape[1] or p == LEVELS[0])]
    (qm, qs), (xm, xs) = levels[0]
    bound = qm @ xm.T + qs @ xs.T + slack
    bound[own] = -np.inf
    m = min(k, len(ids))
    if m == k:
        # The rows of the best coarse bounds are scored first; the least of k exact scores is what others must reach.
        seed = np.argpartition(-bound, m - 1, axis=1)[:, :m]
        exact = products(queries[:, None, :], x[seed])
        sure = np.where(np.isfinite(np.take_along_axis(bound, seed, 1)), exact, np.iinfo(np.int64).min)
        least = np.maximum(least, in_long(sure.min(1)))
    q, r = np.nonzero((bound >= least[:, None]) & ~own)
    for (qm, qs), (xm, xs) in levels[1:]:
        alive = np.zeros(len(q), bool)
        for at in range(0, len(q), 1 << 17):
            a, b = q[at : at + (1 << 17)], r[at : at + (1 << 17)]
            fine = np.einsum("ij,ij->i", qm[a], xm[b]) + np.einsum("ij,ij->i", qs[a], xs[b]) + slack[a, b]
            alive[at : at + len(a)] = fine >= least[a]
        q, r = q[alive], r[alive]
    exact_in_double = largest_product(queries, x) < 1 << 53
    if exact_in_double and len(q) > DENSE * bound.size:
        score = (qf @ xf.T)[q, r].astype(np.int64)
    else:
        parts = [products(queries[q[at : at + (1 << 16)]], x[r[at : at + (1 << 16)]]) for at in range(0, len(q), 1 << 16)]
        score = np.concatenate(parts) if parts else np.empty(0, np.int64)
    high = score >= least[q]
    return *first_k(q[high], r[high], score[high], ids, k), len(q)


def in_long(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; what doesn't fit becomes the next that does."""
    return np.clip(scores, np.iinfo(np.int64).min, np.iinfo(np.int64).max).astype(np.int64)


def first_k(q: np.ndarray, r: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    high, low = (score >> 62).astype(np.int64), (score & ((1 << 62) - 1)).astype(np.int64)
    order = np.lexsort((ids[r], -low, -high, q))
    q, r, score = q[order], r[order], score[order]
    begin = np.searchsorted(q, q)
    top = np.arange(len(q)) - begin < k
    return q[top], r[top], score[top]


# ---------------------------------------------------------------- blocks


def packed(vectors: DataFrame, size: int) -> DataFrame:
    """(id, v, floor) to rows (dims, part, ids, floors, data): blocks of vectors of one length, as little-endian 64-bit numbers.

    Blocks of one length are numbered by part from 0, without gaps but for a block in a hundred thousand.
    """
    dims = vectors.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.ceil(F.count("*") / size).alias("parts"))
    sized = lookup(vectors.withColumn("dims", F.size("v")), stored(dims, "dims"), "dims", "n")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = sized.select("id", "v", "floor", "dims", part.alias("part")).repartition("dims", "part").sortWithinPartitions("dims", "part")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["dims", "part"]):
            keys = np.stack([table.column(c).to_numpy() for c in ("dims", "part")], 1)
            cuts = np.append(np.flatnonzero(np.any(np.diff(keys, axis=0, prepend=-1), 1)), len(keys))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                for at in range(lo, hi, 2 * size):  # hashes deal unevenly; never more than two blocks' rows in one
                    some = table.slice(at, min(2 * size, hi - at))
                    data = some.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8")
                    if len(data) and np.abs(data).max() >= LARGEST:
                        raise OverflowError("a component times the scale reaches 2^53")
                    ids, floors = (some.column(c).to_numpy().astype("<i8").tobytes() for c in ("id", "floor"))
                    row = [[int(keys[lo, 0])], [int(keys[lo, 1])], [ids], [floors], [data.tobytes()]]
                    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], BLOCK)

    return dealt.mapInArrow(freeing(pack), "dims int, part int, ids binary, floors binary, data binary")


BLOCK = ["dims", "part", "ids", "floors", "data"]


def met(asked: DataFrame, data: DataFrame, k: int, first: bool = False) -> DataFrame:
    """(query_id, vec_id, score) of the k best of each query in each block of vectors; of block 0 only, or of all.

    The key of a task's work is a group of query blocks and one block of vectors. Both sides are repeated as often as the
    other has groups or blocks, and shuffled by the key, so work is dealt evenly and nothing is broadcast.
    """
    if first:
        data = data.where("part = 0")
    groups = asked.groupBy("dims").agg(F.floor(F.max("part") / QUERY_GROUP).cast("int").alias("last_group"))
    parts = data.groupBy("dims").agg(F.max("part").alias("last_part"))
    extent = stored(groups.join(parts, "dims").withColumn("n", F.lit(1)), "extent")  # a row a length of vectors
    left = lookup(data, extent, "dims", "n").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("last_group")))).select("g", *BLOCK)
    right = lookup(asked, extent, "dims", "n").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("last_part"))))
    right = right.select(F.floor(F.col("part") / QUERY_GROUP).cast("int").alias("g"), "b", *BLOCK)

    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = [pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.decimal128(38, 0))]).empty_table()]
        cell = lambda t, c, row: t.column(c)[row].as_py()
        whole = lambda t, c, row: np.frombuffer(cell(t, c, row), "<i8")
        for v in range(len(vectors)):
            ids = whole(vectors, "ids", v)
            x = whole(vectors, "data", v).reshape(len(ids), cell(vectors, "dims", v))
            for a in range(len(queries)):
                q_ids = whole(queries, "ids", a)
                asked_ = whole(queries, "data", a).reshape(len(q_ids), x.shape[1])
                q, r, score, _ = best(asked_, q_ids, x, ids, k, whole(queries, "floors", a))
                score = pa.array(score) if score.dtype != object else pa.array(list(map(str, score)), pa.string())
                out.append(pa.table({"query_id": q_ids[q], "vec_id": ids[r], "score": score.cast(pa.decimal128(38, 0))}, schema=out[0].schema))
        return pa.concat_tables(out)

    pairs = left.groupBy("dims", "part", "g").cogroup(right.groupBy("dims", "b", "g"))
    return pairs.applyInArrow(search, "query_id long, vec_id long, score decimal(38,0)")


def top_k(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, wide: bool = False
) -> DataFrame:
    """For each query its k highest scores: query_id, rank (from 1), vec_id, score; ties to smaller ids.

    Ranks are by exact scores of any size; score is a long, null where it doesn't fit, or if wide a decimal.

    Components become floor(scale * x); the score is their integer inner product. Queries are the rows for which
    is_query holds; candidates are all rows but the query's own. Vectors that are null or hold null or non-finite
    components take no part, nor do rows without an id; rows that repeat an id count once, with the smallest of its
    vectors. Vectors of different lengths aren't compared. A query without candidates has no row.

    Every block of queries meets every block of vectors: that the stated queries meet all rows is the operation itself.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col), scale).alias("v"), is_query.alias("q"))
    rows = rows.where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    rows = stored(rows, "vectors")
    none = F.lit(np.iinfo(np.int64).min)
    data = stored(packed(rows.select("id", "v", none.alias("floor")), VECTOR_BLOCK), "vector_blocks")
    asked = rows.where("q").select("id", "v")
    sample = met(stored(packed(asked.withColumn("floor", none), QUERY_BLOCK), "query_blocks"), data, k, first=True)
    low, high = (F.lit(x).cast("decimal(38,0)") for x in (np.iinfo(np.int64).min, np.iinfo(np.int64).max))
    floor = F.least(F.greatest(F.min("score"), low), high).cast("long")  # blocks hold floors as 64-bit integers
    floors = sample.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, floor).alias("floor"))
    floored = asked.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", none))
    found = met(stored(packed(floored, QUERY_BLOCK), "floored_blocks"), data, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows a block of vectors
    score = F.col("score") if wide else F.col("score").try_cast("long").alias("score")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)
