"""Exact nearest neighbours: of one vector, of many, with a threshold, joined to texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import METRICS, as_vector
from ..session import checkpoint_dir

#: Bytes of a block of vectors; of all queries that may be broadcast; blocks of queries whose reach a task remembers.
BLOCK_BYTES, BROADCAST_BYTES, MOST_BLOCKS = 1 << 20, 64 << 20, 1000


def knn(
    vectors: DataFrame, query: Sequence[float], k: int = 20, metric: str = "l2", id_col: str = "chunk_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, distance) of the k nearest, nearest first, ties by id. Vectors of another length or without a distance drop out."""
    near = vectors.where(F.size(vector_col) == len(query))
    near = near.select(id_col, METRICS[metric](F.col(vector_col), as_vector(query)).alias("distance"))
    near = near.where(F.col("distance").isNotNull() & ~F.isnan("distance"))
    return near.orderBy("distance", id_col).limit(k)


def search(vectors: DataFrame, query: Sequence[float], limit: int = 10, threshold: float = 0.0, **columns: str) -> DataFrame:
    """(id, distance, score): the nearest by cosine, then those of at least the threshold; score is 1 - distance.

    The threshold comes after the top-k; the default 0 drops vectors that point away.
    """
    found = knn(vectors, query, limit, "cosine", **columns)
    return found.where(F.col("distance") <= 1 - threshold).withColumn("score", 1 - F.col("distance"))


def with_texts(near: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, text, distance) of neighbours; those without a chunk or document drop out, after the top-k."""
    found = F.broadcast(near).join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id")
    found = F.broadcast(found).join(documents.select("doc_id", "path"), "doc_id")
    return found.select("path", "text", "distance", "chunk_id").orderBy("distance", "chunk_id").drop("chunk_id")


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Blocks of vectors of one length, as they come: dims, ids, data (doubles). Vectors that are null are left out, null components are NaN."""
    schema = T.StructType().add("dims", T.IntegerType()).add("ids", T.ArrayType(vectors.schema[id_col].dataType)).add("data", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column("v"), batch.column("id")
            offsets, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(offsets)
            for d in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == d)
                step = max(1, BLOCK_BYTES // (8 * max(1, d)))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    data = values[offsets[some][:, None] + np.arange(d)].astype("<f8").tobytes()
                    held = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), ids.take(pa.array(some)))
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), held, pa.array([data], pa.binary())], schema.names)

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    return rows.mapInArrow(run, schema)


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of x to those of y, one to one; the same for the same two vectors wherever they stand."""
    if metric == "l2":
        return np.sqrt(np.square(x - y).sum(1))
    return 1 - (x * y).sum(1) / (np.sqrt(np.square(x).sum(1)) * np.sqrt(np.square(y).sum(1)))


def nearest(x: np.ndarray, q: np.ndarray, k: int, metric: str, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of at least the k nearest rows of x to each row of q, where they are within `reached`.

    A product of the whole blocks gives distances but for rounding; what may be among the k nearest is computed anew.
    reached, the k-th distance that each query is sure of, is brought down.
    """
    xx, qq = np.square(x).sum(1), np.square(q).sum(1)
    if metric == "l2":
        rough = qq[:, None] - 2 * (q @ x.T) + xx[None, :]
        slack = 1e-9 * (qq[:, None] + xx[None, :])
        limit = np.square(reached)
    else:
        rough = 1 - (q @ x.T) / np.sqrt(qq[:, None] * xx[None, :])
        slack, limit = np.full((1, 1), 1e-9), reached
    kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(q), np.inf)
    least = np.fmin(np.where(np.isnan(kth), np.inf, kth), limit)[:, None]
    a, r = np.nonzero((rough <= least + 2 * slack) | ~np.isfinite(rough) | ~np.isfinite(slack))
    d = distances(q[a], x[r], metric)
    a, r, d = a[~np.isnan(d)], r[~np.isnan(d)], d[~np.isnan(d)]
    order = np.lexsort((d, a))
    first = np.searchsorted(a[order], np.arange(len(q)))
    full = np.flatnonzero(np.bincount(a, minlength=len(q)) >= k)
    reached[full] = np.minimum(reached[full], d[order][first[full] + k - 1])
    return a, r, d


def knn_join(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding", query_col: str = "query_id", query_vector_col: str = "query"
) -> DataFrame:
    """(query, id, distance, rank) of each query's k nearest, ties by id. Vectors of other lengths or without a distance drop out.

    Both sides are packed in blocks, and each block of vectors meets each block of queries in one product. The queries'
    blocks are broadcast up to BROADCAST_BYTES; more are joined by a shuffle, a group of tasks a block.
    """
    asked = packed(queries, query_col, query_vector_col).withColumnsRenamed({"ids": "asked_ids", "data": "asked"})
    asked = asked.withColumn("block", F.monotonically_increasing_id())
    blocks = packed(vectors, id_col, vector_col)
    widest = queries.agg(F.count("*"), F.max(F.size(query_vector_col))).first()
    if widest[0] * 8 * ((widest[1] or 0) + 2) <= BROADCAST_BYTES:
        pairs = blocks.join(F.broadcast(asked), "dims")
    else:
        checkpoint_dir(vectors.sparkSession)
        asked = asked.checkpoint()  # so that both uses see the same numbers
        named = blocks.join(F.broadcast(asked.groupBy("dims").agg(F.collect_list("block").alias("blocks"))), "dims")
        pairs = named.withColumn("block", F.explode("blocks")).drop("blocks").join(asked, ["dims", "block"])
    kinds = {query_col: queries.schema[query_col].dataType, id_col: vectors.schema[id_col].dataType}
    schema = T.StructType().add(query_col, kinds[query_col]).add(id_col, kinds[id_col]).add("distance", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda c: batch.column(c)[i]  # noqa: E731, B023
                d, block = cell("dims").as_py(), cell("block").as_py()
                ids, asked_ids = cell("ids").values, cell("asked_ids").values
                x, q = (np.frombuffer(cell(c).as_py(), "<f8").reshape(n, d) for c, n in (("data", len(ids)), ("asked", len(asked_ids))))
                if len(reached) > MOST_BLOCKS:
                    reached.clear()
                with np.errstate(all="ignore"):
                    a, r, far = nearest(x, q, k, metric, reached.setdefault(block, np.full(len(q), np.inf)))
                yield pa.RecordBatch.from_arrays([asked_ids.take(pa.array(a)), ids.take(pa.array(r)), pa.array(far)], schema.names)

    found = pairs.select("dims", "ids", "data", "asked_ids", "asked", "block").mapInArrow(run, schema)
    order = Window.partitionBy(query_col).orderBy("distance", id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
