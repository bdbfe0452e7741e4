"""Changes of tables as rewrites: upserts by key, invalidation, and differences between a manifest and what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of new, and those rows of old whose key new doesn't have."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def numbered(rows: DataFrame, order: list[str], column: str, above: int) -> DataFrame:
    """rows with numbers above + 1, above + 2, ... in this order, without sorting them in one task.

    Rows are range-partitioned, counted a partition, and numbered within; only the counts come together.
    """
    checkpoint_dir(rows.sparkSession)
    parts = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = parts.checkpoint()  # so that both uses see the same ranges
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    found = parts.withColumn("_k", inside).join(F.broadcast(sizes), "_part")  # a row a partition
    return found.withColumn(column, (F.col("_before") + F.col("_k") + above).cast("long")).drop("_part", "_k", "_before")


def numbered_within(rows: DataFrame, group: str, order: str, column: str, above: int) -> DataFrame:
    """rows with numbers above + 1, above + 2, ... by group and order in it: what numbered() gives, but only the groups' sizes
    are range-partitioned and stored, so wide rows are shuffled once, by group. No group or order may be null."""
    checkpoint_dir(rows.sparkSession)
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size")).repartitionByRange(group).withColumn("_part", F.spark_partition_id())
    sizes = sizes.checkpoint()  # so that both uses see the same ranges
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("_part").agg(F.sum("_size").alias("_n"))
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(upto.orderBy("_part")), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_size").over(upto.partitionBy("_part").orderBy(group)), F.lit(0))
    begins = sizes.withColumn("_inside", inside).join(F.broadcast(parts), "_part")  # a row a partition
    begins = begins.select(group, (F.col("_before") + F.col("_inside") + above).alias("_begin"))
    found = rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order))).join(begins, group)
    return found.withColumn(column, (F.col("_begin") + F.col("_k")).cast("long")).drop("_begin", "_k")


def upsert_documents(old: DataFrame, scanned: DataFrame, now: str) -> DataFrame:
    """The documents table after a scan (path, sha256, mtime_ns, size_bytes): known paths keep their doc_id.

    What is scanned is active; new paths get the next ids in order of path; the rest of old stays as it is.
    """
    fresh = scanned.select("path", "sha256", "mtime_ns", "size_bytes", F.lit("active").alias("status"), F.lit(now).alias("indexed_at"))
    known = fresh.join(old.select("path", "doc_id"), "path")
    top = old.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    new = numbered(fresh.join(old.select("path"), "path", "left_anti"), ["path"], "doc_id", top)
    return old.join(fresh.select("path"), "path", "left_anti").unionByName(known).unionByName(new).select(old.columns)


def without_documents(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """chunks without those of the documents."""
    return chunks.join(doc_ids.select("doc_id"), "doc_id", "left_anti")


def without_chunks(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors whose chunk is still there."""
    return vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def invalidated(documents: DataFrame, paths: DataFrame, status: str = "stale") -> DataFrame:
    """documents, with this status for those of the paths."""
    marked = paths.select("path").distinct().withColumn("_hit", F.lit(True))
    found = documents.join(marked, "path", "left")
    return found.withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit").select(documents.columns)


def manifest_changes(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, change): added, changed (another hash), touched (same hash, other time or size), same, gone."""
    old = documents.select("path", F.col("sha256").alias("_sha"), F.col("mtime_ns").alias("_time"), F.col("size_bytes").alias("_size"))
    new = manifest.select(F.col("rel_path").alias("path"), "sha256", "mtime_ns", "size")
    both = old.withColumn("_old", F.lit(True)).join(new.withColumn("_new", F.lit(True)), "path", "full_outer")
    same_stat = F.col("_time").eqNullSafe(F.col("mtime_ns")) & F.col("_size").eqNullSafe(F.col("size"))
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "gone")
        .when(~F.col("_sha").eqNullSafe(F.col("sha256")), "changed")
        .when(~same_stat, "touched")
        .otherwise("same")
    )
    return both.select("path", change.alias("change"))


def has_hash(chunks: DataFrame, hashes: DataFrame) -> DataFrame:
    """The hashes that some chunk has."""
    return hashes.join(chunks.select("content_hash"), "content_hash", "left_semi")


def repeats(rows: DataFrame, digest: Column) -> DataFrame:
    """One row: rows, texts (different digests), repeats."""
    counted = rows.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"))
    sums = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("texts"))
    return sums.withColumn("repeats", F.col("rows") - F.col("texts"))
