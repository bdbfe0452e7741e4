"""A manifest as a hash tree: rows in parts that executors hash, nodes above them, differences without reading what is equal.

A row's leaf is the first bits of a hash of its path, so a path has the same leaf in every manifest, whatever else is
added, and no folder makes a large one. A leaf's digest is the SHA-256 of its rows' sorted digests, a node's that of its
children's in their order, eight bits a level. The root's digest stands for the manifest: rows in any order give the same.

    <folder>/rows/part=<first eight bits>   rel_path, mtime_ns, size, sha256, leaf, sorted by leaf
    <folder>/tree/level=<bits>              node, rows, digest; level 0 is the root

Rows without a path are left out; rows that share a path are all hashed. A manifest without rows has no nodes, and the
digest of nothing. The driver sees the nodes of the first level that differ (256 at most) and the root.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import manifest_changes
from ..schema import SCHEMAS, schema_of
from ..sources.datasource import register_corpus

STEP = 8
#: Bits of a leaf: 65,536 leaves, of some 15,000 rows each where there are a billion. 24 for many more.
LEAF_BITS = 16
NOTHING = hashlib.sha256(b"").hexdigest()


def joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


@dataclass(frozen=True)
class HashTree:
    spark: SparkSession
    folder: str
    bits: int = LEAF_BITS

    def rows(self) -> DataFrame:
        held = schema_of("rel_path string, mtime_ns long, size long, sha256 string, leaf long, part long")
        return self.spark.read.schema(held).parquet(f"{self.folder}/rows")

    def nodes(self, level: int) -> DataFrame:
        """node, rows, digest of a level."""
        held = schema_of("node long, rows long, digest string, level long")
        return self.spark.read.schema(held).parquet(f"{self.folder}/tree").where(F.col("level") == level).drop("level")

    def root(self) -> str:
        found = self.nodes(0).first()
        return found["digest"] if found else NOTHING

    def write(self, manifest: DataFrame) -> HashTree:
        """Replaces what the folder holds."""
        leaf = F.shiftrightunsigned(F.xxhash64("rel_path"), 64 - self.bits)
        rows = manifest.select(SCHEMAS["manifest"].names).where("rel_path is not null").withColumn("leaf", leaf)
        rows = rows.withColumn("part", F.shiftright("leaf", self.bits - STEP))
        rows.repartitionByRange("leaf").sortWithinPartitions("leaf", "rel_path").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/rows")
        digest = F.sha2(F.to_json(F.struct(*SCHEMAS["manifest"].names)), 256)
        nodes = self.rows().groupBy(F.col("leaf").alias("node")).agg(F.count("*").alias("rows"), joined(F.sort_array(F.collect_list(digest))).alias("digest"))
        for level in range(self.bits, -1, -STEP):
            mode = "overwrite" if level == self.bits else "append"
            nodes.withColumn("level", F.lit(level)).write.mode(mode).partitionBy("level").parquet(f"{self.folder}/tree")
            child = F.struct("node", F.concat(F.hex("node"), F.lit(":"), "digest", F.lit(";")).alias("digest"))
            above = self.nodes(level).groupBy(F.shiftright("node", STEP).alias("node"))
            nodes = above.agg(F.sum("rows").alias("rows"), joined(F.sort_array(F.collect_list(child))["digest"]).alias("digest"))
        return self


def frozen(spark: SparkSession, root: str, folder: str, bits: int = LEAF_BITS, **options: str) -> HashTree:
    """The hash tree of a corpus, which is walked, read and hashed as the corpus data source does; options are its own."""
    register_corpus(spark)
    return HashTree(spark, folder, bits).write(spark.read.format("corpus").options(root=root, **options).load())


def differing(old: HashTree, new: HashTree, level: int, among: DataFrame | None = None) -> DataFrame:
    """Nodes of a level whose digests differ, or that one tree doesn't have; among: only below those nodes."""
    sides = []
    for tree, name in ((old, "old"), (new, "new")):
        nodes = tree.nodes(level).select("node", F.col("digest").alias(name))
        if among is not None:
            above = among.select(F.col("node").alias("_above"))
            nodes = nodes.join(above, F.shiftright("node", STEP) == F.col("_above"), "left_semi")
        sides.append(nodes)
    return sides[0].join(sides[1], "node", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("node")


def changes(old: HashTree, new: HashTree) -> DataFrame:
    """(path, change) as manifest_changes has it, without the rows that are the same.

    Goes down only where digests differ: of rows, only folders of differing parts are read, and of them only rows of
    differing leaves are joined.
    """
    if old.bits != new.bits:
        raise ValueError(f"trees of {old.bits} and {new.bits} bits")
    spark = old.spark
    if old.root() == new.root():
        return spark.createDataFrame([], schema_of("path string, change string"))
    parts = [r["node"] for r in differing(old, new, STEP).collect()]
    leaves = spark.createDataFrame([(p,) for p in parts], schema_of("node long"))
    for level in range(2 * STEP, old.bits + 1, STEP):
        leaves = differing(old, new, level, leaves)
    leaves = leaves.select(F.col("node").alias("leaf"))
    was, now = (t.rows().where(F.col("part").isin(parts)).join(leaves, "leaf", "left_semi") for t in (old, new))
    found = manifest_changes(was.withColumnsRenamed({"rel_path": "path", "size": "size_bytes"}), now)
    return found.where("change <> 'same'")
