"""The session that the command line and the tests use; a cluster's own settings win."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from .functions.vector import register_functions


def get_spark(app: str = "lodestack", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; master and partitions only where given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    register_functions(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which a cluster sets to a shared one; a new one under /tmp only in a local session where none is set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file:///tmp/lodestack-{uuid.uuid4().hex}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found
