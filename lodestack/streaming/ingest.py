"""Ingestion of a corpus: freeze, then a stream over the manifest in micro-batches, then one commit.

Each batch of the manifest is read, verified, cut, embedded and written to a folder of its own number, so a batch that
is run again replaces itself. The stream's checkpoint is the cursor: a run that fails goes on, with its own frozen
manifest, where it stopped. The index changes once, at the end: all of the run or nothing.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import IndexIdentity, now_text, peak_memory, run_id
from ..operators import merge
from ..operators.chunking import CHUNK_CHARS, packed_lines_of, passages_of, with_hashes
from ..operators.registry import resumable_run, superseded
from ..plans.store import Index, Store
from ..plans.tables import Change
from ..rules import checked
from ..schema import SCHEMAS, schema_of
from ..session import checkpoint_dir
from ..sources.corpus import Snapshot, cut_files, freeze, load_manifest, spread, verified_passages
from ..sources.embedding import BATCH, Embedder, embedded

#: Documents a micro-batch.
BATCH_DOCS = 1000

DOCS = schema_of("rel_path string, mtime_ns long, size long, sha256 string, state string")


@dataclass(frozen=True)
class Stats:
    run_id: str
    docs: int
    chunks: int
    batches: int
    deferred: int
    stale: int
    gone: int
    resumed: bool


def run_row(spark: SparkSession, run: str, name: str, trigger: str, snapshot: Snapshot, status: str, started: str, finished: str | None = None, error: str | None = None) -> DataFrame:
    row = (run, name, trigger, snapshot.path, snapshot.hash, status, started, finished, error)
    return checked("reindex_runs", spark.createDataFrame([row], SCHEMAS["reindex_runs"]))


def write_batches(snapshot: Snapshot, folder: Path, size: int) -> int:
    """The manifest in files of `size` entries, in its order: what the stream reads, a file a batch."""
    folder.mkdir(parents=True, exist_ok=True)
    count = 0
    with open(snapshot.path, encoding="utf-8") as lines:
        part: list[str] = []
        for line in lines:
            part.append(line)
            if len(part) == size:
                (folder / f"{count:08d}.json").write_text("".join(part), encoding="utf-8")
                os.utime(folder / f"{count:08d}.json", (count + 1, count + 1))  # the stream takes older files first
                part, count = [], count + 1
        if part:
            (folder / f"{count:08d}.json").write_text("".join(part), encoding="utf-8")
            os.utime(folder / f"{count:08d}.json", (count + 1, count + 1))
            count += 1
    return count


def stream(spark: SparkSession, work: Path, root: str, embedder: Embedder, dims: int, chunk_chars: int, embed_batch: int, by_lines: bool) -> None:
    """Works off the manifest's batches that the checkpoint doesn't have."""

    def by(parts: Iterable[str]) -> Iterator[tuple[int, int, int, str]]:
        return packed_lines_of(parts, chunk_chars) if by_lines else passages_of(parts, chunk_chars)

    def one(batch: DataFrame, number: int) -> None:
        # A batch is one file and so one partition; reading and cutting are spread by path, embedding by what was written,
        # so that the passages of one large file are spread too, and a lost executor doesn't have files read again.
        at = work.absolute().as_uri()
        cut = cut_files(spread(batch), root, by, strict=by_lines)
        cut.write.mode("overwrite").parquet(f"{at}/cut")
        cut = spark.read.schema(cut.schema).parquet(f"{at}/cut")
        good = with_hashes(verified_passages(cut).withColumnRenamed("rel_path", "path"), tokens=not by_lines)
        embedded(good, embedder, dims, embed_batch).write.mode("overwrite").parquet(f"{at}/chunks/batch={number}")
        cut.where("state is not null").select(DOCS.names).write.mode("overwrite").parquet(f"{at}/docs/batch={number}")

    reader = spark.readStream.schema(SCHEMAS["manifest"]).option("maxFilesPerTrigger", 1)
    query = (
        reader.json((work / "manifest").absolute().as_uri())
        .writeStream.foreachBatch(one)
        .option("checkpointLocation", (work / "checkpoint").absolute().as_uri())
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()


def passages(chunks: DataFrame, key: str) -> DataFrame:
    """(key, passages): a digest of each document's passages, in whatever order they come."""
    each = F.xxhash64("seq", "start_offset", "end_offset", "content_hash")
    return chunks.groupBy(key).agg(F.struct(F.count("*").alias("n"), F.bit_xor(each).alias("x")).alias("passages"))


def merged(index: Index, docs: DataFrame, cut: DataFrame, now: str, anew: bool = False) -> dict[str, Change]:
    """What the run changes in the index's tables.

    Verified documents get their new passages, also if that is none; deferred ones keep theirs; stale and gone ones lose
    them. Documents with the bytes and passages that they had stay as they are, vectors included, unless anew.
    """
    held = index.snapshot()
    old = held.read("documents")
    good = docs.where("state = 'ok'").select(F.col("rel_path").alias("path"), "sha256", "mtime_ns", F.col("size").alias("size_bytes"))
    documents = merge.upsert_documents(old, good, now)
    documents = merge.invalidated(documents, docs.where("state = 'stale'").select(F.col("rel_path").alias("path")), "stale")
    gone = old.select("path").join(docs.select(F.col("rel_path").alias("path")), "path", "left_anti")
    documents = merge.invalidated(documents, gone, "gone").checkpoint()

    # Rows that differ from those held in more than the time of their run.
    about = F.struct(*(c for c in documents.columns if c != "indexed_at")).alias("_about")
    differs = documents.withColumn("_about", about).join(old.select(about), "_about", "left_anti").drop("_about")
    had = passages(held.read("chunks"), "doc_id").join(old.where("status = 'active'").select("doc_id", "path", "sha256"), "doc_id", "right")
    has = good.select("path", "sha256").join(passages(cut, "path"), "path", "left")
    whole = F.struct("path", "sha256", "passages").alias("whole")
    same = has.select(whole).join(had.select(whole), "whole", "left_semi").select("whole.path")
    new_cut = good.select("path") if anew else good.select("path").join(same, "path", "left_anti")
    changed = new_cut.union(differs.where("status in ('stale', 'gone')").select("path")).distinct()
    replaced = documents.join(changed, "path").select("doc_id").checkpoint()
    lost = held.read("chunks").join(replaced, "doc_id", "left_semi").select("chunk_id")
    top = held.read("chunks").agg(F.coalesce(F.max("chunk_id"), F.lit(0))).first()[0]
    new = merge.numbered_within(cut.join(new_cut, "path", "left_semi"), "path", "seq", "chunk_id", top)
    new = new.join(documents.where("status = 'active'").select("path", "doc_id"), "path").withColumn("embedded_at", F.lit(now)).checkpoint()
    return {
        "documents": Change(differs, differs.select("doc_id")),
        "chunks": Change(new.select(SCHEMAS["chunks"].names), replaced),
        "vec_chunks": Change(new.select("chunk_id", "embedding"), lost),
    }


def reindex(
    store: Store,
    root: str,
    identity: IndexIdentity,
    embedder: Embedder,
    chunk_chars: int = CHUNK_CHARS,
    embed_batch: int = BATCH,
    batch_docs: int = BATCH_DOCS,
    include: str | None = None,
    trigger: str = "manual",
    force: bool = False,
    by_lines: bool = False,
    legacy: bool = False,
) -> Stats:
    """Brings the index up to date with the corpus and makes it current.

    A run that was left running or has failed is resumed with its own manifest, unless force starts anew; the newest
    run decides. On an error the run is marked failed and the index stays as it was. by_lines cuts by lines and takes only
    files that are UTF-8; legacy lists the files by the older rules and order (see text_paths).
    """
    spark, name = store.spark, identity.index_name
    checkpoint_dir(spark)
    index = store.index(identity)
    with index.lock():
        store.provider(identity)  # refused before anything is written
        index.open()
        registry = store.registry
        runs, checkpoints = registry.read("reindex_runs"), registry.read("reindex_checkpoints")
        left = None if force else resumable_run(runs, checkpoints, name).first()
        if left and os.path.exists(left["snapshot_manifest"]):
            run, started, trigger = left["run_id"], left["started_at"], left["trigger_kind"]
            snapshot = load_manifest(spark, left["snapshot_manifest"], root)
        else:
            left, run, started = None, run_id(), now_text()
            snapshot = freeze(spark, root, str(store.root / "manifests"), run, include, legacy)
        work = store.root / "runs" / run
        total = snapshot.entries.count()
        batches = write_batches(snapshot, work / "manifest", batch_docs) if not left else len(list((work / "manifest").glob("*.json")))

        def record(*about, **more) -> None:
            with store.changing():
                recorded(*about, **more)

        def recorded(status: str, docs_done: int = 0, chunks: int = 0, error: str | None = None, **tables: DataFrame) -> None:
            known = registry.read("reindex_runs")
            if status == "running":
                known = superseded(known, name, run)
            row = run_row(spark, run, name, trigger, snapshot, status, started, None if status == "running" else now_text(), error)
            last = spark.createDataFrame([(run, "", total, docs_done, chunks, batches, peak_memory(), now_text())], SCHEMAS["reindex_checkpoints"])
            if status == "running":
                tables["embedding_providers"] = store.provider(identity)
            registry.commit(
                reindex_runs=merge.upsert(known, row, "run_id"),
                reindex_checkpoints=merge.upsert(registry.read("reindex_checkpoints"), last, "run_id"),
                **tables,
            )

        record("running")
        try:
            stream(spark, work, root, embedder, identity.dims, chunk_chars, embed_batch, by_lines)
            docs = spark.createDataFrame([], DOCS)
            cut = spark.createDataFrame([], schema_of("path string, seq long, start_offset long, end_offset long, text string, content_hash string, token_count long, embedding array<float>"))
            if batches:
                docs = spark.read.schema(DOCS).parquet(f"{work.absolute().as_uri()}/docs/*")
                cut = spark.read.schema(cut.schema).parquet(f"{work.absolute().as_uri()}/chunks/*")
            tables = merged(index, docs, cut, now_text(), anew=force)
            index.commit(**tables)
        except Exception as e:
            record("failed", error=str(e)[:1000])
            raise
        states = {r["state"]: r["count"] for r in docs.groupBy("state").count().collect()}
        documents = index.read("documents").groupBy("status").count().collect()
        by_status = {r["status"]: r["count"] for r in documents}
        chunks = index.read("chunks").count()
        record("completed", states.get("ok", 0), chunks)
        store.set_current(identity, by_status.get("active", 0), chunks)
        index.vacuum()
        shutil.rmtree(work, ignore_errors=True)
        return Stats(run, states.get("ok", 0), chunks, batches, states.get("deferred", 0), states.get("stale", 0), by_status.get("gone", 0), left is not None)
