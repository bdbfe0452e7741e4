"""Registered queries of the store, ingestion, rules and joins over the driver's tables, each with SQL that gives the same rows.

Those that write keep what they write in a new folder of the session's shared folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse
from urllib.request import url2pathname

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import LodestackError
from .functions import naming, text, vector
from .functions.naming import IndexIdentity
from .operators import chunking, fulltext, knn, merge, registry
from .operators.textstore import TextStore
from .plans.hashtree import HashTree
from .plans.hashtree import changes as hashtree_changes
from .plans.store import Store
from .plans.tables import Change, Tables
from .queries import CUTS, TOKENS, as_documents, query, table, vector_of
from .rules import violations
from .schema import SCHEMAS
from .session import checkpoint_dir
from .sources import corpus, embedding
from .sources.datasource import register_corpus
from .streaming.ingest import reindex


def new_root(spark: SparkSession, name: str) -> Path:
    """A new folder for a store; it must be mounted, as a store's root."""
    at = urlparse(checkpoint_dir(spark))
    if at.scheme not in ("", "file"):
        raise LodestackError(f"a store needs a mounted folder, not {at.geturl()}")
    return Path(url2pathname(at.path)) / f"{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- store


@query("""
    SELECT concat('index.local.', lang, '.64') AS index_name, concat('local/', lang) AS provider_id, count(*) AS doc_count, sum(n_chars)::BIGINT AS chunk_count,
           lang = (SELECT max(lang) FROM documents) AS is_current
    FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def registry_cutover(spark, sf_dir):
    """An index a language, each made current after the other: one is current at the end, and all are listed."""
    store = Store(spark, new_root(spark, "cutover"))
    sizes = table(spark, sf_dir, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    for row in sizes.orderBy("lang").collect():  # a row a language
        identity = IndexIdentity("local", row.lang, 64)
        store.index(identity).open()
        store.set_current(identity, row.n, row.chars)
    known = store.registry.read("index_registry").join(store.registry.read("embedding_providers").select("provider_id"), "provider_id")
    listed = spark.createDataFrame([(x.index_name, x == store.current()) for x in store.list()], "index_name string, served boolean")
    return known.join(listed, "index_name").where("served = is_current").select("index_name", "provider_id", "doc_count", "chunk_count", "is_current")


@query("""
    SELECT lang, concat('local/', lang, ' (64d)') AS header, 1::BIGINT AS index_version, 'refused' AS other_dims
    FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def index_headers(spark, sf_dir):
    """Headers are stamped once, read back, verified, and refuse another identity."""
    store, out = Store(spark, new_root(spark, "headers")), []
    for row in table(spark, sf_dir, "documents").where("lang is not null").select("lang").distinct().collect():
        identity = IndexIdentity("local", row.lang, 64)
        store.index(identity).open()
        held = store.verify(identity).open().header()
        index = store.index(identity)
        index.identity = IndexIdentity("local", row.lang, 32)
        try:
            other = str(index.open())
        except LodestackError:
            other = "refused"
        out.append((row.lang, f"{held['provider_id']} ({held['dims']}d)", held["index_version"], other))
    return spark.createDataFrame(out, "lang string, header string, index_version long, other_dims string")


@query("""
    SELECT c_custkey AS key, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'retired' WHEN c_custkey % 2 = 0 THEN 'degraded' ELSE 'active' END AS status
    FROM customer""")
def registry_upserts(spark, sf_dir):
    """Two commits of upserts to one table: rows of the second replace those of the first, the others stay."""
    tables = Store(spark, new_root(spark, "upserts")).registry
    customers = table(spark, sf_dir, "customer")
    nothing = {n: F.lit(None).cast(f.dataType).alias(n) for n, f in zip(SCHEMAS["embedding_providers"].names, SCHEMAS["embedding_providers"], strict=True)}

    def providers(rows: DataFrame, status: str) -> DataFrame:
        made = nothing | {"provider_id": F.col("c_custkey").cast("string"), "model": F.col("c_name"), "status": F.lit(status)}
        return rows.select(*(c.alias(n) for n, c in made.items()))

    tables.commit(embedding_providers=providers(customers, "active"))
    for rule, status in (("c_custkey % 2 = 0", "degraded"), ("c_custkey % 3 = 0", "retired")):
        with tables.lock():
            known = tables.read("embedding_providers")
            tables.commit(embedding_providers=merge.upsert(known, providers(customers.where(rule), status), "provider_id"))
    return tables.read("embedding_providers").select(F.col("provider_id").cast("long").alias("key"), F.col("model").alias("name"), "status")


# ---------------------------------------------------------------- ingestion


def write_files(docs: DataFrame, root: Path) -> None:
    """A file a document: <source>/<doc_id>.md, and beside each source a hidden file and a binary one."""
    root.mkdir(parents=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for row in batch.to_pylist():
                folder = root / row["source"]
                if folder not in made:  # once a task
                    made.add(folder)
                    folder.mkdir(exist_ok=True)
                    for name in (".hidden.md", "logo.png"):
                        (folder / name).write_bytes(b"x")
                with open(f"{folder}/{row['doc_id']}.md", "wb") as file:
                    file.write((row["text"] or "").encode())
            yield batch.select(["doc_id"])

    docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long").count()


class Measures:
    """An embedder whose vectors SQL can make too: number of characters and of spaces."""

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count(" "))] for t in texts]


MEASURES = IndexIdentity("local", "measures", 2)


@query(
    CUTS.replace("FROM documents\n", "FROM documents WHERE source IS NOT NULL\n")
    + r""" SELECT concat(source, '/', doc_id, '.md') AS path, seq, start_offset, end_offset, sha256(c.text) AS content_hash,
           length(c.text)::DOUBLE AS chars, (length(c.text) - length(replace(c.text, ' ', '')))::DOUBLE AS spaces, 'completed' AS run_status
        FROM cut c JOIN documents d USING (doc_id) WHERE trim(c.text, chr(10) || ' ') <> ''"""
)
def ingest_passages(spark, sf_dir):
    """The whole way: files, frozen list, verified stream, passages, vectors, commit, registry."""
    root = new_root(spark, "ingest")
    write_files(table(spark, sf_dir, "documents").where("source is not null"), root / "files")
    store = Store(spark, root / "store")
    reindex(store, str(root / "files"), MEASURES, Measures(), chunk_chars=500, batch_docs=100_000)
    index = store.verify(store.current())
    found = index.read("chunks").join(index.read("documents").select("doc_id", "path"), "doc_id").join(index.read("vec_chunks"), "chunk_id")
    runs = store.registry.read("reindex_runs").join(store.registry.read("reindex_checkpoints").select("run_id"), "run_id")
    found = found.crossJoin(F.broadcast(runs.select(F.col("status").alias("run_status"))))  # one run
    measured = (F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(("chars", "spaces")))
    return found.select("path", "seq", "start_offset", "end_offset", "content_hash", *measured, "run_status")


@query("""
    SELECT concat(source, '/', doc_id, '.md') AS path, sha256(CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN concat(text, '!') ELSE text END) AS sha256,
           CASE WHEN doc_id % 5 = 0 THEN 'gone' ELSE 'active' END AS status, 2::BIGINT AS runs
    FROM documents WHERE source IS NOT NULL""")
def ingest_changes(spark, sf_dir):
    """A second run: changed files are replaced, missing ones are gone and lose their passages, the rest stays."""
    root, docs = new_root(spark, "changes"), table(spark, sf_dir, "documents").where("source is not null")
    store, other = Store(spark, root / "store"), root / "second"
    write_files(docs, root / "first")
    write_files(docs.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), other)
    for folder in (root / "first", other):
        reindex(store, str(folder), MEASURES, Measures(), batch_docs=100_000)
    index = store.index(MEASURES)
    documents, chunks = index.read("documents"), index.read("chunks")
    left = chunks.join(documents.where("status = 'gone'"), "doc_id")
    runs = store.registry.read("reindex_runs").where("status = 'completed'").count()
    found = documents.where(F.lit(left.isEmpty()))
    return found.select("path", "sha256", "status", F.lit(runs).cast("long").alias("runs"))


# ---------------------------------------------------------------- a corpus as a data source

FILES = """
    WITH f AS (SELECT concat(source, '/', doc_id, '.md') AS rel_path, strlen(coalesce(text, ''))::BIGINT AS size, sha256(coalesce(text, '')) AS sha256
               FROM documents WHERE source IS NOT NULL)"""


def source_files(spark, sf_dir, name: str) -> Path:
    root = new_root(spark, name)
    write_files(table(spark, sf_dir, "documents").where("source is not null"), root / "files")
    register_corpus(spark)
    return root


@query(FILES + " SELECT * FROM f")
def corpus_source(spark, sf_dir):
    """A file a document with a source (the source is its folder), read as spark.read.format("corpus")."""
    root = source_files(spark, sf_dir, "source")
    return spark.read.format("corpus").option("root", str(root / "files")).option("partitionbytes", 4 << 20).load().drop("mtime_ns")


@query(FILES + " SELECT rel_path, size FROM f WHERE size >= 400 AND rel_path >= 'src1' AND rel_path LIKE '%5.md'")
def corpus_source_filters(spark, sf_dir):
    """Its filters are the walk's: no file is opened, nothing outside the range is listed."""
    root = source_files(spark, sf_dir, "filters")
    found = spark.read.format("corpus").schema("rel_path string, size long").option("root", str(root / "files")).load()
    return found.where("size >= 400 and rel_path >= 'src1' and rel_path like '%5.md'")


@query(FILES + " SELECT * FROM f")
def corpus_stream(spark, sf_dir):
    """The same files as a stream in batches by bytes, stopped at its end and started again."""
    root = source_files(spark, sf_dir, "stream")
    at = root.absolute()

    def run() -> None:
        stream = spark.readStream.format("corpus").option("root", str(at / "files")).option("cursor", str(at / "cursor"))
        stream = stream.option("batchbytes", 16 << 20).load()
        query = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{at.as_uri()}/rows/batch={n}"))
        query = query.option("checkpointLocation", f"{at.as_uri()}/checkpoint").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run()
    run()  # finds nothing new
    return spark.read.parquet(f"{at.as_uri()}/rows").select("rel_path", "size", "sha256")


@query("""
    SELECT concat(source, '/', doc_id, '.md') AS path,
           CASE WHEN doc_id % 5 = 0 THEN 'gone' WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'changed' ELSE 'touched' END AS change
    FROM documents WHERE source IS NOT NULL AND (doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0)""")
def hash_tree_changes(spark, sf_dir):
    """Two manifests of the documents as hash trees, and what differs between them."""
    root = new_root(spark, "trees").absolute()
    rows = as_documents(table(spark, sf_dir, "documents").where("source is not null"))
    rows = rows.select("doc_id", F.col("path").alias("rel_path"), "mtime_ns", F.col("size_bytes").alias("size"), "sha256")
    changed = F.when(F.col("doc_id") % 11 == 0, F.lit("other")).otherwise(F.col("sha256"))
    time = F.when(F.col("doc_id") % 13 == 0, F.lit(-1)).otherwise(F.col("mtime_ns"))
    old = HashTree(spark, f"{root.as_uri()}/old").write(rows.where("doc_id % 5 = 0 or doc_id % 7 <> 0"))
    new = rows.where("doc_id % 5 <> 0").withColumn("sha256", changed).withColumn("mtime_ns", time)
    return hashtree_changes(old, HashTree(spark, f"{root.as_uri()}/new").write(new))


# ---------------------------------------------------------------- lists of files


def paths(spark, sf_dir) -> DataFrame:
    """Paths made of the pages' ids: in hidden folders, with binary extensions, and plain ones."""
    k = F.col("page_id")
    folder = F.when(k % 7 == 0, ".git/").when(k % 11 == 0, "a/.cache/b/").when(k % 3 == 0, "a-b/").otherwise("a/")
    end = F.when(k % 5 == 0, ".PNG").when(k % 13 == 0, "").when(k % 2 == 0, ".md").otherwise(".tar.txt")
    return table(spark, sf_dir, "pages").select(F.concat(folder, k.cast("string"), end).alias("rel_path"))


PATHS = """
    WITH p AS (
      SELECT concat(CASE WHEN page_id % 7 = 0 THEN '.git/' WHEN page_id % 11 = 0 THEN 'a/.cache/b/' WHEN page_id % 3 = 0 THEN 'a-b/' ELSE 'a/' END,
                    page_id, CASE WHEN page_id % 5 = 0 THEN '.PNG' WHEN page_id % 13 = 0 THEN '' WHEN page_id % 2 = 0 THEN '.md' ELSE '.tar.txt' END) AS rel_path
      FROM pages)"""


@query(PATHS + " SELECT rel_path FROM p WHERE rel_path NOT LIKE '.%' AND rel_path NOT LIKE '%/.%' AND lower(rel_path) NOT LIKE '%.png' AND rel_path LIKE '%d'")
def text_files(spark, sf_dir):
    return corpus.text_paths(paths(spark, sf_dir), r"d$")


@query(PATHS + " SELECT rel_path FROM p WHERE concat('/x/', rel_path) NOT LIKE '%/.%' AND lower(rel_path) NOT LIKE '%.png' AND rel_path LIKE 'a/%'")
def legacy_text_files(spark, sf_dir):
    return corpus.text_paths(paths(spark, sf_dir), "^/x/a/", legacy="/x")


@query(PATHS + " SELECT rel_path, row_number() OVER (ORDER BY rel_path) AS place FROM p")
def manifest_order(spark, sf_dir):
    return merge.numbered(paths(spark, sf_dir), [corpus.path_order()], "place", 0)


@query(PATHS + " SELECT rel_path, row_number() OVER (ORDER BY string_split(rel_path, '/')) AS place FROM p")
def legacy_path_order(spark, sf_dir):
    return merge.numbered(paths(spark, sf_dir), [corpus.path_order(legacy=True)], "place", 0)


@query("""
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat(html, chr(65533)) ELSE html END AS lossy, CASE WHEN page_id % 3 <> 0 THEN html END AS strict FROM pages""")
def utf8_texts(spark, sf_dir):
    broken = F.when(F.col("page_id") % 3 == 0, F.concat(F.col("html").cast("binary"), F.unhex(F.lit("FF")))).otherwise(F.col("html").cast("binary"))
    rows = table(spark, sf_dir, "pages").select("page_id", broken.alias("data"))
    return rows.select("page_id", text.utf8_text(F.col("data")).alias("lossy"), text.utf8_text(F.col("data"), strict=True).alias("strict"))


@query("""
    SELECT p_partkey AS part, concat('index.local.', replace(p_type, 'E', '-'), '.', p_size, '.db') AS file FROM part""")
def identity_names(spark, sf_dir):
    name = naming.file_names(F.lit("local"), F.translate("p_type", "E", "/"), F.col("p_size"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), name.alias("file"))


# ---------------------------------------------------------------- runs


def runs(spark, sf_dir) -> DataFrame:
    """orders in the part of reindex_runs: a customer's orders are the runs of an index."""
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "failed").otherwise("completed")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_custkey").cast("string").alias("index_name"),
        F.col("o_orderdate").cast("string").alias("started_at"),
        status.alias("status"),
    )


RUNS = """
    WITH r AS (
      SELECT o_orderkey::VARCHAR AS run_id, o_custkey::VARCHAR AS index_name, o_orderdate::VARCHAR AS started_at,
             CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'failed' ELSE 'completed' END AS status FROM orders)"""


@query(
    RUNS
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY index_name ORDER BY started_at DESC, run_id DESC) AS k FROM r),
    c AS (SELECT l_orderkey::VARCHAR AS run_id, count(*) AS batches_done FROM lineitem GROUP BY l_orderkey)
    SELECT index_name, run_id, status, batches_done FROM n JOIN c USING (run_id) WHERE k = 1 AND status IN ('running', 'failed')"""
)
def resumable_runs(spark, sf_dir):
    checkpoints = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("run_id")).agg(F.count("*").alias("batches_done"))
    return registry.resumable_runs(runs(spark, sf_dir), checkpoints).select("index_name", "run_id", "status", "batches_done")


@query(RUNS + " SELECT run_id, CASE WHEN index_name = '7' AND status = 'running' AND run_id <> '1' THEN 'superseded' ELSE status END AS status FROM r")
def superseded_runs(spark, sf_dir):
    return registry.superseded(runs(spark, sf_dir), "7", "1").select("run_id", "status")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = (SELECT max(s_suppkey) FROM supplier)")
def current_index_row(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    last = suppliers.agg(F.max("s_suppkey")).scalar()
    return registry.current_index(suppliers.withColumn("is_current", F.col("s_suppkey") == last)).select("s_suppkey", "s_name")


@query("SELECT event_id, strftime(to_timestamp(floor(epoch(ts))), '%Y-%m-%d %H:%M:%S') || ' UTC' AS at FROM events")
def epoch_texts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.epoch_text(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))


# ---------------------------------------------------------------- passages and vectors


@query("""
    WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3),
    near AS (SELECT vec_id, list_distance(embedding::DOUBLE[], q.v) AS d FROM embeddings, q ORDER BY 2, 1 LIMIT 100)
    SELECT concat(source, '/', d.doc_id, '.md') AS path, sha256(text) AS text_hash, round(d, 6) AS distance
    FROM near JOIN documents d ON d.doc_id = vec_id WHERE d.doc_id % 4 <> 0""")
def passages_near(spark, sf_dir):
    """Neighbours, their passages and documents; those without either drop out after the top-k."""
    vectors, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    near = knn.knn(vectors, vector_of(vectors, 3), 100, "l2", "vec_id").withColumnRenamed("vec_id", "chunk_id")
    chunks = docs.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")
    found = knn.with_texts(near, chunks, as_documents(docs))
    return found.select("path", text.content_hash(F.col("text")).alias("text_hash"), F.round("distance", 6).alias("distance"))


@query(
    CUTS
    + r""" SELECT doc_id, seq, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS spaces
           FROM cut WHERE trim(text, chr(10) || ' ') <> ''"""
)
def embed_passages(spark, sf_dir):
    cut = chunking.chunk_documents(table(spark, sf_dir, "documents"), 500)
    made = embedding.embedded(cut, Measures(), 2)
    return made.select("doc_id", "seq", *(F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(("chars", "spaces"))))


@query("""
    SELECT 'chunks' AS kept, l_orderkey AS key, l_linenumber AS seq FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    UNION ALL
    SELECT 'vectors', l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' AND l_quantity > 10""")
def deleted_documents(spark, sf_dir):
    """Deleting documents takes their passages, and then the vectors of those."""
    lines = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("/", "l_orderkey", "l_linenumber").alias("chunk_id")
    chunks = lines.select(key, F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"))
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    left = merge.without_documents(chunks, gone)
    vectors = merge.without_chunks(lines.where("l_quantity > 10").select(key, "l_orderkey", "l_linenumber"), left)
    return left.select(F.lit("chunks").alias("kept"), F.col("doc_id").alias("key"), "seq").union(
        vectors.select(F.lit("vectors"), "l_orderkey", "l_linenumber")
    )


@query("""
    WITH c AS (
      SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber = 3 AND l_orderkey % 5 = 0 THEN 2 ELSE l_linenumber - 1 END AS seq,
             l_linenumber * 10 - CASE WHEN l_orderkey % 7 = 0 AND l_linenumber > 1 THEN 1 ELSE 0 END AS a,
             l_linenumber * 10 + CASE WHEN l_orderkey % 11 = 0 THEN 0 ELSE 10 END AS b
      FROM lineitem WHERE NOT (l_linenumber = 2 AND l_orderkey % 3 = 0)),
    w AS (
      SELECT *, row_number() OVER o - 1 AS expected, lag(seq) OVER o AS before, lag(b) OVER o AS ended FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY seq))
    SELECT 'repeated_seq' AS problem, count(*) FILTER (seq = before) AS n FROM w
    UNION ALL SELECT 'sparse_seq', count(*) FILTER (seq <> expected) FROM w
    UNION ALL SELECT 'overlap', count(*) FILTER (a < ended) FROM w
    UNION ALL SELECT 'empty_range', count(*) FILTER (b <= a) FROM w
    UNION ALL SELECT 'orphan_chunk', count(*) FROM c WHERE doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def chunk_violations(spark, sf_dir):
    """Planted: gaps in the numbers, overlaps, empty passages, passages without a document."""
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    chunks = table(spark, sf_dir, "lineitem").where(~((line == 2) & (order % 3 == 0))).select(
        order.alias("doc_id"),
        F.when((line == 3) & (order % 5 == 0), 2).otherwise(line - 1).alias("seq"),
        (line * 10 - F.when((order % 7 == 0) & (line > 1), 1).otherwise(0)).alias("start_offset"),
        (line * 10 + F.when(order % 11 == 0, 0).otherwise(10)).alias("end_offset"),
    )
    documents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("doc_id"))
    return chunking.chunk_problems(chunks, documents)


@query("""
    SELECT content_hash FROM (SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE doc_id % 2 = 0)
    WHERE content_hash IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1)""")
def known_hashes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return merge.has_hash(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0").select("content_hash").distinct())


@query("""
    SELECT vec_id, 4 * len(embedding) AS bytes, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings""")
def vector_bytes(spark, sf_dir):
    """To bytes and back."""
    packed = table(spark, sf_dir, "embeddings").select("vec_id", vector.to_bytes(F.col("embedding")).alias("data"))
    back = vector.wide(vector.from_bytes(F.col("data")))
    total = F.aggregate(back, F.lit(0.0), lambda s, x: s + x)
    return packed.select("vec_id", F.octet_length("data").cast("long").alias("bytes"), (F.round(total, 6) + 0.0).alias("total"))


@query("""
    WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_distance(embedding::DOUBLE[], v), 6) AS l2, round(1 - list_cosine_similarity(embedding::DOUBLE[], v), 6) + 0.0 AS cosine, len(embedding)::INT AS length
    FROM embeddings, q""")
def sql_vector_functions(spark, sf_dir):
    """The vector functions in SQL text."""
    vector.register_functions(spark)
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.where("vec_id = 0").select(F.col("embedding").alias("v"))
    return spark.sql(
        """SELECT vec_id, round(vec_distance_l2(embedding, v), 6) AS l2, round(vec_distance_cosine(embedding, v), 6) + 0.0D AS cosine, vec_length(embedding) AS length
           FROM {vectors}, {one}""",
        vectors=vectors,
        one=F.broadcast(one),
    )


# ---------------------------------------------------------------- texts and rules


@query(r"""
    WITH t AS (
      SELECT item_id, regexp_extract_all(strip_accents(lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2))), '[\p{L}\p{N}]+') AS title,
             regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS body FROM benchmark),
    h AS (SELECT item_id, len(title) + len(body) AS len, len(list_filter(title, lambda x: x = 'the')) + len(list_filter(body, lambda x: x = 'the')) AS hits FROM t),
    s AS (SELECT count(*)::DOUBLE AS rows, avg(len) AS avg, count(*) FILTER (hits > 0)::DOUBLE AS n FROM h)
    SELECT concat('w', item_id) AS slug, hits::INT AS hits,
           round(-(CASE WHEN ln((rows - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((rows - n + 0.5) / (n + 0.5)) END) * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * len / avg)), 6) AS rank
    FROM h, s WHERE hits > 0""")
def fts_works(spark, sf_dir):
    """Titles and bodies searched together, joined to works."""
    items = table(spark, sf_dir, "benchmark")
    rows = items.select(F.substring_index("text", " ", 2).alias("title"), F.col("text").alias("body"), F.col("item_id").cast("string").alias("work_id"))
    index = fulltext.write_index(rows, f"{checkpoint_dir(spark)}/works-{uuid.uuid4().hex}", stem=False)
    works = items.select(F.col("item_id").cast("string").alias("work_id"), F.concat(F.lit("w"), "item_id").alias("slug"))
    found = fulltext.ranked(index, "the").join(index.rows, "row_id").join(works, "work_id")
    return found.select("slug", "hits", F.round("rank", 6).alias("rank"))


@query("""
    WITH s AS (SELECT l_orderkey::VARCHAR AS work_id, CASE WHEN l_linenumber % 2 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS subject, l_orderkey FROM lineitem)
    SELECT 'unique work_id, subject' AS rule, concat(work_id, '/', lower(subject)) AS key FROM s GROUP BY work_id, lower(subject) HAVING count(*) > 1
    UNION ALL
    SELECT 'work_id references creative_works', concat(work_id, '/', subject) FROM s WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def subject_rules(spark, sf_dir):
    """Subjects are unique in any case of letters, and belong to a work."""
    subject = F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("work_id"), subject.alias("subject"), F.lit(0.5).alias("weight"))
    works = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("work_id"))
    return violations("work_subjects", rows, {"creative_works": works})


# ---------------------------------------------------------------- tables that change


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS decision_id, o_orderstatus AS link_kind,
           CASE WHEN o_orderkey % 14 = 0 THEN 'changed' ELSE o_orderpriority END AS target, n::BIGINT AS held_before
    FROM orders, (SELECT count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0) WHERE o_orderkey % 7 <> 0 OR o_orderkey % 14 = 0""")
def delta_changes(spark, sf_dir):
    """Added parts and marks of deleted rows: rows come late, some go, some are changed; a reader of the first version keeps it."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("decision_id"), F.col("o_orderstatus").alias("link_kind"), F.col("o_orderpriority").alias("target")
    )
    tables = Tables(spark, new_root(spark, "delta"), ("decision_links",))
    tables.commit(decision_links=orders.where("k % 5 <> 0"))
    first = tables.snapshot()
    tables.commit(decision_links=Change(add=orders.where("k % 5 = 0")))
    new = orders.where("k % 14 = 0").withColumn("target", F.lit("changed"))
    tables.commit(decision_links=Change(new, orders.where("k % 7 = 0").select("decision_id")))
    before = first.read("decision_links").agg(F.count("*").alias("held_before"))
    return tables.read("decision_links").crossJoin(F.broadcast(before))  # one row


CHANGED = """(
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(text, ' of the end') ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0)"""


@query(TOKENS.replace("FROM documents", f"FROM {CHANGED}") + " SELECT doc_id, hits, len FROM h WHERE hits > 0")
def fts_after_changes(spark, sf_dir):
    """Between two searches rows of the table come, go and change; the second finds what is there now."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    store = TextStore(spark, f"{checkpoint_dir(spark)}/changing-{uuid.uuid4().hex}", ("body",), stem=False)
    store.refresh(docs.where("doc_id % 7 <> 0"), "first")
    changed = docs.where("doc_id % 5 <> 0").withColumn("body", F.when(F.col("doc_id") % 3 == 0, F.concat("body", F.lit(" of the end"))).otherwise(F.col("body")))
    index = store.refresh(changed, "second")
    found = fulltext.phrase_hits(index, "of the").join(index.rows.select("row_id", "doc_id"), "row_id")
    return found.select("doc_id", "hits", F.col("length").cast("long").alias("len"))


class FailsOnce(Measures):
    """Measures, which fails on texts with a word as long as a file is there."""

    def __init__(self, flag: str, word: str) -> None:
        self.flag, self.word = flag, word

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if os.path.exists(self.flag) and any(self.word in t for t in texts):
            raise RuntimeError("the service is down")
        return super().__call__(texts)


@query(
    CUTS.replace("FROM documents\n", "FROM documents WHERE doc_id % 2 = 0\n")
    + r""" SELECT concat('s/', doc_id, '.md') AS path, seq, start_offset, end_offset, sha256(text) AS content_hash,
           (length(text) - length(replace(text, ' ', '')))::DOUBLE AS spaces, true AS resumed, 'completed' AS status
        FROM cut WHERE trim(text, chr(10) || ' ') <> ''"""
)
def ingest_resumed(spark, sf_dir):
    """Several batches, the embedder fails in one of the last, and a second call goes on with the first one's list."""
    root, docs = new_root(spark, "resumed"), table(spark, sf_dir, "documents").where("doc_id % 2 = 0").withColumn("source", F.lit("s"))
    write_files(docs, root / "files")
    store, flag = Store(spark, root / "store"), root / "down"
    last = docs.where("trim(text) <> ''").orderBy(F.desc(F.col("doc_id").cast("string"))).select(F.substring(F.trim("text"), 1, 12)).first()[0]
    embedder, batch = FailsOnce(str(flag), last), -(-docs.count() // 5)
    flag.touch()
    try:
        reindex(store, str(root / "files"), MEASURES, embedder, chunk_chars=500, batch_docs=batch)
    except Exception as e:  # noqa: BLE001 - Spark's own kind, around the embedder's
        if "the service is down" not in str(e):
            raise
    flag.unlink()
    stats = reindex(store, str(root / "files"), MEASURES, embedder, chunk_chars=500, batch_docs=batch)
    index = store.index(MEASURES).snapshot()
    found = index.read("chunks").join(index.read("documents").select("doc_id", "path"), "doc_id").join(index.read("vec_chunks"), "chunk_id")
    status = store.registry.read("reindex_runs").where(F.col("run_id") == stats.run_id).select("status")
    about = ("path", "seq", "start_offset", "end_offset", "content_hash", F.col("embedding")[1].cast("double").alias("spaces"))
    return found.select(*about, F.lit(stats.resumed).alias("resumed")).crossJoin(F.broadcast(status))  # one row
