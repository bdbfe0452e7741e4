"""Registered queries of the engine's own operators over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text, vector
from .functions.naming import parsed_names
from .operators import chunking, fulltext, knn, merge, registry
from .operators.textstore import TextStore, table_state
from .plans.find import lanes
from .rules import violations
from .session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def vector_of(vectors: DataFrame, vec_id: int) -> list[float]:
    return vectors.where(F.col("vec_id") == vec_id).select("embedding").first()[0]


# ---------------------------------------------------------------- nearest neighbours


@query("""
    WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_distance(embedding::DOUBLE[], q.v), 6) AS distance FROM embeddings, q
    ORDER BY list_distance(embedding::DOUBLE[], q.v), vec_id LIMIT 20""")
def knn_l2(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = knn.knn(vectors, vector_of(vectors, 0), 20, "l2", "vec_id")
    return found.withColumn("distance", F.round("distance", 6))


@query("""
    WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q.v), 6) + 0.0 AS distance FROM embeddings, q
    ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], q.v), 9), vec_id LIMIT 20""")
def knn_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = knn.knn(vectors, vector_of(vectors, 0), 20, "cosine", "vec_id")
    return found.withColumn("distance", F.round("distance", 6) + 0.0)


@query("""
    WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 1),
    near AS (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], q.v) AS distance FROM embeddings, q
             ORDER BY 2, 1 LIMIT 50)
    SELECT vec_id, round(1 - distance, 6) AS score, source, n_chars FROM near JOIN documents ON doc_id = vec_id
    WHERE distance <= 1 - 0.2""")
def search_threshold(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = knn.search(vectors, vector_of(vectors, 1), 50, 0.2, id_col="vec_id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "n_chars")
    return F.broadcast(found).join(docs, "vec_id").select("vec_id", F.round("score", 6).alias("score"), "source", "n_chars")


@query("""
    WITH p AS (
      SELECT q.vec_id AS query_id, e.vec_id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d
      FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INT AS rank FROM p)
    SELECT query_id, vec_id, round(d, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 5""")
def knn_join(spark, sf_dir):
    """By cosine; every id divisible by 100 asks, against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return knn.knn_join(vectors, asked, 5, "cosine").withColumn("distance", F.round("distance", 6) + 0.0)


@query("""
    WITH p AS (
      SELECT q.vec_id AS query_id, e.vec_id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d
      FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INT AS rank FROM p)
    SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 5""")
def knn_join_hundredths(spark, sf_dir):
    """The same by Euclidean distance."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return knn.knn_join(vectors, asked, 5).withColumn("distance", F.round("distance", 6))


@query("""
    SELECT label, count(*) AS n, round(avg(list_distance(embedding::DOUBLE[], [0.0 FOR i IN range(64)])), 6) AS mean_norm
    FROM embeddings GROUP BY label""")
def vector_norms(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    norm = vector.l2_distance(F.col("embedding"), vector.as_vector([0.0] * 64))
    return vectors.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm), 6).alias("mean_norm"))


# ---------------------------------------------------------------- registry


def decisions(spark, sf_dir) -> DataFrame:
    """events in the part of agent_decisions."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("decision_id"),
        text.utc_text(F.col("ts")).alias("decided_at"),
        F.concat(F.lit("user"), F.col("user_id")).alias("agent"),
        F.col("event_type").alias("domain"),
        F.col("props").alias("summary"),
        F.lit("active").alias("status"),
    )


@query("""
    SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS decided_at, concat('user', user_id) AS agent, event_type AS domain,
           props AS summary, 'active' AS status
    FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'""")
def decided_day(spark, sf_dir):
    return registry.decided(decisions(spark, sf_dir), "2024-01-05")


def works(spark, sf_dir) -> DataFrame:
    """documents in the part of creative_works: the slug is made of source and id, the title of the first line."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("work_id"),
        F.concat(F.col("source"), F.lit("-"), F.col("doc_id")).alias("slug"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("lang").alias("kind"),
    )


@query("""
    SELECT role AS render_kind, turn AS seq, 'ext4' AS location_kind, concat('/state/', conv_id) AS location,
           NULL::BIGINT AS duration_ms, strlen(c.text)::BIGINT AS size_bytes, NULL::VARCHAR AS renderer, '' AS created_at
    FROM conversations c JOIN documents d ON d.doc_id = c.conv_id
    WHERE concat(source, '-', doc_id) = 'the_of' OR translate(split_part(d.text, chr(10), 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the%of%'""")
def renders_by_slug(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("work_id"),
        F.col("role").alias("render_kind"),
        F.col("turn").alias("seq"),
        F.lit("ext4").alias("location_kind"),
        F.concat(F.lit("/state/"), F.col("conv_id")).alias("location"),
        F.lit(None).cast("long").alias("duration_ms"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.lit(None).cast("string").alias("renderer"),
        F.lit("").alias("created_at"),
    )
    return registry.renders(works(spark, sf_dir), turns, "the_of")


@query("""
    SELECT DISTINCT concat(source, '-', doc_id) AS slug, split_part(text, chr(10), 1) AS title, lang AS kind, quality / 2.0::DOUBLE AS weight
    FROM documents JOIN labels USING (doc_id) WHERE lower(source) = 'src3'""")
def tagged_lane(spark, sf_dir):
    subjects = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    subjects = subjects.select(
        F.col("doc_id").cast("string").alias("work_id"), F.upper("source").alias("subject"), (F.col("quality") / 2.0).alias("weight")
    )
    return registry.find_tagged(works(spark, sf_dir), subjects, "Src3")


@query("""
    SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def latest_run_per_index(spark, sf_dir):
    found = registry.latest_rows(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return found.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("""
    WITH l AS (
      SELECT concat(l_orderkey, '/', l_linenumber) AS key, l_quantity, l_discount, l_returnflag, l_extendedprice FROM lineitem)
    SELECT rule, count(*) AS n FROM (
      SELECT 'weight in [0, 1]' AS rule FROM l WHERE NOT (l_quantity / 40 BETWEEN 0.0 AND 1.0)
      UNION ALL
      SELECT 'unique work_id, subject' FROM (SELECT l_orderkey, l_returnflag FROM lineitem GROUP BY ALL HAVING count(*) > 1))
    GROUP BY rule""")
def registry_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("work_id"), F.col("l_returnflag").alias("subject"), (F.col("l_quantity") / 40).alias("weight")
    )
    return violations("work_subjects", rows).groupBy("rule").agg(F.count("*").alias("n"))


@query("""
    SELECT part, provider, model, dims FROM (
      SELECT p_partkey AS part, concat('index.', lower(split_part(p_brand, '#', 1)), '.', replace(p_type, ' ', '.'), '.', p_size, '.db') AS f FROM part),
      LATERAL (SELECT regexp_extract(f, '^index\\.([^.]+)\\.(.+)\\.([0-9]+)\\.db$', ['a', 'b', 'c']) AS x),
      LATERAL (SELECT x.a AS provider, x.b AS model, x.c::BIGINT AS dims)""")
def index_names(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    brand = F.lower(F.substring_index("p_brand", "#", 1))
    name = F.concat(F.lit("index."), brand, F.lit("."), F.translate("p_type", " ", "."), F.lit("."), F.col("p_size"), F.lit(".db"))
    return parts.select(F.col("p_partkey").alias("part"), parsed_names(name).alias("x")).select("part", "x.*")


# ---------------------------------------------------------------- full text

TOKENS = r"""
    WITH t AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS ts FROM documents),
    h AS (SELECT doc_id, len(ts)::BIGINT AS len, len(list_filter(generate_series(1, greatest(len(ts) - 1, 1)),
            lambda i: ts[i] = 'of' AND ts[i + 1] = 'the'))::INT AS hits FROM t),
    s AS (SELECT count(*)::DOUBLE AS rows, avg(len) AS avg, sum((hits > 0)::INT)::DOUBLE AS n FROM h)"""


_STORES: dict[tuple, TextStore] = {}


def indexed(spark, sf_dir, stem: bool = False) -> fulltext.TextIndex:
    """The full-text index of the documents as their files are now; a session's first query writes it, later ones what changed."""
    key = (spark.sparkContext.applicationId, sf_dir, stem)
    if key not in _STORES:
        _STORES[key] = TextStore(spark, f"{checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}", ("body",), stem)
    state = table_state(f"{sf_dir}/documents.parquet", spark)
    return _STORES[key].refresh(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")), state)


def ranked_documents(spark, sf_dir, phrase: str) -> DataFrame:
    index = indexed(spark, sf_dir)
    return fulltext.ranked(index, phrase).join(index.rows.select("row_id", "doc_id"), "row_id")


@query(TOKENS + " SELECT doc_id, hits FROM h WHERE hits > 0")
def fts_phrase(spark, sf_dir):
    return ranked_documents(spark, sf_dir, "of the").select("doc_id", "hits")


@query(
    TOKENS
    + """ SELECT doc_id, round(-(CASE WHEN ln((rows - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((rows - n + 0.5) / (n + 0.5)) END)
            * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * len / avg)), 6) AS rank
          FROM h, s WHERE hits > 0 ORDER BY rank, doc_id"""
)
def bm25_rank(spark, sf_dir):
    return ranked_documents(spark, sf_dir, "of the").select("doc_id", F.round("rank", 6).alias("rank"))


@query()
def fts_snippet(spark, sf_dir):
    """Stemmed, with snippets; tests hold it against SQLite's FTS5."""
    index = indexed(spark, sf_dir, stem=True)
    found = fulltext.ranked(index, "of the").join(index.rows, "row_id")
    return found.select("doc_id", F.round("rank", 6).alias("rank"), fulltext.snippet(F.col("body"), "of the").alias("snippet"))


# ---------------------------------------------------------------- passages

CUTS = r"""
    WITH RECURSIVE r AS (
      SELECT doc_id, text AS rest, 0::BIGINT AS pos, 0::BIGINT AS seq FROM documents
      UNION ALL
      SELECT doc_id, substr(rest, cut + 1), pos + cut, seq + 1 FROM (
        SELECT *, CASE WHEN length(rest) < 500 THEN length(rest)
          WHEN length(regexp_extract(substr(rest, 1, 500), '^(.*\n\n)', 1, 's')) > 0 THEN length(regexp_extract(substr(rest, 1, 500), '^(.*\n\n)', 1, 's'))
          WHEN length(regexp_extract(substr(rest, 1, 500), '^(.*\n)', 1, 's')) > 0 THEN length(regexp_extract(substr(rest, 1, 500), '^(.*\n)', 1, 's'))
          WHEN length(regexp_extract(substr(rest, 1, 500), '^(.* )', 1, 's')) > 0 THEN length(regexp_extract(substr(rest, 1, 500), '^(.* )', 1, 's'))
          ELSE 500 END AS cut FROM r) WHERE length(rest) > 0),
    c AS (
      SELECT doc_id, seq, pos AS start_offset, lead(pos) OVER (PARTITION BY doc_id ORDER BY seq) AS next, rest FROM r),
    cut AS (
      SELECT doc_id, seq, start_offset, next AS end_offset, substr(rest, 1, next - start_offset) AS text FROM c WHERE length(rest) > 0)"""


def cut_documents(spark, sf_dir) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), 500)


@query(
    CUTS
    + r""" SELECT doc_id, seq, start_offset, end_offset, sha256(text) AS content_hash,
           len(regexp_extract_all(text, '\S+'))::BIGINT AS token_count FROM cut WHERE trim(text, chr(10) || ' ') <> ''"""
)
def chunk_boundaries(spark, sf_dir):
    return cut_documents(spark, sf_dir).drop("text")


@query("""
    WITH RECURSIVE l AS (
      SELECT doc_id, unnest(string_split(rtrim(text, chr(10)), chr(10))) AS line, generate_subscripts(string_split(rtrim(text, chr(10)), chr(10)), 1) AS n
      FROM documents WHERE text <> ''),
    p AS (
      SELECT doc_id, n, line, strlen(line) + 1 AS size, 0::BIGINT AS seq FROM l WHERE n = 1
      UNION ALL
      SELECT l.doc_id, l.n, l.line, CASE WHEN p.size + strlen(l.line) + 1 > 600 THEN strlen(l.line) + 1 ELSE p.size + strlen(l.line) + 1 END,
             CASE WHEN p.size + strlen(l.line) + 1 > 600 THEN p.seq + 1 ELSE p.seq END
      FROM p JOIN l ON l.doc_id = p.doc_id AND l.n = p.n + 1)
    SELECT doc_id, seq, min(n) AS start_line, max(n) AS end_line, sha256(string_agg(line, chr(10) ORDER BY n)) AS content_hash
    FROM p GROUP BY doc_id, seq""")
def chunk_line_pack(spark, sf_dir):
    return chunking.chunk_lines(table(spark, sf_dir, "documents"), 600).drop("text")


@query("""
    SELECT * FROM (VALUES ('repeated_seq', 0::BIGINT), ('sparse_seq', 0), ('overlap', 0), ('empty_range', 0), ('orphan_chunk', 0)) AS t(problem, n)""")
def chunk_integrity(spark, sf_dir):
    return chunking.chunk_problems(cut_documents(spark, sf_dir), table(spark, sf_dir, "documents"))


@query(
    CUTS
    + """, per AS (SELECT doc_id, count(*) AS n, max(end_offset - start_offset) AS longest, sum(len(regexp_extract_all(text, '\\S+'))) AS tokens
          FROM cut GROUP BY doc_id)
        SELECT source AS status, count(*) AS documents, sum(n)::BIGINT AS chunks, max(longest) AS longest, sum(tokens)::BIGINT AS tokens
        FROM documents JOIN per USING (doc_id) GROUP BY source"""
)
def run_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("status"))
    return registry.run_statistics(docs, cut_documents(spark, sf_dir))


@query(r"SELECT doc_id, sha256(text) AS content_hash, len(regexp_extract_all(text, '\S+'))::BIGINT AS token_count FROM documents")
def content_hashes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.content_hash(F.col("text")).alias("content_hash"), text.token_count(F.col("text")).alias("token_count"))


@query("SELECT count(*) AS rows, count(DISTINCT sha256(text)) AS texts, count(*) - count(DISTINCT sha256(text)) AS repeats FROM documents")
def dedup_by_hash(spark, sf_dir):
    return merge.repeats(table(spark, sf_dir, "documents"), text.content_hash(F.col("text")))


@query(r"""
    SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '…' ELSE t END AS excerpt,
           CASE WHEN n_chars > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS head
    FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def excerpts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.excerpt(F.col("text")).alias("excerpt"), text.head(F.col("text")).alias("head"))


# ---------------------------------------------------------------- changes


def as_documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".md")).alias("path"),
        text.content_hash(F.col("text")).alias("sha256"),
        F.col("n_chars").alias("mtime_ns"),
        F.col("n_chars").alias("size_bytes"),
        F.lit("active").alias("status"),
        F.lit("t0").alias("indexed_at"),
    )


@query("""
    WITH d AS (SELECT doc_id, concat(source, '/', doc_id, '.md') AS path, text FROM documents),
    old AS (SELECT * FROM d WHERE doc_id % 3 <> 0), new AS (SELECT * FROM d WHERE doc_id % 3 <> 1)
    SELECT o.doc_id, path, sha256(text) AS sha256, 't0' AS indexed_at FROM old o WHERE path NOT IN (SELECT path FROM new)
    UNION ALL SELECT o.doc_id, path, sha256(n.text || '!'), 't1' FROM new n JOIN old o USING (path)
    UNION ALL SELECT (SELECT max(doc_id) FROM old) + row_number() OVER (ORDER BY path), path, sha256(text || '!'), 't1' FROM new
      WHERE path NOT IN (SELECT path FROM old)""")
def upsert_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = as_documents(docs.where("doc_id % 3 <> 0"))
    new = as_documents(docs.where("doc_id % 3 <> 1").withColumn("text", F.concat("text", F.lit("!"))))
    return merge.upsert_documents(old, new, "t1").select("doc_id", "path", "sha256", "indexed_at")


@query("""
    SELECT doc_id, concat(source, '/', doc_id, '.md') AS path,
           CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'stale' ELSE 'active' END AS status FROM documents""")
def invalidate_docs(spark, sf_dir):
    documents = as_documents(table(spark, sf_dir, "documents"))
    bad = documents.join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi").select("path")
    return merge.invalidated(documents, bad).select("doc_id", "path", "status")


@query("""
    SELECT concat(source, '/', doc_id, '.md') AS path,
           CASE WHEN doc_id % 5 = 0 THEN 'gone' WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'changed'
                WHEN doc_id % 13 = 0 THEN 'touched' ELSE 'same' END AS change FROM documents""")
def manifest_diff(spark, sf_dir):
    documents = as_documents(table(spark, sf_dir, "documents"))
    new = documents.where("doc_id % 5 <> 0")
    changed = F.when(F.col("doc_id") % 11 == 0, F.lit("other")).otherwise(F.col("sha256"))
    time = F.when(F.col("doc_id") % 13 == 0, F.lit(-1)).otherwise(F.col("mtime_ns"))
    manifest = new.select(F.col("path").alias("rel_path"), time.alias("mtime_ns"), F.col("size_bytes").alias("size"), changed.alias("sha256"))
    return merge.manifest_changes(documents.where("doc_id % 5 = 0 or doc_id % 7 <> 0"), manifest)


@query(
    TOKENS
    + """, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 2),
    near AS (SELECT vec_id, list_distance(embedding::DOUBLE[], q.v) AS d FROM embeddings, q ORDER BY 2, 1 LIMIT 20)
    SELECT 'tagged' AS lane, doc_id AS key, (quality::DOUBLE) AS score FROM documents JOIN labels USING (doc_id) WHERE lang = 'es'
    UNION ALL SELECT 'text', doc_id, hits::DOUBLE FROM h WHERE hits > 0
    UNION ALL SELECT 'semantic', vec_id, round(d, 6) FROM near"""
)
def find_report(spark, sf_dir):
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    works = docs.select(F.col("doc_id").cast("string").alias("work_id"), F.col("doc_id").cast("string").alias("slug"), F.lit("").alias("title"), F.lit("").alias("kind"))
    subjects = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    subjects = subjects.select(F.col("doc_id").cast("string").alias("work_id"), F.col("lang").alias("subject"), F.col("quality").cast("double").alias("weight"))
    tagged = registry.find_tagged(works, subjects, "ES")
    hits = fts_phrase(spark, sf_dir).select(F.col("doc_id").cast("string").alias("slug"), F.lit("").alias("title"), F.lit("").alias("snippet"), F.col("hits").cast("double").alias("rank"))
    near = knn.knn(vectors, vector_of(vectors, 2), 20, "l2", "vec_id")
    near = near.select(F.col("vec_id").cast("string").alias("path"), F.lit("").alias("text"), F.round("distance", 6).alias("distance"))
    found = lanes(tagged, hits, near)
    return found.select("lane", F.col("key").cast("long").alias("key"), "score")


@query("""
    SELECT user_id, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(value), 4) AS total FROM events GROUP BY user_id""")
def event_log(spark, sf_dir):
    """The event log by user."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.sum("value"), 4).alias("total")
    )


@query("""
    SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal FROM orders
    QUALIFY ordinal >= 3""")
def resume_after_offset(spark, sf_dir):
    return registry.after_offset(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)
