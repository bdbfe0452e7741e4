"""The operators' registered queries: name -> (spark, sf_dir) -> DataFrame, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, exactdup, langid, licenses, mixing, neardup, pieces, simhash, tokens, topk, toxicity, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query(
    "op9_exact_dedup",
    """
    WITH n AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM n
    """,
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_groups(table(spark, sf_dir, "documents"))


@query(
    "op10_mix_sources",
    r"""
    WITH RECURSIVE sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
      FROM documents),
    named AS (
      SELECT source, sum(size)::BIGINT AS source_size,
             list_value(5, 2, 1)[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w
      FROM sized GROUP BY source),
    fill AS (
      SELECT 0 AS step, source, source_size, w, false AS capped FROM named
      UNION ALL
      SELECT step + 1, source, source_size, w,
             capped OR left_words * w >= 3 * source_size * left_weight
      FROM (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0) AS left_words,
                   coalesce(sum(w) FILTER (NOT capped) OVER (), 0) AS left_weight FROM fill)
      WHERE step < 60),
    target AS (
      SELECT source, source_size,
             CASE WHEN capped THEN (3 * source_size)::DOUBLE
                  ELSE (left_words * w)::DOUBLE / left_weight::DOUBLE END AS target
      FROM (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0) AS left_words,
                   coalesce(sum(w) FILTER (NOT capped) OVER (), 0) AS left_weight
            FROM (SELECT * FROM fill WHERE step = 60))),
    ordered AS (
      SELECT s.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
             coalesce(sum(size) OVER (PARTITION BY s.source
               ORDER BY md5(concat(doc_id, ':', size)), doc_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           (CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
             + greatest(0, least(size, budget % source_size - before)) END)::BIGINT AS taken
    FROM ordered
    """,
)
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; fold 2 is held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold(F.col("doc_id")) != 2))
    found = langid.languages(docs, model, spans=False)
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


@query(
    "op8_minhash_near_dedup",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (
      SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
    x AS (SELECT doc_id, unnest(sh) AS g FROM s),
    pairs AS (
      SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY ALL),
    links AS (
      SELECT u, v FROM pairs JOIN s su ON su.doc_id = u JOIN s sv ON sv.doc_id = v
      WHERE 100 * c >= 85 * (len(su.sh) + len(sv.sh) - c)),
    reach(doc_id, node) AS (
      SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON r.node = l.u)
    SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
    FROM s JOIN (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = s.doc_id
    """,
)
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_groups(table(spark, sf_dir, "documents"), per_hundred=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    "op1_warc_archives",
    """
    WITH p AS (
      SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
    groups AS (SELECT *, list_transform(generate_series(0, 7), lambda i: ('0x' || h[5 * i + 1:5 * i + 5])::BIGINT) AS g FROM p)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(g, lambda n: concat(
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 15) & 31)::INT + 1, 1),
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 10) & 31)::INT + 1, 1),
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 5) & 31)::INT + 1, 1),
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n & 31)::INT + 1, 1))), '') AS payload_digest,
           CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> top THEN top END AS refers_to
    FROM groups
    """,
)
def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op3_exact_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
    r AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
)
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id")) != 2))
    found = toxicity.scores(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")


@query("op2_piece_nbest")
def op2_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op11_simhash_near_dedup")
def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def as_long(name: str) -> Column:
    """A decimal column as long; null where it doesn't fit."""
    return F.col(name).try_cast("long").alias(name)


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "component", "n", as_long("deviation"), "whitened", "explained", "identity_error")


def lloyd_sql(rounds: int = 10) -> str:
    """SQL of op13: a pair of tables a round, as neither an aggregate of an aggregate nor a loop is needed then."""
    distance = "list_sum(list_transform(list_zip(v, z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
      SELECT id, v, k, d FROM (SELECT id, v, k, {distance} AS d FROM kept, c{k})
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, k) = 1)""")
        if k < rounds:
            steps.append(f"""s{k} AS (
      SELECT k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{k}, range(1, 65) r(i) GROUP BY k, i),
    m{k} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS z FROM s{k} GROUP BY k),
    c{k + 1} AS MATERIALIZED (SELECT k, coalesce(m{k}.z, c{k}.z) AS z FROM c{k} LEFT JOIN m{k} USING (k))""")
    return f"""
    WITH kept AS MATERIALIZED (
      SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS z
      FROM (SELECT sha256(concat('3:', vec_id)) AS h, v FROM kept ORDER BY h LIMIT 8)),
    {", ".join(steps)}
    SELECT vec_id, a.k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia,
           sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN kept USING (id) JOIN c{rounds} c ON c.k = a.k
    """


@query("op13_centroid_clustering", lloyd_sql())
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.clustered(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", as_long("distance"), as_long("cluster_inertia"), as_long("inertia"), "centroid_sha256")
