"""Schemas of the tables of an index and of the registry."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

CHUNKER_VERSION = "boundary-1"
INDEX_VERSION = 1

_DDL = {
    # one index
    "index_meta": "id int, provider_id string, model string, dims long, index_version long, chunker_version string, created_at string",
    "documents": "doc_id long, path string, sha256 string, mtime_ns long, size_bytes long, status string, indexed_at string",
    "chunks": "chunk_id long, doc_id long, seq long, start_offset long, end_offset long, text string, content_hash string, token_count long, embedded_at string",
    "vec_chunks": "chunk_id long, embedding array<float>",
    "manifest": "rel_path string, mtime_ns long, size long, sha256 string",
    # the registry
    "embedding_providers": "provider_id string, kind string, model string, dims long, endpoint string, quality_tier long, fallback_allowed boolean, status string, last_health_at string, notes string",
    "index_registry": "index_name string, provider_id string, db_path string, index_version long, is_current boolean, doc_count long, chunk_count long, created_at string, retired_at string",
    "reindex_runs": "run_id string, index_name string, trigger_kind string, snapshot_manifest string, snapshot_hash string, status string, started_at string, finished_at string, error string",
    "reindex_checkpoints": "run_id string, last_doc_path string, docs_total long, docs_done long, chunks_written long, batches_done long, peak_rss_bytes long, updated_at string",
    "creative_works": "work_id string, slug string, title string, kind string, status string, created_by string, synopsis string, source_session string, created_at string, updated_at string",
    "work_subjects": "work_id string, subject string, weight double",
    "work_renders": "render_id string, work_id string, render_kind string, seq long, location_kind string, location string, mime string, sha256 string, size_bytes long, duration_ms long, renderer string, spec_json string, created_at string",
    "work_text_fts": "title string, body string, work_id string, render_id string",
    "agent_decisions": "decision_id string, decided_at string, agent string, domain string, summary string, rationale string, reversibility string, status string, supersedes string, session_ref string",
    "decision_links": "decision_id string, link_kind string, target string",
}
_TYPES: dict[str, DataType] = {
    "string": StringType(),
    "long": LongType(),
    "int": IntegerType(),
    "double": DoubleType(),
    "boolean": BooleanType(),
    "array<float>": ArrayType(FloatType()),
}


def schema_of(columns: str) -> StructType:
    """The schema of "name type, ..."; unlike Spark's own parser it needs no session."""
    out = StructType()
    for column in columns.split(", "):
        name, kind = column.split(" ")
        out = out.add(name, _TYPES[kind])
    return out


SCHEMAS: dict[str, StructType] = {name: schema_of(ddl) for name, ddl in _DDL.items()}
INDEX_TABLES = ("index_meta", "documents", "chunks", "vec_chunks")
REGISTRY_TABLES = tuple(list(_DDL)[5:])
