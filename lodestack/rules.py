"""Constraints of the tables as DataFrames of violations: rule, key, and nothing where all rows obey."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import ConstraintError, ForbiddenPathError
from .functions.text import ascii_lower

# The sets that columns may hold, the largest inline medium, and the folder that holds no state.
ALLOWED = {
    "embedding_providers": {"kind": ["local-ollama", "local-onnx", "api"], "status": ["active", "degraded", "retired"]},
    "reindex_runs": {
        "trigger_kind": ["manual", "provider-change", "scheduled", "file-watch"],
        "status": ["running", "completed", "failed", "superseded"],
    },
    "creative_works": {
        "kind": ["essay", "poem", "story", "speech", "radio", "letter", "script", "song", "lore", "other"],
        "status": ["outline", "draft", "rendered", "voiced", "published", "archived"],
    },
    "work_renders": {
        "render_kind": ["outline", "text", "tapscript", "tts-audio", "music", "image", "video", "pdf"],
        "location_kind": ["ext4", "r2"],
    },
    "agent_decisions": {
        "domain": ["infra", "creative", "comms", "fleet-policy", "memory", "media"],
        "reversibility": ["trivial", "moderate", "hard"],
        "status": ["active", "superseded", "reverted", "proposed"],
    },
    "decision_links": {"link_kind": ["file", "work", "render", "run", "index", "url"]},
    "documents": {"status": ["active", "stale", "gone"]},
}
MEDIA = ["tts-audio", "music", "image", "video"]
MEDIA_BYTES = 1 << 20
FORBIDDEN = "/mnt/"

KEYS = {
    "embedding_providers": [["provider_id"], ["kind", "model", "dims"]],
    "index_registry": [["index_name"]],
    "reindex_runs": [["run_id"]],
    "reindex_checkpoints": [["run_id"]],
    "creative_works": [["work_id"], ["slug"]],
    "work_subjects": [["work_id", "subject"]],
    "work_renders": [["render_id"], ["work_id", "render_kind", "seq"]],
    "agent_decisions": [["decision_id"]],
    "decision_links": [["decision_id", "link_kind", "target"]],
    "documents": [["doc_id"], ["path"]],
    "chunks": [["chunk_id"], ["doc_id", "seq"]],
    "vec_chunks": [["chunk_id"]],
}
#: Columns whose keys are the same in any case of A-Z.
NO_CASE = {"work_subjects": {"subject"}}
#: table -> (column, parent table, parent column)
REFERENCES = {
    "index_registry": [("provider_id", "embedding_providers", "provider_id")],
    "reindex_runs": [("index_name", "index_registry", "index_name")],
    "reindex_checkpoints": [("run_id", "reindex_runs", "run_id")],
    "work_subjects": [("work_id", "creative_works", "work_id")],
    "work_renders": [("work_id", "creative_works", "work_id")],
    "agent_decisions": [("supersedes", "agent_decisions", "decision_id")],
    "decision_links": [("decision_id", "agent_decisions", "decision_id")],
    "chunks": [("doc_id", "documents", "doc_id")],
    "vec_chunks": [("chunk_id", "chunks", "chunk_id")],
}


def row_rules(table: str) -> dict[str, Column]:
    """Conditions of single rows. As in SQL, a row breaks one only if it is false; unknown passes."""
    c = F.col
    rules = {f"{column} in set": c(column).isin(values) for column, values in ALLOWED.get(table, {}).items()}
    more = {
        "embedding_providers": {"dims > 0": c("dims") > 0},
        "index_registry": {"db_path allowed": ~c("db_path").startswith(FORBIDDEN)},
        "work_subjects": {"weight in [0, 1]": c("weight").between(0.0, 1.0)},
        "work_renders": {
            "size_bytes >= 0": c("size_bytes") >= 0,
            "duration_ms >= 0": c("duration_ms") >= 0,
            "r2 location": (c("location_kind") != "r2") | c("location").startswith("r2://"),
            "ext4 location": (c("location_kind") != "ext4") | ~c("location").startswith(FORBIDDEN),
            "media fence": ~c("render_kind").isin(MEDIA) | (c("location_kind") == "r2") | (c("size_bytes") <= MEDIA_BYTES),
        },
        "agent_decisions": {"decided_at in UTC": c("decided_at").endswith("Z")},
        "index_meta": {"id = 1": c("id") == 1, "dims > 0": c("dims") > 0},
        "chunks": {"end > start": c("end_offset") > c("start_offset")},
    }
    return rules | more.get(table, {})


def violations(table: str, rows: DataFrame, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """(rule, key) of each broken rule: row conditions, unique keys, and references to the parents given."""
    key = F.concat_ws("/", *(F.col(x).cast("string") for x in KEYS.get(table, [rows.columns[:1]])[0]))
    checks = [F.when(~condition, F.lit(name)) for name, condition in row_rules(table).items()]
    found = []
    if checks:
        broken = rows.select(key.alias("key"), F.explode(F.array_compact(F.array(*checks))).alias("rule"))
        found.append(broken.select("rule", "key"))
    for columns in KEYS.get(table, []):
        folded = [ascii_lower(F.col(c)).alias(c) if c in NO_CASE.get(table, ()) else F.col(c) for c in columns]
        counted = rows.groupBy(*folded).agg(F.count("*").alias("n")).where("n > 1")
        found.append(counted.select(F.lit(f"unique {', '.join(columns)}").alias("rule"), F.concat_ws("/", *columns).alias("key")))
    for column, parent, target in REFERENCES.get(table, []):
        if parents and parent in parents:
            known = parents[parent].select(F.col(target).alias("_known"))
            orphans = rows.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_known"), "left_anti")
            found.append(orphans.select(F.lit(f"{column} references {parent}").alias("rule"), key.alias("key")))
    if table == "index_registry":
        current = rows.where("is_current").agg(F.count("*").alias("n")).where("n > 1")
        found.append(current.select(F.lit("one current index").alias("rule"), F.col("n").cast("string").alias("key")))
    if not found:
        return rows.select(F.lit("").alias("rule"), F.lit("").alias("key")).limit(0)
    return reduce(DataFrame.unionByName, found)


def checked(table: str, rows: DataFrame, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """rows, or ConstraintError that names some of what is broken."""
    bad = violations(table, rows, parents).limit(5).collect()
    if bad:
        raise ConstraintError(f"{table}: " + "; ".join(f"{r.rule} ({r.key})" for r in bad))
    return rows


def allowed_path(path: str) -> str:
    """path, unless state may not live there."""
    if path == FORBIDDEN.rstrip("/") or path.startswith(FORBIDDEN):
        raise ForbiddenPathError(path)
    return path
