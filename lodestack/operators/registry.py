"""Queries of the registry: tagged works, renders, decisions, runs, current index."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BadDateError
from ..functions.text import ascii_lower, same_word, title_pattern


def find_tagged(works: DataFrame, subjects: DataFrame, phrase: str) -> DataFrame:
    """(slug, title, kind, weight) of works with the subject, in any case of A-Z; heaviest first, ties by slug."""
    tagged = subjects.where(same_word(F.col("subject"), F.lit(phrase))).select("work_id", "weight")
    found = tagged.join(works.select("work_id", "slug", "title", "kind"), "work_id")
    return found.select("slug", "title", "kind", "weight").distinct().orderBy(F.desc("weight"), "slug")


RENDER_COLUMNS = ("render_kind", "seq", "location_kind", "location", "duration_ms", "size_bytes", "renderer", "created_at")


def renders(works: DataFrame, work_renders: DataFrame, slug: str) -> DataFrame:
    """Renders of the work of this slug, or of works whose title holds the slug's words; by kind and number."""
    wanted = works.where((F.col("slug") == slug) | ascii_lower(F.col("title")).like(title_pattern(slug))).select("work_id")
    found = work_renders.join(wanted, "work_id")
    return found.orderBy("render_kind", "seq", "work_id").select(*RENDER_COLUMNS)


def day_bounds(day: str) -> tuple[str, str]:
    try:
        if len(day) != 10:
            raise ValueError(day)
        first = date.fromisoformat(day)
    except ValueError:
        raise BadDateError(day) from None
    return first.isoformat(), (first + timedelta(days=1)).isoformat()


def decided(decisions: DataFrame, day: str) -> DataFrame:
    """Decisions of one day in UTC, in order; times are compared as text."""
    first, next_ = day_bounds(day)
    found = decisions.where((F.col("decided_at") >= first) & (F.col("decided_at") < next_))
    return found.orderBy("decided_at", "decision_id").select("decided_at", "agent", "domain", "summary", "status")


def latest_rows(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Each key's newest row; partial results are combined before the shuffle, so a key may have any number of rows."""
    newest = F.max_by(F.struct(*rows.columns), F.struct(time, tie)).alias("row")
    return rows.groupBy(F.col(key).alias("_key")).agg(newest).select("row.*")


def after_offset(rows: DataFrame, key: str, order: str, offset: int) -> DataFrame:
    """rows with ordinal, their place in their key's order from 0, those before the offset left out."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("ordinal", place.cast("long")).where(F.col("ordinal") >= offset)


def resumable_runs(runs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Each index's newest run with its checkpoint, if it is still running or has failed."""
    newest = latest_rows(runs, "index_name", "started_at", "run_id")
    return newest.where(F.col("status").isin("running", "failed")).join(checkpoints, "run_id")


def resumable_run(runs: DataFrame, checkpoints: DataFrame, index_name: str) -> DataFrame:
    """The same of one index: a row or none."""
    return resumable_runs(runs.where(F.col("index_name") == index_name), checkpoints)


def superseded(runs: DataFrame, index_name: str, run_id: str) -> DataFrame:
    """runs, after run_id has begun: other runs of the index that are still marked running are superseded."""
    old = (F.col("index_name") == index_name) & (F.col("status") == "running") & (F.col("run_id") != run_id)
    return runs.withColumn("status", F.when(old, "superseded").otherwise(F.col("status")))


def current_index(indexes: DataFrame) -> DataFrame:
    return indexes.where("is_current")


def run_statistics(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a document status: documents, chunks, longest chunk, tokens."""
    per_doc = chunks.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max(F.col("end_offset") - F.col("start_offset")).alias("longest"), F.sum("token_count").alias("tokens")
    )
    joined = documents.select("doc_id", "status").join(per_doc, "doc_id", "left")
    return joined.groupBy("status").agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
        F.coalesce(F.max("longest"), F.lit(0)).alias("longest"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    )
