"""Semantic memory over text corpora, as Spark jobs."""
