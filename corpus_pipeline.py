"""A corpus pipeline of five stages; each gets what the one before has kept, written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import exactdup, langid, mixing, neardup, pieces
from lodestack.llm.shared import new_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates share so many hundredths of their five-word shingles.
NEAR_PER_HUNDRED = 80
#: Segmentations of a text in the last stage.
BEST = 4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts and texts without letters. A missing lang is filled in.

    If no document has a lang to learn from, nothing can be told and only texts without letters go.
    """
    model = langid.fit(docs)
    found = langid.languages(docs, model, keep=COLUMNS[1:], spans=False)
    if model.langs:
        found = found.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred"))
    else:
        found = found.where(F.col("text").rlike(r"\p{L}"))
    return found.select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts that of the largest doc_id."""
    return exactdup.without_copies(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document of the smallest doc_id."""
    return neardup.without_near_copies(docs, per_hundred=NEAR_PER_HUNDRED).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's share of words; documents repeat where a source's share is above its words."""
    return mixing.mixed_documents(docs, chars_col="n_chars").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of whole texts and the scores of the best segmentations."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), BEST, keep=("lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        at = new_folder(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first and last stage (a fitted model, n-best segmentations) can't be told in SQL.
ORACLE_SQL = None
