"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lookup, sifted, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """Null counts as empty; only A-Z are lower-cased. ASCII texts take the faster of two ways to the same."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null and empty texts are equal. Of equal texts the
    row with the largest id stays. Of rows that share id and text, and of equal texts whose ids are all null, each
    is kept (their ids equal keep_id), and each counts in group_size. Other columns of docs are not looked at.

    Each level groups only what the level before left: rows whose length no other row has never reach the prefix
    level, rows whose length and prefix no other row has never reach the level of full hashes. Every row's digest is
    part of the result, so the only scan of the texts makes all three keys, and the levels run on those.
    """
    text = normalised(F.col(text_col))
    keys = docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id",
        F.octet_length("text").alias("bytes"),
        F.xxhash64(F.substring("text", 1, PREFIX_CHARS)).alias("prefix"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
    )
    keys = stored(keys, "exact_keys")

    prefixes = shared_prefixes(keys)
    third = lookup(
        keys.select(F.struct("bytes", "prefix").alias("level"), "digest", "id"), prefixes, "level", "n"
    )
    groups = (
        third.groupBy("level", "digest")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("digest", "keep_id", "group_size", F.col("group_size").alias("n"))
    )
    groups = stored(groups, "exact_groups")
    found = lookup(keys.select("id", "digest"), groups, "digest", "n", "left")
    return found.select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def shared_prefixes(keys: DataFrame) -> DataFrame:
    """Of stored keys (bytes, prefix), those that several rows have: level, n. First lengths, then prefixes within them."""
    lengths = stored(keys.groupBy("bytes").agg(F.count("*").alias("n")).where("n > 1"), "lengths")
    second = lookup(keys.select("bytes", "prefix"), lengths, "bytes", "n")
    prefixes = second.groupBy("bytes", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    return stored(prefixes.select(F.struct("bytes", "prefix").alias("level"), "n"), "prefixes")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns; repeats of a kept row's id and text stay.

    Lengths and prefixes come first, and only texts that share both with another are read in full and hashed. No text
    is shuffled but those of rows that share their id's mark with a dropped row (see sifted).
    """
    # Lower-casing A-Z changes no length, and of the prefix only what it holds.
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.xxhash64(normalised(F.substring(text, 1, PREFIX_CHARS)))
    keys = stored(docs.select(F.octet_length(text).alias("bytes"), start.alias("prefix")), "exact_keys")
    levels = stored(shared_prefixes(keys).select(F.xxhash64("level.bytes", "level.prefix").alias("h")), "levels")
    again, _ = sifted(docs, F.xxhash64(F.octet_length(text), start), levels)
    digest = F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    full = stored(again.select(F.col(id_col).alias("id"), digest.alias("digest")), "digests")
    groups = full.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    dropped = lookup(full, stored(groups, "exact_groups"), "digest", "n").where(~F.col("id").eqNullSafe(F.col("keep_id")))
    dropped = stored(dropped.select(F.col("id").alias("_id"), F.col("digest").alias("_digest")).distinct(), "exact_dropped")
    marks = stored(dropped.select(F.xxhash64("_id").alias("h")), "dropped_marks")
    maybe, sure = sifted(docs, F.xxhash64(id_col), marks)
    same = maybe[id_col].eqNullSafe(dropped["_id"]) & (digest == dropped["_digest"])
    return sure.unionByName(maybe.join(dropped, same, "left_anti"))
