"""Mixing sources to target weights: hash-random order within each source, cut at the source's exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.merge import numbered
from .shared import lookup, stored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source gives more than so many times its words.
EPOCHS = 3
#: Keys are ranges of 2^32; so many ranges a source, so that a range holds a bounded share of the largest source.
RANGES = 4096
#: A table of a row a source is broadcast up to so many sources, beyond that joined by a shuffle.
BROADCAST_SOURCES = 100_000

WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size), one row each, with target: weights' shares of all words, at most EPOCHS times.

    What a source can't give is shared anew by weight until no target is above: in rounds, each of which sums what is
    left over the sources that aren't full. Sources are numbered by ranges, so no task has all of them. Zero words in
    all give zero targets.
    """
    order = [F.col("source").isNull(), F.col("source")]
    s = numbered(sources.select("source", "source_size"), order, "_at", -1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_at") % len(WEIGHTS) + 1).cast("int")).cast("long")
    s = stored(s.withColumn("w", weight).withColumn("most", F.col("source_size") * EPOCHS), "sources")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    full, count = F.lit(False), -1
    while True:
        left = s.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(full, F.col("most"))).alias("given"),
            F.sum(F.when(~full, F.col("w"))).alias("weight"),
            F.count(F.when(full, 1)).alias("full"),
        ).first()
        words, open_weight = (left["words"] or 0) - (left["given"] or 0), left["weight"] or 0
        if left["full"] == count or not open_weight:
            break
        count = left["full"]
        full = full | (wide("most") * F.lit(open_weight) <= F.lit(words) * wide("w"))
    share = (F.lit(words) * F.col("w")).cast("double") / F.lit(float(open_weight or 1))
    return s.select("source", "source_size", F.when(full, F.col("most")).otherwise(share).cast("double").alias("target"))


def order_key(id_: Column, text: Column, size: Column) -> Column:
    """MD5 of the id and the size; without an id the text stands in for it, so that such rows don't share one key."""
    named = F.when(id_.isNull(), F.xxhash64(text).cast("string")).otherwise(id_.cast("string"))
    return F.md5(F.concat(named, F.lit(":"), size.cast("string")))


def cuts(sized: DataFrame, ranges: int) -> DataFrame:
    """Of stored rows (of, id, size, key): of each source its size, target, how often all of it is taken, and where it is cut.

    cut is the (key, id, size) of the row at which the rest of the budget ends, or null, and spare the words that the
    row and those equal to it give. Sums of a source's ranges of keys tell the range that holds the cut, and only
    rows of such ranges are sorted.
    """
    ranged = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / 2**32)
    sums = stored(sized.groupBy("of", ranged.alias("range")).agg(F.sum("size").alias("words"), F.count("*").alias("n")), "ranges")
    want = targets(sums.groupBy("of").agg(F.sum("words").alias("source_size")).select("of.source", "source_size"))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.call_function("div", budget, F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    want = want.select(F.struct("source").alias("of"), "source_size", "target", whole.alias("whole"))
    want = stored(want.withColumn("rest", budget - F.col("whole") * F.col("source_size")), "targets")
    earlier = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.withColumn("begun", F.coalesce(F.sum("words").over(earlier), F.lit(0)))  # RANGES rows a source at most
    begun = begun.join(want.select("of", "rest"), "of").where("rest > begun and rest <= begun + words")
    begun = stored(begun.select(F.struct("of", "range").alias("part"), (F.col("rest") - F.col("begun")).alias("rest"), "n"), "cut_ranges")
    near = lookup(sized.select(F.struct("of", ranged.alias("range")).alias("part"), F.struct("key", "id", "size").alias("row"), "size"), begun, "part", "n")
    equal = near.groupBy("part", "row").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    equal = equal.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    found = equal.where("rest > inside and rest <= inside + words")
    found = found.select(F.col("part.of").alias("of"), F.col("row").alias("cut"), (F.col("rest") - F.col("inside")).alias("spare"))
    sizes = sums.groupBy("of").agg(F.sum("n").alias("n"))
    return stored(want.drop("rest").join(found, "of", "left").join(sizes, "of"), "cuts")


def with_taken(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """rows (of, key, id, size, ...) with their source's columns of cut, and taken."""
    if cut.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(cut.drop("n")), "of")
    else:
        joined = lookup(rows, cut, "of", "n")
    joined = joined.withColumn("_side", F.struct("key", "id", "size"))
    once = F.when(F.col("cut").isNotNull() & (F.col("_side") < F.col("cut")), F.col("size")).otherwise(F.lit(0))
    at_cut = F.col("cut").isNotNull() & F.col("_side").eqNullSafe(F.col("cut"))
    # Rows that equal the one at the cut: one where ids are distinct.
    place = F.row_number().over(Window.partitionBy("of").orderBy("key")) - 1
    last = joined.where(at_cut).withColumn("_once", F.greatest(F.lit(0), F.least(F.col("size"), F.col("spare") - place * F.col("size"))))
    out = joined.where(~at_cut).withColumn("_once", once.cast("long")).unionByName(last)
    return out.withColumn("taken", (F.col("whole") * F.col("size") + F.col("_once")).cast("long")).drop("_once", "_side", "cut", "spare", "whole")


def mixed_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ranges: int = RANGES
) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken (words the mix takes, repeats counted).

    A source's budget is its target, rounded. It takes every document budget // source_size times, and then
    documents in order of a random key (MD5 of the id and the number of words) until the rest of the budget is
    spent; the document at the cut gives only its first words. So taken sums to the budget, and no document gives
    more than EPOCHS times its words. Null texts and texts without words have size 0 and give nothing; a null
    source is a source of its own; a null id is replaced by a hash of the text. Of rows that share source, id and size
    an arbitrary one is cut, if any is: the sum stays, and reruns differ only in which of the equals it is.
    """
    sized = stored(sizes(docs, id_col, text_col, source_col).drop("row"), "sizes")
    found = with_taken(sized, cuts(sized, ranges))
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, of, size, key and row: all columns as one, so that no name of docs meets another."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.struct(F.col(source_col).alias("source")).alias("of"),
        words_in(text).alias("size"),
        text.alias("text"),
        F.struct(*docs.columns).alias("row"),
    )
    return rows.select("id", "of", "size", order_key(F.col("id"), F.col("text"), F.col("size")).alias("key"), "row")


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = None
) -> DataFrame:
    """The mix itself: rows of docs, each as often as mixed_words takes it whole, and once more cut where it is cut.

    A cut row's text ends after the words taken (and chars_col, if given, is its new length). Rows without words and
    rows that aren't taken go. A row tells by itself on which side of its source's cut it stands, so texts aren't
    shuffled.
    """
    rows = sizes(docs, id_col, text_col, source_col)
    cut_at = cuts(stored(rows.drop("row"), "sizes"), RANGES)
    rows = with_taken(rows, cut_at).where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), times)))
    left = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    text = F.col(f"row.{text_col}")
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # after each word
    cut = left < F.col("size")
    text = F.when(cut, F.array_join(F.slice(ends, F.lit(1), left.cast("int")), "")).otherwise(text)
    new = {text_col: text}
    if chars_col:
        new[chars_col] = F.when(cut, F.length(text).cast("long")).otherwise(F.col(f"row.{chars_col}"))
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
