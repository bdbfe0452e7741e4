"""Full-text search of one phrase: stored postings, phrase hits, BM25 rank, snippet.

An index is made of segments. A segment is written once and searched often (ranked): it holds rows with a number each, and
of every row and term one posting with the term's places and the row's length. Each task writes the postings of its own rows,
those of a term in blocks, in folders by a hash of the term and sorted by it, so nothing is shuffled to write them, and a search
reads only its own terms and joins what it found with the rows last. For a few rows that nobody stores, text_index and
phrase_rank do the same on arrays of tokens.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stem as words
from ..functions.marks import unmarked

# Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SNIPPET_TOKENS = 12
OPEN, CLOSE, DOTS = "«", "»", "…"
#: Term hashes are dealt to a folder for so many rows, so many folders at most; in a folder, files are sorted by terms.
BUCKET_ROWS, MOST_BUCKETS = 2000, 64
#: Rows at most whose postings share a file in each folder.
PART_ROWS = 1 << 20
#: Rows of a file of rows, so that small tables are read by several tasks, too.
FILE_ROWS = 4096
#: Characters of texts whose postings of a term make a block.
BLOCK_CHARS = 8 << 20
#: Bits of a row's number below those of its segment's.
SEGMENT_BITS = 50


def tokenised(column: Column, stem: bool = True) -> Column:
    """Tokens of a text column, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: words.tokens(t, stem))

    return run(column)


def text_index(rows: DataFrame, columns: tuple[str, ...] = ("title", "body"), stem: bool = True) -> DataFrame:
    """rows with the tokens of each searched column; write it once and search it often."""
    return rows.select("*", *(tokenised(F.col(c), stem).alias(f"{c}_tokens") for c in columns))


@dataclass(frozen=True)
class Segment:
    """Rows and postings that were written together and never change."""

    at: str
    number: int
    buckets: int
    rows: int
    tokens: int


@dataclass(frozen=True)
class TextIndex:
    """Segments, and marks of their rows that are gone; statistics are sums, less those of the marked rows."""

    spark: SparkSession
    segments: tuple[Segment, ...]
    columns: tuple[str, ...] = ("title", "body")
    stem: bool = True
    gone: tuple[str, ...] = ()
    gone_rows: int = 0
    gone_tokens: int = 0

    @property
    def count(self) -> int:
        return sum(s.rows for s in self.segments) - self.gone_rows

    @property
    def tokens(self) -> int:
        return sum(s.tokens for s in self.segments) - self.gone_tokens

    def live(self, rows: DataFrame) -> DataFrame:
        """rows (row_id, ...) that aren't marked as gone."""
        if not self.gone:
            return rows
        marks = self.spark.read.schema("word long, bits long").parquet(*self.gone)
        return unmarked(rows, F.col("row_id"), marks, self.gone_rows)

    @property
    def held(self) -> DataFrame:
        return self.live(reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{s.at}/rows") for s in self.segments]))

    @property
    def rows(self) -> DataFrame:
        """The indexed rows, and row_id."""
        return self.held.drop("_digest")

    def postings_of(self, terms: list[str]) -> DataFrame:
        """The terms' postings: of each segment only the folders of the terms are read."""
        out = []
        for s in self.segments:
            of = [(F.col("bucket") == bucket_of(F.lit(t), s.buckets)) & (F.col("term") == t) for t in dict.fromkeys(terms)]
            blocks = self.spark.read.schema(f"{BLOCK}, bucket int, part int").parquet(f"{s.at}/postings")
            blocks = blocks.where(reduce(Column.__or__, of))
            out.append(blocks.select("term", F.inline(F.arrays_zip("row_id", "field", "positions", "length"))))
        return self.live(reduce(DataFrame.unionByName, out))


#: Postings of a term: the k-th entries of the lists are the k-th posting.
BLOCK = "term string, row_id array<long>, field array<int>, positions array<array<int>>, length array<int>"
#: No token is empty, so the empty term's list has a posting a row, with the row's length.
EVERY_ROW = ""


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def lists(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def blocks(row_ids: list[int], texts: list[list[str | None]], part: int, stem: bool) -> pa.RecordBatch:
    """The blocks of rows whose k-th field has texts[k]: a term's postings by row and field, and a block of every row."""
    fields, codes, sizes = len(texts), {}, []
    code, found = codes.setdefault, []
    for of_row in zip(*texts, strict=True):
        for text in of_row:
            made = [code(w, len(codes)) for w in words.raw(text)]
            found.append(np.array(made, np.int32))
            sizes.append(len(made))
    # Words that are the same term get the same number, in the order of the terms.
    terms = [words.term(w, stem) for w in codes]
    names = sorted(set(terms))
    rank = {t: k for k, t in enumerate(names)}
    of_word = np.array([rank[t] for t in terms], np.int64)
    size = np.array(sizes, np.int64).reshape(-1, fields)
    units = np.repeat(np.arange(size.size), size.ravel())  # a unit is a field of a row
    places = np.arange(len(units)) - np.repeat(np.cumsum(size.ravel()) - size.ravel(), size.ravel())
    term = of_word[np.concatenate(found)] if len(units) else np.empty(0, np.int64)
    order = np.argsort(term, kind="stable")
    term, units, places = term[order], units[order], places[order]
    new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (units[1:] != units[:-1])])) if len(term) else np.empty(0, np.int64)
    starts = np.searchsorted(term[new], np.arange(len(names)))  # of each term's postings; every name has some
    every, n = np.array(row_ids, np.int64), len(row_ids)
    row, field = units[new] // fields, units[new] % fields
    length = size.sum(axis=1)
    bounds = np.concatenate([[0], n + starts, [n + len(new)]])
    columns = [
        pa.array([EVERY_ROW, *names], pa.string()),
        lists(pa.array(np.concatenate([every, every[row]])), bounds),
        lists(pa.array(np.concatenate([np.full(n, -1), field]).astype(np.int32)), bounds),
        lists(lists(pa.array(places.astype(np.int32)), np.concatenate([np.zeros(n, np.int64), new, [len(places)]])), bounds),
        lists(pa.array(np.concatenate([length, length[row]]).astype(np.int32)), bounds),
        pa.array(np.full(len(names) + 1, part, np.int32)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["term", "row_id", "field", "positions", "length", "part"])


def posted(columns: tuple[str, ...], stem: bool, part_rows: int):
    """Rows (row_id, columns) to blocks of their postings; part counts the task's rows, part_rows a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_ids, texts, chars, seen = [], [[] for _ in columns], 0, 0
        for batch in batches:
            for row_id, *of_row in zip(*(batch.column(c).to_pylist() for c in ("row_id", *columns)), strict=True):
                row_ids.append(row_id)
                for held, text in zip(texts, of_row, strict=True):
                    held.append(text)
                    chars += len(text or "")
                seen += 1
                if chars >= BLOCK_CHARS or seen % part_rows == 0:
                    yield blocks(row_ids, texts, (seen - 1) // part_rows, stem)
                    row_ids, texts, chars = [], [[] for _ in columns], 0
        if row_ids:
            yield blocks(row_ids, texts, (seen - 1) // part_rows, stem)

    return run


def write_segment(rows: DataFrame, at: str, columns: tuple[str, ...], stem: bool, number: int = 0) -> Segment:
    """Writes a segment of rows to the folder `at`; its number makes its row ids differ from those of others.

    A task writes the postings of the rows that it reads, and no file gets more than PART_ROWS postings of a term and
    field, however frequent it is.
    """
    spark = rows.sparkSession
    numbered = rows.withColumn("row_id", F.monotonically_increasing_id() + F.lit(number << SEGMENT_BITS))
    numbered.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{at}/rows")
    held = spark.read.parquet(f"{at}/rows")
    count, last = held.agg(F.count("*"), F.coalesce(F.max("row_id"), F.lit(0))).first()
    if last >> SEGMENT_BITS > number:
        raise ValueError("a segment of more partitions than its numbers have room for")
    buckets = max(1, min(MOST_BUCKETS, -(-count // BUCKET_ROWS)))
    made = held.select("row_id", *columns).mapInArrow(posted(columns, stem, PART_ROWS), f"{BLOCK}, part int")
    made = made.withColumn("bucket", bucket_of(F.col("term"), buckets)).sortWithinPartitions("bucket", "part", "term")
    made.write.partitionBy("bucket", "part").parquet(f"{at}/postings")
    segment = Segment(at, number, buckets, count, 0)
    tokens = TextIndex(spark, (segment,)).postings_of([EVERY_ROW]).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] if count else 0
    return Segment(at, number, buckets, count, tokens)


def write_index(rows: DataFrame, at: str, columns: tuple[str, ...] = ("title", "body"), stem: bool = True) -> TextIndex:
    """An index of one segment, for rows that don't change; null texts have no tokens. textstore keeps one of rows that do."""
    return TextIndex(rows.sparkSession, (write_segment(rows, at, columns, stem),), columns, stem)


def moved(places: Column, offset: int) -> Column:
    return F.transform(places, lambda x: x - offset)


def phrase_hits(index: TextIndex, phrase: str) -> DataFrame:
    """(row_id, hits, length) of the rows that hold the phrase in a field; overlapping hits count.

    Only the phrase's terms are read; places of its i-th term less i that all terms share are the phrase's begins.
    """
    wanted = words.tokens(phrase, index.stem)
    if not wanted or not index.segments:
        return index.spark.createDataFrame([], "row_id long, hits int, length int")
    found = index.postings_of(wanted)
    if len(wanted) == 1:
        return found.groupBy("row_id").agg(F.sum(F.size("positions")).cast("int").alias("hits"), F.max("length").alias("length"))
    terms = list(dict.fromkeys(wanted))
    places = [F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"p{k}") for k, t in enumerate(terms)]
    rows = found.groupBy("row_id", "field").agg(*places, F.first("length").alias("length"))
    begins = F.col("p0")
    for offset, t in enumerate(wanted[1:], 1):
        begins = F.array_intersect(begins, moved(F.col(f"p{terms.index(t)}"), offset))
    rows = rows.withColumn("hits", F.coalesce(F.size(begins), F.lit(0))).where("hits > 0")
    return rows.groupBy("row_id").agg(F.sum("hits").cast("int").alias("hits"), F.max("length").alias("length"))


def bm25(hits: Column, length: Column, rows: Column, with_: Column, mean: Column) -> Column:
    """Lower is better; terms that most rows hold get the least weight instead of a negative one."""
    idf = F.log((rows - with_ + 0.5) / (with_ + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    f = hits.cast("double")
    return -idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))


def ranked(index: TextIndex, phrase: str) -> DataFrame:
    """(row_id, hits, rank) of the rows that hold the phrase."""
    found = phrase_hits(index, phrase)
    found = found.join(F.broadcast(found.agg(F.count("*").cast("double").alias("_with"))))  # one row
    mean = F.lit(index.tokens / max(1, index.count))
    rank = bm25(F.col("hits"), F.col("length"), F.lit(float(index.count)), F.col("_with"), mean)
    return found.select("row_id", "hits", rank.alias("rank"))


def hits_of(tokens: Column, phrase: list[str]) -> Column:
    """How often the phrase's tokens stand in a row; overlapping hits count."""
    wanted = F.array(*map(F.lit, phrase))
    if len(phrase) == 1:
        found = F.filter(tokens, lambda t: t == F.lit(phrase[0]))
    else:
        last = F.size(tokens) - len(phrase) + 1
        places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        found = F.filter(places, lambda k: F.slice(tokens, k, F.lit(len(phrase))) == wanted)
    return F.when(F.array_contains(tokens, phrase[0]), F.size(found)).otherwise(F.lit(0))


def phrase_rank(index: DataFrame, phrase: str, columns: tuple[str, ...] = ("title", "body"), stem: bool = True) -> DataFrame:
    """index rows that hold the phrase in one of the columns, with hits and rank (lower is better).

    The whole phrase is one sequence of tokens; without tokens there are no rows.
    """
    wanted = words.tokens(phrase, stem)
    if not wanted:
        return index.withColumn("hits", F.lit(0)).withColumn("rank", F.lit(0.0)).limit(0)
    arrays = [F.col(f"{c}_tokens") for c in columns]
    counted = index.withColumn("hits", sum((hits_of(a, wanted) for a in arrays), F.lit(0)))
    counted = counted.withColumn("_len", sum((F.size(a) for a in arrays), F.lit(0)))
    stats = counted.agg(
        F.count("*").cast("double").alias("_rows"), F.avg("_len").alias("_avg"), F.sum((F.col("hits") > 0).cast("double")).alias("_with")
    )
    found = counted.where("hits > 0").join(F.broadcast(stats))  # one row
    rank = bm25(F.col("hits"), F.col("_len"), F.col("_rows"), F.col("_with"), F.col("_avg"))
    return found.withColumn("rank", rank).drop("_len", "_rows", "_avg", "_with")


def snippet(column: Column, phrase: str, size: int = SNIPPET_TOKENS, stem: bool = True) -> Column:
    """size tokens around the window with most hits, each hit marked; the text's begin if there is none."""
    wanted = words.tokens(phrase, stem)

    def one(text: str | None) -> str:
        if not text:
            return ""
        text = unicodedata.normalize("NFC", text)  # places are those of composed characters
        have, at = words.tokens(text, stem), words.spans(text)
        n = len(wanted)
        hits = [k for k in range(len(have) - n + 1) if n and have[k : k + n] == wanted]
        first = 0
        if hits:
            inside = lambda k: [h for h in hits if k <= h and h + n <= k + size] or [k]
            best = max(hits, key=lambda k: (len(inside(k)), -k))
            span = inside(best)[-1] + n - best
            first = min(max(0, best - max(0, size - span) // 2), max(0, len(have) - size))
        last = min(first + size, len(have)) - 1
        if last < 0:
            return text
        out, place, k = [DOTS] if first else [], at[first][0] if first else 0, first
        marks = [h for h in hits if h >= first and h + n - 1 <= last]
        while k <= last:
            if k in marks:
                out += [text[place : at[k][0]], OPEN, text[at[k][0] : at[k + n - 1][1]], CLOSE]
                place, k = at[k + n - 1][1], k + n
            else:
                out.append(text[place : at[k][1]])
                place, k = at[k][1], k + 1
        out.append(DOTS if last < len(have) - 1 else text[place:])
        return "".join(out)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(column)


def find_text(index: TextIndex | DataFrame, works: DataFrame, phrase: str) -> DataFrame:
    """(slug, title, snippet) of indexed rows (title, body, work_id, render_id) that hold the phrase, best rank first.

    Rows without a work drop out. Snippets are made of the rows found only. index is a stored one or that of text_index.
    """
    stored = isinstance(index, TextIndex)
    found = ranked(index, phrase).join(index.rows, "row_id") if stored else phrase_rank(index, phrase)
    found = found.select("work_id", "render_id", "body", "rank")
    found = found.join(works.select("work_id", "slug", F.col("title").alias("work_title")), "work_id")
    marked = snippet(F.col("body"), phrase, stem=index.stem if stored else True).alias("snippet")
    found = found.select("slug", F.col("work_title").alias("title"), marked, "rank", "render_id")
    return found.orderBy("rank", "slug", "render_id").drop("render_id")
