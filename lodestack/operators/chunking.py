"""Cutting texts in passages: by characters at natural boundaries, or by lines up to a size in bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WHITE_CHARS, content_hash, token_count

#: Smaller sizes count as this.
LEAST_CHARS = 64
CHUNK_CHARS = 2000


def boundary(text: str, begin: int, size: int) -> int:
    """Where a passage of at most size characters ends: after the last empty line, line break or space, or at size."""
    end = begin + size
    for mark in ("\n\n", "\n", " "):
        at = text.rfind(mark, begin, end)
        if at >= 0:
            return at + len(mark)
    return end


def passages_of(parts: Iterable[str], max_chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int, int, str]]:
    """(seq, start, end, text) of a text that comes in parts; a passage of white space only is left out, and leaves its
    number out too. No more than a part and a passage is held: where a passage ends depends on its window alone."""
    size, at, seq, held = max(max_chars, LEAST_CHARS), 0, 0, ""

    def kept(begin: int, end: int) -> bool:
        return bool(held[begin:end].strip(WHITE_CHARS))

    for part in parts:
        held += part
        begin = 0
        while len(held) - begin >= size:
            end = boundary(held, begin, size)
            if kept(begin, end):
                yield seq, at + begin, at + end, held[begin:end]
            begin, seq = end, seq + 1
        held, at = held[begin:], at + begin
    if kept(0, len(held)):
        yield seq, at, at + len(held), held


def passages(text: str | None, max_chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int, int, str]]:
    """passages_of a whole text."""
    return passages_of([text or ""], max_chars)


def lines_of(parts: Iterable[str]) -> Iterator[str]:
    """Lines without their breaks, of a text that comes in parts; nothing follows the last break."""
    begun: list[str] = []
    for part in parts:
        *whole, rest = part.split("\n")
        for line in whole:
            yield ("".join(begun) + line).removesuffix("\r")
            begun = []
        if rest:
            begun.append(rest)
    if begun:
        yield "".join(begun).removesuffix("\r")


def packed_lines_of(parts: Iterable[str], max_bytes: int) -> Iterator[tuple[int, int, int, str]]:
    """(seq, first line, last line, text): whole lines up to max_bytes with their breaks; a longer line stands alone, and
    is what is held at most."""
    held: list[str] = []
    size, first, seq, last = 0, 1, 0, 0
    for last, line in enumerate(lines_of(parts), 1):
        more = len(line.encode("utf-8", "surrogatepass")) + 1
        if held and size + more > max_bytes:
            yield seq, first, last - 1, "\n".join(held)
            held, size, first, seq = [], 0, last, seq + 1
        held.append(line)
        size += more
    if held:
        yield seq, first, last, "\n".join(held)


def packed_lines(text: str | None, max_bytes: int) -> Iterator[tuple[int, int, int, str]]:
    """packed_lines_of a whole text."""
    return packed_lines_of([text or ""], max_bytes)


def exploded(docs: DataFrame, text_col: str, cut, names: tuple[str, str], keep: tuple[str, ...]) -> DataFrame:
    schema = T.StructType([docs.schema[c] for c in keep])
    schema = schema.add("seq", "long").add(names[0], "long").add(names[1], "long").add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places = [], []
            for k, text in enumerate(batch.column(text_col)):
                made = list(cut(text.as_py()))
                rows += made
                places += [k] * len(made)
                if len(rows) > 5000 or k == len(batch) - 1:  # one batch of long texts makes many
                    kept = [batch.column(c).take(pa.array(places, pa.int64())) for c in keep]
                    columns = list(zip(*rows, strict=True)) or [[]] * 4
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays(kept + [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], schema.names)
                    rows, places = [], []

    return docs.select(*keep, *([text_col] if text_col not in keep else [])).mapInArrow(run, schema)


def with_hashes(found: DataFrame, tokens: bool = True) -> DataFrame:
    """Passages with content_hash and token_count, which is null for lines."""
    count = token_count(F.col("text")) if tokens else F.lit(None).cast("long")
    return found.withColumn("content_hash", content_hash(F.col("text"))).withColumn("token_count", count)


def chunk_documents(docs: DataFrame, max_chars: int = CHUNK_CHARS, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, seq, start_offset, end_offset, text, content_hash, token_count: a row a passage, slices of the text."""
    found = exploded(docs, text_col, lambda t: passages(t, max_chars), ("start_offset", "end_offset"), keep)
    return with_hashes(found)


def chunk_lines(docs: DataFrame, max_bytes: int = CHUNK_CHARS, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, seq, start_line, end_line, text, content_hash: a row a run of lines, numbered from 1."""
    found = exploded(docs, text_col, lambda t: packed_lines(t, max_bytes), ("start_line", "end_line"), keep)
    return with_hashes(found).drop("token_count")


def chunk_problems(chunks: DataFrame, documents: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(problem, n): repeated numbers, numbers that aren't dense (reported only), overlaps, orphans, missing vectors."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("seq")
    seen = chunks.select(
        "seq",
        (F.row_number().over(order) - 1).alias("expected"),
        F.lag("seq").over(order).alias("before"),
        F.lag("end_offset").over(order).alias("ended"),
        "start_offset",
        "end_offset",
    )
    count = lambda condition: F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")
    totals = seen.agg(
        count(F.col("seq") == F.col("before")).alias("repeated_seq"),
        count(F.col("seq") != F.col("expected")).alias("sparse_seq"),
        count(F.col("start_offset") < F.col("ended")).alias("overlap"),
        count(F.col("end_offset") <= F.col("start_offset")).alias("empty_range"),
    )
    names = ["repeated_seq", "sparse_seq", "overlap", "empty_range"]
    out = totals.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("problem", "n"))
    if documents is not None:
        orphans = chunks.join(documents.select("doc_id"), "doc_id", "left_anti")
        out = out.union(orphans.agg(F.lit("orphan_chunk"), F.count("*")))
    if vectors is not None:
        out = out.union(chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti").agg(F.lit("no_vector"), F.count("*")))
    return out
