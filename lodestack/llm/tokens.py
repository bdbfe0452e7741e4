"""Token-ID output: independent zstandard frames, a trailing seek table with checksums, and a reader by document.

A file holds one frame a document (its ids as little-endian unsigned 16- or 32-bit numbers), then a skippable frame
with the documents' ids and the width, then a skippable frame with the seek table of the public seekable format:
for each frame its compressed size, size, and the low 32 bits of the XXH64 of its content.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import filled, freeing, in_small_batches, new_folder, pieces_of, ragged, stored

# Fixed values of the seekable zstandard format.
SKIPPABLE_TABLE = 0x184D2A5E
SKIPPABLE_DOCUMENTS = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
TABLE_FOOTER = struct.Struct("<IBI")
TABLE_ENTRY = struct.Struct("<III")
HAS_CHECKSUMS = 0x80

END = 0
LEVEL = 3
#: Distinct words of which a worker keeps the ids; further ones are encoded each time they are met.
KEPT_WORDS = 400_000

#: Spaces at either end of a text or next to white space, and texts with white space outside ASCII.
ODD_SPACE = (
    r"(^|[\s\x0b]) | ([\s\x0b]|$)|[\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
#: Words that begin with their space and hold no white space at either end, so that any of them may follow each other in a text.
PLAIN_WORD = r"^ [^\s\x0b]((?s:.*)[^\s\x0b])?\z"
#: Of such words, so many are encoded as one text.
JOINED_WORDS = 1024
SPACE, NOTHING = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


# ---------------------------------------------------------------- encoding


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library, each distinct word encoded once.

    Such a tokenizer splits text before every single space between two other characters, so the words between
    can be encoded apart, each with its space. Texts with white space next to a space are encoded as they are, and so
    are texts that hold the string of an added token, which the library looks for in the text before it splits it.
    """

    def __init__(self, path: str) -> None:
        self.of = tokenizer(path)
        self.added = sorted({x.content for x in self.of.get_added_tokens_decoder().values()})
        vocabulary = self.of.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        for token, k in vocabulary.items():
            self.lengths[k] = len(token)  # a character of the byte-level alphabet is a byte
        self.words = pa.array([], pa.large_string())
        self.ids = np.empty(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.of.encode_batch_fast(texts, add_special_tokens=False)]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        return (np.concatenate(found) if found else np.empty(0, np.uint32)), bounds

    def joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() of words like PLAIN_WORD, many as one text: where a word's ids end is known by their bytes.

        Words whose ends aren't ends of ids, as of a tokenizer that changes the text first, are encoded one by one.
        """
        made, counts = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]
        runs = [words.slice(at, JOINED_WORDS) for at in range(0, len(words), JOINED_WORDS)]
        found = self.of.encode_batch_fast(["".join(run.to_pylist()) for run in runs], add_special_tokens=False)
        for run, coded in zip(runs, found, strict=True):
            ids = np.array(coded.ids, np.uint32)
            have, want = np.cumsum(self.lengths[ids]), np.cumsum(pc.binary_length(run).to_numpy().astype(np.int64))
            last = np.searchsorted(have, want)
            if len(have) and have[-1] == want[-1] and (have[last] == want).all():
                ends = last + 1
            else:
                ids, bounds = self.encode(run.to_pylist())
                ends = bounds[1:]
            made.append(ids)
            counts.append(np.diff(ends, prepend=0))
        return np.concatenate(made), np.cumsum(np.concatenate(counts))

    def words_encoded(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each distinct word: all ids, and where each word's begin and how many there are."""
        at = pc.index_in(distinct, value_set=self.words)
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        new = distinct.filter(pa.array(~known))
        plain = pc.match_substring_regex(new, PLAIN_WORD)
        other = pc.invert(plain)
        of_new = np.flatnonzero(~known)
        is_plain = plain.to_numpy(zero_copy_only=False)
        of_new = np.concatenate([of_new[is_plain], of_new[~is_plain]])
        ids, bounds = self.joined(new.filter(plain))
        more, ends = self.encode(new.filter(other).to_pylist())
        ids, bounds = np.concatenate([ids, more]), np.concatenate([bounds, bounds[-1] + ends[1:]])
        new = pa.concat_arrays([new.filter(plain), new.filter(other)])
        starts, lengths = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        every = np.concatenate([self.ids, ids])
        starts[known], lengths[known] = self.bounds[place[known]], np.diff(self.bounds)[place[known]]
        starts[of_new], lengths[of_new] = len(self.ids) + bounds[:-1], np.diff(bounds)
        room = max(0, KEPT_WORDS - len(self.words))
        if room and len(new):
            self.words = pa.concat_arrays([self.words, new.slice(0, room)])
            self.ids = np.concatenate([self.ids, ids[: bounds[min(room, len(new))]]])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1 : room + 1]])
        return every, starts, lengths

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text's after the other, and the bounds of each text's."""
        n = len(texts)
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        for string in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, string))
        odd = odd.to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * n
        ids, ends = self.encode(texts.filter(pa.array(odd)).to_pylist())
        for k, i in enumerate(np.flatnonzero(odd)):
            out[i] = ids[ends[k] : ends[k + 1]]
        plain = np.flatnonzero(~odd)
        if len(plain):
            lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
            flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            first = np.zeros(len(flat), bool)
            first[offsets[:-1]] = True
            spaced = pc.if_else(pa.array(first), flat, pc.binary_join_element_wise(SPACE, flat, NOTHING))
            coded = spaced.dictionary_encode()
            codes = coded.indices.to_numpy()
            ids, starts, lengths = self.words_encoded(coded.dictionary)
            every = ids[ragged(starts[codes], lengths[codes])]
            ends = np.concatenate([[0], np.cumsum(lengths[codes])])[offsets]
            for k, i in enumerate(plain):
                out[i] = every[ends[k] : ends[k + 1]]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
        return (np.concatenate(out) if n else np.empty(0, np.uint32)), bounds


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker, so that frequent words are encoded once a worker."""
    return Encoder(path)


# ---------------------------------------------------------------- files


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes a file of the format above; one call of add a document."""

    def __init__(self, sink, dtype: str = "<u4", level: int = LEVEL) -> None:
        import zstandard

        self.sink, self.dtype, self.entries, self.doc_ids = sink, np.dtype(dtype), [], []
        self.largest = int(np.iinfo(self.dtype).max)
        self.compress = zstandard.ZstdCompressor(level=level).compress

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        if len(ids) and int(ids.max()) > self.largest:
            raise OverflowError(f"id {ids.max()} doesn't fit {self.dtype}")
        data = ids.astype(self.dtype).tobytes()
        frame = self.compress(data)
        self.sink.write(frame)
        self.entries.append(TABLE_ENTRY.pack(len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.doc_ids.append(doc_id)

    def close(self) -> None:
        import zstandard

        about = zstandard.compress(json.dumps({"dtype": self.dtype.str, "doc_ids": self.doc_ids}).encode())
        self.sink.write(struct.pack("<II", SKIPPABLE_DOCUMENTS, len(about)) + about)
        # The table has one more entry, so that the documents' frame is found by the same rule; it holds no ids.
        table = b"".join(self.entries) + TABLE_ENTRY.pack(len(about) + 8, 0, 0)
        footer = TABLE_FOOTER.pack(len(self.entries) + 1, HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_TABLE, len(table) + len(footer)) + table + footer)
        self.sink.close()


class FrameReader:
    """Reads single documents of a file; only their frames are read and decompressed."""

    def __init__(self, source) -> None:
        import zstandard

        self.source = source
        size = source.size()
        if size < TABLE_FOOTER.size + 8:
            raise ValueError("not a seekable file: too short")
        n, flags, magic = TABLE_FOOTER.unpack(self.at(size - TABLE_FOOTER.size, TABLE_FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("not a seekable file: no seek table with checksums")
        length = n * TABLE_ENTRY.size
        table = np.frombuffer(self.at(size - TABLE_FOOTER.size - length, length), "<u4").reshape(n, 3)
        self.sizes, self.lengths, self.checksums = table.astype(np.int64).T
        self.starts = np.cumsum(self.sizes) - self.sizes
        about = self.at(int(self.starts[-1]), int(self.sizes[-1]))
        found = json.loads(zstandard.decompress(about[8:]))
        self.doc_ids, self.dtype = found["doc_ids"], np.dtype(found["dtype"])
        self.decompress = zstandard.ZstdDecompressor().decompress

    def at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def frame(self, k: int, data: bytes) -> np.ndarray:
        import xxhash

        out = self.decompress(data, max_output_size=int(self.lengths[k])) if self.lengths[k] else b""
        if len(out) != self.lengths[k] or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != self.checksums[k]:
            raise ValueError(f"frame {k}: checksum differs")
        return np.frombuffer(out, self.dtype)

    def read(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self.frame(k, self.at(int(self.starts[k]), int(self.sizes[k])))

    def all(self, span: int = 4 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """Every document in order; neighbouring frames are fetched together."""
        k, n = 0, len(self)
        while k < n:
            to = max(k + 1, int(np.searchsorted(self.starts[:n] + self.sizes[:n], self.starts[k] + span, "right")))
            data = self.at(int(self.starts[k]), int(self.starts[to - 1] + self.sizes[to - 1] - self.starts[k]))
            for i in range(k, to):
                at = int(self.starts[i] - self.starts[k])
                yield i, self.frame(i, data[at : at + int(self.sizes[i])])
            k = to


# ---------------------------------------------------------------- the operator


def write_tokens(
    docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, dtype: str | None = None
) -> DataFrame:
    """Writes files of ids in ascending id order and returns the manifest: part, uri, n_docs, n_tokens, start.

    A file is written under a name of its own by each attempt of a task; the manifest names those of the tasks that
    counted, so retries and speculative copies leave nothing in the result. Null texts are empty and get only the
    end id. Rows that share an id follow each other in the order of their texts' hashes; null ids come first. dtype is
    by default the narrower of two and four bytes that holds every id of the vocabulary; an id that doesn't fit fails.
    """
    dtype = dtype or ("<u2" if max(end, tokenizer(path).get_vocab_size(with_added_tokens=True) - 1) <= 0xFFFF else "<u4")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Range limits come from a sample of ids and text hashes, so that one id can't fill a task.
    dealt = docs.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, writer, tokens = encoder(path), None, 0
        uri = f"{folder}/{uuid.uuid4().hex}.ids.zst"
        for batch in batches:
            for piece in pieces_of(batch, "text"):
                if writer is None:
                    files, at = opened(uri)
                    files.create_dir(at.rpartition("/")[0], recursive=True)
                    writer = FrameWriter(files.open_output_stream(at, compression=None), dtype)
                ids, bounds = encode(filled(piece.column("text")))
                last = np.array([end], np.uint32)
                for k, doc_id in enumerate(piece.column("id").to_pylist()):
                    writer.add(doc_id, np.concatenate([ids[bounds[k] : bounds[k + 1]], last]))
                tokens += len(ids) + len(piece)
        if writer is not None:
            writer.close()
            row = [[TaskContext.get().partitionId()], [uri], [len(writer.doc_ids)], [tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["part", "uri", "n_docs", "n_tokens"])

    parts = stored(in_small_batches(dealt.select("id", "text")).mapInArrow(freeing(write), "part long, uri string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, columns: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """One row per document of the manifest's files: doc_id, start, and what `columns` makes of its ids.

    Every frame is checked against its checksum; a file that differs fails the job.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                files, at = opened(uri)
                with files.open_input_file(at) as source:
                    reader, rows = FrameReader(source), []
                    for k, ids in reader.all():
                        rows.append({"doc_id": reader.doc_ids[k], "start": start} | columns(ids))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, to_arrow)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, to_arrow)

    made = manifest.sparkSession.createDataFrame([], f"doc_id long, start long, {schema}").schema
    to_arrow = to_arrow_schema(made)
    # A number of partitions that adaptive execution leaves as it is: the rows are few, what they name is not.
    files = manifest.sparkSession.sparkContext.defaultParallelism * 4
    return manifest.select("uri", "start", "part").repartition(files, "part").mapInArrow(read, made)


def digest(ids: np.ndarray) -> dict:
    return {"n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


def token_digests(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Writes the token files of docs, reads them back, and returns doc_id, start, n_tokens, ids_crc32."""
    manifest = write_tokens(docs, new_folder(spark, "tokens"), path)
    return read_tokens(manifest, digest, "n_tokens long, ids_crc32 long")
