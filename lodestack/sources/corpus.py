"""A directory of text files as a DataFrame, and its frozen, hash-verified list (the manifest)."""

from __future__ import annotations

import codecs
import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NoRootError
from ..rules import allowed_path
from ..schema import SCHEMAS
from ..session import checkpoint_dir

# Extensions of files that hold no text.
BINARY_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "webp", "bmp", "ico", "mp3", "wav", "mp4", "avi", "mov",
    "webm", "pdf", "zip", "gz", "tar", "bz2", "7z", "exe", "dll", "so", "dylib", "o", "a",
    "class", "jar", "wasm", "db", "sqlite", "bin",
]
READ_BYTES = 64 << 10
#: Of a file that is cut, read at a time; a worker holds about so many characters of passages, too.
TEXT_BYTES = 1 << 20
#: Rows of passages and files at which a worker passes them on.
CUT_ROWS = 4096


@dataclass(frozen=True)
class Snapshot:
    root: str
    path: str
    hash: str
    entries: DataFrame


def listed(spark: SparkSession, root: str) -> DataFrame:
    """rel_path of each regular file below root, with slashes; links aren't followed; what can't be read, and names that aren't UTF-8, are left out.

    Folders are listed by the executors, a level of the tree a job, so the driver holds no names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("rel_path").to_pylist():
                names, kinds = [], []
                try:
                    for entry in os.scandir(os.path.join(root, folder)):
                        if not entry.name.isprintable() and any("\ud800" <= c <= "\udfff" for c in entry.name):
                            continue  # bytes that aren't UTF-8
                        if entry.is_dir(follow_symlinks=False) or entry.is_file(follow_symlinks=False):
                            names.append(f"{folder}/{entry.name}" if folder else entry.name)
                            kinds.append(entry.is_dir(follow_symlinks=False))
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.bool_())], ["rel_path", "folder"])

    checkpoint_dir(spark)
    folders, found = spark.createDataFrame([("",)], "rel_path string"), spark.createDataFrame([], "rel_path string")
    while not folders.isEmpty():
        level = folders.repartition("rel_path").mapInArrow(run, "rel_path string, folder boolean").checkpoint()
        found = found.union(level.where("not folder").select("rel_path"))
        folders = level.where("folder").select("rel_path")
    return found


def text_paths(paths: DataFrame, include: str | None = None, legacy: str | None = None) -> DataFrame:
    """Of rel_path those that may be text: no hidden component, no binary extension, and include found in it.

    legacy is the root if the older rules hold: a name is hidden if the full path has "/." anywhere, and include is
    looked for in the full path.
    """
    extension = F.lower(F.regexp_extract("rel_path", r"\.([^./]*)$", 1))
    full = F.concat(F.lit(f"{legacy.rstrip('/')}/"), F.col("rel_path")) if legacy is not None else F.col("rel_path")
    hidden = full.contains("/.") if legacy is not None else full.rlike(r"(^|/)\.")
    kept = paths.where(~hidden & ~extension.isin(BINARY_EXTENSIONS))
    return kept.where(full.rlike(include)) if include else kept


def path_order(legacy: bool = False) -> Column:
    """Byte order of the paths; the older order compares them component by component."""
    return F.split("rel_path", "/") if legacy else F.col("rel_path")


def file_paths(spark: SparkSession, root: str, include: str | None = None, legacy: bool = False) -> DataFrame:
    """rel_path of each file below root that may be text."""
    if not os.path.isdir(root):
        raise NoRootError(root)
    return text_paths(listed(spark, root), include, os.path.abspath(root) if legacy else None)


def hashed(path: str) -> tuple[int, int, str] | None:
    """mtime in ns, size and SHA-256 of a file; None if it can't be read."""
    digest = hashlib.sha256()
    try:
        stat = os.stat(path)
        with open(path, "rb") as file:
            while part := file.read(READ_BYTES):
                digest.update(part)
    except OSError:
        return None
    return stat.st_mtime_ns, stat.st_size, digest.hexdigest()


def entries(paths: DataFrame, root: str) -> DataFrame:
    """rel_path, mtime_ns, size, sha256 of the paths; unreadable files are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("rel_path").to_pylist()
            found = [(n, *h) for n in names if (h := hashed(os.path.join(root, n)))]
            yield pa.RecordBatch.from_pylist([dict(zip(SCHEMAS["manifest"].names, x, strict=True)) for x in found], ENTRY)

    return spread(paths).mapInArrow(run, SCHEMAS["manifest"])


def spread(paths: DataFrame) -> DataFrame:
    """Rows dealt out by rel_path: by a number of tasks, as adaptive execution would go by the bytes of paths, not of files."""
    return paths.repartition(4 * paths.sparkSession.sparkContext.defaultParallelism, "rel_path")


ENTRY = pa.schema([("rel_path", pa.string()), ("mtime_ns", pa.int64()), ("size", pa.int64()), ("sha256", pa.string())])


def freeze(spark: SparkSession, root: str, manifest_dir: str, run: str, include: str | None = None, legacy: bool = False) -> Snapshot:
    """Lists and hashes the corpus and writes <run>.manifest.jsonl, in order of the paths, a batch of lines at a time."""
    allowed_path(os.path.abspath(manifest_dir))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = "".join(json.dumps(e, ensure_ascii=False, separators=(",", ":")) + "\n" for e in batch.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([text])], ["lines"])

    # Stored, as sorting looks at its rows twice and would have the files read twice.
    found = entries(file_paths(spark, root, include, legacy), root).checkpoint().orderBy(path_order(legacy))
    os.makedirs(manifest_dir, exist_ok=True)
    path = os.path.join(manifest_dir, f"{run}.manifest.jsonl")
    with open(path, "w", encoding="utf-8") as out:  # one small file, for its hash
        for row in found.mapInArrow(lines, "lines string").toLocalIterator(prefetchPartitions=True):
            out.write(row["lines"])
    return load_manifest(spark, path, root)


def load_manifest(spark: SparkSession, path: str, root: str = "") -> Snapshot:
    with open(path, "rb") as file:
        digest = hashlib.file_digest(file, "sha256").hexdigest()
    rows = spark.read.schema(SCHEMAS["manifest"]).json(Path(path).absolute().as_uri()).where("rel_path is not null")
    return Snapshot(root, path, digest, rows)


def unchanged(snapshot: Snapshot, strong: bool = False) -> DataFrame:
    """rel_path and matches: whether size and time, or for strong the hash, are still the manifest's; missing files don't match."""
    root = snapshot.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                full = os.path.join(root, e["rel_path"])
                if strong:
                    now = hashed(full)
                    out.append(now is not None and now[2] == e["sha256"])
                else:
                    try:
                        stat = os.stat(full)
                        out.append((stat.st_mtime_ns, stat.st_size) == (e["mtime_ns"], e["size"]))
                    except OSError:
                        out.append(False)
            yield pa.RecordBatch.from_arrays([batch.column("rel_path"), pa.array(out, pa.bool_())], ["rel_path", "matches"])

    return snapshot.entries.mapInArrow(run, "rel_path string, matches boolean")


def contents(entries: DataFrame, root: str, strict: bool = False) -> DataFrame:
    """entries with state and text: ok, deferred (time or size differ, or missing) or stale (another hash).

    Bytes that aren't UTF-8 are replaced, or, if strict, make the file invalid, which leaves what is known of it as it is.

    The hash is of the bytes that the text comes from, so nothing changed is ever passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e in batch.to_pylist():
                state, text = "ok", None
                try:
                    full = os.path.join(root, e["rel_path"])
                    stat = os.stat(full)
                    if (stat.st_mtime_ns, stat.st_size) != (e["mtime_ns"], e["size"]):
                        state = "deferred"
                    else:
                        with open(full, "rb") as file:
                            data = file.read()
                        if hashlib.sha256(data).hexdigest() == e["sha256"]:
                            text = data.decode("utf-8", "strict" if strict else "replace")
                        else:
                            state = "stale"
                except UnicodeDecodeError:
                    state = "invalid"
                except OSError:
                    state = "deferred"
                yield pa.RecordBatch.from_pylist([e | {"state": state, "text": text}], TEXT)

    return entries.select(*SCHEMAS["manifest"].names).mapInArrow(run, "rel_path string, mtime_ns long, size long, sha256 string, state string, text string")


TEXT = ENTRY.append(pa.field("state", pa.string())).append(pa.field("text", pa.string()))


def text_parts(path: str, digest, strict: bool) -> Iterator[str]:
    """The text of a file in parts; digest takes the bytes that they come from."""
    decoder = codecs.getincrementaldecoder("utf-8")("strict" if strict else "replace")
    with open(path, "rb") as file:
        while data := file.read(TEXT_BYTES):
            digest.update(data)
            yield decoder.decode(data)
        yield decoder.decode(b"", final=True)


def cut_files(entries: DataFrame, root: str, cut: Callable[[Iterator[str]], Iterator[tuple[int, int, int, str]]], strict: bool = False) -> DataFrame:
    """What contents() followed by a cut gives, with a part of a file in memory: a row a passage (state is null), then one
    for the file itself, with its state and no passage.

    A file is hashed as it is cut, so its state is known after its passages: those of a file that isn't ok are not to be
    used (see verified_passages).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0  # of several files, so that small ones share a batch
        for batch in batches:
            for e in batch.to_pylist():
                state = "ok"
                try:
                    full = os.path.join(root, e["rel_path"])
                    stat = os.stat(full)
                    if (stat.st_mtime_ns, stat.st_size) != (e["mtime_ns"], e["size"]):
                        state = "deferred"
                    else:
                        digest = hashlib.sha256()
                        for seq, start, end, text in cut(text_parts(full, digest, strict)):
                            found.append(e | {"seq": seq, "start_offset": start, "end_offset": end, "text": text})
                            held += len(text)
                            if held >= TEXT_BYTES:
                                yield pa.RecordBatch.from_pylist(found, CUT)
                                found, held = [], 0
                        if digest.hexdigest() != e["sha256"]:
                            state = "stale"
                except UnicodeDecodeError:
                    state = "invalid"
                except OSError:
                    state = "deferred"
                found.append(e | {"state": state})
                if len(found) >= CUT_ROWS:
                    yield pa.RecordBatch.from_pylist(found, CUT)
                    found, held = [], 0
        yield pa.RecordBatch.from_pylist(found, CUT)

    columns = "rel_path string, mtime_ns long, size long, sha256 string, state string, seq long, start_offset long, end_offset long, text string"
    return entries.select(*SCHEMAS["manifest"].names).mapInArrow(run, columns)


def verified_passages(cut: DataFrame) -> DataFrame:
    """rel_path, seq, start_offset, end_offset, text of cut_files' files that are ok; cut should be a stored table. Only where
    a file is not ok is there a join."""
    found = cut.where("state is null").select("rel_path", "seq", "start_offset", "end_offset", "text")
    bad = cut.where("state <> 'ok'").select("rel_path")
    return found if bad.isEmpty() else found.join(bad, "rel_path", "left_anti")


CUT = pa.schema([*TEXT.remove(TEXT.get_field_index("text")), *(pa.field(n, pa.int64()) for n in ("seq", "start_offset", "end_offset")), pa.field("text", pa.string())])
