"""A directory of text files as a Spark data source: spark.read.format("corpus"), and a stream whose offset is a path.

    register_corpus(spark)
    spark.read.format("corpus").option("root", "/data/notes").load().where("rel_path like 'a/%' and size < 1000")
    spark.readStream.format("corpus").option("root", "/data/notes").option("cursor", "/shared/cursor").load()

Rows are the manifest's: rel_path, mtime_ns, size, sha256. A schema of fewer of these columns may be given; without
sha256 no file is opened. Options:

root            the folder, which driver and executors share; one that isn't there is an error.
include         a pattern (Python's re) that a path must hold; legacy: the older rules, as in corpus.text_paths.
partitionbytes  a partition is a range of paths with about so many bytes, a file counting openbytes more.
cursor          stream only: a file that keeps the end of the last planned batch. With it, a batch takes about batchbytes of
                files' own bytes, and 100,000 files at most; without it a batch takes all that is there, so that a restarted
                stream never steps back.

The planner walks the tree in the order of paths, once; a stream's planner goes on where its last batch ended, and walks
anew from there only if a folder that it is in has changed since it was listed. A task gets the names of its files,
compressed, and lists no folder, so a large folder costs no more a file than a small one. Filters on rel_path narrow the walk,
those on size and mtime_ns spare the reading; register_corpus sets spark.sql.python.filterPushdown.enabled, without which
Spark refuses a source that takes filters.

Links aren't followed; files and folders that can't be read, and names that aren't UTF-8, are left out. An empty tree
has no rows. A stream sees files after its offset only: a file that appears before it is for a new stream.
"""

from __future__ import annotations

import os
import re
import stat
import time
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from ..errors import NoRootError
from ..schema import SCHEMAS
from .corpus import BINARY_EXTENSIONS, ENTRY, hashed

PARTITION_BYTES = 128 << 20
OPEN_BYTES = 64 << 10
BATCH_BYTES = 1 << 30
#: Files of a batch of a stream with a cursor, at most.
BATCH_FILES = 100_000
#: Folders that are listed ahead of the walk, fewer if they hold so many names.
AHEAD, AHEAD_NAMES = 16, 50_000
#: A folder changed less than this before it was listed may change again without another time.
RACY_NS = 2 * 10**9
ROWS = 1024


@dataclass(frozen=True)
class Rules:
    """Which files of root belong to the corpus."""

    root: str
    include: str | None = None
    legacy: bool = False

    def visible(self, name: str) -> bool:
        return not name.startswith(".")

    def text(self, path: str) -> bool:
        extension = re.search(r"\.([^./]*)\Z", path)
        if extension and extension[1].lower() in BINARY_EXTENSIONS:
            return False
        full = f"{os.path.abspath(self.root).rstrip('/')}/{path}" if self.legacy else path
        return not self.include or re.search(self.include, full) is not None

    def hides_all(self) -> bool:
        """By the older rule a dot after a slash anywhere in the full path hides."""
        return self.legacy and "/." in os.path.abspath(self.root)


@dataclass(frozen=True)
class Span:
    """Paths above `after`, up to `upto` (None: to the end)."""

    after: str = ""
    upto: str | None = None

    def past(self, path: str) -> bool:
        return self.upto is not None and path > self.upto

    def meets(self, folder: str) -> bool:
        """Whether paths that start with folder, which ends in a slash, may lie in the span."""
        return not self.past(folder) and (folder > self.after or self.after.startswith(folder))


def folder_time(rules: Rules, folder: str) -> int | None:
    try:
        return os.stat(os.path.join(rules.root, folder)).st_mtime_ns
    except OSError:
        return None


def scanned(rules: Rules, folder: str) -> list[tuple[str, os.DirEntry]]:
    """Entries of a folder by their paths, those of folders with a slash at the end, in byte order."""
    out = []
    try:
        with os.scandir(os.path.join(rules.root, folder)) as entries:
            for e in entries:
                try:
                    e.name.encode()
                    is_folder = e.is_dir(follow_symlinks=False)
                    if rules.visible(e.name) and (is_folder or e.is_file(follow_symlinks=False)):
                        out.append((f"{folder}{e.name}{'/' if is_folder else ''}", e))
                except (OSError, UnicodeEncodeError):
                    continue
    except OSError:
        return []
    return sorted(out, key=lambda x: x[0])


def walk(rules: Rules, span: Span = Span(), backward: bool = False, held: dict[str, tuple[int | None, int]] | None = None) -> Iterator[tuple[str, os.DirEntry]]:
    """(rel_path, entry) of the corpus's files in the span, in byte order of the paths or backward.

    held gets the folders that are listed and not yet passed, with their times and the time of the listing.
    """
    if rules.hides_all():
        return
    held = {} if held is None else held
    with ThreadPoolExecutor(AHEAD) as pool:

        def listing(folder: str) -> Future:
            held[folder] = folder_time(rules, folder), time.time_ns()
            return pool.submit(scanned, rules, folder)

        def below(folder: str, found: Future) -> Iterator[tuple[str, os.DirEntry]]:
            entries = found.result()
            first = bisect_right(entries, span.after, key=lambda x: x[0])
            # Only the entry before may be a folder that the span begins in.
            first -= bool(first and entries[first - 1][0].endswith("/") and span.meets(entries[first - 1][0]))
            entries = entries[first : None if span.upto is None else bisect_right(entries, span.upto, key=lambda x: x[0])]
            if backward:
                entries.reverse()
            folders = iter([p for p, _ in entries if p.endswith("/")])
            listed: dict[str, Future] = {}

            def more() -> None:
                while len(listed) < AHEAD and sum(len(f.result()) for f in listed.values() if f.done()) < AHEAD_NAMES and (p := next(folders, None)) is not None:
                    listed[p] = listing(p)

            more()
            for path, entry in entries:
                if path.endswith("/"):
                    if path not in listed:
                        more()
                    yield from below(path, listed.pop(path))
                    more()
                elif rules.text(path):
                    yield path, entry
            held.pop(folder, None)

        yield from below("", listing(""))


@dataclass
class Pushed:
    """Filters that the walk takes over."""

    span: Span = Span()
    paths: list[tuple[str, object]] = field(default_factory=list)
    numbers: list[tuple[str, str, int]] = field(default_factory=list)

    def take(self, f: D.Filter) -> bool:
        """Whether the filter is taken over; what isn't stays with Spark."""
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        value = getattr(f, "value", None)
        if isinstance(f, D.IsNotNull):
            return column in ENTRY.names  # no column of a row is null
        if column == "rel_path" and isinstance(f, (D.EqualTo, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual, D.StringStartsWith)) and isinstance(value, str):
            if isinstance(f, (D.EqualTo, D.LessThan, D.LessThanOrEqual)):
                self.narrow(upto=value)
            if isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual, D.EqualTo, D.StringStartsWith)):
                self.narrow(after=value if isinstance(f, D.GreaterThan) else before(value))
            if isinstance(f, D.StringStartsWith):
                self.narrow(upto=above(value))  # only narrows: the test below decides
            self.paths.append((type(f).__name__, value))
            return True
        if column == "rel_path" and isinstance(f, D.In) and all(isinstance(v, str) for v in f.value):
            self.narrow(after=before(min(f.value, default="")), upto=max(f.value, default=""))
            self.paths.append(("In", frozenset(f.value)))
            return True
        if column == "rel_path" and isinstance(f, (D.StringEndsWith, D.StringContains)):
            self.paths.append((type(f).__name__, value))
            return True
        if column in ("size", "mtime_ns") and isinstance(f, (D.EqualTo, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual)) and isinstance(value, int):
            self.numbers.append((column, type(f).__name__, value))
            return True
        return False

    def narrow(self, after: str | None = None, upto: str | None = None) -> None:
        low = max(self.span.after, after or "")
        high = self.span.upto if upto is None else upto if self.span.upto is None else min(upto, self.span.upto)
        self.span = Span(low, high)

    def within(self, span: Span) -> Span:
        both = Pushed(self.span)
        both.narrow(span.after, span.upto)
        return both.span

    def path(self, path: str) -> bool:
        return all(TESTS[name](path, value) for name, value in self.paths)

    def stat(self, mtime_ns: int, size: int) -> bool:
        found = {"mtime_ns": mtime_ns, "size": size}
        return all(TESTS[name](found[column], value) for column, name, value in self.numbers)


TESTS = {
    "EqualTo": lambda a, b: a == b,
    "GreaterThan": lambda a, b: a > b,
    "GreaterThanOrEqual": lambda a, b: a >= b,
    "LessThan": lambda a, b: a < b,
    "LessThanOrEqual": lambda a, b: a <= b,
    "In": lambda a, b: a in b,
    "StringStartsWith": lambda a, b: a.startswith(b),
    "StringEndsWith": lambda a, b: a.endswith(b),
    "StringContains": lambda a, b: b in a,
}


def before(path: str) -> str:
    """A bound below path and below all that starts with it: path without its last character."""
    return path[:-1]


def above(prefix: str) -> str | None:
    """A bound above all that starts with prefix; None if there is none."""
    kept = prefix.rstrip("\U0010ffff")
    if not kept:
        return None
    following = ord(kept[-1]) + 1
    return kept[:-1] + chr(0xE000 if following == 0xD800 else following)


def sized(rules: Rules, span: Span, pushed: Pushed, held: dict | None = None) -> Iterator[tuple[str, int]]:
    """(rel_path, size) of the files in the span that the filters leave."""
    for path, entry in walk(rules, pushed.within(span), held=held):
        try:
            about = entry.stat(follow_symlinks=False)
        except OSError:
            continue
        if pushed.path(path) and pushed.stat(about.st_mtime_ns, about.st_size):
            yield path, about.st_size


def packed(files: Iterable[tuple[str, int]], size: int, open_bytes: int, most: float = float("inf")) -> Iterator[list[tuple[str, int]]]:
    """The files in runs of about size bytes, a file counting open_bytes more, and of `most` files at most."""
    out, held = [], 0
    for path, length in files:
        out.append((path, length))
        held += length + open_bytes
        if held >= size or len(out) >= most:
            yield out
            out, held = [], 0
    if out:
        yield out


def cuts(rules: Rules, span: Span, pushed: Pushed, size: int, open_bytes: int) -> Iterator[Span]:
    """The span in ranges of about size bytes, in order."""
    after = span.after
    for run in packed(sized(rules, span, pushed), size, open_bytes):
        yield Span(after, run[-1][0])
        after = run[-1][0]


class Part(D.InputPartition):
    """Paths of files, compressed: those of a folder have much in common."""

    def __init__(self, paths: list[str]) -> None:
        self.names = zlib.compress("\0".join(paths).encode(), 1)

    @property
    def paths(self) -> list[str]:
        return [p for p in zlib.decompress(self.names).decode().split("\0") if p]


class Files:
    """What the batch and the stream reader share: planning ranges and reading one."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        if not options.get("root") or not os.path.isdir(options["root"]):
            raise NoRootError(options.get("root"))
        unknown = set(schema.names) - set(ENTRY.names)
        if unknown:
            raise ValueError(f"the corpus source has no columns {sorted(unknown)}")
        self.rules = Rules(options["root"], options.get("include"), options.get("legacy", "false").lower() == "true")
        self.names = schema.names
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))
        self.open_bytes = int(options.get("openbytes", OPEN_BYTES))
        self.pushed = Pushed()

    def parts(self, files: Iterable[tuple[str, int]]) -> list[Part]:
        return [Part([p for p, _ in run]) for run in packed(files, self.size, self.open_bytes)]

    def rows(self, paths: list[str]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([ENTRY.field(n) for n in self.names])
        out: list[dict] = []
        for path in paths:
            try:
                about = os.lstat(os.path.join(self.rules.root, path))
            except OSError:
                continue
            row = {"rel_path": path, "mtime_ns": about.st_mtime_ns, "size": about.st_size}
            if not stat.S_ISREG(about.st_mode) or not self.pushed.stat(about.st_mtime_ns, about.st_size):
                continue
            if "sha256" in self.names:
                found = hashed(os.path.join(self.rules.root, path))
                if found is None or not self.pushed.stat(*found[:2]):
                    continue
                row |= dict(zip(("mtime_ns", "size", "sha256"), found, strict=True))
            out.append({n: row[n] for n in self.names})
            if len(out) == ROWS:
                yield pa.RecordBatch.from_pylist(out, types)
                out = []
        yield pa.RecordBatch.from_pylist(out, types)


class CorpusReader(Files, D.DataSourceReader):
    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if not self.pushed.take(f):
                yield f

    def partitions(self) -> list[Part]:
        return self.parts(sized(self.rules, Span(), self.pushed)) or [Part([])]  # no partition at all would be one with everything

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.rows(partition.paths)


class CorpusStreamReader(Files, D.DataSourceStreamReader):
    """The offset is the last path of a batch; "" is before all."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        super().__init__(options, schema)
        self.cursor = options.get("cursor")
        self.batch = int(options.get("batchbytes", BATCH_BYTES))
        self.ahead: Iterator[list[tuple[str, int]]] = iter(())  # batches of a walk that goes on
        self.held: dict[str, tuple[int | None, int]] = {}  # folders that it is in
        self.end: str | None = None  # where it is
        self.planned: tuple[str, str, list[tuple[str, int]]] | None = None

    def initialOffset(self) -> dict:
        return {"rel_path": ""}

    def at(self) -> str:
        try:
            with open(self.cursor, encoding="utf-8") as file:
                return file.read()
        except FileNotFoundError:
            return ""

    def latestOffset(self) -> dict:
        """The end of the next batch. A batch's end is in Spark's log before partitions() stores it as the cursor, and
        a batch that is run again stores it again, so the cursor is never before, nor behind, what the log holds."""
        if self.cursor:
            at = self.at()
            if self.planned and self.planned[0] == at:
                return {"rel_path": self.planned[1]}
            found = next(self.ahead, None) if self.end == at and self.same_folders() else None
            if not found:
                self.held = {}
                self.ahead = packed(sized(self.rules, Span(at), self.pushed, self.held), self.batch, 0, BATCH_FILES)
                found = next(self.ahead, None)
            self.end = found[-1][0] if found else None
            self.planned = (at, self.end, found) if found else None
            return {"rel_path": self.end if found else at}
        last = next(walk(self.rules, backward=True), None)
        return {"rel_path": last[0] if last else ""}

    def same_folders(self) -> bool:
        """Whether the folders that the walk is in, or has listed ahead, are as they were when it listed them."""
        return all(then is not None and at - then > RACY_NS and folder_time(self.rules, f) == then for f, (then, at) in self.held.items())

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if self.cursor:
            with open(f"{self.cursor}.new", "w", encoding="utf-8") as file:
                file.write(end["rel_path"])
            os.replace(f"{self.cursor}.new", self.cursor)
        span = start["rel_path"], end["rel_path"]
        if self.planned and self.planned[:2] == span:
            return self.parts(self.planned[2])
        return self.parts(sized(self.rules, Span(*span), self.pushed))

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.rows(partition.paths)

    def commit(self, end: dict) -> None:
        pass


class CorpusSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> StructType:
        return SCHEMAS["manifest"]

    def reader(self, schema: StructType) -> CorpusReader:
        return CorpusReader(self.options, schema)

    def streamReader(self, schema: StructType) -> CorpusStreamReader:
        return CorpusStreamReader(self.options, schema)


def register_corpus(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CorpusSource)
