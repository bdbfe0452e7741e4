"""Tables on disk in versions: immutable Parquet parts, marks of deleted rows, and one small file that says what counts.

    <at>/parts/<table>-<version>-<commit>    rows that a commit has added
    <at>/parts/<table>-<version>-<commit>-gone    marks of rows that a commit has deleted
    <at>/VERSION    the version, what each table is made of, and when parts were replaced
    <at>/pins/<reader>    what a reader with a pin still needs
    <at>/LOCK    held by the only writer

A commit either replaces a table or changes it: new rows are a new part, and deleted rows are marked, 64 rows a number,
by their file and place in it; nothing else is written. Where marks or parts become many, a commit compacts the table.
A reader takes a snapshot, which is one version of all tables. The folder must be one that driver and executors share.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LockedError
from ..functions.marks import marked, unmarked
from ..schema import SCHEMAS, schema_of

#: Parts of a table, and the share of deleted rows, beyond which a commit writes the table anew.
MOST_PARTS, MOST_GONE = 16, 1 / 3
#: Seconds after which a pin no longer counts: its reader has ended without taking it back.
PIN_S = 24 * 3600.0

MARKS = schema_of("file string, word long, bits long")


def replace_text(path: Path, text: str) -> None:
    """Writes a small file so that readers see the old or the new text."""
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    part.write_text(text)
    os.replace(part, path)


@dataclass(frozen=True)
class Change:
    """What a commit does to a table: rows whose columns equal a row of `delete` go, those of `add` come."""

    add: DataFrame | None = None
    delete: DataFrame | None = None


@dataclass(frozen=True)
class Made:
    """What a table is made of."""

    parts: tuple[str, ...] = ()
    gone: tuple[str, ...] = ()  # parts with marks
    gone_rows: int = 0

    @staticmethod
    def of(held: str | dict) -> Made:
        return Made((held,)) if isinstance(held, str) else Made(tuple(held["parts"]), tuple(held["gone"]), held["gone_rows"])


@dataclass(frozen=True)
class Snapshot:
    """One version of all tables; later commits don't change it. See Tables.pinned for readers that take long."""

    spark: SparkSession
    at: Path
    version: int
    tables: dict[str, Made] = field(default_factory=dict)

    def paths(self, parts: tuple[str, ...]) -> list[str]:
        return [(self.at / "parts" / p).absolute().as_uri() for p in parts]

    def places(self, name: str) -> DataFrame:
        """The table's rows with the file that holds each, and their number in it."""
        made = self.tables[name]
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(*self.paths(made.parts))
        rows = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("_row"))
        if not made.gone:
            return rows
        marks = self.spark.read.schema(MARKS).parquet(*self.paths(made.gone))
        kept = rows.withColumn("_file", F.col("file"))
        return unmarked(kept, F.col("_row"), marks, made.gone_rows, "file").withColumnRenamed("_file", "file")

    def read(self, name: str) -> DataFrame:
        made = self.tables.get(name, Made())
        if not made.parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        if made.gone:
            return self.places(name).select(SCHEMAS[name].names)
        return self.spark.read.schema(SCHEMAS[name]).parquet(*self.paths(made.parts))


class Tables:
    """Named tables in versions; a commit writes the next version and moves the pointer."""

    def __init__(self, spark: SparkSession, at: str | Path, names: tuple[str, ...]) -> None:
        self.spark, self.at, self.names = spark, Path(at), names

    def held(self) -> dict:
        """What the pointer says; one read of one small file."""
        pointer = self.at / "VERSION"
        return json.loads(pointer.read_text()) if pointer.exists() else {"version": 0, "parts": {}}

    def state(self) -> tuple[int, dict[str, Made]]:
        held = self.held()
        return held["version"], {name: Made.of(x) for name, x in held["parts"].items()}

    @property
    def version(self) -> int:
        return self.state()[0]

    def snapshot(self) -> Snapshot:
        return Snapshot(self.spark, self.at, *self.state())

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    # ------------------------------------------------------------ commits

    def write(self, rows: DataFrame, part: str) -> None:
        rows.write.parquet((self.at / "parts" / part).absolute().as_uri())

    def replaced(self, name: str, version: int, rows: DataFrame) -> Made:
        part = f"{name}-{version}-{uuid.uuid4().hex}"
        self.write(rows.select(SCHEMAS[name].names), part)
        return Made((part,))

    def changed(self, name: str, version: int, snapshot: Snapshot, change: Change) -> Made:
        made, part = snapshot.tables.get(name, Made()), f"{name}-{version}-{uuid.uuid4().hex}"
        parts, gone, gone_rows = made.parts, made.gone, made.gone_rows
        if change.delete is not None and parts:
            keys = change.delete.distinct()
            rows = snapshot.places(name).select("file", "_row", *keys.columns)
            same = [rows[c].eqNullSafe(keys[c]) for c in keys.columns]
            self.write(marked(rows.join(keys, same, "left_semi"), F.col("_row"), "file").select(MARKS.names), f"{part}-gone")
            marks = self.spark.read.schema(MARKS).parquet(*snapshot.paths((f"{part}-gone",)))
            count = marks.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))).first()[0]
            if count:
                gone, gone_rows = (*gone, f"{part}-gone"), gone_rows + count
        if change.add is not None:
            self.write(change.add.select(SCHEMAS[name].names), part)
            if not self.spark.read.schema(SCHEMAS[name]).parquet(*snapshot.paths((part,))).isEmpty():
                parts = (*parts, part)
        now = Snapshot(self.spark, self.at, version, {name: Made(parts, gone, gone_rows)})
        many = len(parts) > MOST_PARTS or len(gone) > MOST_PARTS
        if many or gone and gone_rows > MOST_GONE * self.spark.read.schema(SCHEMAS[name]).parquet(*now.paths(parts)).count():
            whole = self.replaced(name, version, now.read(name))
            for own in (part, f"{part}-gone"):  # no version has had them
                shutil.rmtree(self.at / "parts" / own, ignore_errors=True)
            return whole
        return now.tables[name]

    def commit(self, **tables: DataFrame | Change) -> int:
        """The next version has these tables, replaced or changed, and the others as they are. One writer at a time: see lock."""
        held, snapshot = self.held(), self.snapshot()
        version, parts = snapshot.version + 1, dict(snapshot.tables)
        for name, rows in tables.items():
            parts[name] = self.changed(name, version, snapshot, rows) if isinstance(rows, Change) else self.replaced(name, version, rows)
        used = {p for made in parts.values() for p in (*made.parts, *made.gone)}
        before = {p for made in snapshot.tables.values() for p in (*made.parts, *made.gone)}
        gone = held.get("replaced", {}) | {p: time.time() for p in before - used}
        text = {"version": version, "parts": {n: m.__dict__ for n, m in parts.items()}, "replaced": gone}
        replace_text(self.at / "VERSION", json.dumps(text))
        return version

    # ------------------------------------------------------------ readers that take long, and what they no longer need

    @contextmanager
    def pinned(self) -> Iterator[Snapshot]:
        """A snapshot whose parts stay until the block ends, whatever is committed and vacuumed meanwhile."""
        pin = self.at / "pins" / uuid.uuid4().hex
        pin.parent.mkdir(parents=True, exist_ok=True)
        while True:
            snapshot = self.snapshot()
            replace_text(pin, json.dumps([p for m in snapshot.tables.values() for p in (*m.parts, *m.gone)]))
            if self.version == snapshot.version:  # else a vacuum may have come before the pin
                break
        try:
            yield snapshot
        finally:
            pin.unlink(missing_ok=True)

    def pins(self) -> set[str]:
        folder, out = self.at / "pins", set()
        for pin in folder.iterdir() if folder.is_dir() else ():
            try:
                if not pin.name.startswith(".") and time.time() - pin.stat().st_mtime < PIN_S:
                    out |= set(json.loads(pin.read_text()))
            except FileNotFoundError:  # its reader has just ended
                pass
        return out

    def vacuum(self, older_s: float = 3600.0) -> int:
        """Removes parts that a commit replaced more than so many seconds ago and that no pin holds; returns their number.

        What no version ever had is left of a commit that failed, and goes so many seconds after it was written. Call it
        under the lock.
        """
        held, pins, gone = self.held(), self.pins(), []
        used = {p for made in self.state()[1].values() for p in (*made.parts, *made.gone)} | pins
        replaced = held.get("replaced", {})
        for part in (self.at / "parts").iterdir() if (self.at / "parts").is_dir() else ():
            since = replaced.get(part.name, part.stat().st_mtime)
            if part.name not in used and time.time() - since > older_s:
                shutil.rmtree(part, ignore_errors=True)
                gone.append(part.name)
        if gone and held["version"]:
            replace_text(self.at / "VERSION", json.dumps(held | {"replaced": {p: t for p, t in replaced.items() if p not in gone}}))
        return len(gone)

    @contextmanager
    def lock(self, wait_s: float = 0.0) -> Iterator[None]:
        """Only one writer; others wait so many seconds. The kernel frees the lock when its process ends."""
        self.at.mkdir(parents=True, exist_ok=True)
        until = time.monotonic() + wait_s
        with open(self.at / "LOCK", "a+") as file:
            while True:
                try:
                    fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except OSError:
                    if time.monotonic() >= until:
                        file.seek(0)
                        raise LockedError(f"{self.at} is held by process {file.read() or 'unknown'}") from None
                    time.sleep(0.05)
            file.truncate(0)
            file.write(str(os.getpid()))
            file.flush()
            yield
