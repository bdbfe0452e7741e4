"""A full-text index that follows a table: each refresh adds a segment of what is new and marks what is gone.

Rows have no key of their own here: a row is the digest of its columns, and a table a multiset of digests. Digests whose
number of rows differs between index and table have changed; their rows in the index are marked as gone, and those of
the table come as a new segment. What is the same is neither read a second time nor written. Marks and segments beyond a
bound are merged by writing one segment anew.
"""

from __future__ import annotations

import json
import shutil
import time
import uuid
from dataclasses import asdict, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StaleIndexError
from ..functions.marks import marked
from ..plans.tables import MOST_GONE, replace_text
from .fulltext import EVERY_ROW, Segment, TextIndex, write_segment

#: Segments and files of marks beyond which a refresh writes one segment anew.
MOST_SEGMENTS = 16
#: Seconds for which searches that have begun keep what a refresh has replaced.
KEPT_S = 3600.0


def table_state(path: str, spark: SparkSession) -> str:
    """What the files of a Parquet table are like now: a digest of their paths, sizes and times."""
    about = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = about.agg(F.count("*"), F.bit_xor(F.xxhash64(*about.columns))).first()
    return f"{row[0]}-{row[1]}"


class TextStore:
    """An index in the folder `at` (a path for Spark). With a log, a local file, it outlasts the session."""

    def __init__(self, spark: SparkSession, at: str, columns: tuple[str, ...] = ("title", "body"), stem: bool = True, log: Path | None = None) -> None:
        self.spark, self.at, self.log = spark, at, log
        self.now, self.source = TextIndex(spark, (), columns, stem), ""
        self.replaced: dict[str, float] = {}
        if log and log.exists():
            held = json.loads(log.read_text())
            self.source, self.replaced = held["source"], held["replaced"]
            self.now = replace(
                self.now, segments=tuple(Segment(**s) for s in held["segments"]), gone=tuple(held["gone"]), gone_rows=held["gone_rows"], gone_tokens=held["gone_tokens"]
            )

    def index(self, source: str) -> TextIndex:
        """The index, if it is that of this state of its table."""
        if source != self.source:
            raise StaleIndexError(f"the index is of {self.source or 'nothing'}, the table is {source}: refresh it")
        return self.now

    def refresh(self, rows: DataFrame, source: str) -> TextIndex:
        """The index of these rows; source names their state. One refresh at a time.

        rows with null texts have no tokens, repeated rows are found as often as they are there.
        """
        if source == self.source:
            return self.now
        rows = rows.withColumn("_digest", F.sha2(F.to_json(F.struct(*rows.columns)), 256))
        now = self.changed(rows) if self.now.segments else replace(self.now, segments=self.written(rows, 0))
        many = len(now.segments) > MOST_SEGMENTS or len(now.gone) > MOST_SEGMENTS
        if many or now.gone_rows > MOST_GONE * sum(s.rows for s in now.segments):
            now = replace(now, segments=self.written(rows, 0), gone=(), gone_rows=0, gone_tokens=0)
        used, before = ({*(s.at for s in x.segments), *x.gone} for x in (now, self.now))
        self.replaced |= dict.fromkeys(before - used, time.time())
        self.now, self.source = now, source
        self.save()
        return now

    def written(self, rows: DataFrame, number: int) -> tuple[Segment, ...]:
        return (write_segment(rows, f"{self.at}/segment-{uuid.uuid4().hex}", self.now.columns, self.now.stem, number),)

    def changed(self, rows: DataFrame) -> TextIndex:
        now, made = self.now, f"{self.at}/change-{uuid.uuid4().hex}"
        count = lambda df, name: df.groupBy("_digest").agg(F.count("*").alias(name))
        both = count(now.held, "old").join(count(rows, "new"), "_digest", "full_outer")
        both.where(~F.col("old").eqNullSafe(F.col("new"))).write.parquet(f"{made}/digests")
        differs = self.spark.read.schema("_digest string, old long, new long").parquet(f"{made}/digests")
        lost = differs.where("old is not null").select("_digest")
        if not lost.isEmpty():
            dead = now.held.join(lost, "_digest", "left_semi").select("row_id")
            marked(dead, F.col("row_id")).write.parquet(f"{made}/gone")
            marks = self.spark.read.schema("word long, bits long").parquet(f"{made}/gone")
            dead_rows = marks.agg(F.sum(F.bit_count("bits"))).first()[0]
            tokens = now.postings_of([EVERY_ROW]).join(dead, "row_id", "left_semi").agg(F.sum("length")).first()[0]
            now = replace(now, gone=(*now.gone, f"{made}/gone"), gone_rows=now.gone_rows + dead_rows, gone_tokens=now.gone_tokens + tokens)
        if not differs.where("new is not null").isEmpty():
            fresh = rows.join(differs.where("new is not null").select("_digest"), "_digest", "left_semi")
            number = max(s.number for s in now.segments) + 1
            now = replace(now, segments=(*now.segments, *self.written(fresh.select(rows.columns), number)))
        return now

    def save(self) -> None:
        """Keeps the log, and removes what was replaced long enough ago."""
        if not self.log:
            return
        old = [p for p, t in self.replaced.items() if time.time() - t > KEPT_S]
        self.replaced = {p: t for p, t in self.replaced.items() if p not in old}
        self.log.parent.mkdir(parents=True, exist_ok=True)
        held = {"source": self.source, "segments": [asdict(s) for s in self.now.segments], "replaced": self.replaced}
        held |= {"gone": self.now.gone, "gone_rows": self.now.gone_rows, "gone_tokens": self.now.gone_tokens}
        replace_text(self.log, json.dumps(held))
        for path in old:
            shutil.rmtree(self.log.parent / Path(path).relative_to(self.at) if path.startswith(self.at) else path, ignore_errors=True)
