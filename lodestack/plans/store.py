"""Indexes and the registry on disk.

    <root>/<index name>/...    the tables of an index, in versions (see tables)
    <root>/current    the index that serves
    <root>/registry/...    the registry's tables, in the same way
    <root>/text/...    full-text segments of the registry's texts

The root must be a folder that driver and executors share.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ChunkerChangedError, HeaderMismatchError, NoIndexError, ProvenanceError, ProviderRetiredError
from ..functions.naming import IndexIdentity, now_text, parse_file_name
from ..operators.fulltext import TextIndex
from ..operators.textstore import TextStore
from ..operators.merge import upsert
from ..rules import allowed_path, checked
from ..schema import CHUNKER_VERSION, INDEX_TABLES, INDEX_VERSION, REGISTRY_TABLES, SCHEMAS
from .tables import Snapshot, Tables, replace_text


#: Seconds that a writer of the registry waits for another.
REGISTRY_WAIT_S = 120.0


class Index(Tables):
    def __init__(self, spark: SparkSession, root: str | Path, identity: IndexIdentity) -> None:
        super().__init__(spark, Path(root) / identity.index_name, INDEX_TABLES)
        self.identity = identity

    def header(self) -> dict | None:
        row = self.read("index_meta").first()
        return row.asDict() if row else None

    def open(self) -> Index:
        """Stamps a new index with its identity, or refuses one of another identity, version or chunker."""
        held = self.header()
        if held is None:
            row = (1, self.identity.provider_id, self.identity.model, self.identity.dims, INDEX_VERSION, CHUNKER_VERSION, now_text())
            meta = self.spark.createDataFrame([row], SCHEMAS["index_meta"])
            self.at.mkdir(parents=True, exist_ok=True)
            self.commit(index_meta=checked("index_meta", meta))
            return self
        offered = (self.identity.provider_id, self.identity.dims)
        if (held["provider_id"], held["dims"]) != offered:
            raise ProvenanceError(f"{held['provider_id']} ({held['dims']}d)", str(self.identity))
        if (held["index_version"], held["chunker_version"]) != (INDEX_VERSION, CHUNKER_VERSION):
            raise ChunkerChangedError(f"made by {held['chunker_version']}, version {held['index_version']}; rebuild it")
        return self


class Store:
    """The indexes below a root, the current one, and the registry."""

    def __init__(self, spark: SparkSession, root: str | Path, registry: str | Path | None = None) -> None:
        at = Path(registry) if registry else Path(root) / "registry"
        allowed_path(str(Path(root).absolute()))
        allowed_path(str(at.absolute()))
        self.spark, self.root = spark, Path(root)
        self.registry = Tables(spark, at, REGISTRY_TABLES)

    def index(self, identity: IndexIdentity) -> Index:
        return Index(self.spark, self.root, identity)

    def list(self) -> list[IndexIdentity]:
        if not self.root.is_dir():
            return []
        found = (parse_file_name(f"{p.name}.db") for p in self.root.iterdir() if p.is_dir())
        return sorted((x for x in found if x), key=lambda x: x.index_name)

    def current(self) -> IndexIdentity:
        pointer = self.root / "current"
        identity = parse_file_name(f"{pointer.read_text()}.db") if pointer.exists() else None
        if identity is None or not self.index(identity).version:
            raise NoIndexError("no current index")
        return identity

    def current_or(self, other: IndexIdentity) -> IndexIdentity:
        """The current index, or the other if there is none."""
        try:
            return self.current()
        except NoIndexError:
            return other

    def switch(self, name: str) -> IndexIdentity:
        """Makes an index of this root the current one; paths to elsewhere are refused."""
        identity = parse_file_name(name if name.endswith(".db") else f"{name}.db")
        if identity is None or not self.index(identity).version:
            raise NoIndexError(name)
        replace_text(self.root / "current", identity.index_name)
        return identity

    def verify(self, identity: IndexIdentity) -> Index:
        """The index, if its header is what its name says, and the registry's current row too if there is one."""
        index = self.index(identity)
        held = index.header()
        if held is None:
            raise NoIndexError(identity.index_name)
        found = IndexIdentity(held["provider_id"].split("/", 1)[0], held["model"], held["dims"])
        if found.index_name != index.at.name:
            raise HeaderMismatchError(f"{index.at.name} holds {found}")
        row = self.registry.read("index_registry").where("is_current").first()
        if row and row["index_name"] == index.at.name and row["provider_id"] != held["provider_id"]:
            raise HeaderMismatchError(f"registry has {row['provider_id']}, index {held['provider_id']}")
        return index

    def provider(self, identity: IndexIdentity, kind: str = "local-ollama") -> DataFrame:
        """The providers with this one; refused if it has other dimensions or is retired; a degraded one warns."""
        known = self.registry.read("embedding_providers")
        row = known.where(F.col("provider_id") == identity.provider_id).first()
        if row is None:
            new = {"provider_id": identity.provider_id, "kind": kind, "model": identity.model, "dims": identity.dims}
            new |= {"quality_tier": 1, "fallback_allowed": False, "status": "active"}
            row = tuple(new.get(n) for n in SCHEMAS["embedding_providers"].names)
            return upsert(known, self.spark.createDataFrame([row], SCHEMAS["embedding_providers"]), "provider_id")
        if row["dims"] != identity.dims:
            raise ProvenanceError(f"{identity.provider_id} ({row['dims']}d)", str(identity))
        if row["status"] == "retired":
            raise ProviderRetiredError(identity.provider_id)
        if row["status"] == "degraded":
            warnings.warn(f"{identity.provider_id} is degraded", stacklevel=2)
        return known

    @contextmanager
    def changing(self) -> Iterator[Tables]:
        """The registry, for reading, changing and committing it as one step; other writers wait."""
        with self.registry.lock(REGISTRY_WAIT_S):
            yield self.registry

    def texts(self, registry: Snapshot | None = None) -> TextIndex:
        """The full-text index of the registry's texts as they are in this version of it, brought up to date if need be.

        What changed since the last search makes a segment of its own; rows that are gone are marked.
        """
        registry = registry or self.registry.snapshot()
        version = str(registry.tables.get("work_text_fts", "empty"))
        texts = TextStore(self.spark, (self.root / "text").absolute().as_uri(), log=self.root / "text" / "LOG")
        with Tables(self.spark, self.root / "text", ()).lock(REGISTRY_WAIT_S):
            return texts.refresh(registry.read("work_text_fts"), version)

    def set_current(self, identity: IndexIdentity, doc_count: int, chunk_count: int) -> None:
        """Registers the index as the only current one, then moves the pointer."""
        with self.changing():
            self._set_current(identity, doc_count, chunk_count)

    def _set_current(self, identity: IndexIdentity, doc_count: int, chunk_count: int) -> None:
        rows = self.registry.read("index_registry").withColumn("is_current", F.lit(False))
        name = identity.index_name
        at = str(self.index(identity).at.absolute())
        new = [(name, identity.provider_id, at, INDEX_VERSION, True, doc_count, chunk_count, now_text(), None)]
        rows = upsert(rows, self.spark.createDataFrame(new, SCHEMAS["index_registry"]), "index_name")
        self.registry.commit(embedding_providers=self.provider(identity), index_registry=checked("index_registry", rows))
        replace_text(self.root / "current", name)
