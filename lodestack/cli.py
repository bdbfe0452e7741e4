"""Command line: index, search, status, list, switch, reindex, find, renders, decided."""

from __future__ import annotations

import argparse
import sys

from .errors import EmbeddingError, LodestackError
from .functions.naming import IndexIdentity, expand_home
from .functions.text import head
from .operators import registry
from .plans.find import find, search_index
from .plans.store import Store
from .session import get_spark
from .sources.embedding import HASH_MODEL, Embedder, HashEmbedder, HttpEmbedder
from .streaming.ingest import reindex


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lodestack", description=__doc__)
    p.add_argument("--index-dir", default="~/.lodestack")
    p.add_argument("--registry", help="folder of the registry; without it, registry in the index folder")
    p.add_argument("--gateway", help="URL of the embedding service, which any model but that of hashes of words needs")
    p.add_argument("--provider", default="local")
    p.add_argument("--model", default=HASH_MODEL)
    p.add_argument("--dims", type=int, default=768)
    p.add_argument("--batch-size", type=int, default=32)
    p.add_argument("--chunk-size", type=int, default=2000)
    p.add_argument("--master", default="local[*]")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("index", "reindex"):
        c = commands.add_parser(name)
        c.add_argument("--root", required=True)
        c.add_argument("--force", action="store_true")
        c.add_argument("--include")
        c.add_argument("--trigger", default="manual")
        c.add_argument("--legacy", action="store_true", help="list files by the older rules and order")
    c = commands.add_parser("search")
    c.add_argument("--query", required=True)
    c.add_argument("--limit", type=int, default=10)
    c.add_argument("--threshold", type=float, default=0.0)
    commands.add_parser("status")
    commands.add_parser("list")
    commands.add_parser("switch").add_argument("--target", required=True)
    c = commands.add_parser("find")
    c.add_argument("phrase")
    c.add_argument("--k", type=int, default=20)
    commands.add_parser("renders").add_argument("slug")
    commands.add_parser("decided").add_argument("date")
    return p


def run(args: argparse.Namespace) -> list[str]:
    spark = get_spark(master=args.master, partitions=8)
    store = Store(spark, expand_home(args.index_dir), args.registry and expand_home(args.registry))
    identity = IndexIdentity(args.provider, args.model, args.dims)

    def embedder_of(x: IndexIdentity) -> Embedder:
        """What embeds for this index: searches use the current one's model, not the one of the options.

        Hashes of words are that of their own model only; any other needs the service."""
        if args.gateway:
            return HttpEmbedder(args.gateway, x.model)
        if x.model != HASH_MODEL:
            raise EmbeddingError(f"{x.model} needs an embedding service (--gateway)")
        return HashEmbedder(x.dims)

    read = store.registry.read
    if args.command in ("index", "reindex"):
        s = reindex(
            store, args.root, identity, embedder_of(identity), args.chunk_size, args.batch_size,
            include=args.include, trigger=args.trigger, force=args.force, by_lines=args.command == "index", legacy=args.legacy,
        )
        return [f"run {s.run_id}: {s.docs} documents, {s.chunks} passages, {s.deferred} deferred, {s.stale} stale, {s.gone} gone"]
    if args.command == "search":
        rows = search_index(store, args.query, embedder_of(store.current()), args.limit, args.threshold)
        rows = rows.withColumn("text", head(rows["text"])).collect()
        return [f"#{i} {r.path} ({r.score:.4f})\n{r.text}" for i, r in enumerate(rows, 1)] or ["no results"]
    if args.command == "status":
        current = store.current()
        index = store.verify(current)
        return [f"{current}: {index.read('documents').count()} documents, {index.read('chunks').count()} passages"]
    if args.command == "list":
        try:
            current = store.current()
        except LodestackError:
            current = None
        return [f"{'*' if x == current else ' '} {x}" for x in store.list()] or ["no indexes"]
    if args.command == "switch":
        return [f"current: {store.switch(args.target)}"]
    if args.command == "find":
        try:
            embedder = embedder_of(store.current_or(identity))
        except EmbeddingError:
            embedder = None  # the other lanes answer without
        report = find(store, args.phrase, embedder, args.k)
        lines = [f"[{r.lane}] {r.key} {r.title or ''} {r.detail or ''} ({r.score})" for r in report.hits.collect()]
        return lines + ([f"passages skipped: {report.skipped}"] if report.skipped else [])
    if args.command == "renders":
        rows = registry.renders(read("creative_works"), read("work_renders"), args.slug).collect()
        return [f"{r.render_kind} v{r.seq} {r.location}" for r in rows] or ["no renders"]
    rows = registry.decided(read("agent_decisions"), args.date).collect()
    return [f"{r.decided_at} {r.agent} [{r.domain}] {r.summary}" for r in rows] or ["no decisions"]


def main(argv: list[str] | None = None) -> int:
    try:
        print("\n".join(run(parser().parse_args(argv))))
    except LodestackError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
