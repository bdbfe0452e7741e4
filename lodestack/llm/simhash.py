"""Near duplicates by SimHash fingerprints, found in BK-trees.

1. A scan makes each text's 64-bit fingerprint; rows of one fingerprint form a class, only classes go on.
2. Two fingerprints that differ in at most RADIUS bits agree in one of RADIUS + 1 blocks of their bits. So each class is
   posted under each of its blocks' values; a value that no other class has finds nothing and is left out.
3. The classes of one value are a shard. Its BK-tree keeps children by their integer distance to their parent; a search
   that stands at distance d from a node follows only edges of d - RADIUS to d + RADIUS. A shard above SHARD classes is
   posted again under blocks of the bits that are left, twice at most. What is above SHARD then is cut in trees of TREE
   classes; each goes, as one row, to every task that searches it, so what is broadcast is bounded.
4. Tasks emit only links that join two trees of their forest; the components of those are the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Forest, components, filled, freeing, in_small_batches, lookup, pieces_of, ragged, stored, whole_groups

WORDS = 3
SEED = 42
BITS = 64
#: Fingerprints link at so many differing bits or fewer.
RADIUS = 3
#: Most classes of a shard that isn't posted again, and most of a tree, about, where no more bits divide a shard.
SHARD = 4096
TREE = 1 << 16
#: Lengths of the blocks of bits: of the whole fingerprint, then of what is left of it, and so on.
BLOCK_BITS = (16, 12, 9)
#: Texts are hashed in windows of about so many bytes.
WINDOW = 1 << 20
#: Hashes whose bits are counted at a time.
HASHES = 1 << 18
#: Pairs of a query and a node from which a search goes on at a time.
FRONTIER = 1 << 14

SPACE = re.compile(rb"[\x20\x09-\x0D]")


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, n: int = WORDS, window: int = WINDOW) -> Iterator[np.ndarray]:
    """XXH64 of the n-word shingles of one lower-cased text, window by window, repeats included."""
    hash_, held, at, seen = xxhash.xxh64_intdigest, [], 0, False
    while at < len(text):
        space = SPACE.search(text, at + window)
        to = space.start() if space else len(text)
        words = held + text[at:to].split()  # of bytes, so at the same six characters
        at = to
        if len(words) >= n:
            line = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lengths + 1) - 1
            begins, ends = (ends - lengths)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
            yield np.fromiter((hash_(line[b:e], SEED) for b, e in zip(begins, ends, strict=True)), np.uint64, len(begins))
            seen = True
            words = words[len(words) - n + 1 :]
        held = words
    if held and not seen:  # fewer words than a shingle has
        yield np.array([hash_(b" ".join(held), SEED)], np.uint64)


def bit_counts(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each run of hashes, how many have each bit set; runs must not be empty."""
    # Four counters of 16 bits lie in one number, so runs are cut below 2^16 first.
    sizes = np.diff(bounds)
    cuts = -(-sizes // 65535)
    starts = np.repeat(bounds[:-1], cuts) + 65535 * ragged(np.zeros(len(cuts), np.int64), cuts)
    out = np.zeros((len(sizes), BITS), np.int64)
    run = np.repeat(np.arange(len(sizes)), cuts)
    for shift in range(16):
        sums = np.add.reduceat((h >> np.uint64(shift)) & np.uint64(0x0001000100010001), starts)
        for lane in range(4):
            part = ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64)
            out[:, 16 * lane + shift] = np.bincount(run, part, len(sizes)).astype(np.int64)
    return out


def fingerprints(texts: pa.Array, n: int = WORDS) -> np.ndarray:
    """The fingerprint of each text, as an unsigned number; zero where a text is null or has no words."""
    counts, totals = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    held, owners, waiting = [], [], 0

    def count() -> None:
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        np.add.at(counts, owners, bit_counts(np.concatenate(held), np.concatenate([[0], np.cumsum(sizes)])))
        np.add.at(totals, owners, sizes)

    for i, text in enumerate(filled(texts).cast(pa.large_binary())):
        for h in shingle_hashes(text.as_py().lower(), n):
            held.append(h)
            owners.append(i)
            waiting += len(h)
            if waiting >= HASHES:
                count()
                held, owners, waiting = [], [], 0
    if held:
        count()
    bits = (2 * counts > totals[:, None]).astype(np.uint64)
    return (bits << np.arange(BITS, dtype=np.uint64)).sum(1, dtype=np.uint64)


def scanned(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                made = fingerprints(part.column("text"), n).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.int64()), pa.array(made)], ["id", "fp"])

    return run


# ---------------------------------------------------------------- BK-trees


class Trees:
    """BK-trees of several groups of fingerprints, as arrays; each group's first fingerprint is its root.

    Every fingerprint is a node. Children are sorted by parent and by distance to it, so the edges that a search follows
    are one range.
    """

    def __init__(self, fps: np.ndarray, roots: np.ndarray) -> None:
        """fps: unsigned, group after group; roots: for each fingerprint the place of its group's first."""
        self.fps = fps
        at = np.flatnonzero(roots != np.arange(len(fps)))
        over = roots[at]
        nodes, keys = [], []
        while len(at):
            key = over * (BITS + 1) + np.bitwise_count(fps[at] ^ fps[over])
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            nodes.append(at[first])
            keys.append(key[first])
            over = at[first][np.cumsum(first) - 1]  # the rest go below the node that has taken their edge
            at, over = at[~first], over[~first]
        keys, nodes = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, nodes))
        order = np.argsort(keys, kind="stable")
        self.keys, self.nodes = keys[order], nodes[order]

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) places of fingerprints at radius or less, searching from roots; portions of bounded size."""
        open_ = [(np.arange(len(queries)), roots)]
        while open_:
            q, at = open_.pop()
            if len(q) > FRONTIER:
                open_.append((q[FRONTIER:], at[FRONTIER:]))
                q, at = q[:FRONTIER], at[:FRONTIER]
            d = np.bitwise_count(queries[q] ^ self.fps[at]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], at[hit]
            low = np.searchsorted(self.keys, at * (BITS + 1) + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.keys, at * (BITS + 1) + np.minimum(d + radius, BITS), "right")
            if (high > low).any():
                open_.append((np.repeat(q, high - low), self.nodes[ragged(low, high - low)]))


EDGE = "u long, v long"


def edges(
    trees: Trees, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, roots: np.ndarray, radius: int
) -> Iterator[pa.RecordBatch]:
    """Links between the queries and the trees' fingerprints, as many as keep their components."""
    forest = Forest()
    forest.index(np.concatenate([ids, query_ids]))
    own, asked = forest.index(ids), forest.index(query_ids)
    for q, at in trees.within(queries, roots, radius):
        used = forest.add(asked[q], own[at])
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[q[used]]), pa.array(ids[at[used]])], ["u", "v"])


def linking(radius: int):
    """Rows (key, fp, cls), sorted by key, to links within each key's shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key"]):
            key, fps, cls = (table.column(c).to_numpy() for c in ("key", "fp", "cls"))
            new = np.concatenate([[True], key[1:] != key[:-1]])
            roots = np.flatnonzero(new)[np.cumsum(new) - 1]
            fps = fps.view(np.uint64)
            yield from edges(Trees(fps, roots), cls, fps, cls, roots, radius)

    return run


# ---------------------------------------------------------------- shards


def posted(level: int, radius: int) -> Column:
    """Keys of a row (key, left) under radius + 1 blocks of `left`, each with the bits that are left without the block."""
    width = BLOCK_BITS[level]
    posts = []
    for i in range(radius + 1):
        low, high = i * width, (i + 1) * width
        value = F.shiftrightunsigned("left", low).bitwiseAND(F.lit((1 << width) - 1))
        rest = F.col("left").bitwiseAND(F.lit((1 << low) - 1))
        if high < BITS:  # what lies above the block moves down
            rest = rest.bitwiseOR(F.shiftleft(F.shiftrightunsigned("left", high), low))
        posts.append(F.struct(F.xxhash64("key", F.lit(level), F.lit(i), value).alias("key"), rest.alias("left")))
    return F.array(*posts)


def links(classes: DataFrame, radius: int, shard: int, tree: int) -> DataFrame:
    """classes (fp, cls), fingerprints distinct, to links (u, v) that keep the components of all links.

    Keys are hashes; if two collide, their shards make one tree, and the distances decide as always.
    """
    posts, found = classes.select("cls", "fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("left")), None
    for level in range(len(BLOCK_BITS)):
        posts = posts.withColumn("post", F.explode(posted(level, radius))).select("cls", "fp", "post.*")
        counts = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n"))
        posts = stored(lookup(posts, stored(counts, "shard_sizes"), "key", "n"), "shards")
        small = posts.where(F.col("size") <= shard).select("key", "fp", "cls").repartition("key").sortWithinPartitions("key")
        small = small.mapInArrow(freeing(linking(radius)), EDGE)
        found = small if found is None else found.unionByName(small)
        posts = posts.where(F.col("size") > shard)
        if posts.isEmpty():
            return found
    return found.unionByName(links_of_large(posts, radius, tree))


def links_of_large(posts: DataFrame, radius: int, tree: int) -> DataFrame:
    """Links within shards (key, fp, cls, size) of any size: trees of about `tree` classes, each searched by those that follow."""
    parts = F.ceil(F.col("size") / tree).cast("int")
    dealt = posts.select("key", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"), parts.alias("parts"), "fp", "cls")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "part"]):
            key, part, parts, fps, cls = (table.column(c).to_numpy() for c in ("key", "part", "parts", "fp", "cls"))
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]), [True]]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                row = [[int(key[lo])], [int(part[lo])], [int(parts[lo])], [fps[lo:hi].tobytes()], [cls[lo:hi].tobytes()]]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                names = ["key", "part", "parts", "fps", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names)

    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part")
    packed = dealt.mapInArrow(freeing(pack), "key long, part int, parts int, fps binary, ids binary")
    packed = stored(packed, "shard_trees")
    held = packed.withColumn("asker", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)))
    asking = packed.withColumnsRenamed({"part": "asker", "fps": "asked", "ids": "asked_ids"})
    asking = asking.drop("parts").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("asker"))))
    pairs = held.join(asking, ["key", "part", "asker"]).select("fps", "ids", "asked", "asked_ids")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                fps, ids, asked, asked_ids = (np.frombuffer(column[row].as_py(), np.int64) for column in batch.columns)
                trees = Trees(fps.view(np.uint64), np.zeros(len(fps), np.int64))
                yield from edges(trees, ids, asked.view(np.uint64), asked_ids, np.zeros(len(asked), np.int64), radius)

    return in_small_batches(pairs).mapInArrow(freeing(search), EDGE)


# ---------------------------------------------------------------- the operator


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, n: int = WORDS, shard: int = SHARD, tree: int = TREE
) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 lower-case hex digits), component_id.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; the shingles of a text are its n-word sequences, repeats
    included, joined by spaces, or its whole sequence if it has fewer words. A bit of the fingerprint is 1 if it is set
    in over half of the shingles' XXH64 (seed 42). Null texts and texts without words have fingerprint zero and are
    linked like any other. Fingerprints that differ in radius bits or fewer are linked; component_id is the least id
    reachable by links, the row's own included. Rows that share an id keep a row each. Rows without an id get the
    component of their fingerprint's other rows, or null if it has none, and link nothing. Other columns of docs are
    not looked at.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must be 0 to {RADIUS}")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scan = stored(in_small_batches(plain).mapInArrow(freeing(scanned(n)), "id long, fp long"), "fingerprints")
    classes = stored(scan.groupBy("fp").agg(F.min("id").alias("cls"), F.count("*").alias("n")), "fingerprint_classes")
    joined = components(links(classes.where("cls is not null").select("fp", "cls"), radius, shard, tree))
    roots = classes.join(joined.withColumnRenamed("node", "cls"), "cls", "left")
    roots = stored(roots.select("fp", "n", F.coalesce("root", "cls").alias("component_id")), "fingerprint_roots")
    found = lookup(scan, roots, "fp", "n")
    return found.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
