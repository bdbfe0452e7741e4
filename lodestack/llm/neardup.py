"""Near duplicates: an inverted join on MinHash coordinates, then exact comparison of whole shingle sets.

1. A scan makes each text's shingle set, its size, its 128-bit set hash and its MinHash signature of COORDINATES values.
   Texts of equal sets form a class; only a class's first row goes on.
2. Classes are posted under each (coordinate, value). Values that no other class has are left out. A pair that
   shares at least `matches` values shares one within each class's rarest ones, so only that prefix is posted again.
3. Within a posting list, pairs are counted on all coordinates, one byte each; pairs that tasks know to be connected
   are skipped, and a task emits only pairs that connect two trees of its forest. Long lists are cut in blocks.
   The components of these pairs ("families") contain every component of true links.
4. Families' shingle sets are made anew and compared in full, in blocks of bounded size; again only links that
   connect two trees are emitted. Their components are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Forest, components, filled, freeing, hashes, in_small_batches, lookup, mixed, pieces_of, ragged, sifted, stored, whole_groups, words_of

WORDS = 5
COORDINATES = 64
#: A link at the similarity asked for is missed with at most this probability; closer ones with less.
MISS = 1e-6
#: Most members of a posting list, and most rows of a family, in one block.
LIST_BLOCK = 1024
FAMILY_BLOCK = 256
#: Shingles after which a block of a family is full.
FAMILY_SHINGLES = 1 << 18
#: Pairs compared at a time.
PAIRS = 1 << 17


def least_matches(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most matches that two sets of this similarity reach with probability 1 - miss."""
    total, t = 0.0, 0
    while t <= coordinates:
        total += comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if total > miss:
            return t
        t += 1
    return coordinates


# ---------------------------------------------------------------- shingles


def shingle_sets(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted, and the bounds of each text's."""
    words, codes, bounds = words_of(pc.ascii_lower(filled(texts)))
    h = mixed(hashes(words)) if len(words) else np.empty(0, np.uint64)
    h = h[codes]
    counts = np.diff(bounds)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    multiply = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(len(h), np.uint64)
    if len(h) >= n:
        for k in range(n):
            rolled[: len(h) - n + 1] = (rolled[: len(h) - n + 1] + h[k : len(h) - n + 1 + k]) * multiply
    short = np.flatnonzero((counts > 0) & (counts < n))
    for i in short:  # the whole sequence is the shingle
        x = counts[i : i + 1].astype(np.uint64)
        for k in range(bounds[i], bounds[i + 1]):
            x = (x ^ h[k : k + 1]) * multiply
        rolled[bounds[i]] = x[0]
    values = mixed(rolled[ragged(bounds[:-1], made)])
    ends = np.cumsum(made)
    sets = [np.unique(values[e - m : e]) for e, m in zip(ends, made, strict=True)]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def coordinate_seeds(k: int) -> np.ndarray:
    return mixed(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def signatures(values: np.ndarray, bounds: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """MinHash values of each nonempty set: k coordinates, each told apart from the others."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, k), np.uint64)
    if not len(full):
        return out
    at = bounds[full]
    for i, seed in enumerate(coordinate_seeds(k)):
        x = (values ^ seed) * np.uint64(0xFF51AFD7ED558CCD | 1)
        x ^= x >> np.uint64(32)
        x *= seed | np.uint64(1)
        out[full, i] = np.minimum.reduceat(x, at)
    return mixed(out + coordinate_seeds(k)[None, :])


SCAN = "id long, n_shingles long, set_hash binary, postings array<bigint>, bytes binary"


def scanned(id_col: str, text_col: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, text_col):
                values, bounds = shingle_sets(part.column(text_col), n)
                sizes = np.diff(bounds)
                sig = signatures(values, bounds)
                full = np.flatnonzero(sizes)
                twice = np.zeros((len(sizes), 2), np.uint64)  # two independent sums over the set
                if len(full):
                    twice[full, 0] = np.add.reduceat(mixed(values), bounds[full])
                    twice[full, 1] = np.add.reduceat(mixed(values ^ np.uint64(0xA5A5A5A55A5A5A5A)), bounds[full])
                m = len(sizes)
                lengths = np.where(sizes > 0, COORDINATES, 0)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                low = sig.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(id_col).cast(pa.int64()),
                        pa.array(sizes),
                        fixed_rows(twice.view(np.uint8).reshape(m, 16)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig[sizes > 0].ravel().view(np.int64))),
                        fixed_rows(low),
                    ],
                    ["id", "n_shingles", "set_hash", "postings", "bytes"],
                )

    return run


def fixed_rows(rows: np.ndarray) -> pa.Array:
    """A binary value of each row of bytes."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


# ---------------------------------------------------------------- pairs of posting lists


def pairs_within(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs a < b of places of one group, in portions of bounded size."""
    sizes = np.diff(bounds)
    place = np.arange(bounds[-1])
    later = np.repeat(bounds[1:], sizes) - place - 1  # partners after each place
    total, at = np.cumsum(later), 0
    while at < len(place):
        begun = total[at] - later[at]
        to = max(at + 1, int(np.searchsorted(total, begun + PAIRS, "right")))
        a = np.repeat(place[at:to], later[at:to])
        yield a, ragged(place[at:to] + 1, later[at:to])
        at = to


def bounds_of(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), len(new))


def matching(matches: int):
    """Rows (key, i, j, side, cls, bytes), sorted by key, i, j, to edges (u, v) that keep the lists' connectivity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for table in whole_groups(batches, ["key", "i", "j"]):
            column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)  # noqa: E731, B023
            cls, side, i, j = column("cls"), column("side"), column("i"), column("j")
            data = table.column("bytes").combine_chunks()
            start = np.frombuffer(data.buffers()[1], np.int32)[data.offset]
            sketch = np.frombuffer(data.buffers()[2], np.uint8)[start : start + len(cls) * COORDINATES]
            sketch = sketch.reshape(-1, COORDINATES)
            at = forest.index(cls)
            for a, b in pairs_within(bounds_of(column("key"), i, j)):
                apart = (side[a] != side[b]) | (i[a] == j[a])  # blocks of a list: each pair in one place only
                a, b = a[apart], b[apart]
                unknown = forest.root(at[a]) != forest.root(at[b])  # the skip
                a, b = a[unknown], b[unknown]
                hit = (sketch[a] == sketch[b]).sum(1) >= matches
                a, b = a[hit], b[hit]
                used = forest.add(at[a], at[b])
                if len(used):
                    yield pa.RecordBatch.from_arrays([pa.array(cls[a[used]]), pa.array(cls[b[used]])], ["u", "v"])

    return run


def families(classes: DataFrame, matches: int) -> DataFrame:
    """classes (cls, postings, bytes) to (cls, family): the components of pairs that share enough values."""
    # Without the bytes; a posting is two numbers.
    posts = classes.select("cls", F.explode("postings").alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("times", F.col("n"))
    kept = lookup(posts, stored(shared, "shared_values"), "key", "n").select("cls", F.struct("times", "key").alias("post"))
    prefix = kept.groupBy("cls").agg(F.array_sort(F.collect_list("post")).alias("posts"))  # COORDINATES at most
    prefix = prefix.where(F.size("posts") >= matches).select(
        "cls", F.explode(F.expr(f"slice(posts, 1, size(posts) - {matches} + 1)")).alias("post")
    )
    prefix = stored(prefix.select("cls", "post.key", "post.times"), "prefix")
    # A list's members after the cut, at most `times`.
    blocks = F.ceil(F.col("times") / LIST_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    spread = prefix.withColumn("b", own).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select(
        "key",
        F.least("b", "o").alias("i"),
        F.greatest("b", "o").alias("j"),
        (F.col("b") < F.col("o")).cast("byte").alias("side"),
        "cls",
    )
    spread = spread.join(classes.select("cls", "bytes"), "cls")
    dealt = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    edges = dealt.mapInArrow(freeing(matching(matches)), "u long, v long")
    return components(edges).select(F.col("node").alias("cls"), F.col("root").alias("family"))


# ---------------------------------------------------------------- exact links


def setter(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                values, bounds = shingle_sets(part.column("text"), n)
                offsets = pa.array((bounds * 8).astype(np.int32))
                sets = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets.buffers()[1], pa.py_buffer(values)])
                names = ["cls", "family", "b", "parts"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), sets], [*names, "shingles"])

    return run


def intersections(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of a block's sets, by products of 0/1 matrices of shingles that sets share."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    order = np.argsort(values, kind="stable")
    v, owner = values[order], owner[order]
    edges = bounds_of(v) if len(v) else np.array([0])
    many = np.diff(edges) > 1
    columns = np.repeat(np.where(many, np.cumsum(many) - 1, -1), np.diff(edges))
    owner, columns = owner[columns >= 0], columns[columns >= 0]
    out = np.zeros((n, n), np.float32)
    width = 2048
    for at in range(0, int(many.sum()), width):
        lo, hi = np.searchsorted(columns, [at, at + width])
        m = np.zeros((n, width), np.float32)
        m[owner[lo:hi], columns[lo:hi] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def linking(per_hundred: int):
    """Rows (family, i, j, side, cls, shingles), sorted, to links (u, v) that keep the components of all links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for table in whole_groups(batches, ["family", "i", "j"]):
            column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)  # noqa: E731, B023
            cls, side, i, j = column("cls"), column("side"), column("i"), column("j")
            data = table.column("shingles").combine_chunks()
            cuts = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64) // 8
            values = np.frombuffer(data.buffers()[2], np.uint64)
            at = forest.index(cls)
            u, v = [], []
            groups = bounds_of(column("family"), i, j)
            for lo, hi in zip(groups[:-1], groups[1:], strict=True):
                common = intersections(values[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo])
                size = np.diff(cuts[lo : hi + 1])
                link = 100 * common >= per_hundred * (size[:, None] + size[None, :] - common)
                if i[lo] != j[lo]:
                    link &= side[lo:hi, None] != side[None, lo:hi]
                a, b = np.nonzero(np.triu(link, 1))
                used = forest.add(at[lo + a], at[lo + b])
                u.append(cls[lo + a[used]])
                v.append(cls[lo + b[used]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return run


def links(docs: DataFrame, members: DataFrame, per_hundred: int, n: int) -> DataFrame:
    """docs (id, text) and members (cls, family, size) to a forest of the links within the families.

    A family of less than a block is one block; others are dealt to blocks by hashes, and each pair of blocks meets.
    """
    totals = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("n") / FAMILY_BLOCK), F.ceil(F.col("shingles") / FAMILY_SHINGLES)).cast("int")
    totals = stored(totals.select("family", parts.alias("parts"), "n"), "family_sizes")
    placed = lookup(members.select("cls", "family"), totals, "family", "n")
    placed = stored(placed.withColumn("b", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")), "members")
    # Only texts of members are shuffled, and a few that pass the filter by mistake.
    marks = stored(placed.select(F.xxhash64("cls").alias("h")), "member_marks")
    maybe, _ = sifted(docs.where("id is not null"), F.xxhash64("id"), marks)
    texts = maybe.join(placed, F.col("id") == F.col("cls"))
    sets = texts.select("cls", "family", "b", "parts", "text").mapInArrow(
        freeing(setter(n)), "cls long, family long, b int, parts int, shingles binary"
    )
    spread = sets.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select(
        "family",
        F.least("b", "o").alias("i"),
        F.greatest("b", "o").alias("j"),
        (F.col("b") < F.col("o")).cast("byte").alias("side"),
        "cls",
        "shingles",
    )
    dealt = spread.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return dealt.mapInArrow(freeing(linking(per_hundred)), "u long, v long")


# ---------------------------------------------------------------- the operator


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_hundred: int = 80, n: int = WORDS
) -> DataFrame:
    """One row per row of docs: id, n_shingles, class_id, component_id, kept.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text's set holds its distinct n-word shingles, or its
    whole sequence if it has fewer words; null texts and texts without words have no set and are linked with nothing.
    Texts are linked when 100 * intersection >= per_hundred * union of whole sets. class_id is the least id of equal
    sets, component_id the least id reachable by links; kept where the row's id is its component's. Ids should be
    distinct and not null: rows of one id count as one text for the links (a null id is reported as its own
    component and linked with nothing). Other columns of docs are not looked at.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scan = stored(in_small_batches(plain).mapInArrow(freeing(scanned("id", "text", n)), SCAN), "signatures")
    full = scan.where("n_shingles > 0 and id is not null")
    first = F.min_by(F.struct("postings", "bytes", "n_shingles"), "id").alias("s")
    classes = full.groupBy("set_hash").agg(F.min("id").alias("cls"), F.count("*").alias("n"), first)
    classes = stored(classes.select("set_hash", "cls", "n", "s.postings", "s.bytes", F.col("s.n_shingles").alias("size")), "classes")
    matches = least_matches(per_hundred / 100)
    members = families(classes, matches).join(classes.select("cls", "size"), "cls")
    joined = components(links(plain, stored(members, "families"), per_hundred, n))

    roots = classes.select("set_hash", "n", "cls").join(joined.withColumnRenamed("node", "cls"), "cls", "left")
    roots = roots.select("set_hash", "n", F.col("cls").alias("class_id"), F.coalesce("root", "cls").alias("component_id"))
    roots = stored(roots, "roots")
    thin = scan.select("id", "n_shingles", F.when(F.expr("n_shingles > 0 and id is not null"), F.col("set_hash")).alias("set_hash"))
    found = lookup(thin, roots, "set_hash", "n", "left")
    component = F.coalesce("component_id", "id")
    return found.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.coalesce("class_id", "id").alias("class_id"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_hundred: int = 80) -> DataFrame:
    """The rows of docs that near_groups keeps, with all their columns; no text is shuffled but those that go (see sifted)."""
    found = near_groups(docs, id_col, text_col, per_hundred)
    dropped = stored(found.where("not kept").select(F.col(id_col).alias("_id")).distinct(), "near_dropped")
    marks = stored(dropped.select(F.xxhash64("_id").alias("h")), "dropped_marks")
    maybe, sure = sifted(docs, F.xxhash64(id_col), marks)
    return sure.unionByName(maybe.join(dropped, maybe[id_col] == dropped["_id"], "left_anti"))
