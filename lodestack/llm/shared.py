"""What several of the operators use: the shared folder, skew-proof joins, components, word tables."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 0.001
#: Texts go through numpy in pieces of about so many bytes.
PIECE_BYTES = 4 << 20


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a new one under /tmp only in a local session where none is set (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file:///tmp/lodestack-{uuid.uuid4().hex}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestack/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a table in the shared folder and read again: its lineage ends there."""
    at = new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


# ---------------------------------------------------------------- joins on skewed keys


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """left joined with right, one row a key, where a few keys may hold most rows of left.

    right.weight is the number of rows that left has of the key. Keys above HOT_SHARE of the summed weights are
    at most 1 / HOT_SHARE in number, so they are broadcast; the rest are joined by a shuffle. weight is dropped.
    how: inner or left; rows of left without a key aren't shuffled. left is read two or three times and right more
    often, so both should be stored tables or cheap.
    """
    least = right.agg((F.sum(weight) * HOT_SHARE).alias("least")).scalar()
    hot = F.broadcast(right.where(F.col(weight) > least).drop(weight))
    cold = right.where(F.col(weight) <= least).drop(weight)
    first = left.join(hot, key)
    rest = left.where(F.col(key).isNotNull()).join(hot.select(key), key, "left_anti")
    out = first.unionByName(rest.join(cold, key, how).select(first.columns))
    if how == "left":
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name not in (key, weight)]
        out = out.unionByName(left.where(F.col(key).isNull()).select("*", *none))
    return out


# ---------------------------------------------------------------- a filter of bounded size

#: Bits of a filter a key, and the least and most bits in all; 2^26 bits are a million rows to broadcast.
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26


def sifted(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be among keys, and rows whose key is not among them.

    key is a hash of a row (long, not null), keys a stored table of one such column. The keys become marks in a
    field of bits that is broadcast: a row a 64 bits, 2^20 rows at most whatever the number of keys. With 16 bits a
    key about 6 % of the other rows pass by mistake, above 4 million keys more; so what passes is to be looked up, and
    what doesn't needs no shuffle. rows is read twice.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_BITS * keys.count()).bit_length()))
    word = lambda c: F.shiftright(F.pmod(c, F.lit(bits)), 6)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(c, F.lit(64)).cast("int"))
    h = F.col(keys.columns[0])
    field = keys.groupBy(word(h).alias("_word")).agg(F.bit_or(bit(h)).alias("_bits"))
    field = F.broadcast(stored(field, "field"))
    whole = rows.select(F.struct(*rows.columns).alias("_row"), key.alias("_key"))
    marked = whole.join(field, word(F.col("_key")) == F.col("_word"), "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit(F.col("_key"))) != 0, F.lit(False))
    return marked.where(hit).select("_row.*"), marked.where(~hit).select("_row.*")


# ---------------------------------------------------------------- components


def are_stars(edges: DataFrame) -> bool:
    """Whether every node of the edges (u, v), u > v, is either a root or a leaf of one root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("root"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
    return ends.where("leaf > 1 or (leaf = 1 and root = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v: long) to (node, root): the least node that each node reaches.

    Alternating large and small stars until every tree is a star; each round's edges are stored, so a lost executor
    costs one round. Self-loops and nulls are ignored; a node without other edges isn't returned.
    """
    now = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while not are_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        # Larger neighbours go to the least one, and so does the node itself.
        large = lookup(both, stored(low, "low"), "u", "n").select(F.greatest("u", "v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        small = lookup(large, low, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v")
        now = stored(small.distinct(), "small")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


class Forest:
    """Keeps, of the edges it is given, those that join two trees; works on whole arrays."""

    def __init__(self) -> None:
        self.ids, self.parent = np.empty(0, np.int64), np.empty(0, np.int64)

    def index(self, ids: np.ndarray) -> np.ndarray:
        """Places of the ids; new ones are added."""
        new = np.setdiff1d(ids, self.ids)
        if len(new):
            everything = np.union1d(self.ids, new)
            moved = np.searchsorted(everything, self.ids)
            parent = np.arange(len(everything))
            parent[moved] = moved[self.parent]
            self.ids, self.parent = everything, parent
        return np.searchsorted(self.ids, ids)

    def root(self, at: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return self.parent[at]
            self.parent = up

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the edges (places a, b) joined two trees."""
        used = []
        open_ = np.arange(len(a))
        while len(open_):
            ra, rb = self.root(a[open_]), self.root(b[open_])
            apart = ra != rb
            open_, ra, rb = open_[apart], ra[apart], rb[apart]
            if not len(open_):
                break
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            _, first = np.unique(high, return_index=True)
            self.parent[high[first]] = low[first]
            used.append(open_[first])
        return np.concatenate(used) if used else np.empty(0, np.int64)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group ends, of batches that are sorted by keys. Groups must be bounded."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        columns = [table.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        differs = np.zeros(table.num_rows, bool)
        for c in columns:
            differs |= c != c[-1]
        cut = len(differs) - int(np.argmax(differs[::-1])) if differs.any() else 0
        if not cut and held and any(held[-1].column(k)[-1].as_py() != c[-1] for k, c in zip(keys, columns, strict=True)):
            yield pa.concat_tables(held).combine_chunks()
            held = []
        if cut:
            yield pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks()
            held = []
        held.append(table.slice(cut))
    if held:
        yield pa.concat_tables(held).combine_chunks()


# ---------------------------------------------------------------- memory of workers

#: Most bytes of a batch that goes to a Python worker, unless the session says otherwise.
BATCH_BYTES = 4 << 20
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def in_small_batches(texts: DataFrame) -> DataFrame:
    """texts, whose session from now on sends them to Python workers in batches of BATCH_BYTES; a longer text goes alone.

    Ten thousand rows, Spark's own limit, may be many MB of texts, which JVM and worker hold several times.
    """
    conf = texts.sparkSession.conf
    if conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return texts

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Free pages of Arrow's pool and of the C library go back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def freeing(run: Task) -> Task:
    """run, after which free memory goes back: workers outlive their tasks and share an executor."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return freed


# ---------------------------------------------------------------- texts in numpy


def filled(texts: pa.Array) -> pa.Array:
    """Null texts count as empty."""
    return pc.fill_null(texts.cast(pa.large_string()), "")


def pieces_of(batch: pa.RecordBatch, column: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about size bytes of the column; a longer text makes a part of its own.

    The parts are copies: some of Arrow's string functions go wrong on slices.
    """
    lengths = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)).astype(np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        begun = ends[at] - lengths[at]
        to = max(at + 1, int(np.searchsorted(ends, begun + size, "right")))
        yield batch.take(pa.array(np.arange(at, to)))
        at = to


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+`: distinct words, each word's place among them, and bounds of each text's words."""
    lists = pc.ascii_split_whitespace(texts)
    starts = lists.offsets.to_numpy()
    flat = lists.values.slice(starts[0], starts[-1] - starts[0])
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    bounds = kept[starts - starts[0]].astype(np.int64)
    coded = flat.filter(full).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), bounds


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.empty(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit numbers (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    from pandas.util import hash_array

    return hash_array(np.asarray(words.to_pandas(), dtype=object), categorize=False)
