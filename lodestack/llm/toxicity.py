"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import Words, letter_words
from .shared import filled, freeing, in_small_batches, mixed, pieces_of, ragged, stored

#: Labelled rows that the model is fitted on, those of the smallest id hashes.
TRAIN_ROWS = 12_000
EPOCHS = 3
BUCKETS = 1 << 20
#: Rates and penalties of FTRL-proximal: weights stay 0 until their gradients sum to more than L1. Of thirteen settings
#: these did best on a quarter of the rows that labels may be learned from (fold 3), fitted on folds 0 and 1.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.2
#: A text is called toxic from this score.
THRESHOLD = 0.3
#: Numbers that tell words, neighbours, words with one between and stems apart.
KINDS = {"word": 1, "bigram": 2, "skip": 3, "stem": 4}
#: A word's first letters stand for its inflected forms.
STEM = 5
PIECE = 4 << 20


# ---------------------------------------------------------------- features


def word_hashes(w: Words, letters: int | None = None) -> np.ndarray:
    """A 64-bit hash of each distinct word, or of its first letters."""
    if not len(w.starts):
        return np.empty(0, np.uint64)
    lengths = w.lengths if letters is None else np.minimum(w.lengths, letters)
    at = ragged(w.starts, lengths)
    place = at - np.repeat(w.starts, lengths)
    power = np.power(np.uint64(0x100000001B3), place.astype(np.uint64))
    return mixed(np.add.reduceat((w.chars[at].astype(np.uint64) + np.uint64(1)) * power, np.cumsum(lengths) - lengths))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of every word, its stem, pair of neighbours and pair with one word between: bucket, and place of its text."""
    w = letter_words(texts)
    h = word_hashes(w)[w.codes]
    stems = word_hashes(w, STEM)[w.codes]
    owner = np.repeat(np.arange(len(texts)), np.diff(w.bounds))
    buckets, owners = [], []
    for kind, gap in (("word", 0), ("stem", 0), ("bigram", 1), ("skip", 2)):
        m = len(h) - gap
        if m <= 0:
            continue
        x = (stems if kind == "stem" else h) if not gap else h[:m] * np.uint64(0x9E3779B97F4A7C15) + h[gap:]
        inside = owner[:m] == owner[gap:]
        buckets.append((mixed(x + np.uint64(KINDS[kind])) % np.uint64(BUCKETS)).astype(np.int32)[inside])
        owners.append(owner[:m][inside])
    if not buckets:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


# ---------------------------------------------------------------- fitting


class Ftrl:
    """Per-coordinate rates and L1: a weight follows from the sums z and n of its own gradients."""

    def __init__(self, constant: float = 0.0, size: int = BUCKETS) -> None:
        self.constant, self.z, self.n = constant, np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        rate = (BETA + np.sqrt(n)) / ALPHA + L2
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / rate)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One row: its distinct buckets."""
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-w.sum() - self.constant)) - label
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + gradient**2


@dataclass
class Model:
    """Bounded: at most BUCKETS weights, those that aren't 0, and the constant; without labels a constant of minus infinity."""

    at: np.ndarray
    weights: np.ndarray
    constant: float


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of labels (id, toxic), fitted on a bounded sample: `rows` rows, those of the smallest hashes of their ids.

    The constant isn't learned but follows from the sample's labels, log((toxic + 1/2) / (others + 1/2)), so L1 doesn't hold
    it back and few labels give a low score to clean texts. Executors make the features of whole texts; one task then
    learns from them in the order of the hashes, EPOCHS times, with one batch of rows in memory. Labels that are null
    are left out; an id with two labels is toxic; of rows of docs that share an id one counts, that of the smallest hash.
    Without labels every text scores 0.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("_label"))
    known = known.withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(rows)
    # At most `rows` ids: a bounded broadcast.
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id")
    sample = sample.select(F.col("_label").cast("int").alias("label"), "text", F.col("_h").alias("h"), F.xxhash64("text").alias("h2"), "_id")
    first = F.row_number().over(Window.partitionBy("_id").orderBy("h2", "text"))  # tasks keep one row an id before the shuffle
    sample = sample.withColumn("k", first).where("k = 1").drop("k", "_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text", PIECE):
                texts = filled(part.column("text")).to_pylist()
                buckets, owner = features(texts)
                pairs = np.unique(owner * BUCKETS + buckets)
                cuts = np.searchsorted(pairs // BUCKETS, np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array((pairs % BUCKETS).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("label", "h", "h2")), lists], ["label", "h", "h2", "at"])

    made = stored(in_small_batches(sample).mapInArrow(freeing(featured), "label int, h long, h2 long, at array<int>"), "features")
    counts = made.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    if not counts["n"]:
        return Model(np.empty(0, np.int64), np.empty(0), -np.inf)
    constant = float(np.log((counts["toxic"] + 0.5) / (counts["n"] - counts["toxic"] + 0.5)))
    again = made.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    again = again.repartition(1).sortWithinPartitions("epoch", "h", "h2")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(constant)
        for batch in batches:
            lists = batch.column("at")
            flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for k, label in enumerate(batch.column("label").to_pylist()):
                model.learn(flat[cuts[k] - cuts[0] : cuts[k + 1] - cuts[0]], label)
        w = model.weights()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["at", "w"])

    found = again.mapInArrow(freeing(learn), "at long, w double").toPandas()
    return Model(found["at"].to_numpy(), found["w"].to_numpy(), constant)


# ---------------------------------------------------------------- scoring


def scores(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of docs: id, the columns in keep, score (0 to 1) and predicted (1 from THRESHOLD).

    The whole text counts: its distinct words, neighbours and skip-grams. Words are runs of letters, lower-cased.
    Null and empty texts, and texts without letters, get the score of the constant alone: the share of toxic labels
    that the model was fitted on, or 0 without any. Repeated rows are scored
    alike; other columns are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.at.astype(np.int32), model.weights.astype(np.float32), model.constant))
    names = [id_col, *keep]
    schema = T.StructType([docs.schema[c] for c in names]).add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, constant = held.value
        table = np.zeros(BUCKETS)
        table[at] = w
        for batch in batches:
            for part in pieces_of(batch, text_col, PIECE):
                texts = filled(part.column(text_col)).to_pylist()
                buckets, owner = features(texts)
                heavy = table[buckets] != 0
                pairs = np.unique(owner[heavy] * BUCKETS + buckets[heavy])
                sums = np.bincount(pairs // BUCKETS, table[pairs % BUCKETS], len(texts)) + constant
                score = 1 / (1 + np.exp(-np.clip(sums, -50, 50))) if np.isfinite(constant) else np.zeros(len(texts))
                out = [part.column(c) for c in names] + [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, schema.names)

    return in_small_batches(docs.select(*names, *([text_col] if text_col not in names else []))).mapInArrow(freeing(run), schema)
