"""Language identification: script ranges narrow the candidates, Viterbi over words labels spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import filled, freeing, in_small_batches, mixed, pieces_of, ragged, stored

#: Rows a language that the model is fitted on, those of the smallest hashes.
TRAIN_ROWS = 1500
#: More languages than this are an error: a model has a column a language.
MOST_LANGS = 1000
#: Hash buckets of the letter groups.
BUCKETS = 1 << 16
#: What a change of language between two words costs, in natural logarithms.
SWITCH = 6.0
#: Most a single word can say for or against a language.
WORD_LIMIT = 8.0
UNKNOWN = "und"
#: Bytes of text that are labelled at once: long enough to share each step among many texts.
PIECE = 3 << 20

# Script ranges of the Unicode standard, first and last code point; letters elsewhere are "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "georgian": [(0x10A0, 0x10FF)],
    "ethiopic": [(0x1200, 0x137F)],
    "khmer": [(0x1780, 0x17FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
NAMES = ["other", *SCRIPTS]
#: A language is a candidate for a script that at least this share of its training letters has.
SCRIPT_SHARE = 0.002


@dataclass
class Model:
    """Bounded in size: a row of BUCKETS and of scripts for each language."""

    langs: list[str]
    scores: np.ndarray  # BUCKETS x languages, float32
    candidates: np.ndarray  # scripts x languages, bool


@lru_cache(1)
def script_table() -> np.ndarray:
    """For each code point the number of its script in NAMES, or 255 if it isn't a letter."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    table = np.zeros(0x110000, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            table[a : b + 1] = k
    table[~letter] = 255
    return table


@dataclass
class Words:
    """Distinct words (runs of letters, lower-cased) of some texts, and where they stand."""

    codes: np.ndarray  # of each word in the texts, its distinct word
    bounds: np.ndarray  # of each text's words
    starts: np.ndarray  # of each distinct word in chars
    lengths: np.ndarray
    chars: np.ndarray  # code points
    places: np.ndarray  # of each word in the texts: first char, counted over all texts


def letter_words(texts: list[str]) -> Words:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    text = "".join(texts)
    lower = text.lower()
    if len(lower) != len(text):  # a few letters have longer lower cases; those stay as they are
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    chars = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = script_table()[chars] != 255
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    ends = np.cumsum(lengths)
    cuts = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(chars))]  # words end with their text
    first[cuts[letter[cuts]]] = True
    last[cuts[letter[cuts - 1]] - 1] = True
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    # Distinct words by two independent 64-bit sums would be long to check; Arrow's dictionaries do it exactly.
    data = chars[ragged(starts, stops - starts)]
    offsets = np.concatenate([[0], np.cumsum((stops - starts) * 4)])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )
    coded = words.dictionary_encode()
    distinct = coded.dictionary
    at = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1] // 4
    inner = np.frombuffer(distinct.buffers()[2] or b"", np.uint32)
    return Words(
        coded.indices.to_numpy().astype(np.int64),
        np.searchsorted(starts, np.concatenate([[0], ends])),
        at[:-1],
        np.diff(at),
        inner,
        starts,
    )


def letter_groups(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the groups of one to four letters of each distinct word, ends marked; and the word of each."""
    marked = w.lengths + 2
    base = np.cumsum(marked) - marked
    c = np.zeros(int(marked.sum()), np.uint64)  # 0 marks both ends
    c[ragged(base + 1, w.lengths)] = w.chars[ragged(w.starts, w.lengths)]
    word = np.repeat(np.arange(len(marked)), marked)
    buckets, owners = [], []
    for n in (1, 2, 3, 4):
        if len(c) < n:
            break
        h = np.full(len(c) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + c[k : len(c) - n + 1 + k]
        inside = word[: len(h)] == word[n - 1 :]
        if n == 1:
            inside &= c > 0
        buckets.append((mixed(h[inside]) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(word[: len(h)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def scripts_of(w: Words) -> np.ndarray:
    """The script of each distinct word's first letter."""
    return script_table()[w.chars[w.starts]] if len(w.starts) else np.empty(0, np.uint8)


# ---------------------------------------------------------------- fitting


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """A model of rows with a text and a language: at most `rows` a language, those of the smallest text hashes.

    Counts of letter groups a language are made on the executors; the driver gets one bounded table a language. More than
    MOST_LANGS languages are an error.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # About twice the rows asked for fall below a hash limit that the language's row count sets; equal texts count once.
    # The table of sizes has a row a language, as the model has a column: MOST_LANGS at most, so it can be broadcast.
    sizes = stored(known.groupBy("lang").agg(F.count("*").alias("n")), "lang_sizes")
    many = sizes.count()
    if many > MOST_LANGS:
        raise ValueError(f"{many} languages to learn from; at most {MOST_LANGS} are possible")
    sizes = F.broadcast(sizes)
    low = known.withColumn("h", F.xxhash64("text")).join(sizes, "lang")
    # The limit is a double: a product of hash and count would leave the range of long from 2^23 rows a language on.
    low = low.where(F.pmod("h", F.lit(1 << 40)) < F.lit(float(2 * rows) * (1 << 40)) / F.col("n"))
    low = low.groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = low.withColumn("k", rank).where(F.col("k") <= rows).select("lang", "text").repartition(16)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for lang in set(langs):
                w = letter_words([t for t, x in zip(texts, langs, strict=True) if x == lang])
                if not len(w.codes):
                    continue
                buckets, owners = letter_groups(w)
                times = np.bincount(w.codes, minlength=len(w.lengths))
                mine = sums.setdefault(lang, np.zeros(BUCKETS + len(NAMES)))
                mine[:BUCKETS] += np.bincount(buckets, times[owners], BUCKETS)
                mine[BUCKETS:] += np.bincount(scripts_of(w), times * w.lengths, len(NAMES))
        for lang, mine in sums.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(mine[at])], ["lang", "at", "n"]
            )

    parts = sample.mapInArrow(freeing(counted), "lang string, at int, n double")
    rows_ = parts.groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows_["lang"].unique())
    counts = np.zeros((BUCKETS + len(NAMES), max(1, len(langs))))
    if len(rows_):
        counts[rows_["at"].to_numpy(), np.searchsorted(langs, rows_["lang"].to_numpy().astype(str))] = rows_["n"]
    groups, scripts = counts[:BUCKETS], counts[BUCKETS:]
    share = (groups + 0.5) / (groups.sum(0) + 0.5 * BUCKETS)
    scores = np.log(share)
    scores -= scores.mean(1, keepdims=True)
    use = scripts / np.maximum(1, scripts.sum(0)) >= SCRIPT_SHARE
    use[~use.any(1)] = True  # a script that no language has leaves all of them
    return Model(langs, scores.astype(np.float32), use)


# ---------------------------------------------------------------- labelling


def word_scores(w: Words, model: Model) -> np.ndarray:
    """Distinct words x languages: mean score of the letter groups by the root of their number, and candidates only."""
    n = len(w.lengths)
    buckets, owners = letter_groups(w)
    out = np.zeros((n, len(model.langs)), np.float32)
    each = np.maximum(1, np.bincount(owners, minlength=n))
    for k in range(len(model.langs)):
        out[:, k] = np.bincount(owners, model.scores[buckets, k], n) / np.sqrt(each)
    out = np.clip(out, -WORD_LIMIT, WORD_LIMIT)
    out[~model.candidates[scripts_of(w)]] = -2 * WORD_LIMIT - SWITCH
    return out


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word: the best sum of scores less `switch` a change, in all texts at once.

    Texts stand in columns, longest first, so that step t works on the texts that have a word t. Of equal paths
    the one that stays, and of languages the first.
    """
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    lengths, starts = lengths[order], bounds[:-1][order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # texts with more than t words
    where = np.concatenate([[0], np.cumsum(active)])
    changed = np.zeros((where[-1], scores.shape[1]), bool)
    kind = np.min_scalar_type(max(0, scores.shape[1] - 1))  # holds every language's number
    best = np.zeros(where[-1], kind)
    v = np.zeros((len(lengths), scores.shape[1]), np.float32)
    for t in range(steps):
        n = active[t]
        now = v[:n]
        if t:
            top = now.argmax(1)
            high = now[np.arange(n), top] - np.float32(switch)
            best[where[t] : where[t + 1]] = top
            less = now < high[:, None]
            changed[where[t] : where[t + 1]] = less
            np.copyto(now, np.broadcast_to(high[:, None], now.shape), where=less)
        now += scores[starts[:n] + t]
    state = v.argmax(1)
    out = np.empty(len(scores), kind)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        out[starts[:n] + t] = state[:n]
        if t:
            jump = changed[where[t] : where[t + 1]][np.arange(n), state[:n]]
            state[:n] = np.where(jump, best[where[t] : where[t + 1]], state[:n])
    return out


def labelled(texts: list[str], model: Model) -> tuple[list[str], np.ndarray, np.ndarray, Words, np.ndarray]:
    """Of each text the language, score and share of words; and the words with their labels."""
    w = letter_words(texts)
    n, many = len(texts), len(model.langs)
    each = word_scores(w, model)[w.codes] if len(w.codes) else np.zeros((0, many), np.float32)
    label = viterbi(each, w.bounds)
    owner = np.repeat(np.arange(n), np.diff(w.bounds))
    weight = w.lengths[w.codes].astype(float)
    mass = np.bincount(owner * many + label, weight, n * many).reshape(n, many)
    sums = np.stack([np.bincount(owner, each[:, k], n) for k in range(many)], 1) if many else mass
    # Most letters win; of equal ones the better sum of scores.
    top = np.lexsort((sums.ravel(), mass.ravel(), np.repeat(np.arange(n), many))).reshape(n, many)[:, -1] - np.arange(n) * many
    share = mass[np.arange(n), top] / np.maximum(1, mass.sum(1))
    own = sums[np.arange(n), top][:, None]
    sure = 1 / np.exp(np.clip(sums - own, -50, 50)).sum(1)
    none = np.diff(w.bounds) == 0
    langs = [UNKNOWN if e else model.langs[k] for k, e in zip(top, none, strict=True)]
    score = np.where(none, 0.0, np.clip(share * sure, 0, 1))
    return langs, score, share, w, label


SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
SPANS = T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("lang", "string"))


def languages(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), spans: bool = True
) -> DataFrame:
    """One row per row of docs: the id and the columns in keep, lang_pred, score (0 to 1) and, if asked for, spans.

    The whole text is read. Words are runs of letters, lower-cased. lang_pred is the language with most letters of
    the words labelled so; `und` with score 0 if the text is null or has no letter. A text in a script that no
    learned language uses gets the language that its letter groups fit best. score is that language's share of the
    letters times its probability given the sum of scores. spans are runs of words of one language, as offsets in
    characters. Without any labelled row to learn from, every text is `und`. Other columns are not looked at, and
    repeated rows are labelled alike.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    names = [id_col, *keep]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part in pieces_of(batch, text_col, PIECE):
                texts = filled(part.column(text_col)).to_pylist()
                if model.langs:
                    langs, score, _, w, marks = labelled(texts, model)
                else:
                    langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                out = [part.column(c) for c in names] + [pa.array(langs, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    out.append(span_array(texts, w, marks, model) if model.langs else pa.array([[]] * len(texts), SPAN_TYPE))
                yield pa.RecordBatch.from_arrays(out, [f.name for f in schema.fields])

    schema = T.StructType([docs.schema[c] for c in names])
    schema = schema.add("lang_pred", "string").add("score", "double")
    if spans:
        schema = schema.add("spans", SPANS)
    return in_small_batches(docs.select(*names, *([text_col] if text_col not in names else []))).mapInArrow(freeing(label), schema)


def span_array(texts: list[str], w: Words, marks: np.ndarray, model: Model) -> pa.Array:
    """Runs of words of one label in each text."""
    n = len(texts)
    begins = np.cumsum([0, *map(len, texts)])[:-1]
    owner = np.repeat(np.arange(n), np.diff(w.bounds))
    new = np.ones(len(marks), bool)
    new[1:] = (marks[1:] != marks[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(marks))[: len(first)] - 1
    start = w.places[first] - begins[owner[first]]
    end = w.places[last] + w.lengths[w.codes[last]] - begins[owner[last]]
    offsets = np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32)
    langs = pa.array(np.asarray(model.langs, object)[marks[first]] if len(first) else [], pa.string())
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64()), langs], ["start", "end", "lang"])
    )
