"""SentencePiece encoding and decoding with the N best segmentations of whole texts.

The lattice of a text has an edge for each piece at each place, and for a character that no piece has an edge of its
bytes. No piece of the model goes on from another character to a space, or over a line break, so the lattice falls
apart in segments there, and each distinct segment is solved once: forward Viterbi scores (whole arrays of segments
at a time), and with the backward scores how much its second best path loses. The N best paths of a text leave the best
path only in the N - 1 segments that lose least; of these a backward A* search, with the forward scores as exact
heuristics, gives the best paths in order, and the N least sums of losses are the text's.

A unigram model brings log-probabilities. A BPE model has none: its scores are merge ranks, and the public library
refuses N-best for it. Sums of ranks mean nothing, so for such a model the lattice is scored by Zipf's law,
p ~ 1 / (rank + 1), and the model's own ids, those of its merges, are given beside the N best segmentations.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import filled, freeing, in_small_batches, pieces_of, ragged

BEST = 4
#: What a character of bytes scores below the worst piece, as in the public library.
UNKNOWN_PENALTY = 10.0
#: Scores are multiples of this, so that their sums are exact and equal paths have equal scores.
SCORE_UNIT = 2.0**-20
#: Segments up to this length are solved as arrays of at most so many places, longer ones one by one.
ARRAY_LENGTH = 48
ARRAY_PLACES = 1 << 16
#: Pieces up to so many characters are looked up in arrays of all places, longer ones in lists of the places that have one.
DENSE = 4
#: Bytes of text that are encoded at once.
PIECE = 1 << 20
#: Distinct segments and searches that a worker keeps (some 30 MB); others are solved each time they are met.
KEPT_SEGMENTS, KEPT_SEARCHES = 250_000, 10_000
NONE = -np.inf
BASE = np.uint64(0x100000001B3)
#: Marks of a table of hashes; a power of two.
MARKS = 1 << 18


def marked(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


def zipf_scores(scores: np.ndarray) -> np.ndarray:
    """The scores, or, if they are the merge ranks of a BPE model (0, -1, -2, ...), log-probabilities by Zipf's law."""
    if not np.array_equal(scores, np.round(scores)):
        return scores
    rank = np.searchsorted(np.sort(-scores), -scores)  # equal scores share the first rank
    return -np.log(rank + 1.0) - np.log((1 / (rank + 1.0)).sum())


class Pieces:
    """The model's pieces with spaces as themselves, for lookups by text and, in arrays, by hashes a length."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("\ufb01  \u2460") != sp.normalize("x").replace("x", "\ufb01▁▁\u2460"):
            raise ValueError("the model alters texts before it cuts them")
        self.bytes_of: list[bytes] = [b""] * sp.vocab_size()
        self.byte_ids = [0] * 256
        plain: list[tuple[str, int]] = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i).replace("▁", " ")
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                plain.append((piece, i))
                self.bytes_of[i] = piece.encode()
        if any(" " in p.lstrip(" ") or "\n" in p for p, _ in plain):
            raise ValueError("a piece goes on to a space or over a line break")
        scores = zipf_scores(np.array([sp.get_score(i) for _, i in plain], float))
        scores = np.round(scores / SCORE_UNIT) * SCORE_UNIT
        self.of: dict[str, tuple[int, float]] = {p: (i, s) for (p, i), s in zip(plain, scores.tolist(), strict=True)}
        self.before = len(sp.encode("\n"))
        self.line_break = sp.encode("\n")[-1]
        self.unknown = min(s for _, s in self.of.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.of))
        self.tables = []
        for n in range(1, self.longest + 1):
            found = sorted((self.hash(p), i, s) for p, (i, s) in self.of.items() if len(p) == n)
            hashes, ids, scores = (np.array([x[k] for x in found], t) for k, t in ((0, np.uint64), (1, np.int32), (2, float)))
            marks = np.zeros(MARKS, bool)  # most stretches of a text are no piece, which one look tells
            marks[marked(hashes)] = True
            self.tables.append((hashes, ids, scores, marks))
        self.byte_sizes = np.array(list(map(len, self.bytes_of)), np.int64)
        self.byte_begins = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def own_ids(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The model's own ids of segments, and their bounds.

        No piece goes over a line break, so one before each segment changes nothing behind it, and cuts what one call
        gives for all. Segments with a line break of their own, and those with U+2581, are encoded by themselves: the
        library takes that for a space; here it is a character like others.
        """
        odd = pc.or_(pc.match_substring(segments, "\n"), pc.match_substring(segments, "▁")).to_numpy(zero_copy_only=False)
        plain = segments.filter(pa.array(~odd)).to_pylist()
        ids = np.array(self.model.encode("\n" + "\n".join(plain), num_threads=1) if plain else [], np.int32)
        breaks = np.flatnonzero(ids == self.line_break)
        sizes = np.zeros(len(segments), np.int64)
        sizes[~odd] = np.diff(np.append(breaks, len(ids))) - 1
        ids = np.delete(ids, breaks)[breaks[0] if len(breaks) else 0 :]
        if odd.any():
            mark, found = [self.byte_ids[b] for b in "▁".encode()], {}
            for k in np.flatnonzero(odd).tolist():
                parts = self.model.encode(["\n" + x for x in segments[k].as_py().split("▁")], num_threads=1)
                found[k] = [i for n, x in enumerate(parts) for i in (mark if n else []) + x[self.before :]]
                sizes[k] = len(found[k])
            every = np.empty(int(sizes.sum()), np.int32)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            every[np.repeat(~odd, sizes)] = ids
            for k, x in found.items():
                every[bounds[k] : bounds[k + 1]] = x
            ids = every
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) % 2**64
        return h

    def edges(self, text: str, end: int) -> Iterator[tuple[int, float, tuple[int, ...]]]:
        """Edges that end at a place, longest first: begin, score, ids."""
        for begin in range(max(0, end - self.longest), end):
            found = self.of.get(text[begin:end])
            if found:
                yield begin, found[1], (found[0],)
        if text[end - 1 : end] not in self.of:
            yield end - 1, self.unknown, tuple(self.byte_ids[b] for b in text[end - 1 : end].encode("utf-8", "surrogatepass"))


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


# ---------------------------------------------------------------- one segment


def forward(edges: list[list[tuple[int, float, tuple[int, ...]]]]) -> list[float]:
    """Viterbi scores: of the best path to each place, from the edges that end at each."""
    best = [0.0]
    for own in edges:
        best.append(max([best[begin] + score for begin, score, _ in own]))
    return best


def search(p: Pieces, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best paths, best first: backward A* from the end, where forward scores are what remains exactly.

    Of equal scores those come first whose last pieces are longer. The newest of equal entries goes on, so that ties
    lead straight to the begin instead of into all their variants.
    """
    edges = [list(p.edges(text, end)) for end in range(1, len(text) + 1)]
    best = forward(edges)
    agenda, count, found = [(-best[-1], 0, len(text), 0.0, None)], -1, []
    while agenda and len(found) < n:
        _, _, place, done, path = heapq.heappop(agenda)
        if not place:
            ids: list[int] = []
            while path:
                ids.extend(path[0])
                path = path[1]
            found.append((done, tuple(ids)))
            continue
        for begin, score, ids in reversed(edges[place - 1]):
            heapq.heappush(agenda, (-(best[begin] + score + done), count, begin, done + score, (ids, path)))
            count -= 1
    return found


# ---------------------------------------------------------------- many segments


def solved(p: Pieces, segments: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct segments: all ids of the best paths, bounds, scores, and losses of the second best paths."""
    n = len(segments)
    lengths = pc.utf8_length(segments).to_numpy().astype(np.int64)
    score, loss = np.zeros(n), np.full(n, np.inf)
    counts, done = np.zeros(n, np.int64), []  # done: rows, and their ids in this order
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < n and lengths[order[at]] <= ARRAY_LENGTH:
        most = max(1, ARRAY_PLACES // int(lengths[order[at]] * 1.3 + 1))
        to = min(at + most, int(np.searchsorted(lengths[order], ARRAY_LENGTH, "right")))
        # Neighbouring lengths share an array.
        to = max(at + 1, min(to, int(np.searchsorted(lengths[order], lengths[order[at]] * 1.3 + 1, "right"))))
        rows = order[at:to]
        chars = np.frombuffer("".join(segments.take(pa.array(rows)).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        score[rows], loss[rows], counts[rows], ids = solve_rows(p, chars, lengths[rows])
        done.append((rows, ids))
        at = to
    for i in order[at:]:
        text = segments[int(i)].as_py()
        two = search(p, text, 2)
        score[i], counts[i] = two[0][0], len(two[0][1])
        done.append((np.array([i]), np.array(two[0][1], np.int32)))
        if len(two) > 1:
            loss[i] = two[0][0] - two[1][0]
    bounds = np.concatenate([[0], np.cumsum(counts)])
    every = np.empty(int(bounds[-1]), np.int32)
    for rows, ids in done:
        every[ragged(bounds[rows], counts[rows])] = ids
    return every, bounds, score, loss


def solve_rows(p: Pieces, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of segments of rising lengths, in a row in chars: scores, losses, numbers of ids, ids."""
    # Places first, rows of segments last: each step works on whole rows of memory.
    w, width, row = len(lengths), int(lengths[-1]), np.arange(len(lengths))
    c = np.zeros((width, w), np.uint64)
    c[ragged(np.zeros(w, np.int64), lengths), np.repeat(row, lengths)] = chars.astype(np.uint64) + np.uint64(1)
    most = min(p.longest, width)
    score, number, rare, h = [], [], [], np.zeros((width + 1, w), np.uint64)
    for n in range(1, most + 1):
        h = h[: width - n + 1] * BASE + c[n - 1 :]
        hashes, ids, scores, marks = p.tables[n - 1]
        maybe = np.flatnonzero(marks[marked(h)] & (c[n - 1 :] > 0)) if len(hashes) else np.empty(0, np.int64)
        asked = h.ravel()[maybe]
        at = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
        hit = hashes[at] == asked if len(maybe) else np.empty(0, bool)
        cells, at = maybe[hit], at[hit]
        if n <= DENSE:
            number.append(np.full(h.shape, -1, np.int32))
            score.append(np.full(h.shape, NONE))
            number[-1].ravel()[cells], score[-1].ravel()[cells] = ids[at], scores[at]
        else:  # few stretches of this length are pieces: begins, rows, scores, ids, and where each begin's are
            begin = cells // w
            rare.append((begin, cells % w, scores[at], ids[at], np.searchsorted(begin, np.arange(width + 2))))
    score[0] = np.where((number[0] < 0) & (c > 0), p.unknown, score[0])
    dense = min(most, DENSE)
    ahead = np.full((width + 1, w), NONE)
    ahead[0] = 0
    for end in range(1, width + 1):
        for n in range(1, min(dense, end) + 1):
            np.maximum(ahead[end], ahead[end - n] + score[n - 1][end - n], out=ahead[end])
        for n in range(DENSE + 1, min(most, end) + 1):
            _, who, scores, _, cuts = rare[n - DENSE - 1]
            mine = slice(cuts[end - n], cuts[end - n + 1])
            who = who[mine]
            ahead[end, who] = np.maximum(ahead[end, who], ahead[end - n, who] + scores[mine])
    behind = np.full((width + 1, w), NONE)
    behind[lengths, row] = 0
    for begin in range(width - 1, -1, -1):
        for n in range(1, min(dense, width - begin) + 1):
            np.maximum(behind[begin], score[n - 1][begin] + behind[begin + n], out=behind[begin])
        for n in range(DENSE + 1, min(most, width - begin) + 1):
            _, who, scores, _, cuts = rare[n - DENSE - 1]
            mine = slice(cuts[begin], cuts[begin + 1])
            who = who[mine]
            behind[begin, who] = np.maximum(behind[begin, who], scores[mine] + behind[begin + n, who])
    best = ahead[lengths, row]
    # An edge is on the best path if its end was reached by it: from the last place back, of equal scores the longest.
    open_, steps, loss = np.zeros((width + 1, w), bool), [], np.full(w, np.inf)
    open_[lengths, row] = True
    for end in range(width, 0, -1):
        for n in range(min(most, end), 0, -1):
            begin = end - n
            if n > DENSE:
                _, who, scores, ids, cuts = rare[n - DENSE - 1]
                mine = slice(cuts[begin], cuts[begin + 1])
                who, scores, ids = who[mine], scores[mine], ids[mine]
                if not len(who):
                    continue
                through = ahead[begin, who] + scores
                taken = open_[end, who] & (through == ahead[end, who])
                lost = best[who] - (through + behind[end, who])
                chosen, numbers = who[taken], ids[taken]
            else:
                who = slice(None)
                through = ahead[begin] + score[n - 1][begin]
                taken = open_[end] & (through == ahead[end])
                lost = best - (through + behind[end])
                chosen = np.flatnonzero(taken)
                numbers = number[n - 1][begin, chosen]
            lost = np.where(taken | np.isnan(lost), np.inf, lost)
            loss[who] = np.minimum(loss[who], lost)
            open_[end, chosen], open_[begin, chosen] = False, True
            steps.append((chosen, np.full(len(chosen), begin), numbers))
    who, begin, n = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.empty(0, np.int64),) * 3
    order = np.lexsort((begin, who))
    who, begin, found = who[order], begin[order], n[order].astype(np.int32)
    odd = np.flatnonzero(found < 0)  # characters that no piece has are cut in bytes
    if len(odd):
        spelt = [[p.byte_ids[b] for b in chr(int(x) - 1).encode("utf-8", "surrogatepass")] for x in c[begin[odd], who[odd]]]
        times = np.ones(len(found), np.int64)
        times[odd] = list(map(len, spelt))
        who, found = np.repeat(who, times), np.repeat(found, times)
        found[found < 0] = [b for x in spelt for b in x]
    return best, loss, np.bincount(who, minlength=w), found


def segmented(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts, each with a space before it unless it is empty, cut before runs of spaces and around line breaks.

    Returns the segments in order and the bounds of each text's.
    """
    some = pc.if_else(pc.greater(pc.binary_length(texts), 0), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    texts = pc.binary_join_element_wise(some, texts, pa.scalar("", pa.large_string()))
    data, sizes = bytes_in(texts), pc.binary_length(texts).to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    space, line = data == ord(" "), data == ord("\n")
    first = line | space  # whether a segment begins at a byte
    first[1:] &= line[1:] | ~space[:-1]
    first[1:] |= line[:-1]
    first[ends[:-1][sizes > 0]] = True
    begins = np.flatnonzero(first)
    cuts = pa.py_buffer(np.append(begins, len(data)))
    segments = pa.Array.from_buffers(pa.large_string(), len(begins), [None, cuts, pa.py_buffer(data)])
    return segments, np.searchsorted(begins, ends)


def spelled(p: Pieces, ids: np.ndarray, bounds: np.ndarray, words: pa.Array) -> np.ndarray:
    """Whether each word's ids decode to the word, byte for byte."""
    sizes = p.byte_sizes[ids]
    ends, wanted = np.concatenate([[0], np.cumsum(sizes)]), pc.binary_length(words).to_numpy().astype(np.int64)
    good = np.diff(ends[bounds]) == wanted
    mine = np.repeat(good, np.diff(bounds))
    got = p.all_bytes[ragged(p.byte_begins[ids[mine]], sizes[mine])]
    have = bytes_in(words.filter(pa.array(good)))
    good[np.repeat(np.flatnonzero(good), wanted[good])[got != have]] = False
    return good


def bytes_in(texts: pa.Array) -> np.ndarray:
    """The bytes of large strings without nulls, one after the other."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data and len(ends) else np.empty(0, np.uint8)


class Encoder:
    """Keeps what it has found of the first KEPT_SEGMENTS segments, in a few arrays; one for a worker and model."""

    def __init__(self, path: str) -> None:
        self.p = pieces(path)
        self.words = pa.array([], pa.large_string())
        self.score, self.loss, self.good = np.empty(0), np.empty(0), np.empty(0, bool)
        # The lattice's ids, and the model's own.
        self.ids = [(np.empty(0, np.int32), np.zeros(1, np.int64))] * 2
        self.searches: dict[tuple[str, int], list] = {}

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Of each word the score, the loss, whether its ids decode to it; and, for the lattice's ids and the model's own, all ids, each word's begin and number."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        new = words.take(pa.array(fresh))
        at[fresh] = len(self.words) + np.arange(len(new))
        ids, bounds, score, loss = solved(self.p, new)
        solutions = [(ids, bounds), self.p.own_ids(new)]
        good = np.logical_and.reduce([spelled(self.p, *x, new) for x in solutions])
        scores, losses, goods = (np.concatenate(x) for x in ((self.score, score), (self.loss, loss), (self.good, good)))
        every = []
        for (old, ends), (more, cuts) in zip(self.ids, solutions, strict=True):
            every.append((np.concatenate([old, more]), np.concatenate([ends, ends[-1] + cuts[1:]])))
        room = min(len(new), KEPT_SEGMENTS - len(self.words))
        if room > 0:
            self.words = pa.concat_arrays([self.words, new.slice(0, room)])
            n = len(self.words)
            self.score, self.loss, self.good = scores[:n], losses[:n], goods[:n]
            self.ids = [(x[: ends[n]], ends[: n + 1]) for x, ends in every]
        return scores[at], losses[at], goods[at], [(x, ends[at], ends[at + 1] - ends[at]) for x, ends in every]

    def searched(self, word: str, n: int) -> list[tuple[float, tuple[int, ...], bool]]:
        """The n best paths of a segment: score, ids, whether they decode to it."""
        key = (word, n)
        if key not in self.searches:
            if len(self.searches) >= KEPT_SEARCHES:
                self.searches.clear()
            spell = lambda ids: b"".join(map(self.p.bytes_of.__getitem__, ids)) == word.encode()
            self.searches[key] = [(s, ids, spell(ids)) for s, ids in search(self.p, word, n)]
        return self.searches[key]

    def __call__(self, texts: pa.Array, n: int = BEST) -> Iterator[tuple[np.ndarray, list[tuple[float, np.ndarray]], bool]]:
        """For each text the model's own ids, its n best segmentations, best first (score and ids), and whether all decode to it.

        Bytes of ids in a row are the bytes of each in a row, so a text is decoded by its segments: each distinct one
        is decoded and compared once, and so is each of a segment's other paths.
        """
        texts = filled(texts)
        segments, bounds = segmented(texts)
        whole = whole_texts(texts, segments, bounds)
        coded = segments.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary
        scores, losses, goods, (lattice, own_model) = self.distinct(words)
        spread = lambda every, starts, counts: (every[ragged(starts[codes], counts[codes])], np.concatenate([[0], np.cumsum(counts[codes])]))
        (ids, ends), (model_ids, model_ends) = spread(*lattice), spread(*own_model)
        loss = losses[codes]
        sums = np.concatenate([[0.0], np.cumsum(scores[codes])])
        wrong = np.concatenate([[0], np.cumsum(~goods[codes])])
        for text, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            mine = ids[ends[lo] : ends[hi]]
            out, equal = [(float(sums[hi] - sums[lo]), mine)], bool(whole[text] and wrong[lo] == wrong[hi])
            if n > 1 and hi > lo:
                # Of equal losses those further in front; a loss of infinity means that there is one path only.
                near = loss[lo:hi]
                limit = np.partition(near, n - 2)[n - 2] if hi - lo >= n - 1 else np.inf
                first = np.flatnonzero(near < limit)
                least = np.concatenate([first, np.flatnonzero(near == limit)[: n - 1 - len(first)]])
                combined = [(0.0, ())]
                for k in sorted(least.tolist()):
                    if not np.isfinite(near[k]):
                        continue
                    paths = self.searched(words[int(codes[lo + k])].as_py(), n)
                    own = tuple(ids[ends[lo + k] : ends[lo + k + 1]].tolist())
                    ways = [(0.0, own), *((paths[0][0] - s, x) for s, x, _ in paths if x != own)][:n]
                    equal &= all(good for _, _, good in paths)
                    combined = heapq.nsmallest(
                        n,
                        ((a + b, done + (((k, x),) if i else ())) for a, done in combined for i, (b, x) in enumerate(ways)),
                        key=lambda y: y[0],
                    )
                for lost, changes in combined[1:]:
                    parts, at = [], lo
                    for k, x in changes:
                        parts += [ids[ends[at] : ends[lo + k]], np.array(x, np.int32)]
                        at = lo + k + 1
                    out.append((out[0][0] - lost, np.concatenate([*parts, ids[ends[at] : ends[hi]]])))
            yield model_ids[model_ends[lo] : model_ends[hi]], out, equal


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def whole_texts(texts: pa.Array, segments: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Whether each text's segments in a row are the text, with a space before it unless it is empty."""
    wanted = pc.binary_length(texts).to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(segments).to_numpy().astype(np.int64))])[bounds]
    good = np.diff(ends) == wanted + (wanted > 0)
    if good.all():
        made, spaces = bytes_in(segments), ends[:-1][wanted > 0]
        good[np.flatnonzero(wanted > 0)[made[spaces] != ord(" ")]] = False
        good[np.repeat(np.arange(len(good)), wanted)[np.delete(made, spaces) != bytes_in(texts)]] = False
    return good


def decoded(p: Pieces, ids: np.ndarray) -> str:
    """The text of ids: pieces with their spaces, bytes as they are, without the space that stands before a text."""
    data = b"".join(map(p.bytes_of.__getitem__, ids.tolist()))
    return data.removeprefix(b" ").decode("utf-8", "replace")


def listed(paths: list[np.ndarray]) -> pa.ListArray:
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in paths])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([np.empty(0, np.int32), *paths]), pa.int32()))


def encode(
    docs: DataFrame, path: str, n: int = BEST, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of docs: id, the columns in keep, n_pieces, ids, nbest_scores, nbest_ids, nbest_crc32, decoded_equal.

    The whole text is encoded. ids are the model's own, n_pieces their number. nbest_scores holds the scores of the n
    best segmentations of the lattice, best first (fewer if the text has fewer), nbest_ids each one's ids, nbest_crc32
    their crc32 as little-endian unsigned 32-bit integers. Scores are log-probabilities of the pieces: a unigram
    model's own, by Zipf's law for a BPE model. decoded_equal tells whether decoding gives the text, for ids and
    each of the n. Null and empty texts have one segmentation, without pieces and of score 0. The character U+2581 in a
    text is encoded by its bytes, so that decoding gives it back. Repeated rows are encoded alike; other columns are
    not looked at.
    """
    names = [id_col, *keep]
    whole = T.ArrayType(T.IntegerType())
    schema = T.StructType([docs.schema[c] for c in names]).add("n_pieces", "long").add("ids", whole)
    schema = schema.add("nbest_scores", T.ArrayType(T.DoubleType())).add("nbest_ids", T.ArrayType(whole))
    schema = schema.add("nbest_crc32", T.ArrayType(T.LongType())).add("decoded_equal", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_of = encoder(path)
        for batch in batches:
            for part in pieces_of(batch, text_col, PIECE):
                texts = part.column(text_col)
                own, scores, crcs, equal, paths, many = [], [], [], [], [], []
                for ids, found, same in found_of(texts, n):
                    own.append(ids)
                    scores.append([s for s, _ in found])
                    crcs.append([zlib.crc32(x.astype("<u4").tobytes()) for _, x in found])
                    equal.append(same)
                    paths += [x for _, x in found]
                    many.append(len(found))
                firsts = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                out = [part.column(c) for c in names] + [pa.array(list(map(len, own)), pa.int64()), listed(own)]
                out += [pa.array(scores, pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(firsts), listed(paths))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(crcs, pa.list_(pa.int64())), pa.array(equal)], schema.names)

    return in_small_batches(docs.select(*names, *([text_col] if text_col not in names else []))).mapInArrow(freeing(run), schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of encoded: id and text of the ids. Null ids give a null text."""
    schema = T.StructType([encoded.schema[id_col]]).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            texts = [None if x is None else decoded(p, np.array(x, np.int64)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], schema.names)

    return encoded.select(id_col, F.col(ids_col)).mapInArrow(run, schema)
