"""Fingerprints against the library's hashes one by one, trees and components against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lodestack.llm import simhash
from lodestack.llm.queries import QUERIES
from lodestack.llm.simhash import Trees, bit_counts, edges, fingerprints, shingle_hashes, simhash_groups

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def fingerprint(text):
    """Straight from the definition."""
    line = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in SPACES else c for c in line).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=3):
    """(id, fingerprint) to the least id reachable, by all pairs."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in prints:
        for b, y in prints:
            if (x ^ y).bit_count() <= radius:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i, _ in prints}


def test_texts_that_are_odd():
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "a\x0bb\x0cc  d", "a\x1cb c d", "ÄB c d e f", "x y " * 5000, "w" * 5000, "É É É É"]
    made = fingerprints(pa.array(texts))
    assert made.tolist() == [fingerprint(t) for t in texts]
    assert made[0] == made[1] == made[2] == 0


def test_windows_and_long_runs():
    draw = random.Random(1)
    text = " ".join(draw.choice("alpha beta gamma delta epsilon".split()) + draw.choice(SPACES) for _ in range(4000)).encode()
    whole = np.concatenate(list(shingle_hashes(text)))
    for window in (1, 7, 100, 4096):
        assert np.array_equal(np.concatenate(list(shingle_hashes(text, window=window))), whole)
    h = np.random.default_rng(0).integers(0, 2**64, 200_000, np.uint64)
    bounds = np.array([0, 1, 70_000, 200_000])
    counts = bit_counts(h, bounds)
    for i in range(3):
        own = h[bounds[i] : bounds[i + 1]]
        assert counts[i].tolist() == [int((own >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]


@pytest.mark.parametrize("spread", [2, 8, 64])
def test_search_finds_all_within_the_radius(spread, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    draw = np.random.default_rng(spread)
    flips = np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, spread, (600, 4)).astype(np.uint64), axis=1)
    fps = np.unique(np.uint64(0xDEADBEEFCAFEF00D) ^ flips)
    groups = np.sort(draw.integers(0, 3, len(fps)))
    roots = np.searchsorted(groups, groups)
    found = {(q, n) for a, b in Trees(fps, roots).within(fps, roots, 3) for q, n in zip(a.tolist(), b.tolist(), strict=True)}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    assert found == set(zip(*map(list, np.nonzero(near & (groups[:, None] == groups[None, :]))), strict=True))


def test_emitted_edges_keep_components_without_all_pairs():
    fps = np.arange(512, dtype=np.uint64)  # nine bits: one component, very many links
    ids, roots = np.arange(512), np.zeros(512, np.int64)
    out = list(edges(Trees(fps, roots), ids, fps, ids, roots, 3))
    assert sum(b.num_rows for b in out) == 511


def near_prints(draw, count):
    """Fingerprints with chains of links, a dense group, and loners."""
    out = [draw.getrandbits(64) for _ in range(count)]
    at = draw.getrandbits(64)
    for _ in range(40):
        for _ in range(draw.randint(1, 4)):
            at ^= 1 << draw.randrange(64)
        out.append(at)
    dense = draw.getrandbits(64)
    out += [dense ^ (1 << draw.randrange(6)) ^ (1 << draw.randrange(6)) ^ (1 << draw.randrange(64)) for _ in range(120)]
    return out


@pytest.mark.parametrize(("shard", "tree"), [(4096, 65536), (8, 16), (2, 3)])
def test_links_at_every_size_of_shards(spark, shard, tree):
    prints = list(dict.fromkeys(near_prints(random.Random(shard), 150)))
    signed = [(p - (1 << 64) if p >> 63 else p, 1000 - i) for i, p in enumerate(prints)]
    classes = spark.createDataFrame(signed, "fp long, cls long")
    from lodestack.llm.shared import components as joined

    found = {r.node: r.root for r in joined(simhash.links(classes, 3, shard, tree)).collect()}
    truth = components([(1000 - i, p) for i, p in enumerate(prints)])
    assert {i: found.get(i, i) for i in truth} == truth
    assert len(set(truth.values())) < len(truth) - 50


def test_rows_that_are_odd(spark):
    docs = [(5, None, 1), (3, "", 2), (9, " ", 3), (7, "a b c d", 4), (7, "a b c d", 5), (8, "A B C D", 6), (None, "a b c d", 7), (None, "no one else has this", 8)]
    docs = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, fp int, component_id string")
    found = sorted(map(tuple, simhash_groups(docs).collect()), key=str)
    zero, abcd, lone = "0" * 16, f"{fingerprint('a b c d'):016x}", f"{fingerprint('no one else has this'):016x}"
    assert found == sorted([(5, zero, 3), (3, zero, 3), (9, zero, 3), (7, abcd, 7), (7, abcd, 7), (8, abcd, 7), (None, abcd, 7), (None, lone, None)], key=str)
    assert simhash_groups(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        simhash_groups(docs, radius=4)


def test_query_over_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, fingerprint(r.text)) for r in rows]
    truth = components(prints)
    found = QUERIES["op11_simhash_near_dedup"](spark, SF)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect())) == sorted((i, f"{p:016x}", truth[i]) for i, p in prints)
