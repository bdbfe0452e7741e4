"""Each operator against a brute-force version, and with nulls, empty and long texts, repeats, empty tables, odd columns."""

import base64
import hashlib
import itertools
import math
import random
import re
import zipfile
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestack.llm import exactdup, langid, licenses, mixing, neardup, pieces, queries, shared, tokens, topk, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, ties and repeats, and columns named as the operators name theirs."""
    rows = [
        (0, None, None, None, None),
        (1, "", "en", "a", 0),
        (2, " \n\t ", "en", "a", 4),
        (3, "The Cat sat on THE mat and so on it went", "en", "a", 40),
        (4, "the cat sat on the mat and so on it went", "en", None, 40),
        (4, "the cat sat on the mat and so on it went", "en", None, 40),
        (5, "word " * 30_000, "en", "b", 150_000),
        (6, "É und ß nicht", "de", "b", 13),
        (7, "é und ß nicht", "de", "c", 13),
        (8, "x" * 50_000, None, "c", 50_000),
        (9, "a b", "en", "c", 3),
        (None, "no id here", "en", "c", 10),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for clash in ("id", "n", "u", "v", "key", "size", "h", "label", "bytes", "score", "keep_id", "start", "_id"):
        df = df.withColumn(clash, F.lit("clash"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- shared


def test_lookup_hot_and_cold(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("k % 2 = 1")
    inner = shared.lookup(left, right, "k", "n")
    assert inner.count() == left.where("k % 2 = 1").count()
    outer = shared.lookup(left, right, "k", "n", "left")
    assert outer.count() == 5000 and outer.where("low is null").count() == left.where("k % 2 = 0").count()


def test_components_random(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in parent if x not in alone}
    assert shared.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_forest_keeps_connectivity():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 200, 500), rng.integers(0, 200, 500)
    forest = shared.Forest()
    at = forest.index(np.concatenate([a, b]))
    used = forest.add(at[:500], at[500:])
    assert len(used) < 200
    other = shared.Forest()
    at2 = other.index(np.concatenate([a, b]))
    other.add(at2[:500][used], at2[500:][used])
    assert np.array_equal(forest.root(at), other.root(at2))


def test_whole_groups_across_batches():
    keys = np.sort(np.random.default_rng(1).integers(0, 30, 500))
    table = pa.table({"k": keys, "v": np.arange(500)})
    for size in (1, 7, 100, 500):
        parts = list(shared.whole_groups(table.to_batches(size), ["k"]))
        assert pa.concat_tables(parts).equals(table)
        ends = [set(p.column("k").to_pylist()) for p in parts]
        assert sum(map(len, ends)) == len(set().union(*ends))


def test_sifted_loses_nothing(spark):
    some = shared.stored(spark.range(0, 10_000, 7).select(F.xxhash64("id").alias("h")), "some")
    rows = spark.range(10_000).withColumn("_word", F.lit("clash"))
    maybe, sure = shared.sifted(rows, F.xxhash64("id"), some)
    assert maybe.count() + sure.count() == 10_000 and maybe.columns == rows.columns
    assert maybe.where("id % 7 = 0").count() == 1429 and maybe.count() < 2800
    none = shared.stored(spark.createDataFrame([], "h long"), "none")
    assert shared.sifted(rows, F.xxhash64("id"), none)[1].count() == 10_000


def test_lookup_spreads_rows_without_a_key(spark):
    left = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("k"), "id")
    right = shared.stored(left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")), "right")
    found = shared.lookup(left, right, "k", "n", "left")
    assert found.count() == 4000 and found.where("m = id").count() == 1000
    assert found.where("k is null").select(F.spark_partition_id()).distinct().count() > 1


# ---------------------------------------------------------------- 1


def page_truth(rows, least=0):
    top = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if i is not None:
            top[p] = max(i, top.get(p, i))
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        old = len(p) >= least and p in top and top[p] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if old else "response", top[p] if old else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b\r\n c", None), (4, "", ""), (5, "u", "é" * 90_000), (5, "u", "é" * 90_000), (None, "n", "<p>x</p>"), (7, "k", "ab"), (8, "k", "ab")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    got = warc.round_trip(spark, pages, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=str) == page_truth(rows, least)


def test_warc_empty_and_payloads(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(spark, pages).count() == 0
    pages = spark.createDataFrame([(1, "http://a", "<b>é</b>")], "page_id long, url string, html string")
    written = warc.write_archives(pages, f"file://{tmp_path}/w")
    row = warc.read_archives(written).first()
    assert bytes(row.payload).decode() == "<b>é</b>" and row.url == "http://a"
    path = written.first().uri.removeprefix("file://")
    with zipfile.ZipFile(path) as z:  # another reader agrees
        assert {i.filename for i in z.infolist()} == {warc.DATA, warc.INDEX, warc.PACKAGE}
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


def test_zip64_directory(tmp_path):
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for k in range(66_000):
            z.writestr(f"m{k}", b"%d" % k)
    with pa.OSFile(str(path)) as f:
        archive = warc.Archive(f)
        assert len(archive.members) == 66_000
        assert all(archive.read(f"m{k}") == b"%d" % k for k in (0, 1, 65_535, 65_999))
    path.write_bytes(b"not a zip")
    with pa.OSFile(str(path)) as f, pytest.raises(ValueError):
        warc.Archive(f)


def test_warc_damage_is_seen():
    data = warc.record(1, "http://a", b"payload", None)
    with pytest.raises(ValueError):
        warc.parsed(data.replace(b"payload", b"paylxad"))


# ---------------------------------------------------------------- 2

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def library_edges():
    """Pieces as the library lists them, with log-probabilities by Zipf's law of their ranks; and bytes."""
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    order = sorted(sp.get_score(i) for i in plain)[::-1]
    rank = {s: k for k, s in reversed(list(enumerate(order)))}
    total = math.log(math.fsum(1 / (rank[s] + 1) for s in order))
    score = lambda i: round((-math.log(rank[sp.get_score(i)] + 1) - total) * 2**20) / 2**20
    of = {sp.id_to_piece(i).replace("▁", " "): (i, score(i)) for i in plain}
    return of, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def best_paths(edges, text, n):
    """The n best of the whole text by lists of n at each place."""
    of, byte_ids = edges
    least = min(s for _, s in of.values())
    text = f" {text}" if text else ""
    best = [[(0.0, ())]] + [[] for _ in text]
    for end in range(1, len(text) + 1):
        made = [(s + of[text[k:end]][1], (*ids, of[text[k:end]][0])) for k in range(end) if text[k:end] in of for s, ids in best[k]]
        if text[end - 1] not in of:
            made += [(s + least - 10, (*ids, *(byte_ids[b] for b in text[end - 1].encode()))) for s, ids in best[end - 1]]
        best[end] = sorted(made, key=lambda x: -x[0])[:n]
    return best[-1]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_nbest_exact(n):
    edges, p, encoder = library_edges(), pieces.pieces(MODEL), pieces.Encoder(MODEL)
    rng = random.Random(n)
    texts = ["", "a", "  two  spaces ", "\n\nx\ny", "日本 語 ▁ x\x00\x01", "zq" * 60, None]
    texts += ["".join(rng.choice("abe the\n é") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    for text, (_, got, equal) in zip(texts, encoder(pa.array(texts), n), strict=True):
        want = best_paths(edges, text or "", n)
        assert [s for s, _ in got] == [s for s, _ in want]
        assert len({tuple(i) for _, i in got}) == len(got)
        for _, ids in got:
            assert pieces.decoded(p, ids) == (text or "")


def test_pieces_odd_tables(spark):
    got = pieces.encode(odd_docs(spark), MODEL, keep=("lang",)).collect()
    assert len(got) == 12 and all(r.decoded_equal for r in got)
    assert [r.n_pieces for r in got if r.doc_id in (0, 1)] == [0, 0]
    back = pieces.decode(pieces.encode(odd_docs(spark), MODEL), MODEL).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((r.doc_id or -1, r.text or "") for r in odd_docs(spark).collect())
    assert pieces.encode(empty_docs(spark), MODEL).count() == 0


# ---------------------------------------------------------------- 3


@pytest.mark.parametrize("kind", ["clusters", "walks"])
def test_top_k_agrees_with_all_scores(kind):
    rng = np.random.default_rng(2)
    if kind == "clusters":  # dimensions in no order: segments say little
        x = (rng.normal(0, 200, (20, 64))[rng.integers(0, 20, 3000)] + rng.normal(0, 20, (3000, 64))).astype(np.int64)
    else:  # neighbouring dimensions are alike: segments say nearly all
        x = np.cumsum(rng.normal(0, 60, (3000, 64)), 1).astype(np.int64)
    q, ids = x[::100], np.arange(3000)
    a, b, score, pairs = topk.best(q, ids[::100], x, ids, 10)
    if kind == "walks":
        assert pairs < 0.05 * len(q) * len(x)
    full = q @ x.T
    for k in range(len(q)):
        order = sorted((j for j in range(3000) if j != ids[::100][k]), key=lambda j: (-full[k, j], j))[:10]  # noqa: B023
        assert b[a == k].tolist() == order


def test_top_k_over_many_blocks(spark, monkeypatch):
    """Blocks of vectors and of queries, groups of query blocks, and floors, against all scores; and the plan."""
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "QUERY_GROUP", 2)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(700, 24)), np.repeat(rng.normal(size=(20, 24)), 15, 0)]).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(5000 + i, [1.0] * i) for i in range(1, 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(vectors, F.col("vec_id") % 9 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = np.floor(x.astype(float) * 1024).astype(np.int64)
    scores = whole @ whole.T
    for q in range(0, 1000, 9):
        order = [k for k in np.lexsort((np.arange(1000), -scores[q])).tolist() if k != q][:10]
        assert sorted(got[q]) == [(n, k, scores[q, k]) for n, k in enumerate(order, 1)]
    assert set(got) == set(range(0, 1000, 9))


def test_top_k_odd_rows(spark):
    rows = [(0, [0.5, 0.25]), (0, [0.5, 0.25]), (100, [1.0, float("nan")]), (200, None), (300, [1.0, None]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-0.001, 0.0]), (4, [1.0]), (400, [2.0]), (None, [1.0, 1.0]), (5, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, k=2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 512 * 512 + 256 * 256), (0, 2, 2, 512 * 512 + 256 * 256), (400, 1, 4, 2048 * 1024)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# ---------------------------------------------------------------- 4

BPE = public_tokenizers.path("byte_bpe_50k.json")


def token_truth(rows):
    of, out, start = Tokenizer.from_file(BPE), [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = of.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(20, "  a  b \n c\td 's  "), (21, "<|endoftext|> x"), (22, "it's 3  o'clock   x")], "doc_id long, text string"), allowMissingColumns=True)
    got = [tuple(r) for r in tokens.token_digests(spark, docs, BPE).orderBy("start").collect()]
    assert got == token_truth([(r.doc_id, r.text) for r in docs.collect()])
    assert tokens.token_digests(spark, empty_docs(spark), BPE).count() == 0


def test_token_width(spark, tmp_path):
    writer = tokens.FrameWriter(pa.OSFile(str(tmp_path / "w"), "wb"), "<u2")
    writer.add(1, np.array([65_535], np.uint32))
    with pytest.raises(OverflowError):
        writer.add(2, np.array([70_000], np.uint32))


def test_token_file_reads_single_documents(tmp_path):
    path = tmp_path / "x.zst"
    with pa.OSFile(str(path), "wb") as f:
        w = tokens.FrameWriter(f, "<u2")
        for k in range(50):
            w.add(k, np.arange(k, dtype=np.uint32))
        w.close()
    with pa.OSFile(str(path)) as f:
        r = tokens.FrameReader(f)
        assert r.doc_ids == list(range(50)) and r.read(33).tolist() == list(range(33)) and r.read(0).tolist() == []
        assert [len(x) for _, x in r.all(64)] == list(range(50))
    data = bytearray(path.read_bytes())
    data[int(r.starts[40]) + 12] ^= 0xFF
    path.write_bytes(bytes(data))
    with pa.OSFile(str(path)) as f, pytest.raises(Exception):  # noqa: B017
        tokens.FrameReader(f).read(40)
    with pa.OSFile(str(path)) as f:
        assert tokens.FrameReader(f).read(39).tolist() == list(range(39))


# ---------------------------------------------------------------- 5


def test_licenses():
    mit = licenses.NOTICES["MIT"][0]
    found = licenses.found_in("Copyright 2020 A.\n\n" + mit.replace("furnished", "given") + "\nThe above copyright notice stays.")
    assert [(x["license"], x["missing"], x["between"]) for x in found] == [("MIT", ["furnished"], ["given"])]
    found = licenses.found_in("foo bar. " * 100 + "\nThis is licensed under the GNU General Public License, version 2.\nSPDX-License-Identifier: GPL-3.0-only")
    assert [x["license"] for x in found] == ["GPL-2.0", "GPL-3.0"]
    assert licenses.found_in("The license plate of my car. " * 20) == []
    text = "é\nReleased under the\nMIT License."
    (one,) = licenses.found_in(text)
    assert text[one["start"] : one["end"]] == "Released under the\nMIT License"


def test_license_scan_tables(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(30, "x\nLicensed under CC BY-NC 4.0."), (30, "x\nLicensed under CC BY-NC 4.0.")], "doc_id long, text string"), allowMissingColumns=True)
    got = licenses.scan(docs).collect()
    assert [(r.doc_id, r.license) for r in got] == [(30, "CC-BY-NC-4.0")] * 2
    assert licenses.scan(empty_docs(spark)).count() == 0


def test_license_statements_all_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {"MIT": "the MIT License", "Apache-2.0": "the Apache License, Version 2.0", "GPL-3.0": "the GNU General Public License, version 3", "CC-BY-NC-4.0": "CC BY-NC 4.0"}
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        for name, words in want.items():
            assert ((r.doc_id, name) in got) == (words in r.text)


# ---------------------------------------------------------------- 6


def test_toxicity_learns_and_scores(spark):
    rng = random.Random(0)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = rng.choices(words, k=40)
        if toxic:
            text.insert(rng.randrange(40), rng.choice(["badword", "worseword"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs.where("doc_id < 400"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    seen = np.unique(toxicity.features([t for _, t in rows[:400]])[0])
    assert len(model.at) < 0.1 * len(seen)  # sparse: most features that were seen have no weight
    got = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    assert sum(got[i].predicted == labels[i][1] for i in range(400, 600)) >= 195
    odd = toxicity.scores(odd_docs(spark), model, keep=("lang",)).collect()
    assert len(odd) == 12 and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (0, 1, 2)}) == 1
    none = toxicity.fit(docs, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    assert [(r.score, r.predicted) for r in toxicity.scores(docs.limit(1), none).collect()] == [(0.0, 0)]
    few = toxicity.fit(docs, spark.createDataFrame([(k, 0) for k in range(1, 6)], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.scores(docs, few).collect()} == {0}
    assert toxicity.scores(empty_docs(spark), model).count() == 0


def test_ftrl_against_plain_sums(spark):
    """The published update, one coordinate at a time in dictionaries, over the same rows in the same order."""
    rng = random.Random(3)
    words = [f"w{chr(97 + k)}" for k in range(26)]
    rows = [(i, " ".join(rng.choices(words, k=12) + (["bad", "worse"] if i % 3 == 0 else []))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id")).collect()]
    z, n, w = {}, {}, {}
    for _ in range(toxicity.EPOCHS):
        for i in order:
            buckets, _ = toxicity.features([rows[i][1]])
            at = sorted(set(buckets.tolist()))
            for b in at:
                zb, nb = z.get(b, 0.0), n.get(b, 0.0)
                rate = (toxicity.BETA + math.sqrt(nb)) / toxicity.ALPHA + toxicity.L2
                w[b] = 0.0 if abs(zb) <= toxicity.L1 else -(zb - math.copysign(toxicity.L1, zb)) / rate
            p = 1 / (1 + math.exp(-math.fsum(w[b] for b in at) - model.constant))
            g = p - (i % 3 == 0)
            for b in at:
                nb = n.get(b, 0.0)
                z[b] = z.get(b, 0.0) + g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / toxicity.ALPHA * w[b]
                n[b] = nb + g * g
    rate = lambda b: (toxicity.BETA + math.sqrt(n[b])) / toxicity.ALPHA + toxicity.L2
    want = {b: -(z[b] - math.copysign(toxicity.L1, z[b])) / rate(b) for b in z if abs(z[b]) > toxicity.L1}
    assert math.isclose(model.constant, math.log(40.5 / 80.5))
    assert want and dict(zip(model.at.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(want, rel=1e-9)


def test_toxicity_features_are_whole():
    buckets, owner = toxicity.features(["a b c", "", "a"])
    assert np.bincount(owner, minlength=3).tolist() == [3 + 3 + 2 + 1, 0, 2]
    assert set(buckets[owner == 2]) < set(buckets[owner == 0])


# ---------------------------------------------------------------- 7


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    scores, bounds = rng.normal(0, 5, (16, 3)).astype(np.float32), np.array([0, 0, 5, 6, 13, 16])
    got = langid.viterbi(scores, bounds, 4.0)
    for lo, hi in itertools.pairwise(bounds):
        value = lambda p: sum(scores[lo + k, x] for k, x in enumerate(p)) - 4 * sum(a != b for a, b in itertools.pairwise(p))  # noqa: B023, E731
        best = max(map(value, itertools.product(range(3), repeat=int(hi - lo))))
        assert abs(value(got[lo:hi]) - best) < 1e-3


def test_language_spans_and_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("doc_id % 4 <> 0"))
    held = langid.languages(docs.where("doc_id % 4 = 0"), model, keep=("lang",))
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    mixed = spark.createDataFrame([(1, "the and of that with the this for. Der die und nicht mit von ist der. the of and to is it")], "doc_id long, text string")
    (row,) = langid.languages(mixed, model).collect()
    assert [s.lang for s in row.spans] == ["en", "de", "en"]
    assert mixed.first().text[row.spans[1].start : row.spans[1].end].startswith("Der die")


def test_language_odd_tables(spark):
    docs = odd_docs(spark)
    got = {r.doc_id: r for r in langid.languages(docs, langid.fit(docs), keep=("lang",)).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[0].score == 0
    assert got[7].lang_pred == "de" and got[8].lang_pred in ("de", "en")
    none = langid.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in langid.languages(docs, none).collect()} == {"und"}
    assert langid.languages(empty_docs(spark), langid.fit(empty_docs(spark))).count() == 0


def test_scripts_narrow_candidates(spark):
    rows = [(k, t, x) for k, (t, x) in enumerate([("привет мир как дела", "ru"), ("hello world how are you", "en")] * 5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.languages(spark.createDataFrame([(1, "мир"), (2, "how"), (3, "مرحبا")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in got][:2] == ["ru", "en"] and got[2].lang_pred in ("ru", "en")


# ---------------------------------------------------------------- 8


def shingles(text, n=5):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_truth(rows, hundred):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= hundred * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def families_of_copies(seed, families=12, size=14):
    """Groups of texts with different numbers of changed words, so that links are above, at and below the limit."""
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 6, 30, 120, 400]))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((k, " ".join(text).upper() if rng.random() < 0.1 else " ".join(text)))
            k += 1
    return rows


@pytest.mark.parametrize("hundred", [80, 85])
def test_near_groups_against_all_pairs(spark, hundred, monkeypatch):
    rows = families_of_copies(hundred)
    want = near_truth(rows, hundred)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_groups(docs, per_hundred=hundred).collect()}
    assert got == want


def test_near_groups_in_many_blocks(spark, monkeypatch):
    """Lists and families are cut in blocks: the same result."""
    monkeypatch.setattr(neardup, "LIST_BLOCK", 4)
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", 3)
    monkeypatch.setattr(neardup, "PAIRS", 16)
    rows = families_of_copies(7, 4, 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_groups(docs, per_hundred=85).collect()}
    assert got == near_truth(rows, 85)


def test_near_groups_odd_tables(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_groups(odd_docs(spark)).collect()), key=str)
    by = {g[0]: g for g in got}
    assert by[0] == (0, 0, 0, True) and by[1] == (1, 0, 1, True) and by[2][1] == 0
    assert by[4] == (4, 7, 3, False) and by[3] == (3, 7, 3, True) and len(got) == 12
    assert by[5][1] == 1 and by[9][1] == 1 and by[6][2] == 6 and by[7][2] == 7
    assert neardup.near_groups(empty_docs(spark)).count() == 0


def test_miss_probability():
    assert neardup.least_matches(0.85, 64, 1e-6) == 39 and neardup.least_matches(0.8, 64, 1e-6) == 34


# ---------------------------------------------------------------- 9


def test_without_copies_keeps_what_the_groups_keep(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(k, "t" * (70 + k % 3) + str(k % 5), "en", "a", 1) for k in range(100, 160)], DOCS), allowMissingColumns=True)
    kept = {(r.doc_id, r.text_sha256) for r in exactdup.exact_groups(docs).where("kept").collect()}
    got = exactdup.without_copies(docs)
    assert got.columns == docs.columns
    found = [(r.doc_id, hashlib.sha256(lower(r.text or "").encode()).hexdigest()) for r in got.collect()]
    assert set(found) == kept and len(found) == len(kept) + 1  # id 4 stands there twice
    assert exactdup.without_copies(empty_docs(spark)).count() == 0


def test_exact_groups(spark):
    got = exactdup.exact_groups(odd_docs(spark))
    by = {}
    for r in odd_docs(spark).collect():
        by.setdefault(lower(r.text or ""), []).append(r.doc_id)
    want = []
    for text, ids in by.items():
        top = max((i for i in ids if i is not None), default=None)
        want += [(i, top, len(ids), i == top, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert exactdup.exact_groups(empty_docs(spark)).count() == 0
    kept = exactdup.without_copies(odd_docs(spark))
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 1, 2, 4, 4, 5, 6, 7, 8, 9]
    assert kept.columns == odd_docs(spark).columns


# ---------------------------------------------------------------- 10


def fill(sizes):
    """Targets by repeated sharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        shares = {s: rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        above = {s for s in shares if shares[s] >= 3 * sizes[s]}
        if not above:
            return shares | {s: 3.0 * sizes[s] for s in full}
        full |= above


@pytest.mark.parametrize("seed", range(3))
def test_mix_budgets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randrange(60), rng.choice(["a", "b", "B", "é", None, "z"] + ["hot"] * 8)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_words(docs, ranges=16).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t))
    want = fill(sizes)
    source = {i: s for i, _, s in rows}
    for s in sizes:
        mine = [r for r in got if source[r.doc_id] == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 for r in mine)
        assert sum(r.taken for r in mine) == int(want[s] + 0.5)
        assert sum(r.taken % max(1, r.size) != 0 for r in mine) <= 1 and all(r.taken <= 3 * r.size for r in mine)
    again = {tuple(r) for r in mixing.mixed_words(docs.repartition(5)).collect()}
    assert again == {tuple(r) for r in got}
    made = mixing.mixed_documents(docs)
    words = made.select(mixing.words_in(F.col("text")).alias("n"), "source").groupBy("source").agg(F.sum("n").alias("n")).collect()
    assert {r.source: r.n for r in words} == {s: int(want[s] + 0.5) for s in want if int(want[s] + 0.5)}


def test_mix_odd_tables(spark):
    got = mixing.mixed_words(odd_docs(spark)).collect()
    assert len(got) == 12 and [r.taken for r in got if r.doc_id in (0, 1, 2)] == [0, 0, 0]
    assert mixing.mixed_words(empty_docs(spark)).count() == 0 and mixing.mixed_documents(empty_docs(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mixed_words(blank).collect()] == [(0.0, 0)] * 2


# ---------------------------------------------------------------- queries


def test_queries_are_complete():
    numbers = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES)
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", ["op4_token_files", "op6_toxicity", "op7_language_id"])
def test_query_covers_whole_table(spark, name):
    got = queries.QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.select("doc_id").distinct().count() == got.count() == docs.count()


def test_token_query_against_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in queries.QUERIES["op4_token_files"](spark, SF).orderBy("start").collect()]
    assert got == token_truth([(r.doc_id, r.text) for r in docs.collect()])


def test_no_module_reads_local_paths():
    for path in Path(queries.__file__).parent.glob("*.py"):
        assert "tempfile" not in path.read_text() and "localCheckpoint" not in path.read_text()
