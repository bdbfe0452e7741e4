"""Texts cut as they are read give the passages of whole texts, in bounded memory, and only if their hash is right."""

import functools
import hashlib
import json
import os
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from lodestack.functions.text import WHITE_CHARS
from lodestack.operators import chunking, merge
from lodestack.sources import corpus


def whole_passages(text, size):
    """The rule on a whole text, written plainly."""
    out, begin, seq, size = [], 0, 0, max(size, 64)
    while begin < len(text):
        end = len(text)
        if end - begin >= size:
            window = text[begin : begin + size]
            ends = [window.rfind(m) + len(m) for m in ("\n\n", "\n", " ") if m in window]
            end = begin + (ends[0] if ends else size)
        if text[begin:end].strip(WHITE_CHARS):
            out.append((seq, begin, end, text[begin:end]))
        begin, seq = end, seq + 1
    return out


def whole_lines(text, size):
    lines = [x.removesuffix("\r") for x in (text.removesuffix("\n").split("\n") if text else [])]
    out, at = [], 0
    while at < len(lines):
        upto, held = at + 1, len(lines[at].encode()) + 1
        while upto < len(lines) and held + len(lines[upto].encode()) + 1 <= size:
            held, upto = held + len(lines[upto].encode()) + 1, upto + 1
        out.append((len(out), at + 1, upto, "\n".join(lines[at:upto])))
        at = upto
    return out


def texts(count):
    rng = random.Random(11)
    alphabet = ["a", "bc", " ", " ", "\n", "\n\n", "\r\n", "é", "🌊", "word ", "x" * 90, " " * 150, "　"]
    for _ in range(count):
        text = "".join(rng.choices(alphabet, k=rng.randrange(0, 120)))
        places = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(0, 30)))
        yield text, [text[a:b] for a, b in zip([0, *places], [*places, len(text)], strict=True)], rng.choice([1, 64, 65, 100, 700])


def test_parts_give_what_whole_texts_give():
    for text, parts, size in texts(1500):
        want = whole_passages(text, size)
        assert list(chunking.passages_of(iter(parts), size)) == want == list(chunking.passages(text, size))
        want = whole_lines(text, size)
        assert list(chunking.packed_lines_of(iter(parts), size)) == want == list(chunking.packed_lines(text, size))


def test_bytes_cut_anywhere(tmp_path, monkeypatch):
    """Parts of a few bytes split characters; the text and the digest are those of the whole file."""
    rng = random.Random(3)
    for k in range(200):
        data = b"".join(rng.choices(["é🌊a".encode(), b"\xff", b"\xe2\x82", b"plain ", b"\xf0\x9f", b"\n"], k=rng.randrange(0, 40)))
        (tmp_path / f"{k}").write_bytes(data)
        monkeypatch.setattr(corpus, "TEXT_BYTES", rng.choice([1, 2, 3, 5, 7]))
        digest = hashlib.sha256()
        assert "".join(corpus.text_parts(str(tmp_path / f"{k}"), digest, False)) == data.decode("utf-8", "replace")
        assert digest.hexdigest() == hashlib.sha256(data).hexdigest()
        try:
            want = data.decode()
        except UnicodeDecodeError:
            with pytest.raises(UnicodeDecodeError):
                list(corpus.text_parts(str(tmp_path / f"{k}"), hashlib.sha256(), True))
        else:
            assert "".join(corpus.text_parts(str(tmp_path / f"{k}"), hashlib.sha256(), True)) == want


@pytest.mark.parametrize("cut", [chunking.passages_of, chunking.packed_lines_of])
def test_memory_is_bounded(tmp_path, cut):
    """64 MB of text in less than 16 MB."""
    path = tmp_path / "large.md"
    with open(path, "wb") as out:
        for k in range(64):
            out.write((f"line {k} é of some words\n" * 40_000).encode()[: 1 << 20])
    tracemalloc.start()
    digest, total = hashlib.sha256(), 0
    for *_, text in cut(corpus.text_parts(str(path), digest, False), 2000):
        total += len(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20 and total > 50 << 20 and digest.hexdigest() == hashlib.sha256(path.read_bytes()).hexdigest()


def test_files(spark, tmp_path):
    """Passages and states are those of contents(); of files that are stale, invalid or deferred no passage is used."""
    root = tmp_path / "files"
    root.mkdir()
    bodies = {f"{k}.md": text.encode() for k, (text, _, _) in enumerate(texts(40))}
    bodies |= {"empty.md": b"", "blank.md": b" \n\n ", "bad.md": b"good start " * 50 + b"\xff", "large.md": b"words of a large file\n" * 200_000}
    for name, body in bodies.items():
        (root / name).write_bytes(body)
    entries = corpus.entries(corpus.file_paths(spark, str(root)), str(root)).collect()
    (root / "0.md").write_bytes(b"longer than before " * 100)
    (root / "1.md").unlink()
    stat = os.stat(root / "large.md")
    for name in ("large.md",):  # other bytes, same size and time
        (root / name).write_bytes(bodies[name][::-1])
        os.utime(root / name, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    for strict in (False, True):
        frame = spark.createDataFrame(entries, corpus.SCHEMAS["manifest"])
        cut = corpus.cut_files(frame.repartition(3), str(root), functools.partial(chunking.passages_of, max_chars=100), strict)
        cut.write.mode("overwrite").parquet((tmp_path / "cut").as_uri())
        cut = spark.read.parquet((tmp_path / "cut").as_uri())
        want = corpus.contents(frame, str(root), strict).collect()
        states = {r.rel_path: r.state for r in want}
        assert {r.rel_path: r.state for r in cut.where("state is not null").collect()} == states
        assert states["large.md"] == "stale" and states["0.md"] == states["1.md"] == "deferred" and states["bad.md"] == ("invalid" if strict else "ok")
        got = sorted((r.rel_path, r.seq, r.start_offset, r.end_offset, r.text) for r in corpus.verified_passages(cut).collect())
        assert got == sorted((r.rel_path, *p) for r in want if r.state == "ok" for p in whole_passages(r.text, 100))
        assert cut.where("state is null and rel_path = 'large.md'").count() > 0


def test_files_are_hashed_once_and_spread(spark, tmp_path, monkeypatch):
    """The list of a run comes of one look at each file, by several tasks, however few bytes the paths have."""
    root, log = tmp_path / "files", tmp_path / "log"
    for folder in (root, log):
        folder.mkdir()
    for k in range(60):
        (root / f"{k:02d}é.md").write_text(f"text {k}")
    at = str(log)

    def seen(batches):
        import uuid

        for batch in batches:
            for path in batch.column("rel_path").to_pylist():
                with open(f"{at}/{os.getpid()}-{uuid.uuid4().hex}", "w") as out:
                    out.write(path)
            yield batch

    kept = corpus.entries
    monkeypatch.setattr(corpus, "entries", lambda paths, root: kept(paths, root).mapInArrow(seen, corpus.SCHEMAS["manifest"]))
    frozen = corpus.freeze(spark, str(root), str(tmp_path / "m"), "r")
    assert sorted(p.read_text() for p in log.iterdir()) == sorted(p.name for p in root.iterdir())
    with open(frozen.path, encoding="utf-8") as lines:
        found = [json.loads(line) for line in lines]
    want = [(p.name, hashlib.sha256(p.read_bytes()).hexdigest()) for p in sorted(root.iterdir())]
    assert [(e["rel_path"], e["sha256"]) for e in found] == want and list(found[0]) == ["rel_path", "mtime_ns", "size", "sha256"]
    cut = corpus.cut_files(corpus.spread(frozen.entries), str(root), functools.partial(chunking.passages_of, max_chars=100))
    assert cut.select(F.spark_partition_id()).distinct().count() > 4
    wide = cut.where("state is null").select(F.col("rel_path").alias("path"), "seq", "text")
    wide = wide.unionByName(wide.withColumn("seq", F.lit(7).cast("long")))
    numbers = [{(r.path, r.seq): r.k for r in f.collect()} for f in (merge.numbered(wide, ["path", "seq"], "k", 40), merge.numbered_within(wide, "path", "seq", "k", 40))]
    assert numbers[0] == numbers[1] and sorted(numbers[1].values()) == list(range(41, 161))
