"""The corpus as a data source against the present reader: rows, filters, ranges, streams that go on."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestack.sources import corpus, datasource
from lodestack.sources.datasource import Pushed, Rules, Span, cuts, register_corpus, walk


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    names = [f"{d}{k}.md" for d in ("", "a/", "a-b/", "a/b/", "a.d/", "ü/", "z/y/x/") for k in range(12)]
    names += [".hidden/x.md", "a/.x.md", "a/logo.PNG", "a/plain", "a/b.tar.gz", "a/dot.", "z/𝄞.md"]
    for k, name in enumerate(names):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x" * (k * 37 % 400))
    (root / "empty").mkdir()
    os.symlink(root / "a", root / "link")
    with open(os.path.join(os.fsencode(root), b"\xff.md"), "wb") as file:
        file.write(b"x")
    return root


def load(spark, root, **options):
    register_corpus(spark)
    return spark.read.format("corpus").options(root=str(root), **options).load()


def plain(spark, root, *about):
    found = corpus.entries(corpus.file_paths(spark, str(root), *about), str(root)).collect()
    return sorted(map(tuple, found))


def test_walk_order_and_spans(root):
    """Any span of the walk is what a list of all paths holds in it; backward is the reverse."""
    rules = Rules(str(root))
    every = [p for p, _ in walk(rules)]
    assert every == sorted(every) and len(every) == len(set(every)) == 87
    assert [p for p, _ in walk(rules, backward=True)] == every[::-1]
    marks = ["", "a", "a/", "a/b", "a/b/3.md", "a-b/9.md", "a0", "z/y/x/11.md", "zz", *every[::9]]
    for after in marks:
        for upto in [None, *marks]:
            want = [p for p in every if p > after and (upto is None or p <= upto)]
            assert [p for p, _ in walk(rules, Span(after, upto))] == want, (after, upto)


def test_cuts_cover_all(root):
    rules = Rules(str(root))
    every = [p for p, _ in walk(rules)]
    for size in (1, 500, 3000, 10**9):
        parts = list(cuts(rules, Span(), Pushed(), size, 100))
        assert [p for s in parts for p, _ in walk(rules, s)] == every
        for s in parts:
            held = [os.path.getsize(root / p) + 100 for p, _ in walk(rules, s)]
            assert sum(held[:-1]) < size  # no range goes on once it is full


def test_rows_agree(spark, root):
    assert sorted(map(tuple, load(spark, root, partitionbytes="2000", openbytes="100").collect())) == plain(spark, root)
    assert sorted(map(tuple, load(spark, root, include=r"^a/").collect())) == plain(spark, root, r"^a/")
    parent = re.escape(str(root.parent))
    assert sorted(map(tuple, load(spark, root, include=f"^{parent}.*/b/", legacy="true").collect())) == plain(spark, root, f"^{parent}.*/b/", True)
    assert load(spark, root, partitionbytes="2000", openbytes="100").rdd.getNumPartitions() > 5
    narrow = spark.read.format("corpus").schema("size long, rel_path string").option("root", str(root)).load()
    assert sorted((r.rel_path, r.size) for r in narrow.collect()) == [(r[0], r[2]) for r in plain(spark, root)]


FILTERS = [
    "rel_path = 'a/3.md'", "rel_path = 'absent'", "rel_path like 'a/%'", "rel_path like '%3.md'", "rel_path like '%b/%'", "rel_path > 'a/b'", "rel_path >= 'a/3.md'",
    "rel_path < 'a/3.md'", "rel_path <= 'a/3.md'", "rel_path in ('0.md', 'ü/4.md', 'no')", "size > 200", "size = 0", "size <= 37 and rel_path like 'z/%'", "rel_path is not null",
    "rel_path is null", "sha256 like '0%'", "size > 300 or rel_path like 'ü/%'", "not rel_path like 'a%'", "rel_path like '' or size = 37", "rel_path = ''", "mtime_ns > 0 and rel_path > 'z'", "rel_path like 'z/𝄞%'",
]


def test_filters(spark, root):
    every = load(spark, root).collect()
    held = spark.createDataFrame(every, corpus.SCHEMAS["manifest"])
    for rule in FILTERS:
        got = load(spark, root, partitionbytes="2000", openbytes="100").where(rule)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, held.where(rule).collect())), rule


def test_plan_shows_pushed_filters(spark, root):
    found = load(spark, root).where("rel_path like 'a/%' and size > 10 and length(rel_path) > 2")
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "PushedFilters" in plan and "StringStartsWith(rel_path,a/)" in plan and "GreaterThan(size,10)" in plan
    tested = plan[plan.index("Condition") :]
    assert "StartsWith" not in tested and "length" in tested  # what is pushed isn't tested again


def test_edges(spark, tmp_path):
    assert load(spark, tmp_path).count() == 0
    with pytest.raises(Exception, match="NoRootError"):
        load(spark, tmp_path / "absent").count()
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("corpus").schema("name string").option("root", str(tmp_path)).load().count()
    (tmp_path / ".x").mkdir()
    (tmp_path / ".x" / "a.md").write_text("a")
    assert load(spark, tmp_path / ".x", legacy="true").count() == 0 and load(spark, tmp_path / ".x").count() == 1


def test_stream_goes_on(spark, root, tmp_path):
    """A batch that fails is run again as it was; a stream started anew goes on after the last one; no row is lost or twice."""
    register_corpus(spark)
    seen: dict[int, list[str]] = {}
    fails = {2}

    def one(batch, number):
        seen[number] = [r.rel_path for r in batch.select("rel_path").collect()]
        if number in fails:
            raise ValueError("planned")

    def start():
        stream = spark.readStream.format("corpus").options(root=str(root), cursor=str(tmp_path / "cursor"), batchbytes="3000", openbytes="100", partitionbytes="1000").load()
        return stream.writeStream.foreachBatch(one).option("checkpointLocation", str(tmp_path / "checkpoint")).start()

    with pytest.raises(Exception, match="planned"):
        query = start()
        query.processAllAvailable()
    assert max(seen) == 2
    broken, fails = seen[2], set()
    query = start()
    query.processAllAvailable()
    query.stop()
    every = [p for p, _ in walk(Rules(str(root)))]
    assert seen[2] == broken and len(seen) > 4 and [p for k in sorted(seen) for p in sorted(seen[k])] == every

    late = root / "𝄟.md"
    late.write_text("late")
    try:
        query = start()
        query.processAllAvailable()
        query.stop()
    finally:
        late.unlink()
    assert seen[max(seen)] == ["𝄟.md"] and sum(map(len, seen.values())) == len(every) + 1


def test_stream_without_cursor(spark, root, tmp_path):
    """One batch takes all; a restart finds nothing new."""
    register_corpus(spark)
    counts = []
    for _ in range(2):
        stream = spark.readStream.format("corpus").option("root", str(root)).load()
        query = stream.writeStream.foreachBatch(lambda b, n: counts.append(b.agg(F.count("*")).first()[0])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert counts == [87]


def test_tasks_list_no_folder_and_a_stream_walks_once(tmp_path, monkeypatch):
    """A task opens the files it was given; a stream's batches come of one walk, by files' bytes, unless a folder has changed."""
    root, cursor = tmp_path / "r", tmp_path / "cursor"
    (root / "a").mkdir(parents=True)
    for k in range(200):
        (root / "a" / f"{k:03d}.md").write_text("x" * 10)
    old = time.time() - 100
    for folder in (root / "a", root):
        os.utime(folder, (old, old))
    scans = []
    kept = datasource.scanned
    monkeypatch.setattr(datasource, "scanned", lambda rules, folder: scans.append(folder) or kept(rules, folder))
    options = {"root": str(root), "partitionbytes": "50", "openbytes": "0"}
    batch = datasource.CorpusReader(options, corpus.SCHEMAS["manifest"])
    parts = batch.partitions()
    read = [x["rel_path"] for p in parts for b in batch.read(p) for x in b.to_pylist()]
    assert len(parts) == 40 and len(scans) == 2 and len(read) == 200
    scans.clear()
    stream = datasource.CorpusStreamReader(options | {"cursor": str(cursor), "batchbytes": "100", "openbytes": "1000"}, corpus.SCHEMAS["manifest"])
    at, seen = stream.initialOffset(), []
    while (end := stream.latestOffset()) != at:
        assert stream.latestOffset() == end  # asked twice before it is planned
        seen.append([x["rel_path"] for p in stream.partitions(at, end) for b in stream.read(p) for x in b.to_pylist()])
        at = end
        if len(seen) == 10:
            assert len(scans) == 2
            (root / "a" / "150a.md").write_text("y" * 10)  # behind the offset, in a folder that is listed
    assert [p for s in seen for p in s] == sorted([*read, "a/150a.md"]) and max(map(len, seen)) == 10
