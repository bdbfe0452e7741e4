"""Writers side by side, commits of single tables, the index's own model in searches, older rules, stored postings."""

import os
import re
import threading

import pytest
from pyspark.sql import functions as F

from lodestack.errors import LockedError
from lodestack.functions import vector
from lodestack.functions.naming import IndexIdentity
from lodestack.operators import fulltext
from lodestack.plans.store import Store
from lodestack.rules import violations
from lodestack.schema import SCHEMAS
from lodestack.sources import corpus
from lodestack.sources.embedding import HashEmbedder
from lodestack.streaming.ingest import reindex


def files(root, **texts):
    for name, text in texts.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


def test_two_writers_lose_nothing(spark, tmp_path):
    """Two indexes are built at once; both runs, both providers and one current index are in the registry."""
    root, errors = files(tmp_path / "c", **{f"f{k}.md": f"text {k}" for k in range(6)}), []

    def build(model):
        try:
            reindex(Store(spark, tmp_path / "s"), root, IndexIdentity("p", model, 8), HashEmbedder(8), trigger="manual")
        except Exception as e:  # noqa: BLE001 - shown by the assertion
            errors.append(e)

    writers = [threading.Thread(target=build, args=(m,)) for m in ("a", "b")]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert errors == []
    registry = Store(spark, tmp_path / "s").registry
    assert sorted((r.index_name, r.status) for r in registry.read("reindex_runs").collect()) == [("index.p.a.8", "completed"), ("index.p.b.8", "completed")]
    assert registry.read("embedding_providers").count() == registry.read("index_registry").count() == registry.read("reindex_checkpoints").count() == 2
    assert registry.read("index_registry").where("is_current").count() == 1


def test_commits_write_what_changes(spark, tmp_path):
    tables = Store(spark, tmp_path / "s").registry
    subjects = spark.createDataFrame([("w", "x", 0.5)], SCHEMAS["work_subjects"])
    tables.commit(work_subjects=subjects)
    before = tables.state()[1]["work_subjects"]
    tables.commit(decision_links=spark.createDataFrame([], SCHEMAS["decision_links"]))
    assert tables.state()[1]["work_subjects"] == before and tables.version == 2
    old = tables.read("work_subjects")
    tables.commit(work_subjects=subjects.withColumn("weight", F.lit(1.0)))
    assert [r.weight for r in old.collect()] == [0.5]  # a reader keeps its version
    assert tables.vacuum() == 0 and tables.vacuum(older_s=-1) == 1
    assert [r.weight for r in tables.read("work_subjects").collect()] == [1.0]
    with tables.lock(), pytest.raises(LockedError), tables.lock(0.2):
        pass


def test_searches_use_the_index_model(spark, tmp_path, capsys):
    from lodestack.cli import main

    root = files(tmp_path / "c", **{"a.md": "alpha beta", "b.md": "gamma delta"})
    base = ["--index-dir", str(tmp_path / "s"), "--registry", str(tmp_path / "r"), "--master", "local[2]"]
    assert main([*base, "--dims", "16", "index", "--root", root]) == 0 and (tmp_path / "r/VERSION").exists()
    capsys.readouterr()
    for other in (["--dims", "32"], ["--model", "other"]):
        assert main([*base, *other, "search", "--query", "gamma delta", "--limit", "1"]) == 0
        assert "b.md" in capsys.readouterr().out
        assert main([*base, *other, "find", "gamma"]) == 0
        assert "skipped" not in capsys.readouterr().out


def test_subjects_ignore_case(spark):
    rows = spark.createDataFrame([("w", "Silence", 0.5), ("w", "silence", 0.5), ("v", "silence", 0.5)], SCHEMAS["work_subjects"])
    assert [(r.rule, r.key) for r in violations("work_subjects", rows).collect()] == [("unique work_id, subject", "w/silence")]


def test_older_rules(spark, tmp_path):
    root = files(tmp_path / "c", **{"a-b.md": "1", "a__b.md": "2", "x__.h__y.md": "3", "bad.md": b"\xff"})
    order = lambda legacy: [r.rel_path for r in corpus.freeze(spark, root, str(tmp_path / f"m{legacy}"), "r", None, legacy).entries.orderBy(corpus.path_order(legacy)).collect()]
    assert order(False) == ["a-b.md", "a/b.md", "bad.md"] and order(True) == ["a/b.md", "a-b.md", "bad.md"]
    assert corpus.file_paths(spark, root, "/c/a-", legacy=True).count() == 1
    entries = corpus.entries(corpus.file_paths(spark, root), root)
    states = {r.rel_path: (r.state, r.text) for r in corpus.contents(entries, root, strict=True).collect()}
    assert states["bad.md"] == ("invalid", None) and states["a-b.md"] == ("ok", "1")
    assert {r.rel_path: r.text for r in corpus.contents(entries, root).collect()}["bad.md"] == "�"
    hidden = files(tmp_path / ".c", **{"a.md": "1"})
    assert corpus.file_paths(spark, hidden, legacy=True).count() == 0 and corpus.file_paths(spark, hidden).count() == 1


def test_batches_are_spread(spark, tmp_path):
    root = files(tmp_path / "c", **{f"f{k}.md": f"text {k}" for k in range(40)})
    pids = tmp_path / "pids"
    pids.mkdir()

    def embed(texts):
        (pids / f"{os.getpid()}-{hash(texts[0])}").touch()
        return [[1.0]] * len(texts)

    embed.__module__ = "__main__"
    reindex(Store(spark, tmp_path / "s"), root, IndexIdentity("p", "m", 1), embed, batch_docs=1000)
    assert len(list(pids.iterdir())) > 1  # several partitions of one batch


def test_stored_postings_agree_with_arrays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "BUCKET_ROWS", 1)
    rows = [(1, "The runner", "running and running, ran"), (2, None, "Cats run; the cat runs"), (3, "", ""), (4, "été run", "run run run"), (5, "the", "the the the")]
    docs = spark.createDataFrame(rows, "id long, title string, body string")
    for stem in (True, False):
        index = fulltext.write_index(docs, f"file://{tmp_path}/i{stem}", stem=stem)
        arrays = fulltext.text_index(docs, stem=stem).cache()
        for phrase in ("run", "the", "running and", "the the", "run run", "nothing here", "", "cat runs"):
            want = {(r.id, r.hits, round(r.rank, 9)) for r in fulltext.phrase_rank(arrays, phrase, stem=stem).collect()}
            got = fulltext.ranked(index, phrase).join(index.rows, "row_id").collect()
            assert {(r.id, r.hits, round(r.rank, 9)) for r in got} == want, (stem, phrase)
    plan = fulltext.phrase_hits(index, "the cat")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)  # only the folders of the phrase's terms are read


def test_vector_bytes(spark):
    rows = spark.createDataFrame([(1, [1.0, -2.5]), (2, []), (3, None)], "id long, v array<float>")
    got = {r.id: r for r in rows.select("id", vector.to_bytes(F.col("v")).alias("b"), vector.from_bytes(vector.to_bytes(F.col("v"))).alias("w")).collect()}
    assert bytes(got[1].b) == b"\x00\x00\x80\x3f\x00\x00\x20\xc0" and got[1].w == [1.0, -2.5]
    assert bytes(got[2].b) == b"" and got[3].b is None
