"""The engine's operators against brute force, fixtures and SQLite."""

import hashlib
import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestack import rules
from lodestack.errors import BadDateError, ConstraintError, DimensionError, EmbeddingError, ForbiddenPathError, HeaderMismatchError, LockedError, NoIndexError, NoRootError, ProvenanceError, ProviderRetiredError
from lodestack.functions import stem, text
from lodestack.functions.naming import IndexIdentity, expand_home, parse_file_name
from lodestack.operators import chunking, fulltext, knn, merge, registry
from lodestack.plans.find import find, search_index
from lodestack.plans.store import Store
from lodestack.schema import SCHEMAS
from lodestack.sources import corpus
from lodestack.sources.embedding import HashEmbedder, embedded
from lodestack.streaming.ingest import reindex


def rows(spark, name, *dicts):
    return spark.createDataFrame([tuple(d.get(c) for c in SCHEMAS[name].names) for d in dicts], SCHEMAS[name])


@pytest.fixture(scope="module")
def reg(spark):
    works = rows(spark, "creative_works", dict(work_id="w1", slug="pfd-speech", title="PFD Speech", kind="speech", status="rendered"), dict(work_id="w2", slug="harbor-nights", title="Harbor Nights", kind="poem", status="draft"))
    subjects = rows(spark, "work_subjects", dict(work_id="w1", subject="silence", weight=1.0), dict(work_id="w2", subject="Silence", weight=0.4))
    made = rows(
        spark, "work_renders",
        dict(render_id="r1", work_id="w1", render_kind="outline", seq=1, location_kind="ext4", location="/s/o"),
        dict(render_id="r2", work_id="w1", render_kind="tts-audio", seq=1, location_kind="r2", location="r2://a", duration_ms=91000),
        dict(render_id="r3", work_id="w1", render_kind="text", seq=2, location_kind="ext4", location="/s/t"),
    )
    fts = rows(spark, "work_text_fts", dict(title="PFD Speech", body="a long silence before the harbor, running", work_id="w1", render_id="r1"), dict(title="x", body="silence", work_id="none", render_id="r9"))
    decisions = rows(spark, "agent_decisions", *(dict(decision_id=f"d{k}", decided_at=t, agent="a", domain="infra", summary="s", status="active") for k, t in enumerate(["2026-08-13T23:59:59.999Z", "2026-08-13T00:00:00.000Z", "2026-08-14T00:00:00.000Z"])))
    return dict(works=works, subjects=subjects, renders=made, fts=fts, decisions=decisions)


def test_tagged(reg):
    got = registry.find_tagged(reg["works"], reg["subjects"], "SILENCE").collect()
    assert [r.slug for r in got] == ["pfd-speech", "harbor-nights"]
    assert registry.find_tagged(reg["works"], reg["subjects"], "fishing").count() == 0


def test_renders(reg):
    kinds = lambda slug: [r.render_kind for r in registry.renders(reg["works"], reg["renders"], slug).collect()]
    assert kinds("pfd-speech") == ["outline", "text", "tts-audio"]
    assert kinds("pfd-speech-aka") == [] and len(kinds("pfd speech")) == 3 and len(kinds("")) == 3 and kinds("a\\b") == []


def test_decided(reg):
    days = lambda d: [r.decided_at for r in registry.decided(reg["decisions"], d).collect()]
    assert days("2026-08-13") == ["2026-08-13T00:00:00.000Z", "2026-08-13T23:59:59.999Z"] and len(days("2026-08-14")) == 1
    for bad in ("not-a-date", "2026-8-1", "2026-13-01"):
        with pytest.raises(BadDateError):
            registry.decided(reg["decisions"], bad)


def test_find_text(reg):
    got = fulltext.find_text(fulltext.text_index(reg["fts"]), reg["works"], "run").collect()
    assert [(r.slug, r.snippet) for r in got] == [("pfd-speech", "a long silence before the harbor, «running»")]
    for phrase, n in (("silence", 1), ('a*b "quoted"', 0), ("zeppelin", 0), ("", 0)):
        assert fulltext.find_text(fulltext.text_index(reg["fts"]), reg["works"], phrase).count() == n


WORDS = "running runs ran relational conditional happy happiness the of to a silence silences flying flies national generalization oscillators hopping hoping été naïve café 42 x-ray snow_man".split()


def test_ranks_against_sqlite(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 5))), " ".join(rng.choices(WORDS, k=rng.randrange(0, 60)))) for i in range(200)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(title, body, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t(rowid, title, body) VALUES (?, ?, ?)", [(i + 1, a, b) for i, a, b in docs])
    index = fulltext.text_index(spark.createDataFrame(docs, "id long, title string, body string")).cache()
    for phrase in ("run", "the of", "happiness", "general", "x-ray", "naive cafe", "snow man"):
        want = {i - 1: r for i, r in db.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", ('"' + phrase + '"',))}
        found = fulltext.phrase_rank(index, phrase).withColumn("s", fulltext.snippet(F.col("body"), phrase)).collect()
        assert {r.id for r in found} == set(want), phrase
        assert all(abs(r.rank - want[r.id]) < 1e-9 for r in found), phrase


def test_porter_words():
    known = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sized": "size", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "revival": "reviv", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll"}
    assert {w: stem.porter(w) for w in known} == known


# ---------------------------------------------------------------- vectors


def test_knn_and_threshold(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.0] * 4), (4, [1.0, 0.0]), (5, [-1.0, 0.0, 0.0, 0.0])], "chunk_id long, embedding array<float>")
    got = knn.search(v, [0.9, 0.1, 0, 0]).collect()
    assert got[0].chunk_id == 1 and got[0].score > 0.5 and {r.chunk_id for r in got} == {1, 2}
    assert [r.chunk_id for r in knn.search(v, [1.0, 0, 0, 0], threshold=0.99).collect()] == [1]
    assert [r.chunk_id for r in knn.knn(v, [1.0, 0, 0, 0], 3).collect()] == [1, 3, 2]
    assert knn.search(v.limit(0), [1.0, 0, 0, 0]).count() == 0
    asked = spark.createDataFrame([(7, [1.0, 0.0, 0.0, 0.0]), (8, [0.0, 1.0, 0.0, 0.0])], "query_id long, query array<float>")
    got = knn.knn_join(v, asked, 2, id_col="chunk_id").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.rank) for r in got] == [(7, 1, 1), (7, 3, 2), (8, 2, 1), (8, 3, 2)]


def test_embedder_is_checked(spark):
    chunks = spark.createDataFrame([(k, f"text {k}") for k in range(70)], "chunk_id long, text string")
    made = embedded(chunks, HashEmbedder(8), 8).collect()
    assert all(len(r.embedding) == 8 for r in made) and len(made) == 70
    for bad, error in ((lambda t: [[0.0]] * len(t), "DimensionError"), (lambda t: [], "EmbeddingError")):
        with pytest.raises(Exception, match=error):
            embedded(chunks, bad, 8).collect()
    assert DimensionError and EmbeddingError


# ---------------------------------------------------------------- passages


@pytest.mark.parametrize(("body", "size"), [("".join(f"line {i} with some words\n" for i in range(200)), 120), ("Größe 🌊 é\n" * 30, 40), (("\n".join(["para line"] * 5) + "\n\n") * 5, 150), ("just one small note", 2000), ("no trailing newline here", 10), ("x" * 500, 100), ("a" * 64, 64), ("\r\n".join("abc def" for _ in range(50)), 64)])
def test_passages(body, size):
    got = list(chunking.passages(body, size))
    assert all(body[a:b] == t and 0 < b - a <= max(size, 64) for _, a, b, t in got)
    assert "".join(t for *_, t in got) == body and [s for s, *_ in got] == list(range(len(got)))
    if body == "x" * 500:
        assert len(got) == 5


def test_blank_passages():
    assert list(chunking.passages("", 100)) == [] and list(chunking.passages("\n\n \t \n", 100)) == [] and list(chunking.passages(None, 9)) == []
    gap = list(chunking.passages("text" + " " * 200 + "more", 64))
    assert [s for s, *_ in gap] != list(range(len(gap)))  # a blank passage takes a number


def test_packed_lines(spark):
    body = "".join(f"Line number {i}\n" for i in range(100))
    got = list(chunking.packed_lines(body, 100))
    assert got[0][1] == 1 and got[-1][2] == 100 and all(len(t) < 200 for *_, t in got) and "\n".join(t for *_, t in got) + "\n" == body
    assert list(chunking.packed_lines("", 10)) == [] and list(chunking.packed_lines("long long long", 5)) == [(0, 1, 1, "long long long")]
    docs = spark.createDataFrame([(1, body), (2, None), (3, "")], "doc_id long, text string")
    assert chunking.chunk_lines(docs, 100).count() == len(got) and chunking.chunk_documents(docs, 100).where("doc_id <> 1").count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("a  b　c\x85d", "ÀBc"), ("  ", "")], "t string, u string")
    got = df.select(text.token_count(F.col("t")).alias("n"), text.is_blank(F.col("t")).alias("b"), text.ascii_lower(F.col("u")).alias("l"), text.excerpt(F.col("t"), 3).alias("e")).collect()
    assert [tuple(r) for r in got] == [(4, False, "Àbc", "a b…"), (0, True, "", "")]


# ---------------------------------------------------------------- rules and changes


def test_rules(spark, reg):
    parents = {"creative_works": reg["works"]}
    assert rules.violations("work_renders", reg["renders"], parents).count() == 0
    bad = rows(
        spark, "work_renders",
        dict(render_id="a", work_id="w1", render_kind="image", seq=1, location_kind="ext4", location="/mnt/x", size_bytes=2 << 20),
        dict(render_id="a", work_id="zz", render_kind="nope", seq=1, location_kind="r2", location="s3://x", size_bytes=-1),
        dict(render_id="c", work_id="w1", render_kind="music", seq=1, location_kind="ext4", location="/s/m"),
    )
    got = sorted(r.rule for r in rules.violations("work_renders", bad, parents).collect())
    assert got == sorted(["media fence", "ext4 location", "render_kind in set", "r2 location", "size_bytes >= 0", "unique render_id", "work_id references creative_works"])
    with pytest.raises(ConstraintError):
        rules.checked("work_renders", bad)
    with pytest.raises(ForbiddenPathError):
        rules.allowed_path("/mnt/c/x")


def test_upsert_keeps_ids(spark):
    old = rows(spark, "documents", *(dict(doc_id=k, path=f"p{k}", sha256="a", status="active", indexed_at="t0") for k in (1, 2, 5)))
    scan = spark.createDataFrame([("p2", "b", 1, 1), ("a-b", "c", 1, 1), ("a/b", "c", 1, 1)], "path string, sha256 string, mtime_ns long, size_bytes long")
    got = {r.path: (r.doc_id, r.sha256) for r in merge.upsert_documents(old, scan, "t1").collect()}
    assert got == {"p1": (1, "a"), "p2": (2, "b"), "p5": (5, "a"), "a-b": (6, "c"), "a/b": (7, "c")}


def test_latest_and_resumable(spark):
    runs = rows(spark, "reindex_runs", dict(run_id="a", index_name="i", status="failed", started_at="1"), dict(run_id="b", index_name="i", status="completed", started_at="2"))
    points = rows(spark, "reindex_checkpoints", dict(run_id="a"), dict(run_id="b"))
    assert registry.resumable_run(runs, points, "i").count() == 0  # the newest run decides
    assert registry.resumable_run(runs.where("run_id = 'a'"), points, "i").first().run_id == "a"


# ---------------------------------------------------------------- corpus, store, ingestion


def write(root, **files):
    for name, body in files.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())


def test_freeze_filters(spark, tmp_path):
    root = tmp_path / "c"
    write(root, **{"keep.md": "k", ".hidden.md": "h", "sub__.dir__x.md": "x", "photo.PNG": "p", "_draft.md": "d", "a__b.md": "1", "a-b.md": "2", "héllo-🌊.md": "u", "notes.txt": "n"})
    (root / "link.md").symlink_to(root / "keep.md")
    snap = corpus.freeze(spark, str(root), str(tmp_path / "m"), "r1", r"\.md$")
    got = [(r.rel_path, r.size, r.sha256) for r in snap.entries.collect()]
    assert [g[0] for g in got] == sorted(["_draft.md", "a-b.md", "a/b.md", "héllo-🌊.md", "keep.md"], key=str.encode)
    assert dict((a, c) for a, _, c in got)["keep.md"] == hashlib.sha256(b"k").hexdigest()
    assert corpus.load_manifest(spark, snap.path, str(root)).hash == snap.hash
    (root / "keep.md").write_text("changed")
    (root / "a-b.md").unlink()
    for strong in (False, True):
        bad = {r.rel_path for r in corpus.unchanged(snap, strong).where("not matches").collect()}
        assert bad == {"keep.md", "a-b.md"}
    with pytest.raises(NoRootError):
        corpus.file_paths(spark, str(tmp_path / "none"))


def test_names():
    a = IndexIdentity("ollama", "nomic-embed-text", 768)
    assert parse_file_name(a.file_name) == a and parse_file_name("index.foo.db") is None and parse_file_name("not-an-index.db") is None
    assert parse_file_name("index.openai.text-embedding-3.5-small.1536.db") == IndexIdentity("openai", "text-embedding-3.5-small", 1536)
    assert IndexIdentity("p", "a/b", 4).index_name == "index.p.a-b.4" and expand_home("~/x") == os.path.expanduser("~/x")


def test_store_refusals(spark, tmp_path):
    store = Store(spark, tmp_path / "s")
    with pytest.raises(NoIndexError):
        store.current()
    a = IndexIdentity("p", "m", 8)
    store.index(a).open()
    store.set_current(a, 0, 0)
    b = IndexIdentity("p", "n", 8)
    store.index(b).open()
    store.set_current(b, 0, 0)
    assert store.registry.read("index_registry").where("is_current").count() == 1 and store.current() == b
    assert store.switch(a.index_name) == a and store.list() == [a, b]
    with pytest.raises(NoIndexError):
        store.switch("/elsewhere/index.p.m.8.db")
    with pytest.raises(ProvenanceError):
        store.provider(IndexIdentity("p", "m", 16))
    os.rename(tmp_path / "s" / a.index_name, tmp_path / "s" / "index.p.zz.8")
    with pytest.raises(HeaderMismatchError):
        store.verify(IndexIdentity("p", "zz", 8))
    with pytest.raises(ProvenanceError):
        store.index(IndexIdentity("p", "zz", 8)).open()
    retired = store.registry.read("embedding_providers").withColumn("status", F.lit("retired"))
    store.registry.commit(embedding_providers=retired)
    with pytest.raises(ProviderRetiredError):
        store.provider(b)
    with store.index(b).lock(), pytest.raises(LockedError), store.index(b).lock():
        pass


def failing(dims, word, flag):
    """An embedder that fails on texts of one file, as long as the flag file is there."""

    def embed(texts):
        import os

        from lodestack.sources.embedding import HashEmbedder

        if os.path.exists(flag) and any(word in t for t in texts):
            raise RuntimeError("service is down")
        return HashEmbedder(dims)(texts)

    embed.__module__ = "__main__"  # so that it goes to the workers by value
    return embed


def state(index):
    docs = {r.doc_id: r.path for r in index.read("documents").collect()}
    return sorted((docs[r.doc_id], r.seq, r.text) for r in index.read("chunks").collect())


def test_ingest_resume_and_changes(spark, tmp_path):
    root, flag = tmp_path / "c", str(tmp_path / "down")
    write(root, **{f"f{k:02d}.md": "".join(f"file {k} line {i} some words\n" for i in range(40)) for k in range(6)}, **{"empty.md": "", "bad.md": b"ok \xff\xfe bytes"})
    identity = IndexIdentity("p", "m", 16)
    store, control = Store(spark, tmp_path / "s"), Store(spark, tmp_path / "t")
    open(flag, "w").close()
    with pytest.raises(Exception, match="service is down"):
        reindex(store, str(root), identity, failing(16, "file 4", flag), 200, batch_docs=2)
    runs = store.registry.read("reindex_runs").collect()
    assert [r.status for r in runs] == ["failed"] and store.index(identity).read("chunks").count() == 0
    os.unlink(flag)
    stats = reindex(store, str(root), identity, failing(16, "file 4", flag), 200, batch_docs=2)
    assert stats.resumed and stats.run_id == runs[0].run_id and stats.docs == 8
    reindex(control, str(root), identity, HashEmbedder(16), 200)
    index = store.index(identity)
    assert state(index) == state(control.index(identity)) and store.current() == identity
    problems = {r.problem: r.n for r in chunking.chunk_problems(index.read("chunks"), index.read("documents"), index.read("vec_chunks")).collect()}
    assert not any(problems.values())
    assert [r.error for r in store.registry.read("reindex_runs").collect()] == [None]
    # a changed, an emptied, a deleted and a new file
    ids = {r.path: r.doc_id for r in index.read("documents").collect()}
    write(root, **{"f00.md": "gone fishing at dawn\n", "f01.md": "", "new.md": "brand new"})
    (root / "f02.md").unlink()
    stats = reindex(store, str(root), identity, HashEmbedder(16), 200)
    docs = {r.path: r for r in index.read("documents").collect()}
    assert docs["f02.md"].status == "gone" and stats.gone == 1 and docs["f00.md"].doc_id == ids["f00.md"]
    texts = state(index)
    assert [t for p, _, t in texts if p == "f00.md"] == ["gone fishing at dawn\n"] and not [t for t in texts if t[0] in ("f01.md", "f02.md")]
    assert index.read("vec_chunks").count() == len(texts)
    best = search_index(store, "gone fishing at dawn", HashEmbedder(16), 3).first()
    assert best.path == "f00.md" and best.score > 0.99
    report = find(store, "fishing", HashEmbedder(16), 2)
    assert report.skipped is None and {r.lane for r in report.hits.collect()} == {"semantic"}
    assert find(store, "fishing", None).skipped == "no embedder"


def test_command_line(spark, tmp_path, capsys):
    from lodestack.cli import main

    root = tmp_path / "c"
    write(root, **{"a.md": "alpha beta\n", "b.md": "gamma delta\n"})
    base = ["--index-dir", str(tmp_path / "s"), "--dims", "16", "--master", "local[2]"]
    assert main([*base, "status"]) == 1
    assert main([*base, "index", "--root", str(root)]) == 0
    assert main([*base, "search", "--query", "gamma delta", "--limit", "1"]) == 0
    assert "b.md" in capsys.readouterr().out
    for command in (["list"], ["status"], ["find", "alpha"], ["renders", "x"], ["decided", "2026-01-01"], ["switch", "--target", "index.local.word-hash.16"]):
        assert main([*base, *command]) == 0
    assert main([*base, "decided", "nope"]) == 1


def test_entry_registers_everything(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 20
