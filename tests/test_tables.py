"""Changes as added parts and marks, snapshots and pins, retention by replacement, bytes of a second run."""

import os
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestack.errors import StaleIndexError
from lodestack.functions.naming import IndexIdentity
from lodestack.operators import fulltext, textstore
from lodestack.operators.textstore import TextStore, table_state
from lodestack.plans import tables as delta
from lodestack.plans.find import find
from lodestack.plans.store import Store
from lodestack.plans.tables import Change, Tables
from lodestack.schema import SCHEMAS
from lodestack.sources.embedding import HashEmbedder
from lodestack.streaming.ingest import reindex


def links(spark, rows):
    return spark.createDataFrame(rows, SCHEMAS["decision_links"])


def held(tables):
    return sorted(tuple(r) for r in tables.read("decision_links").collect())


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def test_changes_follow_a_plain_list(spark, tmp_path, monkeypatch):
    """Random additions and deletions, with nulls and repeated rows; compactions on the way."""
    monkeypatch.setattr(delta, "MOST_PARTS", 4)
    draw, tables, truth = random.Random(5), Tables(spark, tmp_path / "t", ("decision_links",)), []
    made = lambda: (draw.choice(["a", "b", "c", None]), draw.choice(["x", "y", None]), str(draw.randrange(4)))
    for step in range(9):
        add = [made() for _ in range(draw.randrange(6))]
        keys = {(draw.choice(["a", "b", None]), draw.choice(["x", None])) for _ in range(draw.randrange(3))}
        truth = [r for r in truth if r[:2] not in keys] + add
        delete = spark.createDataFrame(list(keys), "decision_id string, link_kind string")
        tables.commit(decision_links=Change(links(spark, add), delete))
        assert sorted(map(str, truth)) == sorted(str(tuple(r)) for r in tables.read("decision_links").collect()), step
    assert len(tables.state()[1]["decision_links"].parts) <= 4


def test_deletes_write_marks_only(spark, tmp_path):
    tables = Tables(spark, tmp_path / "t", ("decision_links",))
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("decision_id"), F.lit("k").alias("link_kind"), F.sha2(F.col("id").cast("string"), 256).alias("target"))
    tables.commit(decision_links=rows)
    before = size(tmp_path / "t/parts")
    keys = spark.range(0, 200_000, 1000).select(F.col("id").cast("string").alias("decision_id"))
    tables.commit(decision_links=Change(delete=keys))
    assert size(tmp_path / "t/parts") - before < before / 100
    assert tables.read("decision_links").count() == 199_800
    assert tables.read("decision_links").join(keys, "decision_id").count() == 0
    plan = tables.read("decision_links").where("link_kind = 'x'").select("decision_id")._jdf.queryExecution().toString()
    assert "EqualTo(link_kind,x)" in plan and "target" not in plan.split("ReadSchema")[1].split("\n")[0]
    tables.commit(decision_links=Change(delete=spark.range(100_000).select(F.col("id").cast("string").alias("decision_id"))))
    made = tables.state()[1]["decision_links"]
    assert not made.gone and len(made.parts) == 1 and tables.read("decision_links").count() == 99_900  # half were gone: written anew


def test_old_parts_stay_for_readers(spark, tmp_path):
    """A part goes an hour after it was replaced, whenever it was written, and not while a reader has pinned it."""
    tables = Tables(spark, tmp_path / "t", ("decision_links",))
    tables.commit(decision_links=links(spark, [("a", "k", "1")]))
    old = next((tmp_path / "t/parts").iterdir())
    os.utime(old, (time.time() - 7200, time.time() - 7200))
    before = tables.snapshot()
    tables.commit(decision_links=links(spark, [("b", "k", "2")]))
    assert tables.vacuum() == 0
    assert before.read("decision_links").first().decision_id == "a" and held(tables) == [("b", "k", "2")]
    with tables.pinned() as reader:
        tables.commit(decision_links=Change(links(spark, [("c", "k", "3")]), links(spark, [("b", "k", "2")])))
        assert tables.vacuum(older_s=-1) == 1  # the first part, which the pin doesn't need
        assert [r.decision_id for r in reader.read("decision_links").collect()] == ["b"]
    assert held(tables) == [("c", "k", "3")]
    assert tables.vacuum(older_s=-1) >= 1 and held(tables) == [("c", "k", "3")]
    (tmp_path / "t/parts/left-by-a-crash").mkdir()
    assert tables.vacuum() == 0 and tables.vacuum(older_s=-1) == 1


def test_snapshots_are_of_one_version(spark, tmp_path):
    """Vectors and passages that a reader sees belong together although a run commits in between."""
    root = tmp_path / "c"
    root.mkdir()
    (root / "a.md").write_text("first words")
    store, identity = Store(spark, tmp_path / "s"), IndexIdentity("p", "m", 8)
    reindex(store, str(root), identity, HashEmbedder(8))
    with store.index(identity).pinned() as reader:
        vectors = reader.read("vec_chunks")
        (root / "a.md").write_text("second words, quite others")
        reindex(store, str(root), identity, HashEmbedder(8))
        store.index(identity).vacuum(older_s=-1)
        both = vectors.join(reader.read("chunks"), "chunk_id").collect()
        assert [r.text for r in both] == ["first words"]
    assert [r.text for r in store.index(identity).read("chunks").collect()] == ["second words, quite others"]


def test_second_run_writes_what_changed(spark, tmp_path):
    root, draw = tmp_path / "c", random.Random(1)
    root.mkdir()
    for k in range(60):
        (root / f"f{k:02d}.md").write_text(" ".join(draw.choice("alpha beta gamma delta".split()) + str(draw.randrange(10**6)) for _ in range(2000)))
    store, identity = Store(spark, tmp_path / "s"), IndexIdentity("p", "m", 16)
    reindex(store, str(root), identity, HashEmbedder(16), 500)
    index = store.index(identity)
    first, ids = size(index.at / "parts"), {(r.doc_id, r.seq): r.chunk_id for r in index.read("chunks").collect()}
    (root / "f07.md").write_text("only this one is new")
    reindex(store, str(root), identity, HashEmbedder(16), 500)
    assert size(index.at / "parts") - first < first / 10
    doc = index.read("documents").where("path = 'f07.md'").first().doc_id
    now = {(r.doc_id, r.seq): r.chunk_id for r in index.read("chunks").collect()}
    assert {k: v for k, v in now.items() if k[0] != doc} == {k: v for k, v in ids.items() if k[0] != doc}
    assert index.read("vec_chunks").count() == len(now) and index.read("vec_chunks").join(index.read("chunks"), "chunk_id").count() == len(now)
    other = Store(spark, tmp_path / "t")
    reindex(other, str(root), identity, HashEmbedder(16), 500)
    texts = lambda i: sorted((r.path, r.seq, r.text) for r in i.read("chunks").join(i.read("documents").select("doc_id", "path"), "doc_id").collect())
    assert texts(index) == texts(other.index(identity))
    reindex(store, str(root), identity, HashEmbedder(16), 500, force=True)  # writes everything anew
    assert {r.chunk_id for r in index.read("chunks").collect()}.isdisjoint(now.values())


# ---------------------------------------------------------------- full text that follows its table


def searched(index, phrase):
    return sorted((r.id, r.hits, round(r.rank, 9)) for r in fulltext.ranked(index, phrase).join(index.rows, "row_id").collect())


def rebuilt(spark, docs, at, phrase, stem):
    return searched(fulltext.write_index(docs, at, stem=stem), phrase)


@pytest.mark.parametrize("stem", [True, False])
def test_index_follows_random_changes(spark, tmp_path, monkeypatch, stem):
    """After each change hits and ranks are those of an index written anew; compactions on the way."""
    monkeypatch.setattr(textstore, "MOST_SEGMENTS", 3)
    draw, words = random.Random(7), "run running the cat of été".split()
    made = lambda k: (k, draw.choice([None, "", "Run Cat"]), " ".join(draw.choices(words, k=draw.randrange(12))))
    store, now = TextStore(spark, f"file://{tmp_path}/i", stem=stem, log=tmp_path / "LOG"), [made(k) for k in range(30)]
    now += now[:3]  # repeated rows
    for step in range(6):
        docs = spark.createDataFrame(now, "id long, title string, body string")
        index = store.refresh(docs, f"state {step}")
        for phrase in ("run", "the cat", "of"):
            assert searched(index, phrase) == rebuilt(spark, docs, f"file://{tmp_path}/r{step}{phrase[:2]}", phrase, stem), (step, phrase)
        with pytest.raises(StaleIndexError):
            store.index("another state")
        store = TextStore(spark, f"file://{tmp_path}/i", stem=stem, log=tmp_path / "LOG")  # as another process reads it
        assert store.index(f"state {step}").count == len(now)
        kept = [r for r in now if draw.random() > (0.1 if step else 0.5)]
        now = [(r[0], r[1], "the cat runs") if draw.random() < 0.1 else r for r in kept] + [made(100 * (step + 1) + k) for k in range(draw.randrange(5))]
    empty = store.refresh(docs.where("false"), "none")
    assert searched(empty, "run") == [] and empty.count == 0 and empty.rows.count() == 0


def test_small_changes_write_little_and_hot_terms_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "PART_ROWS", 1000)
    docs = spark.range(20_000).select("id", F.lit(None).cast("string").alias("title"), F.concat(F.lit("the word "), F.sha2(F.col("id").cast("string"), 256)).alias("body"))
    store = TextStore(spark, f"file://{tmp_path}/i", log=tmp_path / "LOG")
    index = store.refresh(docs, "one")
    files = fulltext.TextIndex.postings_of(index, ["the"]).groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 15 and max(r["count"] for r in files) < 2000
    before = size(tmp_path / "i")
    index = store.refresh(docs.where("id <> 5").union(spark.createDataFrame([(70_000, None, "the new one")], docs.schema)), "two")
    assert size(tmp_path / "i") - before < before / 20 and len(index.segments) == 2
    found = {r.id for r in fulltext.ranked(index, "the").join(index.rows, "row_id").select("id").collect()}
    assert 70_000 in found and 5 not in found and len(found) == 20_000


def test_queries_see_a_changed_table(spark, tmp_path):
    from lodestack import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).cache()
    at = f"{tmp_path}/documents.parquet"
    rows.write.parquet(at)
    before, state = queries.QUERIES["fts_phrase"](spark, str(tmp_path)).count(), table_state(at, spark)
    more = rows.limit(1).withColumn("doc_id", F.lit(10**6).cast("long")).withColumn("text", F.lit("one of the best"))
    rows.union(more).write.mode("overwrite").parquet(at)
    assert table_state(at, spark) != state
    found = queries.QUERIES["fts_phrase"](spark, str(tmp_path))
    assert found.count() == before + 1 and found.where("doc_id = 1000000").count() == 1
    ranks = queries.QUERIES["bm25_rank"](spark, str(tmp_path))
    assert ranks.count() == before + 1


def test_find_sees_new_texts_of_the_registry(spark, tmp_path):
    store = Store(spark, tmp_path / "s")
    texts = lambda *rows: spark.createDataFrame(rows, SCHEMAS["work_text_fts"])
    work = spark.createDataFrame([("w", "slug", "Title")], "work_id string, slug string, title string")
    full = work.select(*(F.col(n) if n in work.columns else F.lit(None).cast(f.dataType).alias(n) for n, f in zip(SCHEMAS["creative_works"].names, SCHEMAS["creative_works"].fields, strict=True)))
    store.registry.commit(creative_works=full, work_text_fts=texts(("t", "gone fishing", "w", "r1")))
    hits = lambda phrase: [r.key for r in find(store, phrase, None).hits.where("lane = 'text'").collect()]
    assert hits("fishing") == ["slug"] and hits("hunting") == []
    store.registry.commit(work_text_fts=Change(texts(("t", "gone hunting", "w", "r1")), texts(("t", "gone fishing", "w", "r1")).select("render_id")))
    assert hits("fishing") == [] and hits("hunting") == ["slug"]


def test_snippets_of_decomposed_text(spark):
    plain, apart = "un café très bon, le café noir", "un café très bon, le café noir"
    rows = spark.createDataFrame([(plain,), (apart,)], "body string")
    marked = [r.s for r in rows.select(fulltext.snippet(F.col("body"), "café").alias("s")).collect()]
    assert marked == ["un «café» très bon, le «café» noir"] * 2


def test_postings_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Tasks write the postings of the rows that they read, in blocks that small texts share and large ones are cut in."""
    docs = spark.range(300).select("id", F.lit("Un café").alias("title"), F.concat(F.lit("the_cat of "), F.col("id").cast("string"), F.lit(" the cat")).alias("body"))
    shuffled = []
    kept = type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, *a: shuffled.append(a) or kept(self, *a))
    found = {}
    for chars in (1, 700, 1 << 20):
        monkeypatch.setattr(fulltext, "BLOCK_CHARS", chars)
        index = fulltext.write_index(docs, f"file://{tmp_path}/{chars}", stem=False)
        found[chars] = [searched(index, p) for p in ("the cat", "cafe", "17")]
    assert not shuffled and found[1] == found[700] == found[1 << 20]
    assert [len(x) for x in found[1]] == [300, 300, 1] and {hits for _, hits, _ in found[1][0]} == {2}
    stored = [spark.read.parquet(f"{tmp_path}/{chars}/postings").where("term = 'the'").count() for chars in (1, 1 << 20)]
    assert stored[0] == 300 and stored[1] <= 8  # postings of a term are held together
