"""The pipeline's stages on planted documents."""

import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(spark):
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    base = " ".join(words)
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [
        (1, base, "en", "a"),
        (2, base.upper(), "en", "a"),
        (3, near, "en", "b"),
        (4, "quite another text about something that nobody else has written here", "en", "b"),
        (5, "1234 !!! 5678", "en", "b"),
        (6, None, None, None),
        (7, "a clean short text", None, "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)


def test_stages(spark, tmp_path):
    docs, ids = planted(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"file://{tmp_path}/{name}"
        stage(spark, docs, "").write.parquet(out)
        docs = spark.read.parquet(out)
        ids[name] = sorted({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "encode":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert ids["language"] == [1, 2, 3, 4, 7]
    assert ids["exact_dedup"] == [2, 3, 4, 7]
    assert ids["near_dedup"] == [2, 4, 7]
    assert set(ids["mix"]) <= {2, 4, 7} and ids["encode"] == ids["mix"]
    assert docs.where(~F.col("decoded_equal")).count() == 0


def test_run_on_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.where("not decoded_equal").count() == 0


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
    assert docs.count() == 0


def test_stages_on_odd_documents(spark, tmp_path):
    """Very long texts, repeated rows, ties, nulls in every column and columns of clashing names: each stage has a defined result."""
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}word" for k in range(400)]
    long = " ".join(words * 120)
    rows = [(1, long, "en", "a"), (2, long + " end", "en", "a"), (3, long.upper(), "en", None), (4, "same words here and there", "en", "b")]
    rows += [(4, "same words here and there", "en", "b"), (5, "", "en", "b"), (6, None, None, None), (7, "\n \t", "en", "c"), (8, "x" * 60_000, None, "c")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    for name in ("row", "_row", "_key", "_word", "_bits", "size", "cls", "family", "h", "n", "key", "of", "taken"):
        docs = docs.withColumn(name, F.lit("clash"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert kept["language"] == [1, 2, 3, 4, 4, 8]
    assert kept["exact_dedup"] == [2, 3, 4, 4, 8]  # 1 and 3 are equal; a row that stands there twice stays
    assert kept["near_dedup"] == [2, 4, 4, 8]
    assert set(kept["mix"]) <= {2, 4, 8} and docs.where("not decoded_equal").count() == 0
