"""Language identification on many rows a language and on many languages."""

import numpy as np
from pyspark.sql import functions as F

from lodestack.llm import langid


def test_fit_on_more_rows_a_language_than_a_long_product_holds(spark):
    docs = spark.range(9_500_000).select(
        F.concat(F.lit("word"), F.translate((F.col("id") % 1000).cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("en").alias("lang")
    )
    assert langid.fit(docs, rows=10_000_000).langs == ["en"]


def test_labels_hold_more_languages_than_a_byte():
    many = 300
    scores = np.full((6, many), -5, np.float32)
    want = [299, 299, 299, 256, 256, 7]
    scores[np.arange(6), want] = 50
    assert langid.viterbi(scores, np.array([0, 2, 6]), 4.0).tolist() == want
