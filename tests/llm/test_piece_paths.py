"""The registered query gives every segmentation itself, and each decodes to its text."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from lodestack.llm import pieces, queries

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_query_gives_the_ids_of_each_segmentation(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    p, rows = pieces.pieces(MODEL), queries.QUERIES["op2_piece_nbest"](spark, SF).collect()
    assert len(rows) == len(texts) and any(len(r.nbest_ids) == pieces.BEST for r in rows)
    for r in rows:
        assert r.decoded_equal and len(r.nbest_ids) == len(r.nbest_scores) == len({tuple(x) for x in r.nbest_ids})
        assert r.nbest_crc32 == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in r.nbest_ids]
        assert {pieces.decoded(p, np.array(x, np.int64)) for x in r.nbest_ids} == {texts[r.doc_id]}


def test_own_ids_are_the_librarys(spark):
    """Of all texts of the table, and of odd ones: spaces, line breaks, bytes, and pieces cut by the cache's limit."""
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", " ", "a", "  two  spaces ", "\n\nx\ny ", "日本 語 x\x00\x01\t\t", "\u2460 ﬁ é e\u0301", "zq" * 500, " \n \n"]
    for limit in (pieces.KEPT_SEGMENTS, 10):
        encoder = pieces.Encoder(MODEL)
        pieces.KEPT_SEGMENTS, kept = limit, pieces.KEPT_SEGMENTS
        try:
            for text, (ids, found, equal) in zip(texts, encoder(pa.array(texts)), strict=True):
                assert ids.tolist() == own.encode(text)
                assert pieces.decoded(encoder.p, ids) == text
        finally:
            pieces.KEPT_SEGMENTS = kept


def test_best_segmentation_is_like_the_models():
    """Sums of ranks would cut common words in letters; log-probabilities don't."""
    (ids, found, _), = pieces.Encoder(MODEL)(pa.array(["the quick brown fox was here before the others"]))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert ids.tolist() == sp.encode("the quick brown fox was here before the others")
    assert [sp.id_to_piece(i) for i in found[0][1].tolist()][:3] == ["▁the", "▁quick", "▁brown"]


def test_unigram_scores_stay_and_ranks_become_log_probabilities():
    assert pieces.zipf_scores(np.array([-2.5, -3.0])).tolist() == [-2.5, -3.0]
    assert np.isclose(np.exp(pieces.zipf_scores(-np.arange(100.0))).sum(), 1)


def test_wrong_decoding_is_told():
    p = pieces.pieces(MODEL)
    words = pa.array(["the", " one", "é", "日", ""], pa.large_string())
    ids, bounds = p.own_ids(words)
    assert pieces.spelled(p, ids, bounds, words).all()
    for wrong in (["thf", " one", "é", "日", ""], ["the", " on", "è", "日", "x"]):
        told = pieces.spelled(p, ids, bounds, pa.array(wrong, pa.large_string()))
        assert told.tolist() == [a == b for a, b in zip(wrong, words.to_pylist(), strict=True)]
    texts, segments = pa.array(["a b", "", "c"], pa.large_string()), pa.array([" a", " b", " c"], pa.large_string())
    bounds = np.array([0, 2, 2, 3])
    assert pieces.whole_texts(texts, segments, bounds).tolist() == [True, True, True]
    assert pieces.whole_texts(pa.array(["a x", "", "c"], pa.large_string()), segments, bounds).tolist() == [False, True, True]
    assert pieces.whole_texts(pa.array(["a b", "", "cd"], pa.large_string()), segments, bounds).tolist() == [True, True, False]
