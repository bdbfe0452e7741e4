"""Token files give the ids of the library as it is loaded, strings of added tokens included."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestack.llm import tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_added_tokens_as_in_the_library(spark):
    of = Tokenizer.from_file(BPE)
    assert of.encode("<|endoftext|> x", add_special_tokens=False).ids == [50256, 2124]
    texts = ["<|endoftext|> x", "a b<|endoftext|>c d", "one <|endoftext|> two", "<|endoftext|><|endoftext|>", "<|endoftext |> x", "plain words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, start = [], 0
    for k, text in enumerate(texts):
        ids = [*of.encode(text, add_special_tokens=False).ids, tokens.END]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in tokens.token_digests(spark, docs, BPE).orderBy("start").collect()] == want
