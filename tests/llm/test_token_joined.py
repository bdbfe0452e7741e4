"""New words are encoded many as one text, and get the ids that the library gives whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from lodestack.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_new_words_are_joined(monkeypatch):
    draw = random.Random(3)
    parts = ["a", "Zug", "é", "日本", "🌊", "12", "'s", "...", "\n", "\t", "_", "qxz", "é"]
    word = lambda: "".join(draw.choice(parts) for _ in range(draw.randrange(1, 6)))
    texts = [" ".join(word() for _ in range(draw.randrange(60))) for _ in range(400)] + ["", "one", "\nfirst last\n", "a\nb c\n d"]
    encoder, asked = tokens.Encoder(PATH), []
    want = [e.ids for e in encoder.of.encode_batch(texts, add_special_tokens=False)]
    kept = encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda words: asked.extend(words) or kept(words))
    for _ in range(2):
        ids, bounds = encoder(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want
    words = {w for t in texts for w in t.split(" ")}
    assert len(words) > 2000 and sum(w.startswith(" ") and w[-1:].isalnum() and w.count(" ") == 1 for w in asked) == 0


def test_words_whose_bytes_differ_are_encoded_apart():
    """With lengths that aren't the words', no bound is guessed."""
    encoder = tokens.Encoder(PATH)
    words = pa.array([" alpha", " beta", " gamma日本", " x"], pa.large_string())
    want = encoder.encode(words.to_pylist())
    for lengths in (encoder.lengths, encoder.lengths + 1, encoder.lengths * 0):
        encoder.lengths = lengths
        for got, plain in zip(encoder.joined(words), want, strict=True):
            assert np.array_equal(got, plain)
