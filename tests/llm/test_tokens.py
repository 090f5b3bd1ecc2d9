import random

import pyarrow as pa
import pytest

from quarry.llm import tokens


@pytest.mark.parametrize(("name", "cut"), [("word_bpe_49k.json", tokens.runs), ("byte_bpe_50k.json", tokens.before_spaces)])
def test_same_ids_when_chunks_are_joined_and_evicted(name, cut):
    """Special tokens within texts, Unicode white space, and a cache of few chunks."""
    path = tokens.vocabulary(name)
    encoder, tk, rng = tokens.Encoder(path, cut), tokens.tokenizer(path), random.Random(4)
    encoder.chunks.kept = 60
    words = ["the", "Über", "don't", "<|endoftext|>", "<|startoftext|>", "a<|endoftext|>b", " ", " x", "日本語", "42", "été", "x" * 300] + [f"w{i}" for i in range(150)]
    for _ in range(30):
        texts = [rng.choice([" ", "  ", "\n", "\t "]).join(rng.choices(words, k=rng.randrange(30))) for _ in range(12)] + [None, ""]
        ids, bounds = encoder.encode(pa.array(texts, pa.string()), 1)
        for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == [*tk.encode(text or "", add_special_tokens=False).ids, 1]
    assert len(encoder.chunks.keys) < 400
