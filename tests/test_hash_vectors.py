"""Hash vectors of many texts at once against one text and token at a time."""

import random

import numpy as np
import pandas as pd
import pytest

from corvane.operators import embedding


@pytest.mark.parametrize("block", [1, 7, 1 << 15])
def test_hash_vectors_count_tokens_of_many_texts_at_once(monkeypatch, block):
    monkeypatch.setattr(embedding, "BLOCK_TOKENS", block)
    rng = random.Random(block)
    texts = [" ".join(f"W{rng.randint(0, 30)}" for _ in range(rng.randint(0, 40))) for _ in range(50)] + ["", None, " \n", "a a b", "İ ß"]
    want = np.zeros((len(texts), embedding.DIMENSIONS))
    for row, text in zip(want, texts):
        for token in (text or "").lower().split():
            slots, signs = embedding.token_slots([token])
            for slot, sign in zip(slots[0], signs[0]):
                row[slot] += sign
    length = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.divide(want, length, out=want, where=length > 0)
    assert np.array_equal(np.stack(list(embedding.hash_vector.func(pd.Series(texts)))), want)
    assert len(embedding.hash_vector.func(pd.Series([], dtype=object))) == 0
