"""Candidate recall of problem 4 on pairs at exactly the least cosine."""

import numpy as np

from gyral.llm import overlap
from gyral.llm.signs import letters
from tests.llm.test_history_recall import pairs_at


def test_pairs_at_the_least_cosine_share_a_band():
    a, b = pairs_at(0.98, 3000, 144, 2)
    mean = a.mean(0)
    text = [letters((x - mean).astype(np.float32), overlap.SHINGLES) for x in (a, b)]
    keys = [overlap.bands(x) for x in text]
    assert (keys[0] == keys[1]).any(1).mean() >= 0.99
    assert (overlap.jaccard(*text) >= overlap.JACCARD).mean() >= 0.9995
    assert overlap.jaccard(text[0], text[0]).tolist() == [1.0] * len(a)


def test_strangers_share_few_bands():
    text = letters(np.random.default_rng(6).standard_normal((8000, 144)).astype(np.float32), overlap.SHINGLES)
    pairs = sum((n * (n - 1) // 2).sum() for _, n in (np.unique(k, return_counts=True) for k in overlap.bands(text).T))
    in_common = overlap.SHINGLES / 288  # on average, in a Poisson distribution
    by_chance = (in_common**3 + 3 * in_common**2 + in_common) / (2 * overlap.SHINGLES) ** 3
    assert pairs <= 8000 * 8000 / 2 * overlap.BANDS * by_chance * 1.5
