"""Candidate recall of problem 2 at every size of the history, against pairs at exactly the least cosine."""

import numpy as np
import pytest

from gyral.llm import history
from gyral.llm.signs import letters, rest_cosine
from tests.llm.test_vectors import DIM, batches, state, units


def pairs_at(cosine, n, dim, seed=0):
    """Unit vectors around a template in the middle of them, and one at that cosine of each."""
    rng = np.random.default_rng(seed)
    template, noise = units(rng.standard_normal((1, dim))), units(rng.standard_normal((n, dim)))
    a = units(template + noise)
    side = units(rng.standard_normal((n, dim)))
    side = units(side - (side * a).sum(1, keepdims=True) * a)
    return a, cosine * a + np.sqrt(1 - cosine**2) * side


def shared(a, b, least, count):
    """Which rows of a and b have a chunk in common."""
    sides = [history.chunks(letters(x.astype(np.float32), count), least) for x in (a, b)]
    common = set(zip(*map(np.ndarray.tolist, sides[0]))) & set(zip(*map(np.ndarray.tolist, sides[1])))
    together = np.zeros(len(a), bool)
    together[[who for who, _ in common]] = True
    return together


@pytest.mark.parametrize("rows", [20_000, 200_000, 2_000_000, 43_000_000, 1_000_000_000])
def test_recall_does_not_fall_with_size(rows):
    a, b = pairs_at(0.98, 3000, 144)
    mean = a.mean(0)
    least, count = history.layout(rows, rest_cosine(np.linalg.norm(a - mean, axis=1).min(), 0.98), 144)
    assert shared(a - mean, b - mean, least, count).mean() >= 0.997


def test_strangers_share_few_chunks():
    rng = np.random.default_rng(5)
    least, count = history.layout(history.CAPACITY, 0.96, 144)
    _, key = history.chunks(letters(rng.standard_normal((20_000, 144)).astype(np.float32), count), least)
    _, n = np.unique(key, return_counts=True)
    # strangers' cosines scatter around 0, and the nearer ones meet more often than pairs at exactly 0
    assert (n * (n - 1) // 2).sum() <= 20_000 * 20_000 / 2 * count / history.BOUNDARY / 288**least * 5


def test_large_history_finds_weak_pairs(spark):
    a, b = pairs_at(0.983, 400, DIM, 1)
    rows = [(k, i + 1000 * k, None, x) for k, side in enumerate((a, b)) for i, x in enumerate(side)]
    h = state(spark, "weak")
    h.capacity = 1_000_000
    assert len({r.id for r in h.process(batches(spark, rows)).collect()} & set(range(1000, 1400))) >= 396


def test_rows_around_one_scan(spark):
    """Rows as near to the template as to each other."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal(DIM)
    rows = [(0, i, None, v + 0.05 * rng.standard_normal(DIM)) for i in range(60)]
    assert {r.id for r in state(spark, "one").process(batches(spark, rows)).collect()} == set(range(1, 60))


def test_lower_cosine_later_is_an_error(spark):
    h = state(spark, "lower")
    h.process(batches(spark, [(0, 1, None, np.arange(DIM))]), 0.98)
    with pytest.raises(ValueError):
        h.process(batches(spark, [(1, 2, None, np.arange(DIM))]), 0.9)
