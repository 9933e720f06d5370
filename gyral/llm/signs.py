"""Strings made of vectors, on which chunk and shingle hashes of vectors are built."""

from __future__ import annotations

from functools import cache

import numpy as np

from gyral.llm.vectors import SEED, decode, rotation, unit


def residuals(blobs, mean: np.ndarray, dim: int) -> np.ndarray:
    """The unit vectors less the corpus template."""
    return (unit(decode(blobs, dim)) - mean).astype(np.float32)


def letters(rest: np.ndarray, count: int) -> np.ndarray:
    """(rows, count) uint16: in each of `count` rotated bases the axis the vector is nearest to, and on which side.

    A letter has log2(2 dim) bits, and alike vectors keep it far more often than as many signs.
    """
    out, n = np.empty((len(rest), count), np.uint16), np.arange(len(rest))
    for s in range(count):
        y = rest @ rotation(rest.shape[1], s + 1).T
        high, low = y.argmax(1), y.argmin(1)
        out[:, s] = np.where(y[n, high] >= -y[n, low], 2 * high + 1, 2 * low)
    return out


def rest_cosine(rest: float, least: float) -> float:
    """Cosine left between two vectors of cosine `least` once a template is taken off that both lie `rest` away from."""
    return float(np.clip(1 - (1 - least) / rest**2, -1, 1))


@cache
def kept_letters(cosine: float, dim: int, pairs: int = 4096, bases: int = 8) -> float:
    """Share of letters that two vectors of that cosine have in common, counted on simulated pairs."""
    rng = np.random.default_rng([SEED, dim])
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.standard_normal((2, pairs, dim)))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return float((letters(a, bases) == letters(cosine * a + np.sqrt(1 - cosine**2) * b, bases)).mean())
