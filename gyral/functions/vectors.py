"""Array arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null where lengths differ or an element is null."""
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean(v: Column) -> Column:
    return total(v) / F.nullif(F.size(v), F.lit(0))


def mse(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def mae(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def z_score(v: Column) -> Column:
    """(x - mean) / (population deviation + 1e-6)."""
    centred = _let(v, lambda a: _let(mean(a), lambda m: F.transform(a, lambda x: x - m)))
    return _let(centred, lambda c: _let(F.sqrt(mean(F.transform(c, lambda x: x * x))) + 1e-6, lambda s: F.transform(c, lambda x: x / s)))


def l2_unit(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    return _let(v, lambda a: _let(F.sqrt(dot(a, a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def block_means(v: Column, blocks: int) -> Column:
    """Means of `blocks` equal runs; the remainder is trimmed off. Null for null and for fewer numbers than blocks."""
    means = _let(F.floor(F.size(v) / blocks).cast("int"), lambda f: F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: mean(F.slice(v, i * f + 1, f))))
    return F.when(F.size(v) >= blocks, means)


def fingerprint(v: Column, blocks: int) -> Column:
    """Centred block means of unit length."""
    return _let(block_means(v, blocks), lambda b: l2_unit(_let(mean(b), lambda m: F.transform(b, lambda x: x - m))))
