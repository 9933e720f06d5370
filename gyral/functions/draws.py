"""Reproducible draws: hashes of a seed and a key instead of a random generator's state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token(seed: str, *keys: Column) -> Column:
    """md5 text of seed|key|..., to order by; the same in other SQL engines."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in keys)).cast("binary"))


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) with 32 bits."""
    return F.conv(F.substring(token(seed, *keys), 1, 8), 16, 10).cast("double") / float(2**32)


def log_uniform(u: Column, low: float, high: float) -> Column:
    """exp of a uniform draw between the logarithms."""
    a, b = F.log(F.lit(float(low))), F.log(F.lit(float(high)))
    return F.exp(a + u * (b - a))
