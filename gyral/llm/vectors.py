"""Unit vectors in a compact, rotated form that joins and Python workers share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 144
SEED = 20240607
#: Rows at most from which means and centroids are fitted; every row is indexed.
FIT_ROWS = 65_536


@cache
def rotation(dim: int, number: int = 0) -> np.ndarray:
    """Random orthogonal matrix number `number`, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def decode(blobs, dim: int) -> np.ndarray:
    """Rows of int16 bytes -> float64 integers, as stored."""
    return np.frombuffer(b"".join(blobs), dtype="<i2").reshape(-1, dim).astype(np.float64)


def unit(ints: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(ints, axis=1, keepdims=True)
    return (ints / np.where(norm > 0, norm, 1)).astype(np.float32)


def _valid(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are valid vectors, and those rows as float64."""
    column = column.cast(pa.large_list(pa.float64())) if not pa.types.is_large_list(column.type) or column.type.value_type != pa.float64() else column
    lengths = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.float64), nan=-1)
    at = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(-1, dim)
    good = np.isfinite(rows).all(1) & ((rows != rows[:, :1]).any(1) if len(rows) else True)
    return at[good], rows[good]


def prepare(df: DataFrame, emb: str = "emb", dim: int = DIM) -> DataFrame:
    """The rows with a valid vector (dim finite numbers, not all equal), `emb` replaced by `v` and `code`.

    v: the vector less its own mean, turned by a fixed random rotation, as int16 with the row's largest number at
    32767; its cosines differ from the exact ones by about 3e-6. code: 64-bit hash of v in int8 steps; rows of one
    code are alike to 0.995 at least, and copies, also those stored in other units, share it. Rows with null,
    short, constant or non-finite vectors are left out, other columns stay as they are.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != emb) + ", v binary, step binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = _valid(batch.column(batch.schema.get_field_index(emb)), dim)
            peak = np.abs(rows).max(1, keepdims=True) if len(rows) else 1
            rows = rows / np.where(peak > 0, peak, 1)
            rows -= rows.mean(1, keepdims=True)
            rows = unit(rows).astype(np.float64) @ rotation(dim).T.astype(np.float64)
            rows /= np.maximum(np.abs(rows).max(1, keepdims=True), 1e-30) if len(rows) else 1
            v, step = np.rint(rows * 32767).astype("<i2"), np.rint(rows * 127).astype("i1")
            rest = batch.take(pa.array(at))
            kept = [i for i, name in enumerate(batch.schema.names) if name != emb]
            packed = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (v, step)]
            yield pa.RecordBatch.from_arrays([*(rest.column(i) for i in kept), *packed], [*(batch.schema.names[i] for i in kept), "v", "step"])

    return df.mapInArrow(run, schema).withColumn("code", F.xxhash64("step")).drop("step")


def fit_sample(prepared: DataFrame, key: str, rows: int, total: int, dim: int = DIM) -> np.ndarray:
    """Unit vectors of about `rows` (at most FIT_ROWS) rows, chosen by a hash of the key."""
    rows = min(rows, FIT_ROWS)
    part = prepared if total <= rows else prepared.filter(F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(1_000_000)) < int(1_000_000 * rows / total) + 1)
    got = [bytes(r[0]) for r in part.select("v").limit(FIT_ROWS).collect()] if total else []
    return unit(decode(got, dim)) if got else np.zeros((0, dim), np.float32)


def centre(sample: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The corpus template: the mean of a fitted sample."""
    return sample.mean(0) if len(sample) else np.zeros(dim, np.float32)


def verified(pairs: DataFrame, first: DataFrame, second: DataFrame, key: str, least: float, dim: int = DIM, few: bool = False) -> DataFrame:
    """pairs(lo, hi) whose exact cosine is at least `least`; first and second(key, v) hold the vectors of lo and of hi.

    One pass over each: a vector of `first` travels once for each of its pairs, one of `second` once. few: the pairs are known
    to be few enough to be sent to the vectors, which then stay where they are but for those of the pairs.
    """
    sent = F.broadcast if few else lambda df: df
    lo = first.select(F.col(key).alias("lo"), F.col("v").alias("v_lo")).join(sent(pairs.select("lo", "hi")), "lo")
    hi = second.select(F.col(key).alias("hi"), F.col("v").alias("v_hi")).join(sent(pairs.select("hi").distinct()), "hi", "left_semi")
    return alike(lo.join(hi, "hi").select("lo", "hi", "v_lo", "v_hi"), least, dim)


def alike(both: DataFrame, least: float, dim: int = DIM, also=None) -> DataFrame:
    """The rows of both(..., v_lo, v_hi) whose vectors have at least that exact cosine, without the vectors.

    also(lo, hi), given the packed vectors of those that have, may sort out more.
    """
    kept = [f for f in both.schema if f.name not in ("v_lo", "v_hi")]
    names, schema = [f.name for f in kept], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lo, hi = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("v_lo", "v_hi"))
            a, b = decode(lo, dim), decode(hi, dim)
            at = np.flatnonzero((a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1)) >= least)
            if also is not None and len(at):
                at = at[also([lo[i] for i in at], [hi[i] for i in at])]
            keep = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keep.column(keep.schema.get_field_index(n)) for n in names], names)

    return both.mapInArrow(run, schema)
