"""Scaling, smoothing, resampling and wavelets of volumes and series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from gyral.operators.voxels import XYZ, by_volume, numbers
from gyral.plans.ranks import group_rank


def intensity_scale(values: Column, nonzero: bool, q: float = 0.995) -> Column:
    """Aggregate: the q-quantile over cells above 0, or over all; 1 where it is missing or not above 1e-6."""
    p = F.percentile(F.when(values > 0, values) if nonzero else values, F.lit(q))
    return F.when(p > 1e-6, p).otherwise(F.lit(1.0))


def clip_normalised(volume: DataFrame, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """volume with n: clipped to two quantiles, over its largest value, to -1..1; top is that value."""
    w = volume.groupBy("vol").agg(F.percentile("v", F.lit(low)).alias("lo"), F.percentile("v", F.lit(high)).alias("hi"), F.max("v").alias("vmax"))
    clipped = F.greatest(F.least("v", "hi"), "lo")
    top = F.greatest(F.least("vmax", "hi"), "lo")
    return volume.join(w, "vol").withColumn("top", top).withColumn("n", F.when(top > 1e-6, clipped / top).otherwise(clipped) * 2 - 1).drop("lo", "hi", "vmax")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def smoothed(series: DataFrame, by: str, place: str, value: str, sigma: float) -> DataFrame:
    """series with smooth: a 1-D Gaussian over dense places 0..n-1, mirrored at both ends; sigma 0 changes nothing."""
    if sigma == 0:
        return series.withColumn("smooth", F.col(value))
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    count = F.col("_n")
    rows = series.join(series.groupBy(by).agg(F.count("*").alias("_n")), by)
    table = F.explode(F.array(*(F.struct(F.lit(i - r).alias("o"), F.lit(w).alias("w")) for i, w in enumerate(weights))))
    spread = rows.select(by, "_n", (F.col(place)).alias("_from"), F.col(value).alias("_v"), table.alias("_k"))
    # the mirrored series has period 2n: each place takes part at its own place and at its mirror images
    images = F.flatten(F.transform(F.sequence(F.lit(-1) - F.floor(F.lit(r) / count).cast("int"), F.floor(F.lit(r) / count).cast("int") + 1), lambda p: F.array(F.col("_from") + 2 * count * p, 2 * count * p - 1 - F.col("_from"))))
    hit = spread.withColumn("_at", F.explode(images)).withColumn("_to", F.col("_at") - F.col("_k.o")).filter((F.col("_to") >= 0) & (F.col("_to") < count))
    summed = hit.groupBy(by, F.col("_to").alias(place)).agg(F.sum(F.col("_v") * F.col("_k.w")).alias("smooth"))
    return series.join(summed, [by, place])


def moving_average(df: DataFrame, by: str, order: str, value: str, decay: float) -> DataFrame:
    """(by, ema): the fold s = decay * s + (1 - decay) * x over each group's rows in order, from the first row's value.

    Written out as a weighted sum, which needs each row's place only: no group is gathered in one task.
    """
    rows = group_rank(df.select(by, order, F.col(value).cast("double").alias("_v")), by, order, name="_p", size="_s")
    left = F.pow(F.lit(decay), F.col("_s") - 1 - F.col("_p"))
    weight = F.when(F.col("_p") == 0, left).otherwise(left * (1 - decay))
    return rows.groupBy(by).agg(F.sum(F.col("_v") * weight).alias("ema"))


def resampled_nearest(volume: DataFrame, shape: tuple[int, int, int], target: tuple[int, int, int]) -> DataFrame:
    """Each target cell takes the source cell under its corner, floor(i * source / target)."""
    rows = volume
    for c, n, m in zip(XYZ, shape, target):
        low = F.ceil(F.col(c) * m / n).cast("int")
        high = F.ceil((F.col(c) + 1) * m / n).cast("int") - 1
        rows = rows.filter(high >= low).withColumn(c, F.explode(F.sequence(low, high)))
    return rows


def resampled_linear(series: DataFrame, by: str, place: str, value: str, size: int, target: int) -> DataFrame:
    """A series of `size` places brought to `target` places, ends on ends, linear in between; missing places are 0."""
    step = (size - 1) / max(1, target - 1)
    places = series.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0), F.lit(target - 1))).alias(place))
    at = F.col(place) * F.lit(step)
    ends = places.withColumn("_low", F.least(F.floor(at), F.lit(max(0, size - 2))).cast("int")).withColumn("_f", at - F.col("_low"))
    pairs = ends.select(by, place, F.explode(F.array(F.struct(F.col("_low").alias("s"), (1 - F.col("_f")).alias("w")), F.struct((F.col("_low") + 1).alias("s"), F.col("_f").alias("w")))).alias("_e"))
    source = series.select(by, F.col(place).cast("int").alias("_s"), F.col(value).alias("_v"))
    met = pairs.select(by, place, F.col("_e.s").alias("_s"), F.col("_e.w").alias("_w")).join(source, [by, "_s"], "left")
    return met.groupBy(by, place).agg(F.sum(F.coalesce("_v", F.lit(0.0)) * F.col("_w")).alias(value))


HAAR = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]


def haar(volume: DataFrame) -> DataFrame:
    """(vol, x, y, z, band, c): one level of the orthonormal Haar transform; band bits say along which axis it differs."""
    block = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in XYZ]
    sign = lambda band: F.when(F.pmod(sum(F.pmod(c, F.lit(2)) * b for c, b in zip(XYZ, band)), F.lit(2)) == 0, F.col("v")).otherwise(-F.col("v"))
    sums = [(F.sum(sign(b)) / math.sqrt(8)).alias(f"b{i}") for i, b in enumerate(HAAR)]
    wide = volume.groupBy("vol", *block).agg(*sums)
    return wide.select("vol", *XYZ, F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col(f"b{i}").alias("c")) for i in range(8)))).alias("k")).select("vol", *XYZ, "k.band", "k.c")


def haar_inverse(bands: DataFrame) -> DataFrame:
    """(vol, x, y, z, v) from haar()."""
    wide = bands.groupBy("vol", *XYZ).agg(*(F.sum(F.when(F.col("band") == i, F.col("c"))).alias(f"b{i}") for i in range(8)))
    cell = lambda p: sum(F.col(f"b{i}") * (-1 if sum(a * b for a, b in zip(p, band)) % 2 else 1) for i, band in enumerate(HAAR)) / math.sqrt(8)
    cells = F.array(*(F.struct(*((F.col(c) * 2 + o).alias(c) for c, o in zip(XYZ, p)), cell(p).alias("v")) for p in HAAR))
    return wide.select("vol", F.explode(cells).alias("k")).select("vol", "k.*")


def kmeans_1d(df: DataFrame, value: str, k: int = 3, rounds: int = 25) -> list[float]:
    """Ascending centres: interior quantiles to begin with, then rounds of means; only k numbers reach the driver a round."""
    start = df.agg(F.percentile(value, F.array(*(F.lit(i / (k + 1)) for i in range(1, k + 1))))).first()[0]
    if start is None:
        return [0.0] * k
    centres = list(start)
    for _ in range(rounds):
        near = F.array_position(F.transform(F.array(*map(F.lit, centres)), lambda c: F.abs(F.col(value) - c)), F.least(*(F.abs(F.col(value) - F.lit(c)) for c in centres))) - 1
        got = {r[0]: r[1] for r in df.filter(F.col(value).isNotNull()).groupBy(near.alias("j")).agg(F.avg(value)).collect()}
        new = [got.get(j, c) for j, c in enumerate(centres)]
        if all(abs(a - b) <= 1e-8 + 1e-5 * abs(b) for a, b in zip(new, centres)):
            break
        centres = new
    return sorted(centres)


def masked_errors(pairs: DataFrame, by: str, inside: Column) -> DataFrame:
    """pairs(by, p, t) -> mean absolute and squared error over the cells inside; null where there are none."""
    gap = F.when(inside, F.col("p") - F.col("t"))
    return pairs.groupBy(by).agg(F.avg(F.abs(gap)).alias("l1"), F.avg(gap * gap).alias("mse"), F.count(gap).alias("n"))


def ssim(pairs: DataFrame, by: str, data_range: float) -> DataFrame:
    """pairs(by, p, t) -> structural similarity of each window, from its moments (uniform weights)."""
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    m = pairs.groupBy(by).agg(F.avg("p").alias("mp"), F.avg("t").alias("mt"), F.var_pop("p").alias("vp"), F.var_pop("t").alias("vt"), F.covar_pop("p", "t").alias("cov"))
    value = (2 * F.col("mp") * F.col("mt") + c1) * (2 * F.col("cov") + c2) / ((F.col("mp") ** 2 + F.col("mt") ** 2 + c1) * (F.col("vp") + F.col("vt") + c2))
    return m.select(by, value.alias("ssim"))


def adaptive_budget(size: Column, most: int, least: int = 1) -> Column:
    """Samples for a hole of a size; the edges are fixed values."""
    tier = F.when(size < 4654, 2).when(size < 18841, 4).when(size < 51128, 8).otherwise(most)
    return F.greatest(F.lit(least), F.least(tier, F.lit(most)))


def along(volume: DataFrame, axis: str, matrix: list[list[tuple[int, float]]], *values: str) -> DataFrame:
    """A linear map along an axis: cell s adds weight times its values to each target of matrix[s]; absent cells are 0.

    The matrix is as long as the axis and holds few targets a cell; one aggregation, combined before the shuffle.
    """
    rest = [c for c in XYZ if c != axis]
    rows = F.array(*(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(float(w)).alias("w")) for t, w in row)).cast("array<struct<t:int,w:double>>") for row in matrix))
    spread = volume.select("vol", *rest, *values, F.explode(F.element_at(rows, F.col(axis) + 1)).alias("_k"))
    return spread.groupBy("vol", *rest, F.col("_k.t").alias(axis)).agg(*(F.sum(F.col(v) * F.col("_k.w")).alias(v) for v in values)).select("vol", *XYZ, *values)


def linear_matrix(size: int, target: int) -> list[list[tuple[int, float]]]:
    """Resampling of an axis, ends on ends, linear in between."""
    step = (size - 1) / max(1, target - 1)
    return [[(i, w) for i in range(target) if (w := 1 - abs(i * step - s)) > 1e-12] for s in range(size)]


def resampled_trilinear(volume: DataFrame, shape: tuple[int, int, int], target: tuple[int, int, int], *values: str) -> DataFrame:
    """volume brought to another grid, axis by axis; cells that are absent count as 0 and stay absent where nothing is near."""
    for c, n, m in zip(XYZ, shape, target):
        volume = along(volume, c, linear_matrix(n, m), *(values or ("v",)))
    return volume


def _mirrored_sums(a: np.ndarray, weights: list[float]) -> np.ndarray:
    """a(x, y, z, any) weighted along x, y and z in turn, mirrored at the borders."""
    r = len(weights) // 2
    for axis in range(3):
        n, out = a.shape[axis], np.zeros(a.shape)
        for o, w in enumerate(weights):
            at = (np.arange(n) + o - r) % (2 * n)
            out += w * a.take(np.where(at < n, at, 2 * n - 1 - at), axis)
        a = out
    return a


def _smooth(vols: pa.Array, index: np.ndarray, table: pa.Table, shape: tuple[int, int, int], weights: list[float], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smoothed, cell, known): arrays (value, cell, vol) of all volumes, each row's cell, and whether the grid has it."""
    x, y, z = (numbers(table, c, -1).astype(np.int64) for c in XYZ)
    known = (x >= 0) & (x < shape[0]) & (y >= 0) & (y < shape[1]) & (z >= 0) & (z < shape[2]) & table.column(0).combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    cell = np.where(known, (x * shape[1] + y) * shape[2] + z, 0)
    k, cells = len(vols), math.prod(shape)
    place = cell[known] * k + index[known]
    sums = np.stack([np.bincount(place, v[known], cells * k).reshape(*shape, k) for v in values], 3)
    out = _mirrored_sums(sums.reshape(*shape, -1), weights).reshape(cells, len(values), k)
    return out.swapaxes(0, 1), cell, known


def _weights(sigma: float) -> list[float]:
    return gaussian_weights(sigma) if sigma else [1.0]


def smoothed_volume(volume: DataFrame, shape: tuple[int, int, int], sigma: float, *values: str) -> DataFrame:
    """(vol, x, y, z, values) of every cell of the grid: a 3-D Gaussian, axis by axis, mirrored at the borders.

    Absent cells and nulls count as 0, cells off the grid don't count; sigma 0 only fills the grid. A volume is smoothed in
    one task, so that only the cells that are there are shuffled, by vol and once.
    """
    names, weights, cells = values or ("v",), _weights(sigma), math.prod(shape)
    own = volume.select("vol", *XYZ, *(F.col(v).cast("double").alias(v) for v in names))
    schema = StructType([own.schema["vol"], *(StructField(c, IntegerType()) for c in XYZ), *(StructField(v, DoubleType()) for v in names)])

    def run(vols: pa.Array, index: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        k = len(vols)
        sums, _, _ = _smooth(vols, index, table, shape, weights, [numbers(table, v, 0.0) for v in names])
        grid = [np.tile(i.ravel().astype(np.int32), k) for i in np.indices(shape)]
        yield pa.RecordBatch.from_arrays([vols.take(pa.array(np.repeat(np.arange(k), cells))), *map(pa.array, grid), *(pa.array(s.T.ravel()) for s in sums)], names=["vol", *XYZ, *names])

    return by_volume(own, run, schema, cells * len(names))


def smoothed_cells(rows: DataFrame, shape: tuple[int, int, int], sigma: float, value: str = "v", name: str = "soft") -> DataFrame:
    """rows(vol, x, y, z, value, any) with what smoothed_volume has of the row's cell; null where the grid has no such cell.

    A row without value is not part of the volume and only asks for its cell.
    """
    weights, own = _weights(sigma), rows.select("vol", *(c for c in rows.columns if c != "vol")).withColumn(value, F.col(value).cast("double"))
    schema = StructType([*own.schema.fields, StructField(name, DoubleType())])

    def run(vols: pa.Array, index: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        sums, cell, known = _smooth(vols, index, table, shape, weights, [numbers(table, value, 0.0)])
        yield from table.append_column(name, pa.array(sums[0, cell, index], mask=~known)).combine_chunks().to_batches()

    return by_volume(own, run, schema, math.prod(shape))


def ssim_map(pairs: DataFrame, shape: tuple[int, int, int], data_range: float, sigma: float = 1.5) -> DataFrame:
    """pairs(vol, x, y, z, p, t, any) on a full grid -> the same with ssim for p and t: similarity of each cell's Gaussian surroundings."""
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    weights, kept = _weights(sigma), ["vol", *(c for c in pairs.columns if c not in ("vol", "p", "t"))]
    rows = pairs.select(*kept, *(F.col(c).cast("double").alias(c) for c in "pt"))
    schema = StructType([*(rows.schema[c] for c in kept), StructField("ssim", DoubleType())])

    def run(vols: pa.Array, index: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = (numbers(table, c, 0.0) for c in "pt")
        sums, cell, known = _smooth(vols, index, table, shape, weights, [a, b, a * a, b * b, a * b])
        p, t, pp, tt, pt = sums
        value = (2 * p * t + c1) * (2 * (pt - p * t) + c2) / ((p * p + t * t + c1) * (pp - p * p + tt - t * t + c2))
        yield from table.select(kept).append_column("ssim", pa.array(value[cell, index], mask=~known)).combine_chunks().to_batches()

    return by_volume(rows, run, schema, 5 * math.prod(shape))


def turned(volume: DataFrame, plane: str, degrees: Column, shape: tuple[int, int, int]) -> DataFrame:
    """volume(vol, x, y, z, v) turned about its centre by an angle of the volume, nearest neighbour, on the same grid.

    Every target cell looks up the cell it comes from; cells that come from outside, or from an absent one, are absent.
    """
    a, b = plane
    sizes = dict(zip(XYZ, shape))
    angles = volume.select("vol").distinct().withColumn("_r", F.radians(degrees.cast("double")))
    span = lambda c: F.explode(F.sequence(F.lit(0), F.lit(sizes[c] - 1)))
    u, w = F.col("_a") - (sizes[a] - 1) / 2, F.col("_b") - (sizes[b] - 1) / 2
    from_a = F.floor(F.cos("_r") * u + F.sin("_r") * w + (sizes[a] - 1) / 2 + 0.5).cast("int").alias(a)
    from_b = F.floor(F.cos("_r") * w - F.sin("_r") * u + (sizes[b] - 1) / 2 + 0.5).cast("int").alias(b)
    targets = angles.withColumn("_a", span(a)).withColumn("_b", span(b)).select("vol", F.col("_a"), F.col("_b"), from_a, from_b)
    return volume.join(targets, ["vol", a, b]).drop(a, b).withColumnsRenamed({"_a": a, "_b": b}).select("vol", *XYZ, "v")


def tiles(series: DataFrame, place: str, size: int, step: int) -> DataFrame:
    """Each row once for every sliding window it is in, as tile, with its place in it as at; windows start at multiples of step."""
    last = F.floor(F.col(place) / step)
    back = F.sequence(F.lit(0), F.lit(-(-size // step) - 1))
    rows = series.withColumn("tile", F.explode(F.transform(back, lambda b: last - b))).withColumn("at", F.col(place) - F.col("tile") * step)
    return rows.filter((F.col("tile") >= 0) & (F.col("at") < size))


def blended(tiled: DataFrame, key: str, value: str, size: int, sigma: float) -> DataFrame:
    """(key, value): what the windows say of a row, averaged with Gaussian weights around the window's middle."""
    weight = F.exp(F.pow((F.col("at") - (size - 1) / 2) / sigma, 2) * -0.5)
    return tiled.groupBy(key).agg((F.sum(F.col(value) * weight) / F.sum(weight)).alias(value))
