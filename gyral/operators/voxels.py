"""Masks and volumes as sparse voxel rows (vol, x, y, z[, v])."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gyral.operators.components import components

XYZ = ("x", "y", "z")

#: Cells of dense arrays that a task holds at once; a volume with more of them is an array of its own.
DENSE_CELLS = 1 << 21
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 1 << 16


def whole_volumes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut anew so that each table holds all rows of its volumes."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        index = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        start = int(np.searchsorted(index, index[-1]))
        if start or held and held[0].column(0)[0] != t.column(0)[0]:
            yield pa.concat_tables([*held, t.slice(0, start)])
            held = []
        held.append(t.slice(start))
    if held:
        yield pa.concat_tables(held)


def by_volume(rows: DataFrame, run: Callable[[pa.Array, np.ndarray, pa.Table], Iterator[pa.RecordBatch]], schema: StructType, cells: int) -> DataFrame:
    """run(vols, index, table) over whole volumes: table has their rows, index says for each row which of vols it is of.

    vol is the first column of rows. One shuffle by vol, none where the rows lie so already. A call gets so many volumes
    of `cells` cells as make DENSE_CELLS, at least one.
    """
    step = max(1, DENSE_CELLS // cells)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_volumes(batches):
            named = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
            index = named.indices.to_numpy()
            for first in range(0, len(named.dictionary), step):
                low, high = np.searchsorted(index, (first, first + step))
                for out in run(named.dictionary.slice(first, step), index[low:high] - first, table.slice(low, high - low)):
                    for at in range(0, out.num_rows, OUT_ROWS):
                        yield out.slice(at, OUT_ROWS)

    return rows.repartition("vol").sortWithinPartitions("vol").mapInArrow(each, schema)


def numbers(table: pa.Table, name: str, null: float) -> np.ndarray:
    """A column as numbers, with `null` for null."""
    return table.column(name).combine_chunks().fill_null(null).to_numpy(zero_copy_only=False)


def offsets(radius: int, metric: str = "manhattan") -> list[tuple[int, int, int]]:
    """Offsets within a radius: 'manhattan' (6-neighbour steps), 'box' (26-neighbour steps) or 'euclid'."""
    size = {"manhattan": lambda p: sum(map(abs, p)), "box": lambda p: max(map(abs, p)), "euclid": lambda p: sum(c * c for c in p) ** 0.5}[metric]
    span = range(-radius, radius + 1)
    return [(i, j, k) for i in span for j in span for k in span if size((i, j, k)) <= radius]


def shifted(mask: DataFrame, steps: list[tuple[int, int, int]], keep: list[str] | None = None) -> DataFrame:
    """Each cell moved by each offset, with the offset as dx, dy, dz."""
    table = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a, b, c in steps))).alias("o")
    rows = mask.select("vol", *XYZ, *(keep or []), table)
    return rows.select("vol", *((F.col(c) + F.col(f"o.d{c}")).alias(c) for c in XYZ), *(keep or []), "o.dx", "o.dy", "o.dz")


def within(shape: tuple[int, int, int]) -> Column:
    return reduce(lambda a, b: a & b, ((F.col(c) >= 0) & (F.col(c) < n) for c, n in zip(XYZ, shape)))


def foreground(volume: DataFrame, share: float | None = None) -> DataFrame:
    """Cells above 0, or above `share` of the volume's largest value."""
    if share is None:
        return volume.filter(F.col("v") > 0)
    return volume.withColumn("_top", F.max("v").over(Window.partitionBy("vol"))).filter(F.col("v") > share * F.col("_top")).drop("_top")


def labelled(mask: DataFrame, shape: tuple[int, int, int], connectivity: int = 6) -> DataFrame:
    """(vol, x, y, z, label): connected components, 6 or 26 neighbours; the label is the component's first cell number."""
    metric = {6: "manhattan", 26: "box"}[connectivity]
    half = [o for o in offsets(1, metric) if o > (0, 0, 0)]
    nx, ny, nz = shape
    at = ((F.col("x").cast("bigint") * ny + F.col("y")) * nz + F.col("z")).alias("cell")
    cells = mask.select("vol", *XYZ).distinct()
    own = cells.select("vol", *XYZ, at)
    moved = shifted(own, half, ["cell"]).select("vol", *XYZ, F.col("cell").alias("from"))
    met = moved.join(own, ["vol", *XYZ])
    edges = met.select(F.struct("vol", F.col("cell").alias("cell")).alias("a"), F.struct("vol", F.col("from").alias("cell")).alias("b"))
    roots = components(edges).select(F.col("node.vol").alias("vol"), F.col("node.cell").alias("cell"), F.col("root.cell").alias("label"))
    return own.join(roots, ["vol", "cell"], "left").select("vol", *XYZ, F.coalesce("label", "cell").alias("label"))


def component_sizes(labels: DataFrame) -> DataFrame:
    """(vol, label, size, place): components of a volume, the largest first, ties by label."""
    sizes = labels.groupBy("vol", "label").agg(F.count("*").alias("size"))
    return sizes.withColumn("place", F.row_number().over(Window.partitionBy("vol").orderBy(F.desc("size"), "label")))


def bounding_boxes(labels: DataFrame, *by: str) -> DataFrame:
    """Half-open boxes, their centres and cell counts per group."""
    ends = [e for c in XYZ for e in (F.min(c).alias(f"{c}0"), (F.max(c) + 1).alias(f"{c}1"))]
    boxes = labels.groupBy(*by).agg(*ends, F.count("*").alias("size"))
    return boxes.withColumns({f"c{c}": F.floor((F.col(f"{c}0") + F.col(f"{c}1")) / 2).cast("int") for c in XYZ})


def dilated(mask: DataFrame, rounds: int, shape: tuple[int, int, int]) -> DataFrame:
    """The mask grown by `rounds` steps to 6 neighbours: all cells within that Manhattan distance."""
    return shifted(mask, offsets(rounds)).filter(within(shape)).select("vol", *XYZ).distinct()


def distance_map(cells: DataFrame, mask: DataFrame, radius: int | None = None) -> DataFrame:
    """cells with dm, the euclidean distance to the nearest cell of the volume's mask; null where the mask is empty.

    With a radius, null beyond it: an equi-join on the shifted coordinates, so a cell meets only what lies within.
    Without, the exact transform axis by axis: each line of cells takes the least of what the lines before it hold, so the
    work is a line's length for each cell, whatever the distances.
    """
    if radius is None:
        return _full_distance_map(cells, mask)
    near = shifted(mask.select("vol", *XYZ).distinct(), offsets(radius, "euclid"))
    reach = near.groupBy("vol", *XYZ).agg(F.min(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).alias("d2"))
    return cells.join(reach, ["vol", *XYZ], "left").withColumn("dm", F.sqrt("d2")).drop("d2")


def _full_distance_map(cells: DataFrame, mask: DataFrame) -> DataFrame:
    span = lambda c: F.sequence(F.col(f"{c}0"), F.col(f"{c}1"))
    box = cells.groupBy("vol").agg(*(f(c).alias(f"{c}{e}") for c in "yz" for f, e in ((F.min, 0), (F.max, 1))))
    least = lambda line, at: F.array_min(F.transform(line, lambda p: p["d2"] + (p["at"] - F.col(at)) * (p["at"] - F.col(at))))
    line = lambda at, d2: F.collect_list(F.struct(F.col(at).cast("long").alias("at"), d2.cast("long").alias("d2"))).alias("line")
    marked = mask.select("vol", *XYZ).distinct()
    along_z = marked.groupBy("vol", "x", "y").agg(line("z", F.lit(0))).join(box, "vol").withColumn("z", F.explode(span("z"))).select("vol", *XYZ, least("line", "z").alias("d2"))
    along_y = along_z.groupBy("vol", "x", "z").agg(line("y", F.col("d2"))).join(box, "vol").withColumn("y", F.explode(span("y"))).select("vol", *XYZ, least("line", "y").alias("d2"))
    along_x = along_y.groupBy("vol", "y", "z").agg(line("x", F.col("d2")))
    return cells.join(along_x, ["vol", "y", "z"], "left").select(*(cells[c] for c in cells.columns), F.sqrt(least("line", "x")).alias("dm"))


def min_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(vol, d): least euclidean distance between two masks of a volume; 0 where they overlap, no row where one is empty.

    b is first reduced, for each column of cells, to what a cell of a can be nearest to: the pairs are then of
    columns, not of cells.
    """
    runs = lambda m: m.groupBy("vol", "x", "y").agg(F.array_sort(F.collect_set("z")).alias("zs"))
    p, q = runs(a), runs(b).select("vol", F.col("x").alias("u"), F.col("y").alias("w"), F.col("zs").alias("ts"))
    gap = F.array_min(F.transform("zs", lambda z: F.array_min(F.transform("ts", lambda t: F.abs(z - t)))))
    d2 = (F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("w")) ** 2 + gap**2
    return p.join(q, "vol").groupBy("vol").agg(F.sqrt(F.min(d2)).alias("d"))


def holes(mask: DataFrame, *_bounds: object) -> DataFrame:
    """Cells that no path of 6-neighbour background cells connects with the volume's border.

    Each volume is flooded from outside in one task, as an array as large as the masks' box and one cell wider: sweeps
    along the axes, there and back, until nothing changes. Boxes and shape, which some callers give, aren't needed.
    """
    schema = mask.select("vol", *(F.lit(0).alias(c) for c in XYZ)).schema

    def enclosed(vols: pa.Array, index: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        low, size = at.min(0) - 1, np.ptp(at, 0) + 3
        if len(vols) > 1 and len(vols) * size.astype(float).prod() > DENSE_CELLS:
            half = len(vols) // 2
            cut_at = np.searchsorted(index, half)
            yield from enclosed(vols.slice(0, half), index[:cut_at], at[:cut_at])
            yield from enclosed(vols.slice(half), index[cut_at:] - half, at[cut_at:])
            return
        air = np.ones((*size, len(vols)), bool)
        air[(*(at - low).T, index)] = False
        out = np.zeros_like(air)
        for axis in range(3):
            np.moveaxis(out, axis, 0)[[0, -1]] = True
        reached = -1
        while reached != (reached := np.count_nonzero(out)):
            for axis in range(3):
                o, a = np.moveaxis(out, axis, 0), np.moveaxis(air, axis, 0)
                for i in range(1, len(o)):
                    o[i] |= o[i - 1] & a[i]
                for i in range(len(o) - 2, -1, -1):
                    o[i] |= o[i + 1] & a[i]
        *found, of = np.nonzero(air & ~out)
        yield pa.RecordBatch.from_arrays([vols.take(pa.array(of)), *(pa.array((f + n).astype(np.int32)) for f, n in zip(found, low))], ["vol", *XYZ])

    def run(vols: pa.Array, index: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        return enclosed(vols, index, np.stack([numbers(table, c, 0).astype(np.int64) for c in XYZ], 1))

    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in ("vol", *XYZ)))
    return by_volume(mask.filter(known).select("vol", *XYZ), run, schema, 1)


def packed(mask: DataFrame, boxes: DataFrame, *by: str) -> DataFrame:
    """(by, shape, bits): each mask cropped to its box as a bitmap, one bit a cell in x, y, z order."""
    place = ((F.col("x") - F.col("x0")) * (F.col("y1") - F.col("y0")) + F.col("y") - F.col("y0")) * (F.col("z1") - F.col("z0")) + F.col("z") - F.col("z0")
    sizes = F.array(*((F.col(f"{c}1") - F.col(f"{c}0")) for c in XYZ))
    rows = mask.join(boxes, [*by]).select(*by, sizes.alias("shape"), place.cast("bigint").alias("place"))
    words = rows.groupBy(*by, "shape", F.floor(F.col("place") / 32).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(pmod(place, 32) AS INT)))").alias("bits"))
    return words.groupBy(*by, "shape").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "bits")))).alias("bits"))


def unpacked(masks: DataFrame, *by: str) -> DataFrame:
    """The cells of packed masks, counted from their box's corner."""
    rows = masks.select(*by, "shape", F.explode("bits").alias("word", "bits")).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(31))))
    rows = rows.filter(F.getbit("bits", "bit") == 1).withColumn("place", F.col("word") * 32 + F.col("bit"))
    plane = F.element_at("shape", 2) * F.element_at("shape", 3)
    return rows.select(*by, F.floor(F.col("place") / plane).cast("int").alias("x"), F.floor(F.pmod("place", plane) / F.element_at("shape", 3)).cast("int").alias("y"), F.pmod("place", F.element_at("shape", 3)).cast("int").alias("z"))


def flipped(volume: DataFrame, axes: str, shape: tuple[int, int, int]) -> DataFrame:
    return volume.withColumns({c: F.lit(n - 1) - F.col(c) for c, n in zip(XYZ, shape) if c in axes})


def rotated(volume: DataFrame, plane: str, turns: int, shape: tuple[int, int, int]) -> DataFrame:
    """Quarter turns in a plane such as 'xy', exact on the grid."""
    a, b = plane
    sizes = dict(zip(XYZ, shape))
    for _ in range(turns % 4):
        volume = volume.withColumns({a: F.lit(sizes[b] - 1) - F.col(b), b: F.col(a)})
        sizes[a], sizes[b] = sizes[b], sizes[a]
    return volume


def scaled(mask: DataFrame, factor: Column) -> DataFrame:
    """Nearest-neighbour isotropic scaling about the origin; factor is a column of the row."""
    f = factor.cast("double")
    rows = mask.withColumn("_f", f)
    for c in XYZ:
        rows = rows.withColumn(c, F.explode(F.sequence(F.ceil(F.col(c) * F.col("_f")), F.greatest(F.ceil((F.col(c) + 1) * F.col("_f")) - 1, F.ceil(F.col(c) * F.col("_f"))))))
    return rows.select("vol", *(F.col(c).cast("int").alias(c) for c in XYZ)).distinct()


def cropped(volume: DataFrame, starts: DataFrame, crop: tuple[int, int, int]) -> DataFrame:
    """volume(vol, x, y, z, v) within each volume's crop box starts(vol, sx, sy, sz), in the box's coordinates."""
    rows = volume.join(starts, "vol").select("vol", *((F.col(c) - F.col(f"s{c}")).alias(c) for c in XYZ), "v")
    return rows.filter(within(crop))


def grid_of(volume: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(vol, x, y, z): every cell of the grid for each volume."""
    nx, ny, nz = shape
    grid = volume.select("vol").distinct().select("vol", F.explode(F.sequence(F.lit(0), F.lit(nx * ny * nz - 1))).alias("i"))
    return grid.select("vol", F.floor(F.col("i") / (ny * nz)).cast("int").alias("x"), F.pmod(F.floor(F.col("i") / nz), F.lit(ny)).cast("int").alias("y"), F.pmod("i", F.lit(nz)).cast("int").alias("z"))


def padded(volume: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Every cell of the grid, 0 where the volume has none."""
    return grid_of(volume, shape).join(volume, ["vol", *XYZ], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def filled(volume: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """padded() for volumes that have a cell once: where a volume's cells lie in one partition, nothing is shuffled."""
    own = volume.filter(F.col("vol").isNotNull() & within(shape)).select("vol", *XYZ, "v")
    rows = own.unionByName(grid_of(volume, shape).withColumn("v", F.lit(None).cast(own.schema["v"].dataType)))
    return rows.groupBy("vol", *XYZ).agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("v"))


def centred_start(centre: Column, crop: int, size: int) -> Column:
    """Start of a crop around a centre, held inside the volume; 0 if the volume is smaller."""
    return F.greatest(F.lit(0), F.least(F.bround(centre - crop / 2).cast("int"), F.lit(size - crop))) if size >= crop else F.lit(0)


def containing_start(low: Column, high: Column, crop: int, size: int, u: Column | None = None) -> Column:
    """Start of a crop that holds low..high; drawn by u among the valid starts, or centred, or centred if too large."""
    if size < crop:
        return F.lit(0)
    middle = F.floor((low + high) / 2) - crop // 2
    first, last = F.greatest(F.lit(0), high - crop + 1), F.least(low, F.lit(size - crop))
    drawn = middle if u is None else F.when(last > first, first + F.floor(u * (last - first + 1))).otherwise(middle)
    start = F.when(high - low + 1 >= crop, middle).otherwise(drawn)
    return F.greatest(F.lit(0), F.least(start, F.lit(size - crop))).cast("int")
