"""Rows that feed training: visible values, mask and hidden target of a case as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyral.operators.voxels import XYZ


def in_order(value: Column, keep: Column) -> Column:
    """Aggregate: the kept values in x, y, z order."""
    cells = F.array_sort(F.collect_list(F.when(keep, F.struct(*XYZ, value.alias("v")))))
    return F.transform(cells, lambda s: s["v"])


def training_rows(volumes: DataFrame, masks: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(vol, voided, target[, prior]): a volume's cells outside the mask, inside it, and the prior's cells inside.

    A case without mask or without visible cells gives no row, as it can't be learnt from. One case is one row: its
    arrays are as long as its grid, not as the table.
    """
    rows = volumes.join(masks.select("vol", *XYZ, F.lit(True).alias("inside")), ["vol", *XYZ], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    cols = [in_order(F.col("v"), ~F.col("inside")).alias("voided"), in_order(F.col("v"), F.col("inside")).alias("target")]
    if prior is not None:
        rows = rows.join(prior.select("vol", *XYZ, F.col("v").alias("p")), ["vol", *XYZ], "left")
        cols.append(in_order(F.coalesce("p", F.lit(0.0)), F.col("inside")).alias("prior"))
    return rows.groupBy("vol").agg(*cols).filter((F.size("voided") > 0) & (F.size("target") > 0))


def sample_rows(cells: DataFrame, shape: tuple[int, int, int], hidden: float = 0.0, *more: str) -> DataFrame:
    """cells(vol, x, y, z, v, inside, loss) -> one row a volume: arrays pos, voided, mask, loss, target and those of `more`.

    All arrays run over the volume's cells in x, y, z order. voided holds `hidden` inside the mask, target the value wherever
    the loss counts and 0 elsewhere. Null values count as 0, null flags as false. A row is as long as its grid.
    """
    pos = ((F.col("x") * shape[1] + F.col("y")) * shape[2] + F.col("z")).cast("int")
    v, inside, loss = F.coalesce("v", F.lit(0.0)), F.coalesce("inside", F.lit(False)), F.coalesce("loss", F.lit(False))
    cell = F.struct(
        pos.alias("pos"), F.when(inside, F.lit(hidden)).otherwise(v).alias("voided"), inside.cast("int").alias("mask"), loss.cast("int").alias("loss"), F.when(loss, v).otherwise(F.lit(0.0)).alias("target"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in more)
    )
    rows = cells.groupBy("vol").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    field = lambda n: F.transform("cells", lambda c: c[n]).alias(n)
    return rows.select("vol", *(field(n) for n in ("pos", "voided", "mask", "loss", "target", *more)))


def channels(volume: DataFrame, hole: DataFrame, loss: DataFrame | None = None) -> DataFrame:
    """volume(vol, x, y, z, v) with inside, whether hole has the cell, and loss, whether loss has it (by default the hole)."""
    key = ["vol", *XYZ]
    rows = volume.join(hole.select(*key, F.lit(True).alias("inside")).distinct(), key, "left")
    if loss is not None:
        rows = rows.join(loss.select(*key, F.lit(True).alias("loss")).distinct(), key, "left")
    inside = F.coalesce("inside", F.lit(False))
    return rows.withColumn("inside", inside).withColumn("loss", inside if loss is None else F.coalesce("loss", F.lit(False)))


def nearest_cells(volume: DataFrame, centres: DataFrame) -> DataFrame:
    """The n cells of each volume nearest to its centre, centres(vol, cx, cy, cz, n); ties by place."""
    d2 = sum((F.col(c) - F.col(f"c{c}")) ** 2 for c in XYZ)
    w = Window.partitionBy("vol").orderBy("_d", *XYZ)
    near = volume.select("vol", *XYZ).join(centres, "vol").withColumn("_d", d2).withColumn("_r", F.row_number().over(w))
    return near.filter(F.col("_r") <= F.col("n")).select("vol", *XYZ)
