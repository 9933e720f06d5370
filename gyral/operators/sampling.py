"""Draws, sizes and placements that repeat: everything random is a hash of a seed and the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyral.functions.draws import token, uniform
from gyral.operators.voxels import XYZ
from gyral.plans.ranks import global_rank
from gyral.session import cut


def split_in_order(df: DataFrame, key: str, seed: str, held_out: int) -> DataFrame:
    """df with split: the `held_out` rows first in hash order are 'val', all others 'train'; ties by key.

    Only the held-out keys are ranked (a bounded top-n), the rest is decided by an anti-join.
    """
    first = df.select(key).distinct().orderBy(token(seed, F.col(key)), key).limit(held_out).withColumn("split", F.lit("val"))
    return df.join(first, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def oversampled(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Union of all parts, each row repeated as often as its part says; copy counts from 1."""
    each = [df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n)))) for df, n in parts if n > 0]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def inverse_size_window(sizes: DataFrame, wanted: DataFrame, tolerance: float, seed: str) -> DataFrame:
    """wanted(key, p) with the pick from sizes(id, p): a draw in a window around the inverse rank of p.

    The rank of p among the n ascending sizes is mirrored, the window reaches tolerance * n / 2 to both sides and is
    held inside 0 .. n - 1. Ranks come from range partitions; the lookups meet the sizes by equality of ranks.
    """
    ranked = cut(global_rank(sizes.select("id", "p"), "p", "id", total="n"), "sizes")
    # the rank of p: the sizes below it, counted where sizes and wanted values lie in one order
    both = sizes.select("p", F.lit(None).cast("bigint").alias("key"), F.lit(1).alias("is_size")).unionByName(wanted.select("p", F.col("key").cast("bigint").alias("key"), F.lit(0).alias("is_size")))
    # wanted values come before equal sizes; of the places before one, those of other wanted values are taken off
    placed_ = global_rank(both, "p", "is_size", "key", name="place")
    asked = global_rank(placed_.filter("is_size = 0").select("key", "p", "place"), "place", name="nth")
    at = asked.withColumn("below", F.col("place") - F.col("nth")).crossJoin(F.broadcast(ranked.agg(F.max("n").alias("n"))))
    half = tolerance * F.col("n") / 2
    low = F.greatest(F.lit(0), (F.col("n") - F.col("below") - half).cast("int"))
    high = (F.col("n") - F.col("below") + half).cast("int")
    high = F.when(high >= F.col("n"), F.col("n") - 1).otherwise(high)
    pick = (low + uniform(seed, F.col("key")) * (high - low)).cast("int")
    drawn = at.select("key", "p", "below", low.cast("int").alias("low"), high.cast("int").alias("high"), pick.alias("rank"))
    return drawn.join(ranked.select("rank", "id", F.col("p").alias("size")), "rank")


def smallest_share(sizes: DataFrame, parts: int) -> DataFrame:
    """The smallest 1/parts of sizes(id, p), as ntile(parts) = 1 has them."""
    ranked = global_rank(sizes.select("id", "p"), "p", "id", total="n")
    return ranked.filter(F.col("rank") < F.floor(F.col("n") / parts) + F.when(F.col("n") % parts > 0, 1).otherwise(0)).select("id", "p")


def drawn_size(keys: DataFrame, key: str, sizes: DataFrame, seed: str) -> DataFrame:
    """(key, target): a size for each key, drawn from the empirical distribution of sizes(id, p)."""
    ranked = cut(global_rank(sizes.select("id", "p"), "p", "id", total="n"), "sizes")
    n = F.broadcast(ranked.agg(F.max("n").alias("n")))
    asked = keys.select(key).crossJoin(n).select(key, F.floor(uniform(seed, F.col(key)) * F.col("n")).cast("bigint").alias("rank"))
    return asked.join(ranked.select(F.col("rank").cast("bigint").alias("rank"), F.col("p").alias("target")), "rank").select(key, "target")


def farthest_of(points: DataFrame, by: str, distance: str, n: int, seed: str, least: float) -> DataFrame:
    """Of n draws among each group's points farther than `least` the one farthest away; ties by place."""
    order = Window.partitionBy(by).orderBy(*XYZ)
    valid = points.filter(F.col(distance) > least).withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy(by))})
    counts = valid.groupBy(by).agg(F.first("_n").alias("_n"))
    draws = counts.select(by, "_n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    draws = draws.select(by, F.floor(uniform(seed, F.col(by), F.col("draw")) * F.col("_n")).cast("int").alias("_i"))
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(distance), *XYZ))
    return valid.drop("_n").join(draws.distinct(), [by, "_i"]).withColumn("_r", best).filter("_r = 1").select(by, *XYZ, distance)


def placed(shapes: DataFrame, spots: DataFrame, *by: str) -> DataFrame:
    """Shape cells shapes(vol, *by, x, y, z) moved so that their box is centred on spots(vol, *by, place, px, py, pz)."""
    keys = ["vol", *by]
    box = shapes.groupBy(*keys).agg(*((F.max(c) - F.min(c) + 1).alias(f"n{c}") for c in XYZ), *(F.min(c).alias(f"m{c}") for c in XYZ))
    rows = shapes.join(box, keys).join(spots, keys)
    cell = lambda c: (F.col(c) - F.col(f"m{c}") + F.col(f"p{c}") - F.floor(F.col(f"n{c}") / 2)).cast("int").alias(c)
    low = lambda c: (F.col(f"p{c}") - F.floor(F.col(f"n{c}") / 2)).cast("int").alias(f"lo{c}")
    high = lambda c: (F.col(f"p{c}") - F.floor(F.col(f"n{c}") / 2) + F.col(f"n{c}")).cast("int").alias(f"hi{c}")
    return rows.select("vol", "place", *map(cell, XYZ), *map(low, XYZ), *map(high, XYZ))


def mirrored(shapes: DataFrame) -> DataFrame:
    """shapes(vol, x, y, z) in the eight mirror images of its box, as turn 0 .. 7: bits 0, 1 and 2 mirror x, y and z."""
    box = shapes.groupBy("vol").agg(*(f(c).alias(f"{e}{c}") for c in XYZ for e, f in (("lo", F.min), ("hi", F.max))))
    rows = shapes.join(box, "vol").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(7))))
    flip = lambda i, c: F.when(F.getbit("turn", F.lit(i)) == 1, F.col(f"hi{c}") + F.col(f"lo{c}") - F.col(c)).otherwise(F.col(c)).alias(c)
    return rows.select("vol", "turn", *(flip(i, c) for i, c in enumerate(XYZ)))


def drawn_spots(keys: DataFrame, tries: int, seed: str, shape: tuple[int, int, int], first: int = 0) -> DataFrame:
    """keys(vol) with `tries` places from `first` on, each at a drawn cell of the grid."""
    rows = keys.select("vol").distinct().withColumn("place", F.explode(F.sequence(F.lit(first), F.lit(first + tries - 1))))
    return rows.select("vol", "place", *(F.floor(uniform(f"{seed}{c}", F.col("vol"), F.col("place")) * n).cast("int").alias(f"p{c}") for c, n in zip(XYZ, shape)))


def smallest_part(shapes: DataFrame, share: float) -> DataFrame:
    """The first cells of each shape in x, y, z order, `share` of them, rounded down but at least one."""
    n = F.count("*").over(Window.partitionBy("vol"))
    rank = F.row_number().over(Window.partitionBy("vol").orderBy(*XYZ))
    rows = shapes.select("vol", *XYZ, rank.alias("_r"), F.greatest(F.lit(1), F.floor(n * share)).alias("_n"))
    return rows.filter(F.col("_r") <= F.col("_n")).select("vol", *XYZ)


def first_masks(cells: DataFrame, codes: DataFrame, per: int | None = None) -> DataFrame:
    """(vol, draw, place, x, y, z): the cells of each volume's first valid place; with `per`, of every `per` places in a row.

    A draw without valid place has no rows.
    """
    draw = F.lit(0) if per is None else F.floor(F.col("place") / per).cast("int")
    best = codes.filter("code = 0").groupBy("vol", draw.alias("draw")).agg(F.min("place").alias("place"))
    return cells.select("vol", "place", *XYZ).join(best, ["vol", "place"]).select("vol", "draw", "place", *XYZ)


def validity(cells: DataFrame, tumour: DataFrame, brain: DataFrame, distances: DataFrame, shape: tuple[int, int, int], share: float, least: float, cells_least: int = 0) -> DataFrame:
    """(vol, place, code): 0 valid, 1 below the grid, 2 beyond it, 3 on the tumour, 4 too little brain, as a share or in cells, 5 too near the tumour.

    cells come from placed(); distances(vol, x, y, z, dm) holds the distance to the tumour where it is below `least` or
    anything up to a larger radius; null or absent means far. The first failing test gives the code.
    """
    key = ["vol", *XYZ]
    rows = (
        cells.join(tumour.select(*key, F.lit(1).alias("t")), key, "left")
        .join(brain.select(*key, F.lit(1).alias("b")), key, "left")
        .join(distances.select(*key, "dm"), key, "left")
    )
    low = F.least(*(F.col(f"lo{c}") for c in XYZ)) < 0
    high = F.greatest(*(F.col(f"hi{c}") - n for c, n in zip(XYZ, shape))) > 0
    seen = rows.groupBy("vol", "place").agg(F.bool_or(low).alias("low"), F.bool_or(high).alias("high"), F.count("t").alias("on"), (F.count("b") / F.count("*")).alias("share"), F.count("b").alias("held"), F.min("dm").alias("near"))
    code = F.when(F.col("low"), 1).when(F.col("high"), 2).when(F.col("on") > 0, 3).when((F.col("share") < share) | (F.col("held") < cells_least), 4).when(F.col("near") < least, 5).otherwise(0)
    return seen.select("vol", "place", code.alias("code"))


def first_valid(codes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(vol) with the first place of code 0 and the number of tries; null where every try failed."""
    done = codes.filter("code = 0").groupBy("vol").agg(F.min("place").alias("place"))
    tries = codes.groupBy("vol").agg(F.count("*").alias("tries"))
    return wanted.join(done, "vol", "left").join(tries, "vol", "left").withColumn("tries", F.coalesce("tries", F.lit(0).cast("bigint")))


def bank(keys: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """`draws` rows a key with the seed of each: seed + 100 * position + draw, positions in key order."""
    ranked = global_rank(keys.select(key).distinct(), key, name="place")
    return ranked.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select(key, "draw", (F.lit(seed) + 100 * F.col("place") + F.col("draw")).cast("bigint").alias("seed"))


def replaced(key: Column, seed: str, p: float, yes: Column, no: Column) -> Column:
    """`yes` with probability p, else `no`."""
    return F.when(uniform(seed, key) < p, yes).otherwise(no)
