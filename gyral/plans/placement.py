"""Queries on samplers that place masks: the cells of what was placed, not only its size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyral.operators import sampling as S
from gyral.operators import voxels as V
from gyral.plans.masks import SHAPE, VOX, tumour, volumes
from gyral.plans.registry import query
from gyral.plans.sampling import u
from gyral.session import cut, release

#: Tries per mirror image, brain share and brain cells that a placement needs.
PER, SHARE, LEAST = 6, 0.25, 2
_BLOCK = "x // 4 = vol % 3 AND y // 4 = vol // 3 % 3"


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of each volume's tumour, as the shape to be placed; some are as high as the grid."""
    t, vol = tumour(spark, sf_dir), F.col("vol")
    return t.filter((F.floor(F.col("x") / 4) == vol % 3) & (F.floor(F.col("y") / 4) == F.floor(vol / 3) % 3))


def shape_sql(source: str) -> str:
    return f"SELECT vol, {', '.join(f'CAST({c} - min({c}) OVER (PARTITION BY vol) AS INTEGER) AS {c}' for c in 'xyz')} FROM {source}"


SHAPES = f"{VOX}, shape0 AS (SELECT vol, x, y, z FROM m WHERE {_BLOCK}), shape AS ({shape_sql('shape0')})"


def tries_sql(pre: str, shape: str, seed: str, tries: int, first: int = 0, turns: bool = False, avoid: str = "m") -> str:
    """CTEs {pre}_c, the cells of every try, and {pre}_k, the code of every try."""
    turn = f"place // {PER}" if turns else "0"
    flip = lambda i, c: f"CASE WHEN ({turn}) // {2 ** i} % 2 = 1 THEN n{c} - 1 - {c} ELSE {c} END"
    spot = ", ".join(f"CAST(floor({u(chr(39) + seed + c + chr(39), 'vol', 'place')} * {n}) AS INTEGER) AS p{c}" for c, n in zip("xyz", SHAPE))
    cells = ", ".join(f"{flip(i, c)} + p{c} - n{c} // 2 AS {c}" for i, c in enumerate("xyz"))
    lows, highs = ", ".join(f"p{c} - n{c} // 2" for c in "xyz"), ", ".join(f"p{c} - n{c} // 2 + n{c} - {n}" for c, n in zip("xyz", SHAPE))
    on = lambda t: f"{pre}_c.vol = {t}.vol AND {pre}_c.x = {t}.x AND {pre}_c.y = {t}.y AND {pre}_c.z = {t}.z"
    return f"""{pre}_b AS (SELECT vol, max(x) + 1 AS nx, max(y) + 1 AS ny, max(z) + 1 AS nz FROM {shape} GROUP BY 1),
{pre}_s AS (SELECT vol, place, {spot} FROM (SELECT DISTINCT vol FROM {shape}), range({first}, {first + tries}) r(place)),
{pre}_c AS (SELECT vol, place, {cells}, least({lows}) AS lo, greatest({highs}) AS hi FROM {shape} JOIN {pre}_b USING (vol) JOIN {pre}_s USING (vol)),
{pre}_k AS (SELECT {pre}_c.vol, place, CASE WHEN min(lo) < 0 THEN 1 WHEN max(hi) > 0 THEN 2 WHEN count(a.vol) > 0 THEN 3 WHEN count(b.vol) / count(*) < {SHARE} OR count(b.vol) < {LEAST} THEN 4 ELSE 0 END AS code
  FROM {pre}_c LEFT JOIN {avoid} a ON {on('a')} LEFT JOIN vox b ON {on('b')} GROUP BY 1, 2)"""


def first_sql(pre: str, name: str, per: int | None = None) -> str:
    draw = "0" if per is None else f"place // {per}"
    return f"{name} AS (SELECT {pre}_c.vol, draw, {pre}_c.place, x, y, z FROM {pre}_c JOIN (SELECT vol, {draw} AS draw, min(place) AS place FROM {pre}_k WHERE code = 0 GROUP BY 1, 2) f ON f.vol = {pre}_c.vol AND f.place = {pre}_c.place)"


def judged(spark: SparkSession, sf_dir: str, cells: DataFrame, avoid: DataFrame | None = None) -> DataFrame:
    avoid = tumour(spark, sf_dir) if avoid is None else avoid
    far = avoid.select("vol", *V.XYZ, F.lit(None).cast("double").alias("dm")).limit(0)
    return S.validity(cells, avoid, volumes(spark, sf_dir), far, SHAPE, SHARE, 0.0, LEAST)


def placed_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid placement of each shape in its eight mirror images, off the tumour and in the brain."""
    mine = cut(shapes(spark, sf_dir), "shapes")
    spots = S.drawn_spots(mine, 8 * PER, "spot", SHAPE).withColumn("turn", F.floor(F.col("place") / PER).cast("int"))
    cells = cut(S.placed(S.mirrored(mine), spots, "turn"), "tries")
    return S.first_masks(cells, judged(spark, sf_dir, cells))


PLACED = f"{SHAPES}, {tries_sql('a', 'shape', 'spot', 8 * PER, turns=True)}, {first_sql('a', 'p')}"
_INTS = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ("x", "y", "z"))


@query(f"WITH {PLACED} SELECT vol, CAST(place AS INTEGER) AS place, {_INTS} FROM p")
def c5_placed_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_masks(spark, sf_dir).drop("draw")


def paired_masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A tumour-like mask and a healthy one of at most 0.7 of its cells that keeps off the first one grown by a step."""
    first = cut(placed_masks(spark, sf_dir), "placed").select("vol", *V.XYZ)
    release(spark)
    small = cut(S.smallest_part(shapes(spark, sf_dir).join(first.select("vol").distinct(), "vol", "left_semi"), 0.7), "small")
    grown = V.dilated(first, 1, SHAPE)
    cells = cut(S.placed(small, S.drawn_spots(small, 4 * PER, "healthy", SHAPE)), "tries")
    return first, S.first_masks(cells, judged(spark, sf_dir, cells, grown)).select("vol", *V.XYZ)


PAIRED = f"""{PLACED}, small0 AS (SELECT vol, x, y, z FROM shape0 WHERE vol IN (SELECT vol FROM p) QUALIFY row_number() OVER (PARTITION BY vol ORDER BY x, y, z) <= greatest(1, floor(count(*) OVER (PARTITION BY vol) * 0.7))), small AS ({shape_sql('small0')}),
grown AS (SELECT DISTINCT vol, x + i.i AS x, y + j.i AS y, z + k.i AS z FROM p, range(-1, 2) i(i), range(-1, 2) j(i), range(-1, 2) k(i) WHERE abs(i.i) + abs(j.i) + abs(k.i) <= 1),
{tries_sql('h', 'small', 'healthy', 4 * PER, avoid='grown')}, {first_sql('h', 'q')}"""


@query(f"WITH {PAIRED} SELECT vol, 'tumour' AS kind, {_INTS} FROM p UNION ALL SELECT vol, 'healthy', {_INTS} FROM q")
def c5_paired_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = paired_masks(spark, sf_dir)
    return first.select("vol", F.lit("tumour").alias("kind"), *V.XYZ).unionByName(second.select("vol", F.lit("healthy").alias("kind"), *V.XYZ))


@query(f"""WITH {SHAPES}, tiny0 AS (SELECT vol, x, y, z FROM shape0 QUALIFY row_number() OVER (PARTITION BY vol ORDER BY x, y, z) <= greatest(1, floor(count(*) OVER (PARTITION BY vol) * 0.25))), tiny AS ({shape_sql('tiny0')}),
{tries_sql('a', 'shape', 'bounded', 6)}, {tries_sql('b', 'tiny', 'bounded', 6, 6)}, u_c AS (SELECT * FROM a_c UNION ALL SELECT * FROM b_c), u_k AS (SELECT * FROM a_k UNION ALL SELECT * FROM b_k), {first_sql('u', 'f')}
SELECT v.vol, CAST(any_value(f.place) AS INTEGER) AS place, coalesce(any_value(f.place) >= 6, false) AS forced_small, count(f.vol) AS cells, CAST(coalesce(sum((f.x * 12 + f.y) * 8 + f.z), 0) AS BIGINT) AS places FROM (SELECT DISTINCT vol FROM vox) v LEFT JOIN f ON f.vol = v.vol GROUP BY 1""")
def c5_bounded_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tries with the shape, then six with a quarter of it; an empty mask where all fail."""
    mine = cut(shapes(spark, sf_dir), "shapes")
    full = S.placed(mine, S.drawn_spots(mine, 6, "bounded", SHAPE))
    tiny = S.placed(S.smallest_part(mine, 0.25), S.drawn_spots(mine, 6, "bounded", SHAPE, 6))
    cells = cut(full.unionByName(tiny), "tries")
    found = S.first_masks(cells, judged(spark, sf_dir, cells))
    place = ((F.col("x") * 12 + F.col("y")) * 8 + F.col("z")).cast("bigint")
    sums = found.groupBy("vol").agg(F.first("place").alias("place"), F.count("*").alias("cells"), F.sum(place).alias("places"))
    zero = F.lit(0).cast("bigint")
    return volumes(spark, sf_dir).select("vol").distinct().join(sums, "vol", "left").select("vol", "place", F.coalesce(F.col("place") >= 6, F.lit(False)).alias("forced_small"), F.coalesce("cells", zero).alias("cells"), F.coalesce("places", zero).alias("places"))


def bank_masks(spark: SparkSession, sf_dir: str, draws: int = 3) -> DataFrame:
    mine = cut(shapes(spark, sf_dir), "shapes")
    cells = cut(S.placed(mine, S.drawn_spots(mine, draws * 2 * PER, "bank", SHAPE)), "tries")
    return S.first_masks(cells, judged(spark, sf_dir, cells), 2 * PER)


_BANK = f"{SHAPES}, {tries_sql('a', 'shape', 'bank', 6 * PER)}, {first_sql('a', 'p', 2 * PER)}"


@query(f"WITH {_BANK} SELECT vol, CAST(draw AS INTEGER) AS draw, {_INTS} FROM p")
def c5_mask_bank_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_masks(spark, sf_dir).drop("place")


@query(f"WITH {_BANK} SELECT p.vol || '-m' || draw AS case_id, count(*) AS decoy, any_value(t.n) + count(*) AS voided FROM p JOIN (SELECT vol, count(*) AS n FROM m GROUP BY 1) t ON t.vol = p.vol GROUP BY p.vol, draw")
def c5_multimask_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoys of each case under names of their own, and what they void together with the tumour they keep off."""
    n = tumour(spark, sf_dir).groupBy("vol").agg(F.count("*").alias("n"))
    decoys = bank_masks(spark, sf_dir).groupBy("vol", "draw").agg(F.count("*").alias("decoy")).join(n, "vol")
    return decoys.select(F.concat("vol", F.lit("-m"), "draw").alias("case_id"), "decoy", (F.col("decoy") + F.col("n")).alias("voided"))
