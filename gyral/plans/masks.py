"""Queries on masks: a voxel table is read off lineitem, one volume a supplier on a 12 x 12 x 8 grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyral.operators import voxels as V
from gyral.plans.registry import query, table
from gyral.session import cut

SHAPE = (12, 12, 8)
#: Which cells of a volume are its tumour.
IN_TUMOUR = "v >= 47"


def volumes(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """(vol, x, y, z, v); with `whole` a volume's cells lie in one partition, so that what is done by volume needs no other shuffle."""
    li = table(spark, sf_dir, "lineitem")
    place = {"x": F.col("l_orderkey") % 12, "y": F.col("l_partkey") % 12, "z": F.floor(F.col("l_orderkey") / 12) % 8}
    cells = li.select(F.col("l_suppkey").alias("vol"), *(c.cast("int").alias(n) for n, c in place.items()), F.col("l_quantity").alias("v"))
    return (cells.repartition("vol") if whole else cells).groupBy("vol", "x", "y", "z").agg(F.max("v").alias("v"))


def tumour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes(spark, sf_dir).filter(IN_TUMOUR).drop("v")


VOX = """vox AS (SELECT l_suppkey AS vol, CAST(l_orderkey % 12 AS INTEGER) AS x, CAST(l_partkey % 12 AS INTEGER) AS y, CAST(l_orderkey // 12 % 8 AS INTEGER) AS z, max(l_quantity) AS v FROM lineitem GROUP BY ALL),
m AS (SELECT vol, x, y, z, (x * 12 + y) * 8 + z AS cell FROM vox WHERE v >= 47)"""


def _labels(step: str) -> str:
    return f"""{VOX}, near AS (SELECT a.vol, a.cell AS a, b.cell AS b FROM m a JOIN m b ON a.vol = b.vol AND {step}),
reach AS (SELECT vol, cell AS a, cell AS b FROM m UNION SELECT r.vol, r.a, n.b FROM reach r JOIN near n ON r.vol = n.vol AND r.b = n.a),
lab AS (SELECT m.*, l.label FROM m JOIN (SELECT vol, a AS cell, min(b) AS label FROM reach GROUP BY 1, 2) l USING (vol, cell))"""


_SIX = _labels("abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= 1")
_BOX = _labels("abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1")
_SIZES = "SELECT vol, CAST(label AS BIGINT) AS label, count(*) AS size FROM lab GROUP BY 1, 2"


def _labelled(spark: SparkSession, sf_dir: str, connectivity: int = 26) -> DataFrame:
    return cut(V.labelled(tumour(spark, sf_dir), SHAPE, connectivity), "labels")


@query(f"WITH RECURSIVE {_BOX} {_SIZES}")
def c5_component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.component_sizes(_labelled(spark, sf_dir)).select("vol", "label", "size")


@query(f"WITH RECURSIVE {_SIX} {_SIZES}")
def c5_component_sizes_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.component_sizes(_labelled(spark, sf_dir, 6)).select("vol", "label", "size")


@query(f"WITH RECURSIVE {_BOX}, s AS ({_SIZES}) SELECT vol, label, size FROM s WHERE size >= 3 QUALIFY row_number() OVER (PARTITION BY vol ORDER BY size DESC, label) = 1")
def c5_largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.component_sizes(_labelled(spark, sf_dir)).filter("place = 1 and size >= 3").select("vol", "label", "size")


_BOXES = "min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1, min(z) AS z0, max(z) + 1 AS z1, count(*) AS size"


@query(f"WITH RECURSIVE {_BOX}, b AS (SELECT vol, CAST(label AS BIGINT) AS label, {_BOXES} FROM lab GROUP BY 1, 2) SELECT *, CAST((x0 + x1) // 2 AS INTEGER) AS cx, CAST((y0 + y1) // 2 AS INTEGER) AS cy, CAST((z0 + z1) // 2 AS INTEGER) AS cz FROM b")
def c5_bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bounding_boxes(_labelled(spark, sf_dir), "vol", "label")


@query(f"WITH {VOX}, b AS (SELECT vol, count(*) AS brain, count(*) FILTER (v >= 47) AS n FROM vox GROUP BY 1) SELECT vol, brain, n, round(n / brain, 6) AS p FROM b")
def c5_volume_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes(spark, sf_dir).groupBy("vol").agg(F.count("*").alias("brain"), F.count_if(F.col("v") >= 47).alias("n")).withColumn("p", F.round(F.col("n") / F.col("brain"), 6))


@query(f"WITH {VOX}, o AS (SELECT i.i, j.i AS j, k.i AS k FROM range(-5, 6) i(i), range(-5, 6) j(i), range(-5, 6) k(i) WHERE abs(i.i) + abs(j.i) + abs(k.i) <= 2), d AS (SELECT DISTINCT vol, x + i AS x, y + j AS y, z + k AS z FROM m, o) SELECT vol, count(*) AS cells, CAST(sum((x * 12 + y) * 8 + z) AS BIGINT) AS places FROM d WHERE x BETWEEN 0 AND 11 AND y BETWEEN 0 AND 11 AND z BETWEEN 0 AND 7 GROUP BY 1")
def c5_dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.dilated(tumour(spark, sf_dir), 2, SHAPE)
    return d.groupBy("vol").agg(F.count("*").alias("cells"), F.sum(((F.col("x") * 12 + F.col("y")) * 8 + F.col("z")).cast("bigint")).alias("places"))


_DM = f"""{VOX}, dm AS (SELECT c.vol, c.x, c.y, c.z, min((c.x - m.x) ** 2 + (c.y - m.y) ** 2 + (c.z - m.z) ** 2) AS d2 FROM vox c LEFT JOIN m ON c.vol = m.vol GROUP BY ALL)"""


@query(f"WITH {_DM} SELECT vol, x, y, z, round(sqrt(d2), 6) AS dm FROM dm")
def c5_distance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.distance_map(volumes(spark, sf_dir).drop("v"), tumour(spark, sf_dir)).withColumn("dm", F.round("dm", 6))


@query(f"WITH {VOX} SELECT a.vol, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 6) AS d FROM m a JOIN (SELECT * FROM vox WHERE v <= 2) b ON a.vol = b.vol GROUP BY 1")
def c5_min_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.min_distance(tumour(spark, sf_dir), volumes(spark, sf_dir).filter("v <= 2")).select("vol", F.round("d", 6).alias("d"))


_HOLES = """SELECT vol, x, y, z FROM air EXCEPT SELECT vol, x, y, z FROM out"""


@query(f"""WITH RECURSIVE {VOX}, g AS (SELECT DISTINCT vol, i.i AS x, j.i AS y, k.i AS z FROM vox, range(-1, 13) i(i), range(-1, 13) j(i), range(-1, 9) k(i)),
air AS (SELECT g.* FROM g ANTI JOIN (SELECT * FROM vox WHERE v >= 20) s ON g.vol = s.vol AND g.x = s.x AND g.y = s.y AND g.z = s.z),
out AS (SELECT vol, x, y, z FROM air WHERE x = -1 AND y = -1 AND z = -1 UNION SELECT a.vol, a.x, a.y, a.z FROM out o JOIN air a ON a.vol = o.vol AND abs(a.x - o.x) + abs(a.y - o.y) + abs(a.z - o.z) = 1)
SELECT vol, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z FROM ({_HOLES})""")
def c5_fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.holes(volumes(spark, sf_dir, whole=True).filter("v >= 20").drop("v"))


@query(f"WITH {VOX}, h AS (SELECT vol, x, y, z FROM vox WHERE v <= 4) SELECT vol, count(*) FILTER (a AND b) AS both_n, count(*) FILTER (a) AS a_n, count(*) AS any_n FROM (SELECT vol, x, y, z, bool_or(a) AS a, bool_or(b) AS b FROM (SELECT vol, x, y, z, true AS a, false AS b FROM m UNION ALL SELECT vol, y, x, z, false, true FROM h) GROUP BY 1, 2, 3, 4) GROUP BY 1")
def c5_mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tumour(spark, sf_dir).withColumns({"a": F.lit(True), "b": F.lit(False)})
    b = volumes(spark, sf_dir).filter("v <= 4").select("vol", F.col("y").alias("x"), F.col("x").alias("y"), "z", F.lit(False).alias("a"), F.lit(True).alias("b"))
    cells = a.unionByName(b).groupBy("vol", "x", "y", "z").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return cells.groupBy("vol").agg(F.count_if(F.col("a") & F.col("b")).alias("both_n"), F.count_if("a").alias("a_n"), F.count("*").alias("any_n"))


@query(f"WITH {VOX}, b AS (SELECT vol, min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM m GROUP BY 1) SELECT m.vol, m.x - x0 AS x, m.y - y0 AS y, m.z - z0 AS z FROM m JOIN b USING (vol)")
def c5_pack_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = tumour(spark, sf_dir)
    return V.unpacked(V.packed(mask, V.bounding_boxes(mask, "vol"), "vol"), "vol")


@query(f"WITH {VOX} SELECT vol, x, y, z, v FROM vox QUALIFY v > 0.9 * max(v) OVER (PARTITION BY vol)")
def c5_relative_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.foreground(volumes(spark, sf_dir), 0.9)


@query(f"WITH {VOX} SELECT vox.vol, vox.x, vox.y, vox.z, vox.v FROM vox ANTI JOIN m ON vox.vol = m.vol AND vox.x = m.x AND vox.y = m.y AND vox.z = m.z WHERE v > 0")
def c5_voided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.foreground(volumes(spark, sf_dir)).join(tumour(spark, sf_dir), ["vol", *V.XYZ], "left_anti")


@query(f"WITH {VOX} SELECT vox.vol, vox.x, vox.y, vox.z, CASE WHEN m.vol IS NOT NULL THEN vox.v * 2 WHEN vox.v <= 4 THEN -1 ELSE vox.v END AS v FROM vox LEFT JOIN m ON vox.vol = m.vol AND vox.x = m.x AND vox.y = m.y AND vox.z = m.z")
def c5_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = tumour(spark, sf_dir).withColumn("inside", F.lit(True))
    value = F.when(F.col("inside"), F.col("v") * 2).when(F.col("v") <= 4, -1.0).otherwise(F.col("v"))
    return volumes(spark, sf_dir).join(mask, ["vol", *V.XYZ], "left").select("vol", *V.XYZ, value.alias("v"))


@query(f"WITH {VOX} SELECT vol, 11 - x AS x, y, 7 - z AS z FROM m")
def c6_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.flipped(tumour(spark, sf_dir), "xz", SHAPE)


@query(f"WITH {VOX} SELECT vol, 11 - y AS x, x AS y, z FROM m")
def c6_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.rotated(tumour(spark, sf_dir), "xy", 1, SHAPE)


@query(f"""WITH {VOX}, f AS (SELECT vol, greatest(0.4, least(2.5, cbrt(80.0 / count(*)))) AS f FROM m GROUP BY 1),
a AS (SELECT vol, f, y, z, unnest(range(CAST(ceil(x * f) AS BIGINT), CAST(greatest(ceil((x + 1) * f) - 1, ceil(x * f)) AS BIGINT) + 1)) AS x FROM m JOIN f USING (vol)), b AS (SELECT vol, f, x, z, unnest(range(CAST(ceil(y * f) AS BIGINT), CAST(greatest(ceil((y + 1) * f) - 1, ceil(y * f)) AS BIGINT) + 1)) AS y FROM a), c AS (SELECT vol, x, y, unnest(range(CAST(ceil(z * f) AS BIGINT), CAST(greatest(ceil((z + 1) * f) - 1, ceil(z * f)) AS BIGINT) + 1)) AS z FROM b)
SELECT DISTINCT vol, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z FROM c""")
def c6_scale_to_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = tumour(spark, sf_dir)
    factor = F.greatest(F.lit(0.4), F.least(F.lit(2.5), F.cbrt(80.0 / F.count("*").over(Window.partitionBy("vol")))))
    rows = mask.withColumn("f", factor)
    return V.scaled(rows, F.col("f"))


@query(f"""WITH {VOX}, b AS (SELECT vol, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM m WHERE x < 6 GROUP BY 1),
s AS (SELECT vol, {", ".join(f"CASE WHEN {c}1 - {c}0 + 1 >= 6 THEN greatest(0, least(({c}0 + {c}1) // 2 - 3, {n} - 6)) ELSE greatest(0, least(({c}0 + {c}1) // 2 - 3, {n} - 6)) END AS s{c}" for c, n in zip("xyz", SHAPE))} FROM b)
SELECT vox.vol, CAST(x - sx AS INTEGER) AS x, CAST(y - sy AS INTEGER) AS y, CAST(z - sz AS INTEGER) AS z, v FROM vox JOIN s USING (vol) WHERE x - sx BETWEEN 0 AND 5 AND y - sy BETWEEN 0 AND 5 AND z - sz BETWEEN 0 AND 5""")
def c6_crop_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = tumour(spark, sf_dir).filter("x < 6").groupBy("vol").agg(*(f(c).alias(f"{c}{n}") for c in V.XYZ for n, f in ((0, F.min), (1, F.max))))
    starts = target.select("vol", *(V.containing_start(F.col(f"{c}0"), F.col(f"{c}1"), 6, n).alias(f"s{c}") for c, n in zip(V.XYZ, SHAPE)))
    return V.cropped(volumes(spark, sf_dir), starts, (6, 6, 6))


@query(f"""WITH {VOX}, g AS (SELECT DISTINCT vol, CAST(i.i AS INTEGER) AS x, CAST(j.i AS INTEGER) AS y, CAST(k.i AS INTEGER) AS z FROM vox, range(0, 16) i(i), range(0, 12) j(i), range(0, 8) k(i))
SELECT g.*, coalesce(v, 0) AS v FROM g LEFT JOIN vox USING (vol, x, y, z)""")
def c6_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.padded(volumes(spark, sf_dir), (16, 12, 8))
