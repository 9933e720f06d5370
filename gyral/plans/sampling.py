"""Queries on splits, draws, sizes and placements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyral.functions.draws import log_uniform, token, uniform
from gyral.operators import sampling as S
from gyral.operators import voxels as V
from gyral.plans.masks import SHAPE, VOX, tumour, volumes
from gyral.plans.registry import query, table
from gyral.session import cut

HEX = "CAST('0x' || substr({0}, 1, 8) AS UBIGINT) / 4294967296.0"


def u(*parts: str) -> str:
    return HEX.format("md5(" + " || '|' || ".join(parts) + ")")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")


_SPLIT = "first AS (SELECT DISTINCT {k}, md5('2026|' || {k}) AS h FROM orders ORDER BY h, {k} LIMIT {n})"


@query(f"WITH {_SPLIT.format(k='o_orderkey', n=150)} SELECT o.o_orderkey, CASE WHEN f.h IS NULL THEN 'train' ELSE 'val' END AS split FROM orders o LEFT JOIN first f USING (o_orderkey)")
def c4_case_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_in_order(_orders(spark, sf_dir), "o_orderkey", "2026", 150).select("o_orderkey", "split")


@query(f"WITH {_SPLIT.format(k='o_custkey', n=50)} SELECT o.o_orderkey, o.o_custkey, CASE WHEN f.h IS NULL THEN 'train' ELSE 'val' END AS split FROM orders o LEFT JOIN first f USING (o_custkey)")
def c4_subject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_in_order(_orders(spark, sf_dir), "o_custkey", "2026", 50).select("o_orderkey", "o_custkey", "split")


@query(f"WITH {_SPLIT.format(k='o_orderkey', n=150)} SELECT o_orderkey FROM first ORDER BY md5('monitor|' || o_orderkey), o_orderkey LIMIT 30")
def c4_monitor_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    val = c4_case_split(spark, sf_dir).filter("split = 'val'").select("o_orderkey")
    return val.orderBy(token("monitor", F.col("o_orderkey")), "o_orderkey").limit(30)


@query(f"WITH {_SPLIT.format(k='o_orderkey', n=150)}, s AS (SELECT o.*, f.h IS NOT NULL AS val FROM orders o LEFT JOIN first f USING (o_orderkey)) SELECT o_custkey, count(*) FILTER (val) AS n_val, count(*) FILTER (NOT val) AS n_train FROM s GROUP BY 1 HAVING bool_or(val) AND bool_or(NOT val)")
def c4_subject_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.split_in_order(_orders(spark, sf_dir), "o_orderkey", "2026", 150)
    n = lambda x: F.count_if(F.col("split") == x).alias(f"n_{x}")
    return s.groupBy("o_custkey").agg(n("val"), n("train")).filter("n_val > 0 and n_train > 0")


@query("SELECT o_orderpriority, count(*) AS n FROM (SELECT * FROM orders, range(3) WHERE o_orderpriority LIKE '1%' UNION ALL SELECT *, 0 FROM orders WHERE o_orderpriority NOT LIKE '1%') GROUP BY 1")
def c4_pool_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    urgent = F.col("o_orderpriority").startswith("1")
    return S.oversampled([(o.filter(urgent), 3), (o.filter(~urgent), 1)]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def c4_keep_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(keep, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def c4_exclude_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    drop = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(drop, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') SELECT (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_a, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS shared, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS any_n, (SELECT count(*) FROM (SELECT k FROM a UNION ALL SELECT k FROM b)) AS all_n")
def c4_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "O")).groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    return flags.agg(F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared"), F.count("*").alias("any_n"), F.coalesce(F.sum(F.col("a") + F.col("b")), F.lit(0)).alias("all_n"))


@query("SELECT p_partkey FROM part ORDER BY md5('pool|' || p_partkey), p_partkey LIMIT 200")
def c4_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey").orderBy(token("pool", F.col("p_partkey")), "p_partkey").limit(200)


_SIZES = f"{VOX}, brain AS (SELECT vol, count(*) AS b FROM vox GROUP BY 1), sizes AS (SELECT vol AS id, count(*) / b AS p FROM m JOIN brain USING (vol) GROUP BY vol, b), ranked AS (SELECT *, row_number() OVER (ORDER BY p, id) - 1 AS rank FROM sizes)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volumes(spark, sf_dir)
    return cut(v.groupBy(F.col("vol").alias("id")).agg((F.count_if(F.col("v") >= 47) / F.count("*")).alias("p")).filter("p > 0"), "sizes")


@query(f"""WITH {_SIZES}, w AS (SELECT s.id AS key, s.p, (SELECT count(*) FROM sizes z WHERE z.p < s.p) AS below, (SELECT count(*) FROM sizes) AS n FROM sizes s),
r AS (SELECT *, greatest(0, CAST(trunc(n - below - 0.1 * n / 2) AS INTEGER)) AS low, least(n - 1, CAST(trunc(n - below + 0.1 * n / 2) AS INTEGER)) AS high FROM w)
SELECT r.key, CAST(low AS INTEGER) AS low, CAST(high AS INTEGER) AS high, k.id, round(k.p, 6) AS size FROM r JOIN ranked k ON k.rank = CAST(trunc(low + {u("'shape'", 'r.key')} * (high - low)) AS INTEGER)""")
def c5_inverse_size_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _sizes(spark, sf_dir)
    return S.inverse_size_window(sizes, sizes.select(F.col("id").alias("key"), "p"), 0.1, "shape").select("key", "low", "high", "id", F.round("size", 6).alias("size"))


@query(f"WITH {_SIZES} SELECT id, round(p, 6) AS p FROM ranked QUALIFY ntile(4) OVER (ORDER BY p, id) = 1")
def c5_size_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.smallest_share(_sizes(spark, sf_dir), 4).select("id", F.round("p", 6).alias("p"))


@query(f"WITH {_SIZES}, n AS (SELECT count(*) AS n FROM sizes) SELECT c.c_custkey, round(r.p, 6) AS target FROM customer c, n JOIN ranked r ON r.rank = CAST(floor({u("'size'", 'c.c_custkey')} * n.n) AS BIGINT)")
def c5_size_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = S.drawn_size(table(spark, sf_dir, "customer"), "c_custkey", _sizes(spark, sf_dir), "size")
    return target.select("c_custkey", F.round("target", 6).alias("target"))


@query(f"SELECT c_custkey, round(exp(ln(2000.0) + {u("'healthy'", 'c_custkey')} * (ln(600000.0) - ln(2000.0))), 3) AS target FROM customer")
def c5_log_uniform_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(log_uniform(uniform("healthy", F.col("c_custkey")), 2000, 600000), 3).alias("target"))


@query(f"WITH {VOX} SELECT n, count(*) AS volumes FROM (SELECT vol, count(*) AS n FROM m GROUP BY 1) GROUP BY 1")
def c5_harvest_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumour(spark, sf_dir).groupBy("vol").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("volumes"))


_DM = f"""{VOX}, dm AS (SELECT c.vol, c.x, c.y, c.z, round(sqrt(min((c.x - m.x) ** 2 + (c.y - m.y) ** 2 + (c.z - m.z) ** 2)), 6) AS dm FROM vox c LEFT JOIN m ON c.vol = m.vol GROUP BY ALL)"""


def _far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(V.distance_map(volumes(spark, sf_dir).drop("v"), tumour(spark, sf_dir), 4).withColumn("dm", F.round("dm", 6)), "far")


@query(f"""WITH {_DM}, p AS (SELECT *, row_number() OVER (PARTITION BY vol ORDER BY x, y, z) - 1 AS i, count(*) OVER (PARTITION BY vol) AS n FROM dm WHERE dm > 1),
d AS (SELECT DISTINCT vol, CAST(floor({u("'spot'", 'vol', 'd')} * n) AS BIGINT) AS i FROM p, range(2) r(d))
SELECT vol, x, y, z, dm FROM p JOIN d USING (vol, i) QUALIFY row_number() OVER (PARTITION BY vol ORDER BY dm DESC, x, y, z) = 1""")
def c5_farthest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    dm = cut(V.distance_map(volumes(spark, sf_dir).drop("v"), tumour(spark, sf_dir)).withColumn("dm", F.round("dm", 6)), "dm")
    return S.farthest_of(dm, "vol", "dm", 2, "spot", 1.0)


TRIES = 24
_SPOT = ", ".join(f"CAST(floor({u(chr(39) + c + chr(39), 'vol', 't')} * {n}) AS INTEGER) AS p{c}" for c, n in zip("xyz", SHAPE))
_CODES = f"""{_DM}, shape AS (SELECT vol, x - min(x) OVER (PARTITION BY vol) AS x, y - min(y) OVER (PARTITION BY vol) AS y, z - min(z) OVER (PARTITION BY vol) AS z FROM vox WHERE v <= 3 AND x < 5 AND y < 5 AND z < 4),
box AS (SELECT vol, max(x) + 1 AS nx, max(y) + 1 AS ny, max(z) + 1 AS nz FROM shape GROUP BY 1),
spots AS (SELECT vol, t AS place, {_SPOT} FROM (SELECT DISTINCT vol FROM shape), range({TRIES}) r(t)),
c AS (SELECT s.vol, place, x + px - nx // 2 AS x, y + py - ny // 2 AS y, z + pz - nz // 2 AS z, least(px - nx // 2, py - ny // 2, pz - nz // 2) AS lo, greatest(px - nx // 2 + nx - 12, py - ny // 2 + ny - 12, pz - nz // 2 + nz - 8) AS hi FROM shape s JOIN box USING (vol) JOIN spots USING (vol)),
g AS (SELECT c.vol, c.place, min(lo) AS lo, max(hi) AS hi, count(m.vol) AS hit, count(b.vol) / count(*) AS share, min(d.dm) AS near FROM c LEFT JOIN m ON c.vol = m.vol AND c.x = m.x AND c.y = m.y AND c.z = m.z
  LEFT JOIN vox b ON c.vol = b.vol AND c.x = b.x AND c.y = b.y AND c.z = b.z LEFT JOIN dm d ON c.vol = d.vol AND c.x = d.x AND c.y = d.y AND c.z = d.z GROUP BY 1, 2),
codes AS (SELECT vol, CAST(place AS INTEGER) AS place, CAST(CASE WHEN lo < 0 THEN 1 WHEN hi > 0 THEN 2 WHEN hit > 0 THEN 3 WHEN share < 0.25 THEN 4 WHEN near < 1.5 THEN 5 ELSE 0 END AS INTEGER) AS code FROM g)"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = volumes(spark, sf_dir).filter("v <= 3 and x < 5 and y < 5 and z < 4").select("vol", *V.XYZ)
    shapes = cut(low, "shapes")
    tries = shapes.select("vol").distinct().withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))))
    spots = tries.select("vol", "place", *(F.floor(uniform(c, F.col("vol"), F.col("place")) * n).cast("int").alias(f"p{c}") for c, n in zip(V.XYZ, SHAPE)))
    return S.validity(S.placed(shapes, spots), tumour(spark, sf_dir), volumes(spark, sf_dir), _far(spark, sf_dir), SHAPE, 0.25, 1.5)


@query(f"WITH {_CODES} SELECT vol, place, code FROM codes")
def c5_validity_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir)


@query(f"WITH {_CODES} SELECT v.vol, p.place, coalesce(p.tries, 0) AS tries FROM (SELECT DISTINCT vol FROM vox) v LEFT JOIN (SELECT vol, min(place) FILTER (code = 0) AS place, count(*) AS tries FROM codes GROUP BY 1) p USING (vol)")
def c5_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_valid(_codes(spark, sf_dir), volumes(spark, sf_dir).select("vol").distinct())


@query(f"WITH {_CODES} SELECT code, count(*) AS tries, count(DISTINCT vol) AS volumes FROM codes GROUP BY 1")
def c5_rejection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).groupBy("code").agg(F.count("*").alias("tries"), F.count_distinct("vol").alias("volumes"))


@query(f"""WITH {VOX}, t AS (SELECT vol, count(*) AS tumour FROM m GROUP BY 1), h AS (SELECT vol, greatest({u("'a'", 'vol')}, {u("'b'", 'vol')}) AS u, tumour FROM t)
SELECT vol, tumour, CAST(floor(u * 100) AS BIGINT) AS drawn, least(CAST(floor(u * 100) AS BIGINT), CAST(floor(0.7 * tumour) AS BIGINT)) AS healthy FROM h""")
def c5_paired_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tumour(spark, sf_dir).groupBy("vol").agg(F.count("*").alias("tumour"))
    drawn = F.floor(F.greatest(uniform("a", F.col("vol")), uniform("b", F.col("vol"))) * 100)
    return t.select("vol", "tumour", drawn.alias("drawn"), F.least(drawn, F.floor(F.col("tumour") * 0.7)).alias("healthy"))


@query("SELECT s_suppkey, CAST(draw AS INTEGER) AS draw, 7 + 100 * (row_number() OVER (PARTITION BY draw ORDER BY s_suppkey) - 1) + draw AS seed FROM supplier, range(5) r(draw)")
def c5_mask_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bank(table(spark, sf_dir, "supplier"), "s_suppkey", 5, 7)


@query("SELECT s_suppkey, s_name || '-m' || k AS case_id FROM supplier, range(5) r(k)")
def c5_multimask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("s_suppkey", F.concat("s_name", F.lit("-m"), "k").alias("case_id"))


@query(f"SELECT o_orderkey, CASE WHEN {u("'synth'", 'o_orderkey')} < 0.3 THEN 'synthetic' ELSE 'real' END AS void FROM orders")
def c5_bernoulli_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", S.replaced(F.col("o_orderkey"), "synth", 0.3, F.lit("synthetic"), F.lit("real")).alias("void"))
