"""Queries on scaling, smoothing, resampling, wavelets and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyral.functions.vectors import block_means, doubles
from gyral.operators import grids as G
from gyral.plans.masks import SHAPE, VOX, volumes
from gyral.plans.registry import query, table
from gyral.plans.ranks import global_rank, group_rank


@query("WITH v AS (SELECT l_suppkey AS vol, CASE WHEN l_linenumber > 3 THEN 0 ELSE l_extendedprice END AS v FROM lineitem), q AS (SELECT vol, quantile_cont(v, 0.995) FILTER (v > 0) AS a, quantile_cont(v, 0.995) AS b FROM v GROUP BY 1) SELECT vol, round(CASE WHEN a > 1e-6 THEN a ELSE 1 END, 6) AS nonzero, round(CASE WHEN b > 1e-6 THEN b ELSE 1 END, 6) AS every FROM q")
def c6_percentile_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("vol"), F.when(F.col("l_linenumber") > 3, 0.0).otherwise(F.col("l_extendedprice")).alias("v"))
    return v.groupBy("vol").agg(F.round(G.intensity_scale(F.col("v"), True), 6).alias("nonzero"), F.round(G.intensity_scale(F.col("v"), False), 6).alias("every"))


@query("WITH q AS (SELECT l_suppkey AS vol, quantile_cont(l_extendedprice, 0.001) AS lo, quantile_cont(l_extendedprice, 0.999) AS hi, max(l_extendedprice) AS mx FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, round(greatest(least(l_extendedprice, hi), lo) / greatest(least(mx, hi), lo) * 2 - 1, 6) AS n, round(greatest(least(mx, hi), lo), 6) AS top FROM lineitem JOIN q ON vol = l_suppkey")
def c6_clip_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("vol"), F.col("l_extendedprice").alias("v"))
    return G.clip_normalised(v).select("l_orderkey", "l_linenumber", F.round("n", 6).alias("n"), F.round("top", 6).alias("top"))


_W = G.gaussian_weights(1.5)
_R = len(_W) // 2
_KERNEL = ", ".join(f"({i - _R}, {w!r})" for i, w in enumerate(_W))


@query(f"""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, value AS v FROM events),
k(o, w) AS (VALUES {_KERNEL}), h AS (SELECT s.user_id, s.i, w, (s.i + o) % (2 * n) AS j, n FROM s, k),
r AS (SELECT user_id, i, w, CASE WHEN (j + 2 * n) % (2 * n) < n THEN (j + 2 * n) % (2 * n) ELSE 2 * n - 1 - (j + 2 * n) % (2 * n) END AS j FROM h)
SELECT r.user_id, r.i, round(sum(w * v), 6) AS smooth FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.j GROUP BY 1, 2""")
def c6_gaussian_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = group_rank(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id", name="i").select("user_id", "i", "value")
    return G.smoothed(series, "user_id", "i", "value", 1.5).select("user_id", "i", F.round("smooth", 6).alias("smooth"))


_BANDS = " UNION ALL ".join(f"SELECT vol, x // 2 AS x, y // 2 AS y, z // 2 AS z, {i} AS band, sum(v * CASE WHEN (x % 2 * {a} + y % 2 * {b} + z % 2 * {c}) % 2 = 0 THEN 1 ELSE -1 END) / sqrt(8) AS c FROM vox GROUP BY 1, 2, 3, 4" for i, (a, b, c) in enumerate(G.HAAR))


@query(f"WITH {VOX} SELECT vol, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, CAST(band AS INTEGER) AS band, round(c, 5) AS c FROM ({_BANDS})")
def c6_haar_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.haar(volumes(spark, sf_dir)).withColumn("c", F.round("c", 5))


@query(f"WITH {VOX} SELECT vol, count(*) AS cells, round(sum(v), 4) AS total, round(sum(v * v), 3) AS energy FROM vox GROUP BY 1")
def c6_haar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = G.haar_inverse(G.haar(volumes(spark, sf_dir))).filter("abs(v) > 1e-9")
    return back.groupBy("vol").agg(F.count("*").alias("cells"), F.round(F.sum("v"), 4).alias("total"), F.round(F.sum(F.col("v") * F.col("v")), 3).alias("energy"))


_NEAR = ", ".join(f"CAST(i{c}.i AS INTEGER) AS {c}" for c in "xyz")


@query(f"WITH {VOX} SELECT vol, {_NEAR}, v FROM vox JOIN range(0, 18) ix(i) ON ix.i * 12 // 18 = x JOIN range(0, 8) iy(i) ON iy.i * 12 // 8 = y JOIN range(0, 8) iz(i) ON iz.i = z")
def c6_resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resampled_nearest(volumes(spark, sf_dir), SHAPE, (18, 8, 8))


@query(f"""WITH {VOX}, p AS (SELECT vol, z, avg(v) AS v FROM vox GROUP BY 1, 2), g AS (SELECT DISTINCT vol, i FROM p, range(0, 13) r(i)), e AS (SELECT vol, i, i * 7 / 12.0 AS pos, least(CAST(floor(i * 7 / 12.0) AS INTEGER), 6) AS low FROM g)
SELECT e.vol, CAST(i AS INTEGER) AS z, round(coalesce(a.v, 0) * (1 - (pos - low)) + coalesce(b.v, 0) * (pos - low), 6) AS v FROM e LEFT JOIN p a ON a.vol = e.vol AND a.z = low LEFT JOIN p b ON b.vol = e.vol AND b.z = low + 1""")
def c6_resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = volumes(spark, sf_dir).groupBy("vol", "z").agg(F.avg("v").alias("v"))
    return G.resampled_linear(profile, "vol", "z", "v", 8, 13).select("vol", "z", F.round("v", 6).alias("v"))


@query(f"WITH {VOX} SELECT vol, x // 4 AS x, y // 4 AS y, z // 4 AS z, round(avg(v), 6) AS v FROM vox GROUP BY ALL")
def c6_average_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = [F.floor(F.col(c) / 4).cast("int").alias(c) for c in "xyz"]
    return volumes(spark, sf_dir).groupBy("vol", *block).agg(F.round(F.avg("v"), 6).alias("v"))


@query("SELECT vec_id, i AS block, round(list_avg((embedding::DOUBLE[])[i * 4 + 1 : i * 4 + 4]), 6) AS m FROM embeddings, range(0, 16) r(i)")
def c6_block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(block_means(doubles(F.col("embedding")), 16)).alias("block", "m"))
    return means.select("vec_id", F.col("block").cast("bigint").alias("block"), F.round("m", 6).alias("m"))


@query(f"WITH {VOX} SELECT vol, x, y, z, round(greatest(v / 50, 0) ** exp(0.08 * (vol % 5 - 2)), 6) AS v FROM vox")
def c6_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.exp((F.col("vol") % 5 - 2) * 0.08)
    return volumes(spark, sf_dir).withColumn("v", F.round(F.pow(F.greatest(F.col("v") / 50, F.lit(0.0)), g), 6))


def _lloyd(rounds: int) -> str:
    """Rounds until no centre moves by more than 1e-8 + 1e-5 of itself; from then on the centres stay as they are."""
    steps = ["c0 AS MATERIALIZED (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events)"]
    for r in range(rounds):
        near = f"CASE WHEN abs(value - c{r}.a) <= abs(value - c{r}.b) AND abs(value - c{r}.a) <= abs(value - c{r}.c) THEN 0 WHEN abs(value - c{r}.b) <= abs(value - c{r}.c) THEN 1 ELSE 2 END"
        means = ", ".join(f"coalesce(avg(value) FILTER (j = {j}), any_value({n})) AS n{n}" for j, n in enumerate("abc"))
        done = " AND ".join(f"abs(n{n} - {n}) <= 1e-8 + 1e-5 * abs({n})" for n in "abc")
        steps.append(f"m{r} AS MATERIALIZED (SELECT {means}, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c FROM (SELECT value, c{r}.*, {near} AS j FROM events, c{r}))")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT {', '.join(f'CASE WHEN {done} THEN {n} ELSE n{n} END AS {n}' for n in 'abc')} FROM m{r})")
    return f"WITH {', '.join(steps)}, f AS (SELECT unnest([a, b, c]) AS centre FROM c{rounds}) SELECT row_number() OVER (ORDER BY centre) AS class, round(centre, 4) AS centre FROM f"


@query(_lloyd(25))
def c6_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = G.kmeans_1d(table(spark, sf_dir, "events"), "value")
    return spark.createDataFrame([(i + 1, round(c, 4)) for i, c in enumerate(centres)], "class bigint, centre double")


@query("SELECT o_orderkey, CAST(greatest(1, least(CASE WHEN o_totalprice / 5 < 4654 THEN 2 WHEN o_totalprice / 5 < 18841 THEN 4 WHEN o_totalprice / 5 < 51128 THEN 8 ELSE 16 END, 16)) AS INTEGER) AS n FROM orders")
def c6_adaptive_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", G.adaptive_budget(F.col("o_totalprice") / 5, 16).alias("n"))


@query("SELECT l_suppkey, round(avg(abs(l_tax - l_discount)) FILTER (l_returnflag = 'R'), 6) AS l1, round(avg((l_tax - l_discount) ** 2) FILTER (l_returnflag = 'R'), 8) AS mse, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY 1")
def c7_masked_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_tax").alias("p"), F.col("l_discount").alias("t"), "l_returnflag")
    return G.masked_errors(pairs, "l_suppkey", F.col("l_returnflag") == "R").select("l_suppkey", F.round("l1", 6).alias("l1"), F.round("mse", 8).alias("mse"), "n")


@query("""WITH m AS (SELECT l_suppkey, avg(l_tax) AS mp, avg(l_discount) AS mt, var_pop(l_tax) AS vp, var_pop(l_discount) AS vt, covar_pop(l_tax, l_discount) AS cov FROM lineitem GROUP BY 1)
SELECT l_suppkey, round((2 * mp * mt + 0.0001) * (2 * cov + 0.0009) / ((mp * mp + mt * mt + 0.0001) * (vp + vt + 0.0009)), 6) AS ssim FROM m""")
def c7_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_tax").alias("p"), F.col("l_discount").alias("t"))
    return G.ssim(pairs, "l_suppkey", 1.0).select("l_suppkey", F.round("ssim", 6).alias("ssim"))




@query("""WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events),
p AS (SELECT event_id, value, i, d, i // 12 - d AS tile FROM e, range(0, 2) r(d)), t AS (SELECT * FROM p WHERE tile >= 0 AND i - tile * 12 < 16),
m AS (SELECT tile, avg(value) AS pred FROM t GROUP BY 1), w AS (SELECT event_id, pred, exp(-0.5 * ((i - tile * 12 - 7.5) / 4.0) ** 2) AS w FROM t JOIN m USING (tile))
SELECT event_id, round(sum(pred * w) / sum(w), 6) AS blended FROM w GROUP BY 1""")
def c6_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = global_rank(table(spark, sf_dir, "events").select("event_id", "ts", "value"), "ts", "event_id", name="i")
    tiled = G.tiles(e, "i", 16, 12)
    pred = tiled.groupBy("tile").agg(F.avg("value").alias("blended"))
    return G.blended(tiled.join(pred, "tile"), "event_id", "blended", 16, 4.0).withColumn("blended", F.round("blended", 6))
