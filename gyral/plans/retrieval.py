"""Queries on the embedding table: index, shortlist, rerank, merge, fill, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyral.functions.vectors import cosine, dot, doubles, fingerprint, l2_unit, mae, mean, mse, z_score
from gyral.operators.grids import moving_average
from gyral.operators.retrieval import built_index, merge, paste, rerank, shortlist, similar_to_any
from gyral.plans.registry import query, table
from gyral.session import cut, scratch_dir

SHORT, K, VISIBLE = 15, 10, 48


def donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as small volumes: dimensions 0-47 are visible, 48-63 are the hole; five of them make a subject."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 5).alias("subject"), F.col("embedding").alias("vec"), "label")


def asked(d: DataFrame) -> DataFrame:
    return d.filter(F.col("id") % 20 == 0)


def _short(d: DataFrame) -> DataFrame:
    return shortlist(asked(d), d, SHORT, 1, VISIBLE)


def _ranked(d: DataFrame) -> DataFrame:
    return rerank(_short(d), asked(d), d, K, slice(0, VISIBLE))


_E = """e AS (SELECT vec_id AS id, vec_id // 5 AS subject, embedding::DOUBLE[] AS vec, label FROM embeddings)"""
_SHORT = f"""{_E}, s AS (SELECT q.id AS query, d.id AS donor, q.vec AS qv, d.vec AS dv, list_cosine_similarity(q.vec[1:48], d.vec[1:48]) AS cos
  FROM e q JOIN e d ON q.subject <> d.subject WHERE q.id % 20 = 0),
short AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(cos, 12) DESC, donor) AS rank FROM s QUALIFY rank <= 15)"""
_MSE = "(list_distance(qv[1:48], dv[1:48]) ** 2 / 48)"
_RANKED = f"""{_SHORT}, ranked AS (SELECT *, {_MSE} AS mse, row_number() OVER (PARTITION BY query ORDER BY round({_MSE}, 12), donor) AS place FROM short QUALIFY place <= 10),
merged AS (SELECT query, u.i - 1 AS dim, avg(dv[u.i]) AS v FROM ranked, (SELECT unnest(range(1, 65)) AS i) u GROUP BY ALL)"""


@query(f"WITH {_E} SELECT id AS vec_id, round(list_avg(vec), 6) AS mean, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 5) AS norm, round(list_sum(list_transform(vec, lambda x: abs((x - list_avg(vec)) / (list_stddev_pop(vec) + 1e-6)))), 4) AS z_l1 FROM e")
def c1_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = doubles(F.col("vec"))
    z = F.aggregate(z_score(v), F.lit(0.0), lambda s, x: s + F.abs(x))
    return donors(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round(mean(v), 6).alias("mean"), F.round(F.sqrt(dot(v, v)), 5).alias("norm"), F.round(z, 4).alias("z_l1"))


@query(f"WITH {_SHORT} SELECT query, donor, round(cos, 6) AS cos, rank FROM short")
def c1_cosine_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(donors(spark, sf_dir)).select("query", "donor", F.round("cos", 6).alias("cos"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_RANKED} SELECT query, dim, round(v, 6) AS v FROM merged")
def c2_rerank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge(_ranked(donors(spark, sf_dir))).select("query", F.col("dim").cast("bigint").alias("dim"), F.round("v", 6).alias("v"))


@query(f"WITH {_RANKED} SELECT e.id AS query, r.donor, round(r.mse, 6) AS mse FROM e LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r ON e.id = r.query WHERE e.id % 20 = 0")
def c2_best_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = donors(spark, sf_dir)
    best = _ranked(d).filter("place = 1").select("query", "donor", F.round("mse", 6).alias("mse"))
    return asked(d).select(F.col("id").alias("query")).join(best, "query", "left")


@query(f"""WITH {_RANKED}, best AS (SELECT query, donor FROM ranked WHERE place = 1)
SELECT b.query, b.donor, 'donor-' || b.donor AS donor_path, round(list_max(list_transform(e.vec, lambda x: abs(x))), 6) AS donor_scale FROM best b JOIN e ON e.id = b.donor""")
def c2_donor_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = donors(spark, sf_dir)
    best = _ranked(d).filter("place = 1").select("query", "donor", "donor_vec")
    return best.select("query", "donor", F.concat(F.lit("donor-"), "donor").alias("donor_path"), F.round(F.array_max(F.transform(doubles(F.col("donor_vec")), F.abs)), 6).alias("donor_scale"))


@query(f"""WITH {_RANKED}, filled AS (SELECT m.query, list(m.v ORDER BY m.dim) AS v FROM merged m WHERE dim >= 48 GROUP BY 1)
SELECT f.query, round(list_avg(list_transform(range(1, 17), lambda i: abs(f.v[i] - e.vec[i + 48]))), 6) AS l1, round(list_avg(list_transform(range(1, 17), lambda i: (f.v[i] - e.vec[i + 48]) ** 2)), 6) AS mse FROM filled f JOIN e ON e.id = f.query""")
def c2_void_fill_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = donors(spark, sf_dir)
    merged = merge(_ranked(d)).filter(F.col("dim") >= VISIBLE)
    filled = merged.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("fill"))
    truth = asked(d).select(F.col("id").alias("query"), doubles(F.slice("vec", VISIBLE + 1, 64 - VISIBLE)).alias("truth"))
    return filled.join(truth, "query").select("query", F.round(mae("fill", "truth"), 6).alias("l1"), F.round(mse("fill", "truth"), 6).alias("mse"))


@query(f"""WITH {_RANKED} SELECT e.id AS query, u.i - 1 AS dim, round(CASE WHEN u.i > 48 THEN m.v * 0.5 ELSE e.vec[u.i] END, 6) AS v
FROM e, (SELECT unnest(range(1, 65)) AS i) u JOIN merged m ON m.query = e.id AND m.dim = u.i - 1 WHERE e.id % 20 = 0""")
def c2_paste(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = donors(spark, sf_dir)
    cells = asked(d).select(F.col("id").alias("query"), F.posexplode(doubles(F.col("vec"))).alias("dim", "own"))
    return cells.join(merge(_ranked(d)), ["query", "dim"]).select("query", F.col("dim").cast("bigint").alias("dim"), F.round(paste(F.col("own"), F.col("v"), F.col("dim") >= VISIBLE, 0.5), 6).alias("v"))


@query(f"""WITH {_RANKED}, best AS (SELECT query, donor, dv, qv FROM ranked WHERE place = 1)
SELECT query, u.i - 1 AS dim, round(CASE WHEN query % 40 = 0 OR u.i > 48 THEN dv[u.i] ELSE qv[u.i] END, 6) AS v FROM best, (SELECT unnest(range(1, 65)) AS i) u""")
def c2_single_best_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best donor pasted into the hole, or, for some queries, the whole donor."""
    best = _ranked(donors(spark, sf_dir)).filter("place = 1").select("query", F.posexplode(F.arrays_zip(doubles(F.col("query_vec")).alias("own"), doubles(F.col("donor_vec")).alias("other"))).alias("dim", "z"))
    v = F.when(F.col("query") % 40 == 0, F.col("z.other")).otherwise(paste(F.col("z.own"), F.col("z.other"), F.col("dim") >= VISIBLE))
    return best.select("query", F.col("dim").cast("bigint").alias("dim"), F.round(v, 6).alias("v"))


_WHOLE = f"""{_E}, s AS (SELECT q.id AS query, d.id AS donor, q.vec AS qv, d.vec AS dv, list_cosine_similarity(q.vec, d.vec) AS cos FROM e q JOIN e d ON q.subject <> d.subject WHERE q.id % 20 = 0),
short AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(cos, 12) DESC, donor) AS rank FROM s QUALIFY rank <= 15),
ranked AS (SELECT * FROM short QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(list_distance(qv, dv) ** 2 / 64, 12), donor) <= 10)"""


@query(f"WITH {_WHOLE} SELECT query, u.i - 1 AS dim, round(avg(dv[u.i]), 6) AS v FROM ranked, (SELECT unnest(range(1, 65)) AS i) u GROUP BY ALL")
def c2_merged_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged donor of a whole healthy volume: no hole, all dimensions count."""
    d = donors(spark, sf_dir)
    whole = rerank(shortlist(asked(d), d, SHORT, 1, 64), asked(d), d, K, slice(0, 64))
    return merge(whole).select("query", F.col("dim").cast("bigint").alias("dim"), F.round("v", 6).alias("v"))


@query(f"WITH {_E} SELECT id, round(list_sum(list_transform(vec, lambda x: abs((x - list_avg(vec)) / (list_stddev_pop(vec) + 1e-6)))), 4) AS z_l1 FROM e")
def c1_index_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is built once; the second call, though of fewer rows, reads what is there."""
    at = scratch_dir(spark, "index")
    built_index(donors(spark, sf_dir), at)
    again = built_index(donors(spark, sf_dir).limit(1), at)
    return again.select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.abs(x)), 4).alias("z_l1"))


_FP = f"""{_E}, b AS (SELECT id, list_transform(range(0, 16), lambda i: list_avg(vec[i * 4 + 1 : i * 4 + 4])) AS m FROM e),
c AS (SELECT id, list_transform(m, lambda x: x - list_avg(m)) AS m FROM b),
f AS (SELECT id, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS f FROM c),
best AS (SELECT p.id, max(list_dot_product(p.f, x.f)) AS best FROM f p, f x WHERE p.id % 20 <> 0 AND x.id % 20 = 0 GROUP BY 1)"""


def _best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = cut(donors(spark, sf_dir).select("id", fingerprint(doubles(F.col("vec")), 16).alias("f")), "prints")
    return similar_to_any(prints.filter(F.col("id") % 20 != 0), prints.filter(F.col("id") % 20 == 0), "f")


@query(f"WITH {_FP} SELECT id AS vec_id, round(best, 6) AS best FROM best WHERE best < 0.75")
def c3_fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best_match(spark, sf_dir).filter(F.coalesce("best", F.lit(-1.0)) < 0.75).select(F.col("id").alias("vec_id"), F.round("best", 6).alias("best"))


@query(f"""WITH {_FP} SELECT round(quantile_cont(best, 0), 6) AS p0, round(quantile_cont(best, 0.5), 6) AS p50, round(quantile_cont(best, 0.9), 6) AS p90, round(quantile_cont(best, 0.95), 6) AS p95,
round(quantile_cont(best, 0.99), 6) AS p99, round(quantile_cont(best, 1), 6) AS p100, count(*) FILTER (best >= 0.7 AND best < 0.75) AS near FROM best""")
def c3_similarity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("best", F.lit(q / 100)), 6).alias(f"p{q}")
    return _best_match(spark, sf_dir).agg(*map(p, (0, 50, 90, 95, 99, 100)), F.count_if((F.col("best") >= 0.7) & (F.col("best") < 0.75)).alias("near"))


@query(f"WITH {_E}, f AS (SELECT label, id, vec[1] AS v, row_number() OVER (PARTITION BY label ORDER BY id) AS n, count(*) OVER (PARTITION BY label) AS c FROM e) SELECT label, round(sum(CASE WHEN n = 1 THEN v * 0.9 ** (c - 1) ELSE 0.1 * v * 0.9 ** (c - n) END), 6) AS ema FROM f GROUP BY 1")
def c6_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = donors(spark, sf_dir).select("label", "id", F.element_at("vec", 1).alias("v"))
    return moving_average(first, "label", "id", "v", 0.9).select("label", F.round("ema", 6).alias("ema"))


@query(f"WITH {_E} SELECT label, u.i - 1 AS dim, round(avg(CASE WHEN f = 0 THEN vec[u.i] ELSE vec[65 - u.i] END), 6) AS v FROM e, (SELECT unnest(range(1, 65)) AS i) u, (SELECT unnest([0, 1]) AS f) GROUP BY 1, 2")
def c6_tta_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = donors(spark, sf_dir).select("label", F.explode(F.array("vec", F.reverse("vec"))).alias("view"))
    return merge(views, "label", "view").select("label", F.col("dim").cast("bigint").alias("dim"), F.round("v", 6).alias("v"))


@query(f"""WITH {_E}, u AS (SELECT label, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS f, id FROM e)
SELECT a.id AS a, b.id AS b, round(list_dot_product(a.f, b.f), 6) AS cos FROM u a JOIN u b ON a.label = b.label AND a.id <> b.id AND a.id % 20 = 0""")
def c1_cosine_within_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = donors(spark, sf_dir).select("id", "label", l2_unit(doubles(F.col("vec"))).alias("f"))
    a, b = d.filter("id % 20 = 0").select(F.col("id").alias("a"), "label", F.col("f").alias("fa")), d.select(F.col("id").alias("b"), "label", F.col("f").alias("fb"))
    return a.join(b, "label").filter("a <> b").select("a", "b", F.round(cosine("fa", "fb"), 6).alias("cos"))
