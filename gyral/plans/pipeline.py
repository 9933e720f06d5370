"""Queries on batch work over orders and lineitem, and on relational extras."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyral.operators import batches as B
from gyral.plans.masks import VOX, tumour, volumes
from gyral.plans.registry import query, table


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 4)")
def c8_pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _t(spark, sf_dir, "lineitem").filter("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return B.pending(_t(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT status, reason, count(*) AS n FROM (SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_orderstatus = 'P' THEN 'open' END AS reason, CASE WHEN o_totalprice < 50000 OR o_orderstatus = 'P' THEN 'fail' ELSE 'ok' END AS status FROM orders) GROUP BY 1, 2")
def c8_status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [("small", F.col("o_totalprice") >= 50000), ("open", F.col("o_orderstatus") != "P")]
    return B.tally(B.judged(_t(spark, sf_dir, "orders"), checks), "status", "reason")


@query("SELECT l_orderkey, l_linenumber, l_orderkey || printf('-%04d', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1) AS item FROM lineitem")
def c8_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.variants(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"])
    return rows.select("l_orderkey", "l_linenumber", F.concat("l_orderkey", "sfx").alias("item"))


@query("SELECT o.o_orderkey, coalesce(l.n, 0) AS variants, CASE WHEN l.n IS NULL THEN '' ELSE '-0000' END AS first_sfx FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l.l_orderkey = o.o_orderkey")
def c8_variant_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    joined = _t(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey", "left")
    return joined.select("o_orderkey", F.coalesce("n", F.lit(0).cast("bigint")).alias("variants"), F.when(F.col("n").isNull(), "").otherwise("-0000").alias("first_sfx"))


@query("SELECT s_suppkey, count(*) FILTER (l_returnflag = 'A') AS t1n, count(*) FILTER (l_returnflag = 'R') AS mask, bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R') AS paired FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def c8_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag")
    has = lambda f: F.count_if(F.col("l_returnflag") == f)
    sides = li.groupBy("s_suppkey").agg(has("A").alias("t1n"), has("R").alias("mask")).withColumn("paired", (F.col("t1n") > 0) & (F.col("mask") > 0))
    return _t(spark, sf_dir, "supplier").select("s_suppkey").join(sides, "s_suppkey")


@query("SELECT donor_id, CASE WHEN starts_with(paths, '/data/gli/') THEN '/app/donors/gli/' || substr(paths, 11) WHEN starts_with(paths, '/data/hcp/') THEN '/app/donors/hcp/' || substr(paths, 11) ELSE paths END AS path FROM donor_index")
def c8_path_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = B.rerooted(F.col("paths"), [("/data/gli/", "/app/donors/gli/"), ("/data/hcp/", "/app/donors/hcp/")])
    return _t(spark, sf_dir, "donor_index").select("donor_id", path.alias("path"))


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_orderpriority, p.p_brand, s.s_name FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey")
def c8_case_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return li.join(o, "l_orderkey").join(p, "l_partkey").join(s, "l_suppkey").select("l_orderkey", "l_linenumber", "o_orderpriority", "p_brand", "s_name")


@query("SELECT donor_id, nullif(list_extract(list_filter(string_split(replace(paths, '\\', '/'), '/'), lambda s: s <> ''), -2), NULL) AS folder, regexp_replace(paths, '(?s)-[0-9]{3}(/|-).*$', '') AS stem FROM donor_index")
def c8_key_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split(F.translate("paths", "\\", "/"), "/"), lambda s: s != "")
    return _t(spark, sf_dir, "donor_index").select("donor_id", F.try_element_at(parts, F.lit(-2)).alias("folder"), F.regexp_replace("paths", r"-[0-9]{3}(/|-)(?s:.*)$", "").alias("stem"))


@query(f"WITH {VOX}, t AS (SELECT vol, list(v ORDER BY x, y, z) AS voided FROM vox WHERE v < 47 GROUP BY 1), h AS (SELECT vol, list(v ORDER BY x, y, z) AS target FROM vox WHERE v >= 47 GROUP BY 1) SELECT vol, len(voided) AS n_visible, len(target) AS n_hole, round(list_avg(voided), 6) AS mean_visible, round(list_avg(target), 6) AS mean_hole FROM t JOIN h USING (vol)")
def c9_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gyral.operators.training import training_rows

    rows = training_rows(volumes(spark, sf_dir), tumour(spark, sf_dir))
    avg = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c), 6)
    return rows.select("vol", F.size("voided").cast("bigint").alias("n_visible"), F.size("target").cast("bigint").alias("n_hole"), avg("voided").alias("mean_visible"), avg("target").alias("mean_hole"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def x_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS price FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def x_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("price"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def x_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gyral.streaming.events import daily

    return daily(_t(spark, sf_dir, "events")).select("day", "event_type", "n", F.round("value", 4).alias("value"))


@query("""WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR AS gap FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM e)
SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, s.n""")
def x_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL '6' HOUR")
    s = _t(spark, sf_dir, "events").select("user_id", "ts", gap.alias("gap")).withColumn("s", F.sum(F.when(F.col("gap"), 1).otherwise(0)).over(w))
    return s.groupBy("user_id", "s").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n")).drop("s")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS decade, count(*) AS n FROM events GROUP BY 1, 2")
def x_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    decade = F.floor(F.get_json_object("props", "$.k").cast("bigint") / 10)
    return _t(spark, sf_dir, "events").groupBy("event_type", decade.alias("decade")).agg(F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance, rank() OVER (ORDER BY count(*) DESC, n_name) AS place FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def x_ranked_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    named = counts.join(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return named.select("n_name", "customers", "balance", F.rank().over(Window.orderBy(F.desc("customers"), "n_name")).cast("bigint").alias("place"))
