"""Skew-aware joins and the tables that cut lineage."""

import os

import pytest
from pyspark.sql import functions as F

from gyral.plans.skew import split_join, spread_join
from gyral.session import cut, discard, shared_dir


def keyed(spark, n, hot, name):
    """A third of the rows in one key; a few null keys."""
    key = F.when(F.col("id") % 3 == 0, F.lit(hot)).when(F.col("id") % 101 == 1, None).otherwise(F.col("id") % 50)
    return spark.range(n).select(key.alias("k"), F.col("id").alias(name))


def test_spread_join_of_hot_keys(spark):
    left, right = keyed(spark, 9_000, 7, "a"), keyed(spark, 90, 7, "b")
    want = left.join(right, "k").agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    got = spread_join(left, right, "k", rows=64, sampled=8)
    assert "_salt" in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.agg(F.count("*"), F.sum("a"), F.sum("b")).first() == want and got.columns == ["k", "a", "b"]
    assert spread_join(left, right.filter("false"), "k", rows=64, sampled=8).count() == 0
    plain = spread_join(left, right, "k")
    assert "_salt" not in plain._jdf.queryExecution().optimizedPlan().toString() and plain.count() == want[0]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_of_hot_keys(spark, how):
    left = keyed(spark, 9_000, 7, "a")
    right = spark.range(0, 50, 2).select(F.col("id").alias("k"), F.lit(1).alias("b"))
    for r in (right, right.unionByName(spark.sql("SELECT 7L AS k, 1 AS b"))):
        assert sorted(map(str, split_join(left, r, "k", how).collect())) == sorted(map(str, left.join(r, "k", how).collect()))


def test_cut_and_discard(spark):
    table = cut(spark.range(5).withColumn("v", F.col("id") * 2), "some")
    at = table._gyral_path.removeprefix("file:")
    assert at.startswith(shared_dir(spark).removeprefix("file:")) and os.path.isdir(at) and table.count() == 5
    discard(table, spark.range(3), None)
    assert not os.path.exists(at)
