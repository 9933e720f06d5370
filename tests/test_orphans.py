import random
from datetime import datetime as D
from datetime import timedelta

from pyspark.sql import functions as F

from gyral.functions.ids import case_key, file_key, subject_key
from gyral.operators.orphans import lifetimes, orphan_references, orphan_report
from gyral.plans.skew import heavy_keys, split_join

REFS = "ref_table string, row_id bigint, key string, t timestamp_ntz"
FILES = "key string, start timestamp_ntz, stop timestamp_ntz"


def refs(spark, rows):
    return spark.createDataFrame(rows, REFS)


def test_reasons(spark):
    files = spark.createDataFrame(
        [("a", D(2025, 1, 1), D(2025, 2, 1)), ("a", D(2025, 3, 1), None), ("b", D(2025, 5, 1), None), ("c", D(2025, 1, 1), D(2025, 1, 2)), ("c", D(2025, 1, 1), D(2025, 1, 2)), ("e", D(2025, 2, 1), D(2025, 1, 1)), (None, D(2025, 1, 1), None)], FILES
    )
    r = refs(spark, [("t", i, k, t) for i, (k, t) in enumerate([
        ("a", D(2025, 1, 1)), ("a", D(2025, 2, 1)), ("a", D(2025, 3, 1)), ("a", D(2024, 12, 1)), ("b", D(2025, 4, 1)), ("c", D(2025, 1, 2)), ("d", D(2025, 1, 1)), (None, D(2025, 1, 1)), ("b", None), ("e", D(2025, 1, 15))])])
    got = {r["row_id"]: r["reason"] for r in orphan_references(r, files).collect()}
    assert got == {1: "removed", 3: "later", 4: "later", 5: "removed", 6: "missing", 8: "later", 9: "missing"}


def test_overlaps_merge(spark):
    files = spark.createDataFrame([("a", D(2025, 1, 1), D(2025, 1, 5)), ("a", D(2025, 1, 5), D(2025, 1, 9)), ("a", D(2025, 1, 2), D(2025, 1, 3)), ("a", D(2025, 2, 1), D(2025, 2, 2))], FILES)
    assert [(r[1].day, r[2].day) for r in lifetimes(files).orderBy("start").collect()] == [(1, 9), (1, 2)]


def test_empty_tables(spark):
    none, no_files = refs(spark, []), spark.createDataFrame([], FILES)
    one = refs(spark, [("t", 1, "a", D(2025, 1, 1))])
    assert orphan_references(none, no_files).count() == 0
    assert [r["reason"] for r in orphan_references(one, no_files).collect()] == ["missing"]
    assert orphan_report(one, no_files).collect()[0]["n_refs"] == 1
    assert orphan_report(none, no_files).count() == 0


def test_report_counts_what_the_rows_say(spark):
    rng = random.Random(4)
    day = lambda n: D(2025, 1, 1) + timedelta(hours=n)
    files = spark.createDataFrame([(f"k{rng.randrange(12)}", day(a := rng.randrange(3000)), day(a + rng.randrange(900)) if rng.random() < 0.8 else None) for _ in range(30)], FILES)
    many = refs(spark, [(f"t{rng.randrange(2)}", i, "k1" if i % 3 == 0 else f"k{rng.randrange(16)}" if i % 11 else None, day(rng.randrange(4000)) if i % 13 else None) for i in range(4000)])
    rows = orphan_references(many, files).groupBy("ref_table", F.date_format("t", "yyyy-MM").alias("month"), "reason").count()
    want = {tuple(r) for r in rows.collect()}
    assert {tuple(r) for r in orphan_report(many, files).collect()} == want and len(want) > 20


def test_hot_lifetimes_beyond_the_broadcast(spark, monkeypatch):
    """A hot key with more lifetimes than are broadcast is salted instead."""
    from gyral.operators import orphans

    monkeypatch.setattr(orphans, "BROADCAST_ROWS", 5)
    day = lambda n: D(2025, 1, 1) + timedelta(days=n)
    files = spark.createDataFrame([("hot", day(2 * i), day(2 * i + 1)) for i in range(20)], FILES)
    many = spark.range(4000).select(F.lit("t").alias("ref_table"), F.col("id").alias("row_id"), F.lit("hot").alias("key"), F.expr("TIMESTAMP_NTZ '2025-01-01' + make_interval(0, 0, 0, CAST(id % 38 AS INT))").alias("t"))
    assert orphan_references(many, files).count() == many.filter("id % 38 % 2 = 1").count()


def test_hot_key_that_came_back(spark):
    n = 6000
    many = spark.range(n).select(F.lit("t").alias("ref_table"), F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"), F.expr("TIMESTAMP_NTZ '2025-01-01' + make_interval(0, 0, 0, CAST(id % 100 AS INT))").alias("t"))
    files = spark.createDataFrame([("hot", D(2025, 1, 1), D(2025, 1, 11)), ("hot", D(2025, 2, 1), None)], FILES)
    assert heavy_keys(many, "key") == ["hot"]
    got = orphan_references(many, files).filter("row_id % 3 = 0")
    expect = sum(1 for i in range(0, n, 3) if 10 <= i % 100 < 31)
    assert got.count() == expect and {r[0] for r in got.select("reason").distinct().collect()} == {"removed"}


def test_split_join_keeps_rows(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("key"))
    right = spark.createDataFrame([(0, "x"), (1, "y")], "key bigint, v string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a, b = split_join(left, right, "key", how), left.join(right, "key", how)
        assert sorted(map(str, a.select("id", "key").collect())) == sorted(map(str, b.select("id", "key").collect()))


def test_ids(spark):
    rows = [
        ("BraTS-GLI-00123-001-m2", "gli-123", "gli-123-001"), ("HCP--999", None, None), ('"HCP-７０７６５９２-０００"', "hcp-7076592", "hcp-7076592-000"),
        ("BraTS–GoAT–99999–9999", "goat-99999", "goat-99999"), ("D:\\scans\\BraTS-GLI-0012345-003.nii.gz", "gli-12345", "gli-12345-003"), ("a\nb/GLI_12345", "gli-12345", None),
        (None, None, None), ("", None, None), ("ugli-12345-001", None, None), ("/data/gli/HCP-7000001-000", "hcp-7000001", "hcp-7000001-000"), ("gli-123-001", None, None), ("\x01gli-123-001", None, None), ("x" * 100_000, None, None),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "s string").select(subject_key(F.col("s")), case_key(F.col("s")))
    assert [tuple(r) for r in df.collect()] == [r[1:] for r in rows]


def test_file_keys(spark):
    rows = [(" /a/B.nii.gz\n", "b.nii.gz"), ("\\a\\b.NII.GZ", "b.nii.gz"), ("file:///x/../b", "b"), ("", None), ("  ", None), (None, None), ("/a/b/", "b"), ("b\t ", "b")]
    df = spark.createDataFrame([(r[0],) for r in rows], "s string").select(file_key(F.col("s")))
    assert [r[0] for r in df.collect()] == [r[1] for r in rows]
