"""3-D kernels, placement, lookups and training rows on small fixtures, with dirt and empty tables."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gyral.operators import batches as B
from gyral.operators import grids as G
from gyral.operators import sampling as S
from gyral.operators import training as T
from gyral.operators import voxels as V
from gyral.operators.retrieval import built_index, shortlist, similar_to_any
from gyral.session import scratch_dir

CELL = "vol bigint, x int, y int, z int, v double"
SHAPE = (5, 4, 3)


def volume(spark, seed=0, vols=2, keep=1.0):
    rng = np.random.default_rng(seed)
    a = rng.random((vols, *SHAPE))
    rows = [(i, x, y, z, float(a[i, x, y, z])) for i, x, y, z in np.ndindex(a.shape) if rng.random() < keep]
    return a, spark.createDataFrame(rows, CELL)


def dense(df, shape, vols=2, value="v"):
    out = np.zeros((vols, *shape))
    for r in df.collect():
        out[r.vol, r.x, r.y, r.z] = r[value]
    return out


def test_trilinear_keeps_corners_and_planes(spark):
    a, df = volume(spark)
    got = dense(G.resampled_trilinear(df, SHAPE, (9, 4, 2)), (9, 4, 2))
    assert got[:, ::2, :, 0] == pytest.approx(a[:, :, :, 0]) and got[:, ::2, :, 1] == pytest.approx(a[:, :, :, 2])
    assert got[:, 1, :, 0] == pytest.approx((a[:, 0, :, 0] + a[:, 1, :, 0]) / 2)
    assert G.resampled_trilinear(df.filter("false"), SHAPE, (9, 4, 2)).count() == 0
    assert dense(G.resampled_trilinear(df, SHAPE, SHAPE), SHAPE) == pytest.approx(a)


def test_gaussian_volume(spark):
    a, df = volume(spark, 1)
    w = np.array(G.gaussian_weights(1.0))
    want = a
    for axis in (1, 2, 3):
        padded = np.pad(want, [(4, 4) if i == axis else (0, 0) for i in range(4)], mode="symmetric") if a.shape[axis] >= 4 else np.take(want, [(i if i < a.shape[axis] else 2 * a.shape[axis] - 1 - i) for i in np.arange(-4, a.shape[axis] + 4) % (2 * a.shape[axis])], axis)
        want = np.apply_along_axis(lambda x: np.convolve(x, w, "valid"), axis, padded)
    assert dense(G.smoothed_volume(df, SHAPE, 1.0), SHAPE) == pytest.approx(want)
    assert dense(G.smoothed_volume(df, SHAPE, 0), SHAPE) == pytest.approx(a)


def test_similarity_map(spark):
    _, df = volume(spark, 2)
    same = G.ssim_map(df.select("vol", *V.XYZ, F.col("v").alias("p"), F.col("v").alias("t")), SHAPE, 1.0)
    assert all(r.ssim == pytest.approx(1) for r in same.collect())
    other = G.ssim_map(df.select("vol", *V.XYZ, F.col("v").alias("p"), (1 - F.col("v")).alias("t")), SHAPE, 1.0)
    assert max(r.ssim for r in other.collect()) < 1


def test_free_turns(spark):
    a, df = volume(spark, 3)
    square = df.filter("x < 4")
    turned = dense(G.turned(square, "xy", F.lit(90), (4, 4, 3)), (4, 4, 3))
    assert turned == pytest.approx(np.rot90(a[:, :4], -1, (1, 2))) or turned == pytest.approx(np.rot90(a[:, :4], 1, (1, 2)))
    assert dense(G.turned(square, "xy", F.lit(0), (4, 4, 3)), (4, 4, 3)) == pytest.approx(a[:, :4])


def test_mirror_images_and_parts(spark):
    shape = spark.createDataFrame([(1, 2, 0, 0), (1, 3, 0, 0), (1, 3, 1, 0)], "vol bigint, x int, y int, z int")
    got = {t: {(r.x, r.y, r.z) for r in S.mirrored(shape).collect() if r.turn == t} for t in range(8)}
    assert got[0] == {(2, 0, 0), (3, 0, 0), (3, 1, 0)} and got[1] == {(3, 0, 0), (2, 0, 0), (2, 1, 0)} and got[2] == {(2, 1, 0), (3, 1, 0), (3, 0, 0)} and got[4] == got[0]
    assert [tuple(r) for r in S.smallest_part(shape, 0.7).orderBy("x").collect()] == [(1, 2, 0, 0), (1, 3, 0, 0)]
    assert S.smallest_part(shape, 0.01).count() == 1 and S.smallest_part(shape.filter("false"), 0.5).count() == 0


def test_lookup_fails_on_a_miss(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    names = spark.createDataFrame([("a", 7)], "k string, n int")
    assert B.looked_up(items.filter("id = 1"), names, "k").select("n").first()[0] == 7
    with pytest.raises(PySparkException, match="no entry for"):
        B.looked_up(items, names, "k").collect()
    assert sorted((r.id, r.n) for r in B.looked_up(items, names, "k", strict=False).collect()) == [(1, 7), (2, None), (3, None)]
    assert {r.id for r in B.missed(items, names, "k").collect()} == {2, 3}


def test_pairs_and_variants(spark):
    one, two = spark.createDataFrame([("a",), ("b",), ("b",)], "k string"), spark.createDataFrame([("b",), ("c",)], "k string")
    assert {tuple(r) for r in B.paired({"x": one, "y": two}, "k").collect()} == {("a", True, False, "y"), ("b", True, True, None), ("c", False, True, "x")}
    files = spark.createDataFrame([("/r/a/c1-0002.nii.gz",), ("/r/a/c1-m3.nii",), ("/r/b/c2.nii.gz",), ("/other/c3.nii",), (None,)], "path string")
    assert sorted((r.root, r.dir, r.name, r.sfx) for r in B.enumerated(files, ["/r/b/", "/r/"]).collect()) == [(0, "/r/b", "c2", ""), (1, "/r/a", "c1", "-0002"), (1, "/r/a", "c1", "-m3")]
    assert sorted((r.k, r.sfx) for r in B.with_fallback(one, spark.createDataFrame([("a", "-1"), ("a", "-2")], "k string, sfx string"), "k").collect()) == [("a", "-1"), ("a", "-2"), ("b", "")]


def test_sample_rows(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1, 2.0), (1, 0, 0, 0, None), (1, 1, 0, 0, 4.0)], CELL)
    hole = spark.createDataFrame([(1, 1, 0, 0), (1, 1, 0, 0)], "vol bigint, x int, y int, z int")
    row = T.sample_rows(T.channels(cells, hole), (2, 1, 2), -1.0).first()
    assert (row.pos, row.voided, row["mask"], row.loss, row.target) == ([0, 1, 2], [0.0, 2.0, -1.0], [0, 0, 1], [0, 0, 1], [0.0, 0.0, 4.0])
    assert T.sample_rows(T.channels(cells.filter("false"), hole), (2, 1, 2)).count() == 0
    none = T.sample_rows(T.channels(cells, hole, hole.filter("false")), (2, 1, 2)).first()
    assert none["mask"] == [0, 0, 1] and none.loss == [0, 0, 0]


def test_vectors_of_another_length_do_not_count(spark):
    rows = [(i, i, [1.0, float(i), 0.5]) for i in range(6)] + [(7, 7, [1.0] * 90), (8, 8, None), (9, 9, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, subject bigint, vec array<double>")
    short = shortlist(df, df, 2).collect()
    assert {r["query"] for r in short} == set(range(6)) and all(r.donor < 6 for r in short)
    best = {r.id: r.best for r in similar_to_any(df.select("id", "vec"), df.filter("id < 3 or id = 7").select("vec"), "vec").collect()}
    assert best[7] is None and best[8] is None and best[5] == pytest.approx(1 + 10 + 0.25)


def test_index_is_reused(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 2.0]), (2, 1, None)], "id bigint, subject bigint, vec array<double>")
    at = scratch_dir(spark, "index")
    assert built_index(df, at).count() == 1 and built_index(df.filter("false"), at).count() == 1
    assert built_index(df.filter("false"), at, overwrite=True).count() == 0


def test_tiles_cover_every_row(spark):
    tiled = G.tiles(spark.range(50).withColumnRenamed("id", "i"), "i", 16, 12)
    assert tiled.select("i").distinct().count() == 50 and tiled.filter("at < 0 or at >= 16 or tile * 12 + at <> i").count() == 0
