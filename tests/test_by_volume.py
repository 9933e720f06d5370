"""What is done volume by volume: one shuffle of the cells that are there, whatever the kernel, and the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyral.operators import grids as G
from gyral.operators import voxels as V
from gyral.queries import queries

CELL = "vol bigint, x int, y int, z int, v double"
SHAPE = (5, 4, 3)


def shuffles(df):
    """Shuffles by a key that the plan of df has."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def mirrored(a, sigma):
    """A Gaussian of one volume as the sum over every offset, by brute force."""
    w = G.gaussian_weights(sigma)
    r = len(w) // 2
    for axis in range(3):
        n, out = a.shape[axis], np.zeros_like(a)
        for t in range(n):
            for o, x in enumerate(w):
                at = (t + o - r) % (2 * n)
                np.moveaxis(out, axis, 0)[t] += x * np.moveaxis(a, axis, 0)[at if at < n else 2 * n - 1 - at]
        a = out
    return a


@pytest.fixture
def small_batches(spark):
    """Volumes that go on over several batches, and arrays of few volumes."""
    before, V.DENSE_CELLS = V.DENSE_CELLS, 150
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    V.DENSE_CELLS = before
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def sparse(spark, vols=9, seed=0):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random((vols, *SHAPE)) < 0.4, rng.random((vols, *SHAPE)), 0)
    a[:, 0, 0, 0] = 1
    return a, [(i, x, y, z, float(a[i, x, y, z])) for i, x, y, z in np.ndindex(a.shape) if a[i, x, y, z]]


def test_gaussian_shuffles_only_the_cells_that_are_there(spark, sf):
    assert shuffles(queries()["c6_gaussian_3d"](spark, sf)) == 1


def test_gaussian_of_sparse_volumes(spark, small_batches):
    a, rows = sparse(spark)
    dirt = [(20, 0, 0, 0, None), (21, -1, 0, 0, 9.0), (21, 0, 4, 0, 9.0), (21, None, 0, 0, 9.0), (None, 0, 0, 0, 9.0)]
    got = G.smoothed_volume(spark.createDataFrame(rows + dirt, CELL), SHAPE, 1.0).collect()
    assert len(got) == len({tuple(r)[:4] for r in got}) == 12 * 60
    assert all(r.v == 0 for r in got if r.vol in (20, 21, None))
    for vol in range(9):
        want = mirrored(a[vol], 1.0)
        assert all(r.v == pytest.approx(want[r.x, r.y, r.z]) for r in got if r.vol == vol)


def test_gaussian_keeps_what_is_not_finite_within_its_reach(spark):
    long = (12, 1, 1)
    got = G.smoothed_volume(spark.createDataFrame([("a", 0, 0, 0, float("nan")), ("b", 0, 0, 0, 1.0)], CELL.replace("bigint", "string")), long, 1.0).collect()
    assert {r.x for r in got if r.vol == "a" and np.isnan(r.v)} == set(range(5)) and not any(np.isnan(r.v) for r in got if r.vol == "b")
    assert G.smoothed_volume(spark.createDataFrame([], CELL), long, 1.0).count() == 0


def test_blurred_prior_is_one_shuffle(spark, sf):
    assert shuffles(queries()["c2_blurred_prior"](spark, sf)) == 1


def test_smoothed_cells_keep_their_rows(spark, small_batches):
    a, rows = sparse(spark)
    more = [(0, 1, 1, 1, None), (0, 1, 1, 1, None), (3, 5, 0, 0, 9.0), (3, None, 0, 0, 9.0), (None, 0, 0, 0, 9.0)]
    df = spark.createDataFrame(rows + more, CELL).withColumn("tag", F.concat("vol", F.lit("/"), "x"))
    got = G.smoothed_cells(df, SHAPE, 1.0).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, (tuple(r) for r in df.collect())))
    for r in got:
        off = r.vol is None or r.x is None or r.x == 5
        assert r.soft is None if off else r.soft == pytest.approx(mirrored(a[r.vol], 1.0)[r.x, r.y, r.z])


def test_similarity_map_shuffles_the_cells_that_are_there(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries()["c7_ssim_map"](spark, sf)
        assert df._jdf.queryExecution().executedPlan().toString().count("Join") == 0 and shuffles(df) == 3  # the cells, their volumes' names, the sums
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filled_is_padded(spark):
    _, rows = sparse(spark, 3)
    df = spark.createDataFrame([*rows, (7, 0, 0, 0, None), (8, -1, 0, 0, 2.0), (8, None, 0, 0, 2.0), (None, 0, 0, 0, 2.0)], CELL)
    cells = lambda d: sorted(map(str, (tuple(r) for r in d.select("vol", *V.XYZ, "v").collect())))
    assert cells(V.filled(df, SHAPE)) == cells(V.padded(df, SHAPE))


def test_similarity_of_values_by_brute_force(spark, small_batches):
    a, rows = sparse(spark, 2, 4)
    b = np.random.default_rng(5).random(a.shape)
    pairs = [(i, x, y, z, float(a[i, x, y, z]), float(b[i, x, y, z]), x == 1) for i, x, y, z in np.ndindex(a.shape)]
    got = G.ssim_map(spark.createDataFrame(pairs, "vol bigint, x int, y int, z int, p double, t double, inside boolean"), SHAPE, 1.0).collect()
    assert len(got) == 120 and all(r.inside == (r.x == 1) for r in got)
    for i in range(2):
        p, t, pp, tt, pt = (mirrored(m, 1.5) for m in (a[i], b[i], a[i] ** 2, b[i] ** 2, a[i] * b[i]))
        want = (2 * p * t + 1e-4) * (2 * (pt - p * t) + 9e-4) / ((p * p + t * t + 1e-4) * (pp - p * p + tt - t * t + 9e-4))
        assert all(r.ssim == pytest.approx(want[r.x, r.y, r.z]) for r in got if r.vol == i)


def enclosed(solid):
    """Cells of a volume's background that a flood from outside does not reach, by brute force."""
    solid = np.pad(solid, 1)
    seen, todo = {(0, 0, 0)}, [(0, 0, 0)]
    while todo:
        at = todo.pop()
        for axis, step in ((a, s) for a in range(3) for s in (-1, 1)):
            to = tuple(c + step * (i == axis) for i, c in enumerate(at))
            if all(0 <= c < n for c, n in zip(to, solid.shape)) and not solid[to] and to not in seen:
                seen.add(to)
                todo.append(to)
    return {(x - 1, y - 1, z - 1) for x, y, z in np.ndindex(solid.shape) if not solid[x, y, z] and (x, y, z) not in seen}


def test_holes_are_one_shuffle_and_no_rounds(spark, sf):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("holes", "holes")
    try:
        df = queries()["c5_fill_holes"](spark, sf)
        assert len(tracker.getJobIdsForGroup("holes")) <= 1 and shuffles(df) == 1  # the table's schema
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_holes_by_brute_force(spark, small_batches):
    rng = np.random.default_rng(7)
    solid = rng.random((8, 7, 6, 5)) < np.linspace(0.5, 0.8, 8)[:, None, None, None]
    winding = np.ones((1, 7, 6, 5), bool)  # a corridor that turns at each end, open at its far end only
    winding[0, 1:6, 1::2, 2] = False
    winding[0, 5, 2, 2] = winding[0, 1, 4, 2] = winding[0, 5, 5, 2] = False
    winding[0, 3, 3, 0] = False
    solid = np.concatenate([solid, winding, np.ones((1, 7, 6, 5), bool)])
    solid[9, 3, 3, 3] = solid[9, 2, 3, 3] = False
    rows = [(int(v), int(x), int(y) - 2, int(z)) for v, x, y, z in np.argwhere(solid)]
    mask = spark.createDataFrame([*rows, rows[0], (None, 0, 0, 0), (3, None, 0, 0)], "vol bigint, x int, y int, z int")
    got = V.holes(mask).collect()
    assert len(got) == len(set(got)) and {(r.x, r.y, r.z) for r in got if r.vol == 9} == {(3, 1, 3), (2, 1, 3)}
    assert {tuple(r) for r in got} == {(v, x, y - 2, z) for v in range(10) for x, y, z in enclosed(solid[v])}
    assert not any(r.vol == 8 for r in got) and V.holes(mask.filter("false")).count() == 0


def test_retrieved_prior_shuffles_cells_by_volume_only(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries()["c9_retrieved_prior"](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(vol#" in plan and not any(", x#" in line for line in plan.split("\n") if "Exchange" in line)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
