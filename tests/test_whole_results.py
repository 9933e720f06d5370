"""Registered queries against the whole computation, where their SQL stops short of it."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyral.functions.draws import uniform
from gyral.operators import voxels as V
from gyral.plans.masks import tumour, volumes
from gyral.queries import queries


def lloyd(x, k=3, rounds=25):
    """Quantile start, then rounds of means until they stay."""
    c = np.quantile(x, np.linspace(0, 1, k + 2)[1:-1])
    for _ in range(rounds):
        j = np.abs(x[:, None] - c).argmin(1)
        new = np.array([x[j == i].mean() if (j == i).any() else c[i] for i in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return np.sort(c)


def test_kmeans_runs_until_it_converges(spark, sf):
    x = np.array([r[0] for r in spark.read.parquet(f"{sf}/events.parquet").filter(F.col("value").isNotNull()).select("value").collect()])
    got = [r.centre for r in queries()["c6_kmeans"](spark, sf).orderBy("class").collect()]
    assert got == pytest.approx(lloyd(x), abs=1e-3)
    assert np.abs(np.array(got) - lloyd(x, rounds=6)).max() > 0.1


def test_distances_without_a_radius(spark):
    rng = random.Random(3)
    grid = list(itertools.product(range(-2, 9), range(7), range(12)))
    cells, marked = rng.sample(grid, 400), {1: rng.sample(grid, 2), 2: [grid[0]], 3: []}
    frame = lambda rows: spark.createDataFrame(rows, "vol bigint, x int, y int, z int")
    everywhere = frame([(v, *c) for v in marked for c in cells])
    got = {(r.vol, r.x, r.y, r.z): r.dm for r in V.distance_map(everywhere, frame([(v, *c) for v, m in marked.items() for c in m])).collect()}
    assert len(got) == 3 * len(cells)
    for v, m in marked.items():
        for c in cells:
            assert got[(v, *c)] == (pytest.approx(min(math.dist(c, p) for p in m)) if m else None)


def distances(spark, sf):
    """(vol, x, y, z): distance, or None in volumes without a tumour, by brute force."""
    place = lambda df: [tuple(r) for r in df.select("vol", "x", "y", "z").collect()]
    marks = {}
    for v, *c in place(tumour(spark, sf)):
        marks.setdefault(v, []).append(c)
    return {(v, *c): round(min(math.dist(c, p) for p in marks[v]), 6) if v in marks else None for v, *c in place(volumes(spark, sf))}


def test_distance_map_reaches_every_cell(spark, sf):
    want = distances(spark, sf)
    got = {(r.vol, r.x, r.y, r.z): r.dm for r in queries()["c5_distance_map"](spark, sf).collect()}
    assert got == want and max(d for d in want.values() if d is not None) > 4


def test_farthest_point_draws_from_every_cell(spark, sf):
    valid = {}
    for (v, *c), d in sorted(distances(spark, sf).items()):
        if d is not None and d > 1:
            valid.setdefault(v, []).append((-d, *c))
    draws = spark.createDataFrame([(v, k) for v in valid for k in range(2)], "vol bigint, draw int").select("vol", uniform("spot", F.col("vol"), F.col("draw")).alias("u")).collect()
    want = {}
    for r in draws:
        spot = valid[r.vol][math.floor(r.u * len(valid[r.vol]))]
        want[r.vol] = min(spot, want.get(r.vol, spot))
    got = {r.vol: (-r.dm, r.x, r.y, r.z) for r in queries()["c5_farthest_point"](spark, sf).collect()}
    assert got == want
