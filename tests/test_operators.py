"""Operators on hand-made fixtures, against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyral.functions.vectors import block_means, fingerprint, z_score
from gyral.operators import batches as B
from gyral.operators import grids as G
from gyral.operators import sampling as S
from gyral.operators import voxels as V
from gyral.operators.components import components
from gyral.operators.retrieval import merge, rerank, shortlist, similar_to_any
from gyral.operators.training import training_rows
from gyral.plans.ranks import global_rank

CELL = "vol bigint, x int, y int, z int"


def mask(spark, cells, vol=1):
    return spark.createDataFrame([(vol, *c) for c in cells], CELL)


def cells(df):
    return sorted((r["x"], r["y"], r["z"]) for r in df.collect())


def test_connectivity(spark):
    m = mask(spark, [(0, 0, 0), (1, 1, 1), (2, 2, 2), (5, 5, 4), (5, 5, 5)])
    assert V.component_sizes(V.labelled(m, (6, 6, 6), 26)).count() == 2
    assert V.component_sizes(V.labelled(m, (6, 6, 6), 6)).count() == 4


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(random.Random(3).randrange(60), random.Random(i).randrange(60)) for i in range(40)]])
def test_components(spark, edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in parent}


def test_box_crop_pad(spark):
    blob = list(itertools.product(range(2, 5), range(1, 3), range(3, 4)))
    box = V.bounding_boxes(mask(spark, blob), "vol").first()
    assert (box.x0, box.x1, box.y0, box.y1, box.z0, box.z1, box.size) == (2, 5, 1, 3, 3, 4, 6)
    volume = mask(spark, blob).withColumn("v", F.lit(2.0))
    got = V.cropped(volume, spark.createDataFrame([(1, 2, 1, 3)], "vol bigint, sx int, sy int, sz int"), (2, 2, 2))
    assert cells(got) == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0)]
    assert V.padded(volume, (6, 6, 6)).agg(F.count("*"), F.sum("v")).first() == (216, 12.0)


def test_holes_and_packing(spark):
    shell = [c for c in itertools.product(range(1, 4), repeat=3) if c != (2, 2, 2)]
    m = mask(spark, shell)
    assert cells(V.holes(m, V.bounding_boxes(m, "vol"), (6, 6, 6))) == [(2, 2, 2)]
    assert cells(V.unpacked(V.packed(m, V.bounding_boxes(m, "vol"), "vol"), "vol")) == sorted((a - 1, b - 1, c - 1) for a, b, c in shell)


def test_distances(spark):
    rng = random.Random(5)
    grid = list(itertools.product(range(8), repeat=3))
    a, b = rng.sample(grid, 12), rng.sample(grid, 9)
    far = {(r.x, r.y, r.z): r.dm for r in V.distance_map(mask(spark, grid), mask(spark, a), 4).collect()}
    for c in grid:
        d = min(math.dist(c, p) for p in a)
        assert far[c] == (pytest.approx(d) if d <= 4 else None)
    assert V.min_distance(mask(spark, a), mask(spark, b)).first()["d"] == pytest.approx(min(math.dist(p, q) for p in a for q in b))
    assert V.min_distance(mask(spark, a), mask(spark, [])).count() == 0
    grown = {c for c in grid if min(sum(abs(i - j) for i, j in zip(c, p)) for p in a) <= 2}
    assert set(cells(V.dilated(mask(spark, a), 2, (8, 8, 8)))) == grown


def test_flip_and_turn_back(spark):
    m = mask(spark, [(0, 1, 2), (3, 2, 1)])
    assert cells(V.flipped(V.flipped(m, "xz", (4, 4, 4)), "xz", (4, 4, 4))) == cells(m)
    assert cells(V.rotated(m, "xy", 4, (4, 4, 4))) == cells(m)
    assert cells(V.scaled(m, F.lit(2.0))) == sorted({(2 * a + i, 2 * b + j, 2 * c + k) for a, b, c in [(0, 1, 2), (3, 2, 1)] for i, j, k in itertools.product((0, 1), repeat=3)})


def test_validity_codes(spark):
    brain = list(itertools.product(range(10), repeat=3))
    tumour = [(0, 0, 0), (0, 0, 1), (0, 1, 0)]
    shapes = mask(spark, [(0, 0, 0), (1, 0, 0)])
    spots = spark.createDataFrame([(1, i, *p) for i, p in enumerate([(0, 5, 5), (10, 5, 5), (1, 0, 0), (5, 5, 5), (2, 1, 1)])], "vol bigint, place int, px int, py int, pz int")
    placed = S.placed(shapes, spots)
    dm = V.distance_map(mask(spark, brain), mask(spark, tumour), 4)
    codes = {r.place: r.code for r in S.validity(placed, mask(spark, tumour), mask(spark, brain), dm, (10, 10, 10), 0.75, 2.0).collect()}
    assert codes == {0: 1, 1: 2, 2: 3, 3: 0, 4: 5}
    thin = S.validity(placed, mask(spark, tumour), mask(spark, [(9, 9, 9)]), dm, (10, 10, 10), 0.75, 2.0)
    assert {r.place: r.code for r in thin.collect()}[3] == 4
    first = S.first_valid(thin, spark.createDataFrame([(1,), (2,)], "vol bigint"))
    assert {r.vol: (r.place, r.tries) for r in first.collect()} == {1: (None, 5), 2: (None, 0)}


def test_percentile_scales(spark):
    v = spark.createDataFrame([(1, float(i)) for i in [0] * 90 + list(range(1, 11))] + [(2, 0.0)], "vol bigint, v double")
    got = {r[0]: (r[1], r[2]) for r in v.groupBy("vol").agg(G.intensity_scale(F.col("v"), True), G.intensity_scale(F.col("v"), False)).collect()}
    raw = np.array([0.0] * 90 + list(range(1, 11)))
    assert got[1] == (pytest.approx(np.percentile(raw[raw > 0], 99.5)), pytest.approx(np.percentile(raw, 99.5)))
    assert got[2] == (1.0, 1.0)


def test_haar(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((4, 4, 4))
    df = spark.createDataFrame([(1, *map(int, i), float(a[i])) for i in np.ndindex(a.shape)], f"{CELL}, v double")
    bands = G.haar(df)
    assert bands.agg(F.sum(F.col("c") ** 2)).first()[0] == pytest.approx((a**2).sum())
    for r in G.haar_inverse(bands).collect():
        assert r.v == pytest.approx(a[r.x, r.y, r.z])
    flat = G.haar(df.withColumn("v", F.lit(1.0))).filter("band > 0 and abs(c) > 1e-12")
    assert flat.count() == 0


def test_smoothing(spark):
    for n, sigma in ((1, 1.0), (3, 2.0), (40, 1.5)):
        x = np.random.default_rng(n).standard_normal(n)
        w = np.array(G.gaussian_weights(sigma))
        padded = np.pad(x, len(w) // 2, mode="symmetric")
        df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "k string, i bigint, v double")
        got = [r.smooth for r in G.smoothed(df, "k", "i", "v", sigma).orderBy("i").collect()]
        assert got == pytest.approx(np.convolve(padded, w[::-1], mode="valid").tolist())
    assert G.smoothed(df, "k", "i", "v", 0).filter("smooth <> v").count() == 0


def test_resampling(spark):
    df = mask(spark, [(i, 0, 0) for i in range(4)]).withColumn("v", F.col("x").cast("double"))
    up = G.resampled_nearest(df, (4, 1, 1), (6, 1, 1))
    assert [r.v for r in up.orderBy("x").collect()] == [math.floor(i * 4 / 6) for i in range(6)]
    down = G.resampled_nearest(df, (4, 1, 1), (2, 1, 1))
    assert [r.v for r in down.orderBy("x").collect()] == [0.0, 2.0]
    line = spark.createDataFrame([("s", i, float(i * i)) for i in range(5)], "k string, i int, v double")
    got = [r.v for r in G.resampled_linear(line, "k", "i", "v", 5, 9).orderBy("i").collect()]
    assert got == pytest.approx(np.interp(np.linspace(0, 4, 9), range(5), [i * i for i in range(5)]).tolist())


def test_kmeans_and_budget(spark):
    x = [1.0, 1.1, 0.9, 5.0, 5.2, 4.8, 9.0, 9.1]
    assert G.kmeans_1d(spark.createDataFrame([(v,) for v in x], "v double"), "v") == pytest.approx([1.0, 5.0, 9.05])
    assert G.kmeans_1d(spark.createDataFrame([], "v double"), "v") == [0.0] * 3
    sizes = spark.createDataFrame([(1,), (4654,), (18841,), (51128,)], "s int")
    assert [r[0] for r in sizes.select(G.adaptive_budget(F.col("s"), 16)).collect()] == [2, 4, 8, 16]
    assert [r[0] for r in sizes.select(G.adaptive_budget(F.col("s"), 8, 4)).collect()] == [4, 4, 8, 8]


def test_errors_without_cells(spark):
    p = spark.createDataFrame([(1, 1.0, 2.0, True), (1, 5.0, 2.0, False), (2, 1.0, 1.0, False)], "k int, p double, t double, m boolean")
    got = {r.k: (r.l1, r.mse, r.n) for r in G.masked_errors(p, "k", F.col("m")).collect()}
    assert got == {1: (1.0, 1.0, 1), 2: (None, None, 0)}


DONOR = "id bigint, subject bigint, vec array<float>"


def test_shortlist_rerank_merge(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((40, 8)).astype(np.float32)
    v[7] = v[6]
    rows = [(i, i // 2, v[i].tolist()) for i in range(40)] + [(90, 45, None), (91, 45, [0.0] * 8), (92, 45, [1.0])]
    d = spark.createDataFrame(rows, DONOR)
    q = d.filter("id < 4 or id >= 90")
    got = shortlist(q, d, 5, 1, 6)
    x = v[:, :6].astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(4):
        others = [j for j in range(40) if j // 2 != i // 2]
        want = sorted(others, key=lambda j: (-round(float(x[i] @ x[j]), 12), j))[:5]
        assert [r.donor for r in got.filter(F.col("query") == i).orderBy("rank").collect()] == want
    assert got.filter("query >= 90").count() == 0
    ranked = rerank(got, q, d, 2, slice(0, 6))
    assert ranked.groupBy("query").count().filter("count <> 2").count() == 0
    best = ranked.filter("query = 0").orderBy("place").collect()
    assert [r.v for r in merge(ranked).filter("query = 0").orderBy("dim").collect()] == pytest.approx(np.mean([v[r.donor] for r in best], 0).tolist(), abs=1e-6)
    assert shortlist(d.filter("false"), d, 5).count() == 0 and shortlist(q, d.filter("false"), 5).count() == 0
    lone = spark.createDataFrame([(1, 1, [1.0, 2.0])], DONOR)
    assert shortlist(lone, lone, 5).count() == 0


def test_fingerprints(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(32)
    rows = [(0, base.tolist()), (1, (base * 3).tolist()), (2, (base + 7).tolist()), (3, rng.standard_normal(32).tolist()), (4, None)]
    f = spark.createDataFrame(rows, "id bigint, v array<double>").select("id", fingerprint(F.col("v"), 8).alias("f"))
    best = {r.id: r.best for r in similar_to_any(f.filter("id > 0"), f.filter("id = 0"), "f").collect()}
    assert best[1] == pytest.approx(1) and best[2] == pytest.approx(1) and best[3] < 0.99 and best[4] is None
    assert [r.best for r in similar_to_any(f.filter("id = 1"), f.filter("false"), "f").collect()] == [None]
    one = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 9.0],)], "v array<double>")
    assert one.select(block_means(F.col("v"), 2)).first()[0] == [1.5, 3.5]
    steps = one.select(F.lit("g").alias("g"), F.posexplode("v").alias("i", "x"))
    assert G.moving_average(steps, "g", "i", "x", 0.5).first()["ema"] == pytest.approx(6.0625)
    x = np.array([1, 2, 3, 4, 9.0])
    assert one.select(z_score(F.col("v"))).first()[0] == pytest.approx(((x - x.mean()) / (x.std() + 1e-6)).tolist())


def test_global_rank(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "id bigint, v bigint")
    assert all(r["rank"] == r["v"] and r["n"] == 101 for r in global_rank(df, "v", total="n").collect())
    assert global_rank(df.filter("false"), "v").count() == 0


def test_batches(spark):
    items = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "c", -1)], "id bigint, name string, v int")
    assert [r.id for r in B.pending(items, items.filter("id < 3"), "id").collect()] == [3]
    got = {r.id: (r.status, r.reason) for r in B.judged(items, [("null", F.col("v").isNotNull()), ("negative", F.col("v") >= 0)]).collect()}
    assert got == {1: ("ok", None), 2: ("fail", "null"), 3: ("fail", "negative")}
    assert items.select(B.rerooted(F.col("name"), [("a", "x/")])).first()[0] == "x/"


def test_split_has_no_leaks(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(300)], "id bigint, subject bigint")
    s = S.split_in_order(df, "subject", "seed", 10)
    assert s.filter("split = 'val'").count() == 30
    assert s.groupBy("subject").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert S.oversampled([(df, 2), (df.limit(5), 1), (df, 0)]).count() == 605


def test_training_rows(spark):
    volume = mask(spark, [(0, 0, 0), (0, 0, 1), (1, 0, 0)]).withColumn("v", F.col("x") * 10.0 + F.col("z"))
    got = training_rows(volume, mask(spark, [(0, 0, 1)]), volume.withColumn("v", F.lit(3.0))).first()
    assert (got.voided, got.target, got.prior) == ([0.0, 10.0], [1.0], [3.0])
    assert training_rows(volume, mask(spark, [])).count() == 0
