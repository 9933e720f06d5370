"""Problems 1, 2 and 4 against brute force, with dirt, ties and hot groups."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyral.llm import history, overlap, similar
from gyral.llm.vectors import decode, prepare, unit
from gyral.session import shared_dir

DIM = 24
SCHEMA = "id bigint, file string, emb array<float>"


def clustered(n, seed=0, spread=0.35, size=4):
    """Vectors in small clusters around a common template."""
    rng = np.random.default_rng(seed)
    template = rng.standard_normal(DIM)
    heads = rng.standard_normal((n // size + 1, DIM))
    return np.float32([template + heads[i // size] + spread * rng.standard_normal(DIM) for i in range(n)])


def units(vectors):
    v = np.asarray(vectors, np.float64)
    v = v - v.mean(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(r[0], r[1], None if r[2] is None else [float(x) for x in r[2]]) for r in rows], schema)


def brute_neighbours(rows, k, least):
    u = units([r[2] for r in rows])
    s = u @ u.T
    pairs = set()
    for i, r in enumerate(rows):
        others = [j for j, q in enumerate(rows) if j != i and (r[1] is None or q[1] is None or r[1] != q[1])]
        for j in sorted(others, key=lambda j: (-round(s[i, j], 9), rows[j][0]))[:k]:
            if s[i, j] >= least:
                pairs.add((min(r[0], rows[j][0]), max(r[0], rows[j][0])))
    return pairs


def found(spark, rows, k=3, least=0.86):
    got = similar.neighbour_pairs(similar.neighbours(frame(spark, rows), "id", "emb", "file", k, least, DIM))
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_prepare(spark):
    v = clustered(3)
    rows = [(1, "a", v[0]), (2, "a", v[0] * 100 + 7), (3, None, None), (4, "b", []), (5, "b", v[1][:7]), (6, "b", [2.0] * DIM), (7, "c", [*v[1][:-1], float("nan")]), (8, "c", [*v[1][:-1], float("inf")]), (9, "d", v[2])]
    df = frame(spark, rows).withColumn("v2", F.lit("clash"))
    got = {r["id"]: r for r in prepare(df, "emb", DIM).collect()}
    assert set(got) == {1, 2, 9} and got[1]["code"] == got[2]["code"] and got[9]["v2"] == "clash"
    x = unit(decode([got[1]["v"], got[9]["v"]], DIM)).astype(float)
    u = units([v[0], v[2]])
    assert x[0] @ x[1] == pytest.approx(u[0] @ u[1], abs=1e-5)
    assert prepare(frame(spark, []), "emb", DIM).count() == 0


def test_scan_abandons_nothing_that_counts():
    v = units(clustered(400, 3, 0.3)).astype(np.float64) * 30000
    ids, files = np.arange(400), np.zeros(400, np.int64)
    i, j, cos = similar.scan(ids, files, np.rint(v), np.arange(400), np.arange(400), 5, 0.86)
    s = units(v) @ units(v).T
    np.fill_diagonal(s, -1)
    want = {(a, b) for a in range(400) for b in np.argsort(-s[a], kind="stable")[:5] if s[a, b] >= 0.86 + 1e-5}
    assert len(want & set(zip(i.tolist(), j.tolist()))) >= 0.97 * len(want) > 100
    assert cos.min() >= 0.86


def test_neighbours(spark):
    v = clustered(600)
    rows = [(i * 3, f"f{i // 2}" if i % 5 else None, v[i]) for i in range(600)]
    want = brute_neighbours(rows, 3, 0.86)
    got = found(spark, rows)
    assert len(got & want) >= 0.97 * len(want) > 50 and len(got - want) <= 0.03 * len(want)


def test_neighbours_of_few_rows(spark):
    v = clustered(4)
    assert found(spark, []) == set()
    assert found(spark, [(1, "a", v[0])]) == set()
    assert found(spark, [(1, "a", v[0]), (2, "a", v[0])]) == set()
    assert found(spark, [(1, None, v[0]), (2, None, v[0]), (3, "b", None)]) == {(1, 2)}


@pytest.mark.parametrize("one_file", [False, True])
def test_hot_group_of_copies(spark, one_file):
    v = clustered(300, 5)
    rows = [(i, "hot" if one_file and i % 3 == 0 else f"f{i}", v[0] if i % 3 == 0 else v[i]) for i in range(300)]
    got, want = found(spark, rows), brute_neighbours(rows, 3, 0.86)
    assert got == want
    assert len(want) <= 3 * 300


def test_long_lists_in_tiles(spark, monkeypatch):
    """A list above a tile's length: every query still meets every target of the list, once."""
    monkeypatch.setattr(similar, "PART_ROWS", 37)
    v = clustered(180, 8)
    rows = [(i, f"f{i // 2}" if i % 5 else None, v[i]) for i in range(180)]
    assert found(spark, rows) == brute_neighbours(rows, 3, 0.86)


def test_near_copies_keep_their_own_neighbours(spark):
    """A tenth of the rows are near-copies of one row, alike to 0.999 and in one int8 code: each has its own list."""
    rng = np.random.default_rng(12)
    v = clustered(600, 13)
    for i in range(0, 600, 10):
        v[i] = v[0] + 0.003 * rng.standard_normal(DIM)
    rows = [(i, f"f{i}", v[i]) for i in range(600)]
    want, got = brute_neighbours(rows, 3, 0.86), found(spark, rows)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_two_levels_hold_every_row(spark):
    v = clustered(2000, 14)
    prepared = prepare(frame(spark, [(i, None, v[i]) for i in range(2000)]), "emb", DIM)
    lists = similar.fit_two_levels(prepared, 2000, DIM)
    near = lists.nearest(unit(decode([r.v for r in prepared.select("v").collect()], DIM)), 3)
    assert len(lists.lists) == lists.starts[-1] and (near >= 0).all() and near.max() < len(lists.lists)
    assert all(len(set(r)) == 3 for r in near.tolist())


def judged(rows, least=0.98):
    """The rule of problem 2, row by row."""
    rows = sorted((r for r in rows if r[3] is not None), key=lambda r: (r[0], r[1]))
    u = units([r[3] for r in rows])
    kept, out = [], set()
    for i, r in enumerate(rows):
        if any(u[i] @ u[j] >= least or (r[2] is not None and r[2] == rows[j][2]) for j in kept):
            out.add(r[1])
        else:
            kept.append(i)
    return out


BATCH = "batch bigint, id bigint, file string, emb array<float>"


def batches(spark, rows):
    return spark.createDataFrame([(b, i, f, None if e is None else [float(x) for x in e]) for b, i, f, e in rows], BATCH)


def dirty_batches(n=300, seed=1):
    rng = np.random.default_rng(seed)
    v = clustered(n, seed, 0.02, 3)
    rows = [(int(rng.integers(0, 4)), int(i), f"f{rng.integers(0, n)}" if rng.random() < 0.8 else None, v[i]) for i in rng.permutation(n)]
    return rows + [(1, n + 1, "x", None), (2, n + 2, "f1", None)]


def state(spark, name):
    import uuid

    return history.DedupHistory(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", DIM)


def test_history_at_once_and_by_batch(spark):
    rows = dirty_batches()
    want = judged(rows)
    at_once = {r.id for r in state(spark, "once").process(batches(spark, rows)).collect()}
    assert len(want) > 60 and len(at_once ^ want) <= 0.03 * len(want)
    h, by_batch = state(spark, "steps"), set()
    for b in range(4):
        by_batch |= {r.id for r in h.process(batches(spark, [r for r in rows if r[0] == b])).collect()}
    assert len(by_batch ^ want) <= 0.03 * len(want)


def test_history_chain(spark):
    """a ~ b ~ c, but a is unlike c: b goes, c stays; and a file links rows of unlike vectors."""
    u = units(clustered(2, 9))
    a, d = u[0], u[1] - (u[1] @ u[0]) * u[0]
    d /= np.linalg.norm(d)
    turn = lambda t: np.cos(t) * a + np.sin(t) * d
    rows = [(0, 1, "a", turn(0)), (0, 2, "b", turn(0.15)), (1, 3, "c", turn(0.3)), (1, 4, "A", turn(1.5)), (2, 5, "A", turn(2.6))]
    assert judged(rows) == {2, 5}
    assert {r.id for r in state(spark, "chain").process(batches(spark, rows)).collect()} == {2, 5}


@pytest.mark.parametrize("noise", [0.0, 0.004])
def test_history_hot_group(spark, noise):
    rng = np.random.default_rng(2)
    v = clustered(400, 4, 1.0, 1)
    rows = [(i % 3, i, None, v[0] + noise * rng.standard_normal(DIM) if i % 3 == 0 else v[i]) for i in range(400)]
    assert {r.id for r in state(spark, "hot").process(batches(spark, rows)).collect()} == judged(rows)


def test_history_waves(spark, monkeypatch):
    """A bucket far above its heads still gives the exact result, in more waves."""
    monkeypatch.setattr(history, "SMALL", 2)
    monkeypatch.setattr(history, "HEADS", 1)
    rows = dirty_batches(90, 6)
    assert len({r.id for r in state(spark, "waves").process(batches(spark, rows)).collect()} ^ judged(rows)) <= 1


def test_empty_history(spark):
    h = state(spark, "none")
    assert h.process(batches(spark, [])).count() == 0
    assert h.process(batches(spark, [(None, 1, None, clustered(1)[0]), (0, 2, None, None)])).count() == 0
    assert [r.id for r in h.process(batches(spark, [(5, 3, "f", clustered(1)[0])])).collect()] == [3]


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 288, (50, 96)).astype(np.uint16)
    who, key = history.chunks(text, 3)
    assert abs(len(who) / (50 * 94) - 1 / history.BOUNDARY) < 0.05 and len(set(key)) == len(key)
    other = text.copy()
    other[:, 10] ^= 1
    _, key2 = history.chunks(other, 3)
    assert len(set(key) & set(key2)) >= 0.93 * len(set(key))
    assert not set(key) & set(history.chunks(np.roll(text, 1, 1), 3)[1])
    assert len(history.chunks(np.zeros((0, 96), np.uint16), 3)[0]) == 0
    assert len(history.chunks(text[:, :2], 3)[0]) == 0


MANIFEST = "id bigint, split_name string, `case` string"


def crossed(rows, vectors, least=0.98):
    u = units([e for _, e in vectors]) if vectors else np.zeros((0, DIM))
    cases = [c for c, _ in vectors]
    alike = {(a, a) for _, _, a in rows if a} | {(cases[i], cases[j]) for i, j in itertools.product(range(len(cases)), repeat=2) if u[i] @ u[j] >= least}
    return {(min(i, j), max(i, j)) for i, s, a in rows for j, t, b in rows if s in overlap.EVALUATION and t == "train" and i != j and (a, b) in alike}


def test_cross_split(spark):
    rng = np.random.default_rng(3)
    v = clustered(80, 7, 0.01, 4)
    vectors = [(f"c{rng.integers(0, 50)}", v[i]) for i in range(80)]
    splits = ["train", "train", "val", "official_val", None, "other"]
    rows = [(i, splits[rng.integers(0, 6)], f"c{rng.integers(0, 60)}" if i % 9 else None) for i in range(300)]
    vec = spark.createDataFrame([(c, [float(x) for x in e]) for c, e in vectors] + [(None, [1.0] * DIM), ("c1", None)], "`case` string, emb array<float>")
    df = spark.createDataFrame(rows + rows[:20], MANIFEST)
    pairs = overlap.cross_split(df, vec, 0.98, DIM)
    got, want = {(r.a_id, r.b_id) for r in pairs.collect()}, crossed(rows, vectors)
    assert len(got ^ want) <= 0.02 * len(want) and len(want) > 100
    report = overlap.overlap_report(df, vec, 0.98, DIM).collect()
    assert sum(r.n_pairs for r in report) == len(got)
    side = {i for i, s, _ in rows if s in overlap.EVALUATION}
    assert sum(r.n_rows for r in report) == len({x for pair in got for x in pair if x in side})


def test_cross_split_without_sides(spark):
    vec = spark.createDataFrame([("a", [float(x) for x in clustered(1)[0]])], "`case` string, emb array<float>")
    rows = spark.createDataFrame([(1, "train", "a"), (2, "train", "a")], MANIFEST)
    assert overlap.cross_split(rows, vec, 0.98, DIM).count() == 0
    assert overlap.cross_split(rows.filter("false"), vec.filter("false"), 0.98, DIM).count() == 0
    both = rows.union(spark.createDataFrame([(3, "val", "a")], MANIFEST))
    assert {(r.a_id, r.b_id) for r in overlap.cross_split(both, vec.filter("false"), 0.98, DIM).collect()} == {(1, 3), (2, 3)}
