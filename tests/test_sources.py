import numpy as np
from pyspark.sql import functions as F

from gyral.sources import tables as T
from gyral.streaming.events import daily, deduplicated, timed, windowed


def test_id_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\n y \nx\n")
    (tmp_path / "b.txt").write_text("z")
    ids = T.read_ids(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt"))
    assert sorted(r.case_id for r in ids.collect()) == ["x", "x", "y", "z"]
    T.write_ids(ids, str(tmp_path / "out"))
    assert [r.case_id for r in T.read_ids(spark, str(tmp_path / "out")).collect()] == ["x", "y", "z"]


def test_npz_and_discovery(spark, tmp_path):
    (tmp_path / "c1").mkdir()
    np.savez(tmp_path / "c1" / "index.npz", paths=np.array(["p", "q"]), emb=np.arange(6, dtype=np.float32).reshape(2, 3))
    (tmp_path / "c1" / "bad.npz").write_bytes(b"no archive")
    rows = T.read_npz(spark, str(tmp_path), ["paths", "emb"], T.INDEX).collect()
    assert sorted((r.paths, r.emb) for r in rows if r._error is None) == [("p", [0, 1, 2]), ("q", [3, 4, 5])]
    assert sum(r._error is not None for r in rows) == 1
    assert {r.case_id for r in T.found_files(spark, str(tmp_path), "*.npz").collect()} == {"c1"}
    assert T.checksums(spark, str(tmp_path), "*.npz").filter(F.length("sha256") == 64).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "mask"), (2, "t1n")], "id int, kind string")
    T.write_kinds(df, str(tmp_path / "k"))
    assert sorted(p.name for p in (tmp_path / "k").iterdir() if p.is_dir()) == ["kind=mask", "kind=t1n"]
    T.write_metrics(df, str(tmp_path / "m"))
    assert T.read_metrics(spark, str(tmp_path / "m"), "id int, kind string").count() == 2


def test_affines_links_and_overwriting(spark, tmp_path):
    rows = [("a", [float(i) / 7 for i in range(16)]), ("b", None), ("c", [1.0])]
    T.write_affines(spark.createDataFrame(rows, "case_id string, affine array<double>"), str(tmp_path / "affine"))
    assert [(r.case_id, r.affine) for r in T.read_affines(spark, str(tmp_path / "affine")).collect()] == [rows[0]]
    lines = next((tmp_path / "affine" / "case_id=a").glob("part*")).read_text().split("\n")
    assert [len(x.split()) for x in lines[:4]] == [4] * 4
    files = spark.createDataFrame([("/x/y/t1n.nii", "c1"), (None, "c2"), ("/x/z", None)], "path string, name string")
    assert [tuple(r) for r in T.linked(files, "/work/", "s-").collect()] == [("/work/s-c1/t1n.nii", "/x/y/t1n.nii")]
    df = spark.createDataFrame([(1, "mask"), (2, "t1n")], "id int, kind string")
    T.write_kinds(df, str(tmp_path / "k"))
    T.write_kinds(df.filter("id = 1"), str(tmp_path / "k"), overwrite=False)
    assert spark.read.parquet(str(tmp_path / "k")).count() == 2


def test_stream_equals_batch(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = windowed(deduplicated(timed(stream))).writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    run = q.start()
    run.awaitTermination(120)
    got = {(r.start.date(), r.event_type): r.n for r in spark.table("days").collect()}
    want = {(r.day.date(), r.event_type): r.n for r in daily(table).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(want) - len(got) <= 10
