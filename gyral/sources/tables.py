"""Readers and writers of the file forms the data comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX = "paths string, emb array<float>"
MANIFEST = "names string, donor_paths string, donor_scales float"


def read_ids(spark: SparkSession, *paths: str) -> DataFrame:
    """(case_id) of one or more id lists, a line each; blank lines are left out, repeats stay."""
    rows = spark.read.text(list(paths)).select(F.trim("value").alias("case_id"))
    return rows.filter("case_id <> ''")


def write_ids(ids: DataFrame, path: str, column: str = "case_id") -> None:
    """One sorted text file; for id lists, which are small by nature."""
    ids.select(F.col(column).cast("string").alias("value")).distinct().coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(path)


def found_files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, case_id, n_bytes) of the files under root; case_id is the parent folder. No content is read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    return rows.select("path", F.element_at(F.split("path", "/"), -2).alias("case_id"), F.col("length").alias("n_bytes"))


def read_npz(spark: SparkSession, root: str, fields: list[str], schema: str, glob: str = "*.npz") -> DataFrame:
    """Rows of npz archives whose arrays share their first dimension: one column per field, one row per entry.

    schema types the fields; higher dimensions become flat arrays. An unreadable archive gives one row of nulls with
    the error in _error, so that nothing is lost silently. Each archive is one task's work.
    """
    names = [f.name for f in T._parse_datatype_string(schema)]
    assert names == fields, "schema and fields must name the same columns"

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        arrays = [z[f] for f in fields]
                    out = pd.DataFrame({f: list(a.reshape(len(a), -1)) if a.ndim > 1 else a.tolist() for f, a in zip(fields, arrays)})
                    yield out.assign(_path=path, _error=None)
                except Exception as e:  # noqa: BLE001 - whatever is wrong with the archive, it is reported
                    yield pd.DataFrame({f: [None] for f in fields}).assign(_path=path, _error=f"{type(e).__name__}: {e}")

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content").mapInPandas(run, f"{schema}, _path string, _error string")


def write_kinds(rows: DataFrame, path: str, kind: str = "kind", overwrite: bool = True) -> None:
    """One folder per kind of a case's files; without overwrite, what is there stays and nothing is written."""
    rows.write.mode("overwrite" if overwrite else "ignore").partitionBy(kind).parquet(path)


def write_affines(rows: DataFrame, path: str) -> None:
    """rows(case_id, affine array of 16 numbers) as text, a folder per case with four lines of four numbers.

    Null affines and those of another length are left out.
    """
    lines = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array_join(F.transform(F.slice("affine", i * 4 + 1, 4), lambda x: F.format_string("%.18e", x)), " "))
    good = rows.filter(F.size("affine") == 16).select("case_id", F.array_join(lines, "\n").alias("value"))
    good.repartition("case_id").write.mode("overwrite").partitionBy("case_id").text(path)


def read_affines(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, affine) from write_affines()."""
    rows = spark.read.schema("value string, case_id string").text(path, wholetext=True)
    return rows.select("case_id", F.transform(F.regexp_extract_all("value", F.lit(r"\S+"), F.lit(0)), lambda x: x.cast("double")).alias("affine"))


def linked(files: DataFrame, root: str, prefix: str = "") -> DataFrame:
    """files(path, name) -> (link, target): where each file stands under root, by its name; no data is copied.

    The view takes the place of a folder of links: read `target`, speak of `link`. Null names and paths give no rows.
    """
    return files.filter("path is not null and name is not null").select(F.concat(F.lit(f"{root.rstrip('/')}/{prefix}"), "name", F.lit("/"), F.substring_index("path", "/", -1)).alias("link"), F.col("path").alias("target"))


def write_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", "true").csv(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def checksums(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, sha256) of files, to verify what was fetched."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return rows.select("path", F.sha2("content", 256).alias("sha256"))
